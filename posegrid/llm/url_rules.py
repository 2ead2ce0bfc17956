"""URL rules as one bit-parallel automaton.

Glob rules are laid side by side in a bit vector of several machine words. For a byte c, ``step[c]`` has the positions that consume c
and ``stay[c]`` the stars that admit it; one shift, two ands and an or move all rules at once over the next byte of all URLs of a
batch. ``*`` matches inside a host (no ``/``), ``**`` matches anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow


@dataclass(frozen=True)
class Rule:
    """``name`` is what a match reports; globs are matched against host and path, written one after the other."""

    name: str
    verdict: str
    globs: tuple[str, ...]


def prefix_rule(verdict: str, prefix: str) -> Rule:
    """A host with all its subdomains, and the start of a path: ``example.org/es/``."""
    return Rule(prefix, verdict, (f"{prefix}**", f"*.{prefix}**"))


# The rules of the contract.
RULES = (
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
)
#: What decides where no rule fits: hosts and paths of advertising and tracking, and things that are no pages.
GENERAL = (
    Rule("advertising", "block", ("ads.*/**", "ad.*/**", "*.doubleclick.net/**", "**/ads/**", "**/adserver/**")),
    Rule("tracking", "block", ("tracker.*/**", "track.*/**", "pixel.*/**", "**/pixel.gif**")),
    Rule("media", "block", ("**.jpg", "**.png", "**.gif", "**.mp4", "**.zip", "**.exe")),
)


class Automaton:
    """Multiword masks of some globs. ``end`` names the bit that a match of a glob leaves set."""

    def __init__(self, globs: list[str]):
        atoms: list[tuple[int, str]] = []  # (byte, the star in front of it)
        self.start, self.end, ends_open = [], [], []
        for g in globs:
            self.start.append(len(atoms))
            star, raw, i = "", g.encode(), 0
            # bit k of a glob: its first k bytes are matched; so a glob of n bytes has n + 1 bits
            cells: list[tuple[int | None, str]] = [(None, "")]
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    star, i = "**", i + 2
                elif raw[i : i + 1] == b"*":
                    star, i = star or "*", i + 1
                else:
                    cells[-1] = (cells[-1][0], star)
                    cells.append((raw[i], ""))
                    star, i = "", i + 1
            cells[-1] = (cells[-1][0], star)
            ends_open.append(star)
            atoms += cells
            self.end.append(len(atoms) - 1)
        self.words = max(1, -(-len(atoms) // 64))
        step, stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for k, (byte, star) in enumerate(atoms):
            w, bit = k // 64, np.uint64(1) << np.uint64(k % 64)
            if byte is not None:
                step[byte, w] |= bit
            if star:
                stay[:, w] |= bit
                if star == "*":
                    stay[ord("/"), w] &= ~bit
        self.step, self.stay = step, stay
        self.first = np.zeros(self.words, np.uint64)
        for k in self.start:
            self.first[k // 64] |= np.uint64(1) << np.uint64(k % 64)

    def matches(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x globs: which globs match each whole row."""
        n = np.diff(offsets)
        order = np.argsort(-n, kind="stable")
        state = np.tile(self.first, (len(n), 1))
        at, live = offsets[:-1][order], n[order]
        for k in range(int(live[0]) if len(live) else 0):
            m = int(np.searchsorted(-live, -k, "left"))  # rows longer than k come first
            c = buf[at[:m] + k]
            d = state[:m]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:m] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.empty((len(n), len(self.end)), bool)
        for g, k in enumerate(self.end):
            out[order, g] = (state[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) > 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, general: tuple[Rule, ...] = GENERAL, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, general, verdict of each row.

    Of the rules that match, the one with the longest name decides (of equally long ones the first by name); else a general rule; else
    a url without a host is blocked and any other allowed. Null urls have an empty host and path.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    globs = [(r, g) for r in [*ordered, *general] for g in r.globs]
    auto, own = Automaton([g for _, g in globs]), len(ordered)
    of = np.array([[*ordered, *general].index(r) for r, _ in globs])
    every = [*ordered, *general]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = column(batch, "canonical")
            rule, other, verdict = [], [], []
            hosts = column(batch, "host").to_pylist()
            for lo in range(0, batch.num_rows, 4096):
                part = texts[lo : lo + 4096].to_pylist()
                raw = [t.encode() for t in part]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
                hit = auto.matches(np.frombuffer(b"".join(raw), np.uint8), offsets)
                found = np.full((len(raw), 2), len(every))
                for g in range(len(globs) - 1, -1, -1):
                    found[hit[:, g], int(of[g] >= own)] = of[g]
                for (a, b), host in zip(found.tolist(), hosts[lo : lo + 4096], strict=True):
                    rule.append(every[a].name if a < len(every) else None)
                    other.append(every[b].name if b < len(every) else None)
                    verdict.append(every[a].verdict if a < len(every) else every[b].verdict if b < len(every) else "allow" if host else "block")
            yield {"id": column(batch, "id"), "host": column(batch, "host"), "path": column(batch, "path"), "rule": rule, "general": other, "verdict": verdict}

    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("canonical", F.concat("host", "path"))
    return map_arrow(rows, run, "id long, host string, path string, rule string, general string, verdict string").withColumnRenamed("id", id_col)
