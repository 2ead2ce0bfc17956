"""Secrets in texts: fixed patterns, and entropy of sliding windows over candidate strings.

A candidate is a maximal run of characters that keys are written in. Windows slide over it with counts updated by the character that
enters and the one that leaves, so the Shannon entropy of each window costs the same whatever its width. The class of a candidate
(digits and a-f, letters and digits, or with the other key characters; letters of one case and digits) sets width and bits. The
allow-list takes out the parts of a candidate that it names, and what is left is looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_spans, column, map_arrow, map_rows, text_chunks

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns of the contract, on UTF-8 bytes; their letters are ASCII only.
ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Byte classes of ``class_spans``.
HEX = np.zeros(256, np.uint8)
HEX[list(b"0123456789abcdef")] = 1
KEY = np.zeros(256, np.uint8)
KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = 1


@dataclass(frozen=True)
class Entropy:
    """Window width and least bits by class: hex digits, letters with digits, all key characters, letters of one case with digits,
    letters of both cases. A placeholder's word excuses the windows that it is in, in part at least."""

    shortest: int = 20
    width: tuple[int, int, int, int, int] = (24, 20, 20, 20, 32)
    bits: tuple[float, float, float, float, float] = (3.1, 3.6, 3.7, 3.6, 4.35)


#: What looks random and is no secret: words of placeholders in a window, and spans of plain numbers.
PLACEHOLDER = re.compile(rb"(?i)example|sample|placeholder|changeme|your[-_]?(api|key|token|secret)|dummy|redacted|xxxx|lorem|abcdefgh|01234567")
NUMBERS = re.compile(rb"^[0-9+=_-]+$")
ALLOWED = (PLACEHOLDER, NUMBERS)
#: Parts taken out of a candidate: digests that name their algorithm, as long as its digests are, and UUIDs.
_DIGESTS = "|".join(f"{name}[-=_](?:[0-9a-f]{{{size * 2}}}|[a-z0-9+/_-]{{1,{-(-size * 4 // 3)}}}={{0,2}})" for name, size in (("md5", 16), ("sha1", 20), ("sha224", 28), ("sha256", 32), ("sha384", 48), ("sha512", 64)))
NAMED = re.compile(rf"(?i)(?<![a-z0-9])(?:{_DIGESTS}|[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}(?![a-z0-9]))".encode())
#: A key that documentation uses as its example.
SHOWN = re.compile(rb"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")
#: A segment of a path that reads as words and numbers.
_WORD = rb"(?:[a-z]*(?:[A-Z][a-z]+)*|[A-Z]+)[0-9]*"
WORDS = re.compile(rb"(?:" + _WORD + rb"[-_=+])*" + _WORD)
SEGMENT = re.compile(rb"[^/]+")
ALNUM = re.compile(rb"[A-Za-z0-9]+")


def _pieces(s: bytes) -> list[tuple[int, int]]:
    """What is left of a candidate without named digests, UUIDs, and the segments of paths that read as words."""
    out = [m.span() for p in (NAMED, SHOWN) for m in p.finditer(s)]
    if b"/" in s:
        out += [m.span() for m in SEGMENT.finditer(s) if WORDS.fullmatch(m[0])]
    pieces, end = [], 0
    for a, b in sorted(out):
        if a > end:
            pieces.append((end, a))
        end = max(end, b)
    return pieces + [(end, len(s))]


def _classes(s: bytes, e: Entropy) -> Iterator[tuple[int, int, int]]:
    """Start, end and class of what is looked at in a piece; words, names in capitals, slugs and numbers are not."""

    def holds(x: bytes) -> tuple[bool, bool, bool, bool]:
        lower, upper, digit = (any(lo <= c <= hi for c in x) for lo, hi in ((97, 122), (65, 90), (48, 57)))
        return lower, upper, digit, all(c in b"0123456789abcdefABCDEF" for c in x)

    lower, upper, digit, hexadecimal = holds(s)
    if digit and lower and upper and not hexadecimal:
        yield 0, len(s), 1 if s.isalnum() else 2
    for m in ALNUM.finditer(s):  # a key of one case has no other class, whatever it is joined to
        if len(m[0]) >= e.shortest:
            lower, upper, digit, hexadecimal = holds(m[0])
            if digit and (lower or upper) and (hexadecimal or not (lower and upper) and not WORDS.fullmatch(m[0])):
                yield *m.span(), 0 if hexadecimal else 3
            elif lower and upper and not digit and len(m[0]) >= e.width[4] and not WORDS.fullmatch(m[0]):
                yield *m.span(), 4


def _windows(s: bytes, w: int, bits: float) -> Iterator[int]:
    """Starts of the windows that reach the bits."""
    clog = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    counts, total = [0] * 256, 0.0
    for i, c in enumerate(s):
        total += clog[counts[c] + 1] - clog[counts[c]]
        counts[c] += 1
        if i >= w:
            d = s[i - w]
            total += clog[counts[d] - 1] - clog[counts[d]]
            counts[d] -= 1
        if i >= w - 1 and math.log2(w) - total / w >= bits:
            yield i - w + 1


def window_spans(s: bytes, e: Entropy = Entropy()) -> list[tuple[int, int]]:
    """Merged windows of a candidate that reach the bits of their class."""
    if len(s) < e.shortest:
        return []
    excused = [m.span() for m in PLACEHOLDER.finditer(s)]
    found, out = [], []
    for a, b in _pieces(s):
        if b - a < e.shortest:
            continue
        for x, y, kind in _classes(s[a:b], e):
            w, k = min(y - x, e.width[kind]), 0
            for i in _windows(s[a + x : a + y], w, e.bits[kind]):
                i += a + x
                while k < len(excused) and excused[k][1] <= i:
                    k += 1
                if k == len(excused) or i + w <= excused[k][0]:
                    found.append((i, i + w))
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if not NUMBERS.search(s[a:b])]


def scan(texts: pa.Array, e: Entropy = Entropy()) -> Iterator[list[tuple[str, int, int]]]:
    """For each text its spans (kind, start, end) in code points, by start and then by kind in the order of KINDS."""
    for i, j, buf, offsets in text_chunks(texts):
        raw = buf.tobytes()
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(i, j)]
        for kind, (mask, least) in ((2, (HEX, 32)), (3, (KEY, e.shortest))):
            s, t = class_spans(buf, offsets, mask)
            long = t - s >= least
            for a, b, row in zip(s[long].tolist(), t[long].tolist(), (np.searchsorted(offsets, s[long], "right") - 1).tolist(), strict=True):
                spans = [(0, b - a)] if kind == 2 else window_spans(raw[a:b], e)
                found[row] += [(a + x, a + y, kind) for x, y in spans]
        lowered = raw.lower()
        cuts = offsets.tolist()
        for row in range(j - i):
            lo, hi = cuts[row], cuts[row + 1]
            if any(lowered.find(w, lo, hi) >= 0 for w in ASSIGN_WORDS):
                found[row] += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw, lo, hi) if m.end(2) - m.start(2) >= 8]
            if raw.find(b"AKIA", lo, hi) >= 0:
                found[row] += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw, lo, hi) if m.end() - m.start() >= 16]
        for row, spans in enumerate(found):
            if not spans:
                yield []
                continue
            lo, hi = cuts[row], cuts[row + 1]
            points = np.concatenate([[0], np.cumsum((buf[lo:hi] & 0xC0) != 0x80)])
            yield [(KINDS[k], int(points[a - lo]), int(points[b - lo])) for a, b, k in sorted(spans, key=lambda x: (x[0], x[2]))]


def scanned(docs: DataFrame, e: Entropy = Entropy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts by base kind, base_sha256 and spans (``kind:start:end``, comma-joined). Null texts are empty, empty ones have no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")}
            for spans in scan(column(batch, "text"), e):
                kinds = [k for k, _, _ in spans]
                for k in KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{s}:{t}" for k, s, t in spans if k != "entropy").encode()).hexdigest())
                out["spans"].append(",".join(f"{k}:{s}:{t}" for k, s, t in spans))
            yield out | {"id": column(batch, "id")}

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(plain, run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long").withColumnRenamed("id", id_col)


def masked(docs: DataFrame, e: Entropy = Entropy(), mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The rows with every span of a text, overlapping ones merged, replaced by ``mark``; texts without secrets, nulls and all other
    columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, text)
            out = texts.to_pylist()
            for n, spans in enumerate(scan(texts, e)):
                if spans:
                    t, end, parts = out[n], 0, []
                    for _, a, b in sorted(spans, key=lambda x: x[1:]):
                        if a >= end:
                            parts += [t[end:a], mark]
                        end = max(end, b)
                    out[n] = "".join(parts) + t[end:]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(out, texts.type) if n == text else column(batch, n) for n in names], names=names)

    return map_rows(docs, run, text_col)
