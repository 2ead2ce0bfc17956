"""Vector best-fit packing of token sequences.

Which pieces share a sequence depends on their lengths alone, so the packing is made over the histogram of lengths, which has at most
as many rows as a sequence has tokens, and is the same for a thousand and for a trillion pieces. From long to short, the pieces of a
length go together to the open bins that fit best: a bin has residual tokens, residual documents and residual attention cost (sum of
squared lengths), no constraint may be passed, and the fitting bin with the smallest weighted residual norm (or largest weighted dot
product) wins. Equal bins are one entry with a count. The runs of equal bins then place the pieces: the k-th piece of a length goes to
the k-th slot of that length, and k comes from counters kept by each task plus sums over the tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, frozen, map_arrow


@dataclass(frozen=True)
class Bin:
    """Capacities of a sequence and the weights of its three residuals. ``documents`` and ``attention`` default to what ``tokens``
    allows at most: as many pieces as tokens, one piece of full length."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    score: str = "norm"

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


def best_fit(lengths: list[int], counts: list[int], b: Bin) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, one past the last rank, sequence of the first rank, offset) for ``counts`` pieces of each length.

    Raises if a single piece passes a capacity.
    """
    cap, w = b.capacity, np.array(b.weights)
    # an entry stands for equal bins with consecutive sequence numbers
    room = np.zeros((1024, 3))
    first, many = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    used, opened, slots = 0, 0, []

    def entry(r: np.ndarray, at: int, n: int) -> None:
        nonlocal room, first, many, used
        if used == len(first):
            keep = np.flatnonzero((many[:used] > 0) & (room[:used, 0] > 0))
            if len(keep) > used // 2:
                room, first, many = (np.concatenate([x, np.zeros_like(x)]) for x in (room, first, many))
            else:
                room[: len(keep)], first[: len(keep)], many[: len(keep)] = room[keep], first[keep], many[keep]
                many[len(keep) : used] = 0
                used = len(keep)
        room[used], first[used], many[used] = r, at, n
        used += 1

    for length, count in sorted(zip(lengths, counts, strict=True), reverse=True):
        item = np.array([length, 1, length * length], np.float64)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens passes the capacity {b}")
        rank = 0
        while rank < count:
            left = room[:used] - item
            fits = np.flatnonzero((many[:used] > 0) & (left >= 0).all(axis=1))
            if len(fits):
                share = left[fits] / cap
                cost = (w * share * share).sum(axis=1) if b.score == "norm" else -(w * (item / cap) * (1 - share)).sum(axis=1)
                e = int(fits[np.argmin(cost)])
                r, start, n = room[e].copy(), int(first[e]), int(min(many[e], count - rank))
                first[e] += n
                many[e] -= n
            else:
                # how many of this length one new bin holds; full bins first, then one for the rest
                each = int(min(cap // item))
                r, start, n = cap.copy(), opened, max(1, (count - rank) // each)
                opened += n
            slots.append((length, rank, rank + n, start, int(cap[0] - r[0])))
            rank += n
            entry(r - item, start, n)
    return slots


#: Words of one tokenizer, by the path of its file: a worker outlives the query it was started for.
_TABLES: dict[str, dict[bytes, bytes]] = {}
#: Distinct words a worker remembers; beyond that it starts afresh.
WORDS_KEPT = 900_000
#: Letters (after ASCII lower-casing; A-Z elsewhere in Latin-1 and Latin Extended-A, without the one that lower-cases to two) and signs
#: after them. For the tokenizer the letters are one unit and the signs another, whatever stands around.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+)([!-/:-@\[-`{-~]*)")


def word_table(tables: dict[str, dict], path: str) -> dict:
    """The table of a tokenizer; those of other tokenizers go."""
    for other in [p for p in tables if p != path]:
        del tables[other]
    return tables.setdefault(path, {})


#: Texts that tell whether words can be encoded one by one in lower case.
PROBES = ("Hello Big  World", "a,b\tC.d\n e'S 12x ", "É Straße naïve", "x\x0by\rz")


def ends_words(model) -> bool:
    """Whether a tokenizer lower-cases, and ends words at white space with tokens of their own, as the table of words asks for."""
    ids = lambda t: model.encode(t, add_special_tokens=False).ids
    whole = all(ids(t) == [i for w in t.encode().lower().split() for i in ids(w.decode())] for t in PROBES)
    return whole and any(t.endswith("</w>") for t in model.get_vocab())


def _encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    ends = np.zeros(model.get_vocab_size() + 1, bool)
    ends[[i for t, i in model.get_vocab().items() if t.endswith("</w>")]] = True
    four, merge = [i.to_bytes(4, "little") for i in range(len(ends))], model.model.tokenize

    def plain(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    if not ends_words(model):
        return lambda texts: iter(plain([(t or b"").decode() for t in texts]))
    known_words = word_table(_TABLES, path)

    def learn(words: set[bytes]) -> None:
        simple, odd, split = [], [], []
        for w in words:
            if not (m := PLAIN.fullmatch(w)):
                odd.append(w)
            elif m[2]:
                split.append((w, m[1], m[2]))
            else:
                simple.append(w)
        # a set minus the table's keys would walk the whole table, so each part is looked up
        simple += {x for _, x, _ in split if x not in known_words and x not in words}
        odd += {x for _, _, x in split if x not in known_words and x not in words}
        ascii_words = [w for w in simple if w.isascii()]
        for w in ascii_words:  # no normalizer changes these, so the model itself takes them
            known_words[w] = b"".join([four[t.id] for t in merge(w.decode())])
        simple = [w for w in simple if not w.isascii()]
        parts = [simple[i : i + 64] for i in range(0, len(simple), 64)]
        for i in range(0, len(parts), 64):
            some = parts[i : i + 64]
            for part, raw in zip(some, plain([b" ".join(p).decode() for p in some]), strict=True):
                # plain words in one string: each ends with the token that ends a word
                last = np.flatnonzero(ends[np.frombuffer(raw, "<u4")])
                if len(last) != len(part):
                    odd += part
                    continue
                at = 0
                for w, end in zip(part, (last * 4 + 4).tolist(), strict=True):
                    known_words[w] = raw[at:end]
                    at = end
        for i in range(0, len(odd), 5000):
            part = odd[i : i + 5000]
            known_words.update(zip(part, plain([w.decode() for w in part]), strict=True))
        known_words.update({w: known_words[x] + known_words[y] for w, x, y in split})

    def encode(texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text, little-endian. White space ends a word for this tokenizer, so each distinct word is encoded once; strings of
        special tokens keep their case and their neighbours."""
        if len(known_words) > WORDS_KEPT:
            known_words.clear()
        split = [None if t and b"<|" in t else (t or b"").lower().split() for t in texts]
        known = [list(map(known_words.get, words or ())) for words in split]
        holes = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in known]
        learn({words[i] for words, at in zip(split, holes, strict=True) for i in at})
        for t, words, ids, at in zip(texts, split, known, holes, strict=True):
            for i in at:
                ids[i] = known_words[words[i]]
            yield plain([t.decode()])[0] if words is None else b"".join(ids)

    return encode


def pieces(docs: DataFrame, tokenizer: str, b: Bin = Bin(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with block and rank (the piece's number among those of its length in its block).

    Null texts are empty; every document ends with ``end_id``, so none is without a piece. ``with_ids`` adds the ids themselves.
    """
    size = b.tokens * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode, seen, block = _encoder(tokenizer), np.zeros(b.tokens + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids]
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary())
            for lo in range(0, batch.num_rows, 256):
                out: dict[str, list] = {n: [] for n in names}
                for doc, ids in zip(column(batch, "id")[lo : lo + 256].to_pylist(), encode(texts[lo : lo + 256].to_pylist()), strict=True):
                    ids += end
                    for k in range(0, len(ids), size):
                        part = ids[k : k + size]
                        n = len(part) // 4
                        for name, v in zip(names, (doc, k // size, k // 4, n, zlib.crc32(part), int(seen[n]), part), strict=False):
                            out[name].append(v)
                        seen[n] += 1
                yield out | {"block": [block] * len(out["piece"])}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, block int" + ", ids binary" * with_ids
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, schema)


def pack(rows: DataFrame, b: Bin = Bin()) -> DataFrame:
    """Adds sequence_id and offset to written ``pieces``. Empty input: no rows. The plan of slots has rows by length, not by piece."""
    spark = rows.sparkSession
    counts = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    base = counts.select("length", "block", earlier.alias("before"))
    histogram = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most b.tokens rows
    slots = np.array(best_fit([r["length"] for r in histogram], [r["n"] for r in histogram], b), np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    shared = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        s = shared.value
        for batch in batches:
            length, rank = (column(batch, c).to_numpy() for c in ("length", "n"))
            # slots are ordered by length and first rank
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                lo, hi = np.searchsorted(s[:, 0], [x, x + 1])
                rows = length == x
                at[rows] = lo + np.searchsorted(s[lo:hi, 1], rank[rows], "right") - 1
            yield {c: column(batch, c) for c in keep} | {"sequence_id": s[at, 3] + rank - s[at, 1], "offset": s[at, 4]}

    keep = [c for c in rows.columns if c not in ("rank", "block")]
    numbered = rows.join(base, ["length", "block"]).select(*keep, (F.col("before") + F.col("rank")).alias("n"))
    kinds = dict(rows.dtypes)
    return map_arrow(numbered, place, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, b: Bin = Bin(), **how) -> DataFrame:
    """Every piece of every document with its place: no sequence passes a capacity, offsets are gapless from 0."""
    return pack(frozen(pieces(docs, tokenizer, b, **how), "pieces"), b)
