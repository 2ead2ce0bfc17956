"""Spelling variants: words one edit apart, found by search schemes on a bidirectional FM-index.

The words of all texts are counted, and those that occur often enough are the vocabulary. Two words one edit apart agree exactly in
the first or in the second half of either word, so each word is dealt to shards by the halves that a neighbour may share, and searched
in the shards of its own two halves. A shard indexes its words, each between delimiters, forwards and backwards. A search matches one
half exactly, then extends over the other with one error; both directions keep the suffix-rank interval of the match, so the search may
turn around at the half. All searches of a shard advance together in numpy.

A half that many words share is dealt to as many shards as its count asks for, so an index stays small whatever the words are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, column, frozen, map_arrow, text_chunks

#: Letters: A-Z, a-z, and U+00C0 to U+00FF, which are the byte C3 and one more.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LEAD = 0xC3
#: Distinct words a task holds before it hands on their counts, and searches that advance together.
HELD_WORDS = 400_000
SEARCHES = 4096


@dataclass(frozen=True)
class Variants:
    """Of every ``slip`` runs of a document one loses a code point. Words have ``length`` code points and ``least`` occurrences. A
    form occurs ``ratio`` times as often as its variant. A shard indexes about ``shard_words`` words."""

    slip: int = 97
    length: int = 5
    least: int = 3
    ratio: int = 2
    shard_words: int = 30_000


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row and lower-cased (A-Z only) text of each maximal run of letters."""
    lead = buf == LEAD
    inside = LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    own = inside[cuts[:-1]] if len(buf) else np.zeros(0, bool)
    starts, ends = cuts[:-1][own], cuts[1:][own]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(LOWER[buf[inside]])))
    return np.searchsorted(offsets, starts, "right") - 1, runs


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


def crc32_after(states: np.ndarray, words: pa.Array, which: np.ndarray, short: int = 64) -> np.ndarray:
    """crc32 of each ``words[which]``, going on from the crc32 ``states`` of what stands before it."""
    table = _crc_table()
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = (at[1:] - at[:-1])[which]
    out = states.astype(np.uint32)
    for k in np.flatnonzero(size > short):
        a = at[which[k]]
        out[k] = zlib.crc32(data[a : a + size[k]].tobytes(), int(states[k]))
    live = np.flatnonzero(size <= short)
    live = live[np.argsort(-size[live], kind="stable")]
    crc, start, left = out[live] ^ np.uint32(0xFFFFFFFF), at[which[live]], size[live]
    for k in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -k, "left"))
        crc[:m] = table[(crc[:m] ^ data[start[:m] + k]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[live] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(v: Variants):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, int] = {}
        for batch in batches:
            texts = column(batch, "text").cast(pa.large_string())
            ids = column(batch, "doc_id").to_pylist()
            for i, _, buf, offsets in text_chunks(texts, CHUNK_BYTES):
                row, runs = letter_runs(buf, offsets)
                coded = runs.dictionary_encode()
                words = coded.dictionary
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pair, times = np.unique(row * max(1, len(words)) + code, return_counts=True)
                doc, code = np.divmod(pair, max(1, len(words)))
                before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids[i : i + len(offsets) - 1]], np.uint32)
                h = crc32_after(before[doc], words, code)
                hit = np.flatnonzero(h % v.slip == 0)
                for k in hit:
                    w = words[code[k]].as_py()
                    p = int(h[k]) % len(w)
                    if len(w) > v.length:
                        w = w[:p] + w[p + 1 :]
                        held[w] = held.get(w, 0) + int(times[k])
                times[hit] = 0
                total = np.zeros(len(words), np.int64)
                np.add.at(total, code, times)
                keep = np.flatnonzero((pc.utf8_length(words).to_numpy(zero_copy_only=False) >= v.length) & (total > 0))
                for w, n in zip(words.take(pa.array(keep)).to_pylist(), total[keep].tolist()):
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS:
                    yield {"word": list(held), "n": list(held.values())}
                    held.clear()
        if held:
            yield {"word": list(held), "n": list(held.values())}

    return run


def vocabulary(docs: DataFrame, v: Variants = Variants()) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough, after the deletions that the hashes of their documents ask for."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(rows, _counted(v), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= v.least)


class Wavelet:
    """Ranks of symbols in a sequence, and the number of smaller symbols in a range, by one bit of the symbol after the other."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.bits = max(1, int(count - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        self.ends: list[int] = []
        row = symbols
        for b in range(self.bits - 1, -1, -1):
            one = (row >> b & 1).astype(bool)
            before = np.zeros(len(row) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            self.ends.append(int(before[-1]))
            row = np.concatenate([row[~one], row[one]])
        start = np.zeros(count, np.int64)
        start[:] = self._down(np.arange(count), np.zeros(count, np.int64), np.zeros(count, np.int64))[0]
        self.start = start

    def _down(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        less = np.zeros(len(lo), np.int64)
        for level, (zeros, end) in enumerate(zip(self.zeros, self.ends)):
            one = (c >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            less += np.where(one, b - a, 0)
            lo, hi = np.where(one, end + lo - a, a), np.where(one, end + hi - b, b)
        return lo, hi, less

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks of ``c`` at both ends, and how many smaller symbols lie between them."""
        a, b, less = self._down(c, lo, hi)
        return a - self.start[c], b - self.start[c], less

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols of each range: number of the range, symbol, ranks at both ends, smaller symbols between them."""
        who, c, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for zeros, end in zip(self.zeros, self.ends):
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            z, o = np.flatnonzero(b > a), np.flatnonzero(hi - b > lo - a)
            who, less = np.concatenate([who[z], who[o]]), np.concatenate([less[z], (less + b - a)[o]])
            c = np.concatenate([c[z] * 2, c[o] * 2 + 1])
            lo, hi = np.concatenate([a[z], (end + lo - a)[o]]), np.concatenate([b[z], (end + hi - b)[o]])
        return who, c, lo - self.start[c], hi - self.start[c], less


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; the last symbol is smaller than all others and stands there alone."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.full(len(rank), -1, np.int64)
        after[:-width] = rank[width:] if width < len(rank) else []
        key = rank * (len(rank) + 1) + after + 1
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(key), np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if rank[order[-1]] == len(rank) - 1:
            return order
        width *= 2


class BidirectionalIndex:
    """FM-indexes of delimited words and of the same text backwards, with intervals kept in step.

    Symbol 0 ends the text, 1 delimits words, letters follow in code-point order. A match is an interval of suffix ranks in the text
    (``lo``) and in the backward text (``back``), both of the same ``size``.
    """

    def __init__(self, words: list[str]):
        flat = np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        self.letters = np.unique(flat[flat != 10])
        self.symbols = len(self.letters) + 2
        body = self.coded(flat)
        text = np.append(body, 0)
        turned = np.append(body[::-1], 0)
        order = suffix_array(text)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))[:-1]]).astype(np.int64)
        self.forward = Wavelet(text[order - 1].astype(np.int64), self.symbols)
        # word that begins after the delimiter of a suffix
        self.word_at = (np.cumsum(text == 1) - 1)[order]
        self.backward = Wavelet(turned[suffix_array(turned) - 1].astype(np.int64), self.symbols)
        self.length = len(text)

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; letters that the index doesn't have are -1."""
        at = np.minimum(np.searchsorted(self.letters, points), max(0, len(self.letters) - 1))
        known = (self.letters[at] == points) if len(self.letters) else np.zeros(len(points), bool)
        return np.where(points == 10, 1, np.where(known, at + 2, -1)).astype(np.int64)

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.length, np.int64)

    def extend(self, left: bool, c, lo, back, size):
        """The intervals with a symbol more on the left or right; a size of 0 is no match."""
        c = np.maximum(c, 0)
        if left:
            a, b, less = self.forward.step(c, lo, lo + size)
            return self.counts[c] + a, back + less, b - a
        a, b, less = self.backward.step(c, back, back + size)
        return lo + less, self.counts[c] + a, b - a

    def spread(self, left: bool, lo, back, size):
        """All extensions: number of the interval, symbol, new interval."""
        if left:
            who, c, a, b, less = self.forward.children(lo, lo + size)
            return who, c, self.counts[c] + a, back[who] + less, b - a
        who, c, a, b, less = self.backward.children(back, back + size)
        return who, c, lo[who] + less, self.counts[c] + a, b - a


def one_edit(index: BidirectionalIndex, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query number, word number) that are exactly one inserted, deleted or replaced code point apart."""
    found = [np.zeros((0, 2), np.int64)]
    for i in range(0, len(queries), SEARCHES):
        part = queries[i : i + SEARCHES]
        sizes = np.array([len(q) for q in part], np.int64)
        table = np.full((len(part), int(sizes.max()) + 2), 1, np.int64)
        coded = index.coded(np.frombuffer("".join(part).encode("utf-32-le"), np.uint32))
        table[:, 1:][np.arange(table.shape[1] - 1)[None, :] < sizes[:, None]] = coded
        for left in (False, True):
            q, w = _scheme(index, table, sizes, left)
            found.append(np.stack([q + i, w], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _scheme(index: BidirectionalIndex, table: np.ndarray, sizes: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Matches one half with its delimiter exactly, walking leftwards, then extends over the other half with one error: to the left
    after the second half, to the right after the first. ``table`` holds the queries between delimiters."""
    half = sizes // 2
    # places of the exact half, walked from its right end: the first half with its delimiter is 0..half, the second half+1..size+1
    at = sizes + 1 if left else half
    stop = half + 1 if left else np.zeros_like(half)
    alive = np.arange(len(sizes))
    lo, back, size = index.whole(len(sizes))
    k = 0
    done = []
    while len(alive):
        c = table[alive, (at - k)[alive]]
        lo, back, size = index.extend(True, c, lo, back, size)
        ok = (size > 0) & (c >= 0)
        alive, lo, back, size = alive[ok], lo[ok], back[ok], size[ok]
        end = (at - k)[alive] == stop[alive]
        done.append((alive[end], lo[end], back[end], size[end]))
        alive, lo, back, size = alive[~end], lo[~end], back[~end], size[~end]
        k += 1
    q, lo, back, size = (np.concatenate(x) for x in zip(*done))
    # ``place`` is the next symbol to match; the last one is the other delimiter, which takes no error
    step = -1 if left else 1
    place = half[q] if left else half[q] + 1
    last = np.zeros(len(q), np.int64) if left else sizes[q] + 1
    off: list[tuple[np.ndarray, ...]] = []
    while len(q):
        own = table[q, place]
        inner = place != last
        off.append((q[inner], place[inner] + step, last[inner], lo[inner], back[inner], size[inner]))  # the word lacks the symbol
        who, c, a, b, n = index.spread(left, lo, back, size)
        letter = c >= 2
        other = letter & inner[who] & (c != own[who])
        off.append((q[who][other], place[who][other] + step, last[who][other], a[other], b[other], n[other]))  # another symbol
        off.append((q[who][letter], place[who][letter], last[who][letter], a[letter], b[letter], n[letter]))  # a symbol more
        same = (c == own[who]) & inner[who]
        q, place, last, lo, back, size = q[who][same], place[who][same] + step, last[who][same], a[same], b[same], n[same]
    q, place, last, lo, back, size = (np.concatenate(x) for x in zip(*off)) if off else [np.zeros(0, np.int64)] * 6
    hits = []
    while len(q):
        c = table[q, place]
        lo, back, size = index.extend(left, c, lo, back, size)
        ok = (size > 0) & (c >= 0)
        end = ok & (place == last)
        hits.append((q[end], index.word_at[lo[end]]))
        go = ok & ~end
        q, place, last, lo, back, size = q[go], place[go] + step, last[go], lo[go], back[go], size[go]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _halves(vocab: DataFrame, deal: bool) -> DataFrame:
    """``side, piece, word, n``: the pieces a word is searched by, or (``deal``) the pieces by which words of its neighbours' lengths
    would search it."""
    size = F.char_length("word")
    lengths = [size - 1, size, size + 1] if deal else [size]
    first = [F.struct(F.lit(0).alias("side"), F.expr("word").substr(F.lit(1), F.floor(n / 2).cast("int")).alias("piece")) for n in lengths]
    second = [F.struct(F.lit(1).alias("side"), F.expr("word").substr((size - F.ceil(n / 2) + 1).cast("int"), F.ceil(n / 2).cast("int")).alias("piece")) for n in lengths]
    return vocab.select("word", "n", F.explode(F.array_distinct(F.array(*first, *second))).alias("p")).select("p.side", "p.piece", "word", "n")


def near_words(vocab: DataFrame, v: Variants = Variants()) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words one edit apart, once."""
    dealt = frozen(_halves(vocab, True), "halves")
    shards = max(1, -(-dealt.count() // v.shard_words))
    heavy = dealt.groupBy("side", "piece").count().filter(F.col("count") > v.shard_words)
    heavy = frozen(heavy.select("side", "piece", F.ceil(F.col("count") / v.shard_words).cast("int").alias("parts")), "heavy-halves")
    parts = F.coalesce("parts", F.lit(1))
    shard = lambda part: F.pmod(F.xxhash64("side", "piece", part), F.lit(shards)).cast("int").alias("shard")
    words = dealt.join(heavy, ["side", "piece"], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts)).select(shard(F.col("part").cast("int")), "word", "n")
    asked = _halves(vocab, False).join(heavy, ["side", "piece"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(shard(F.col("part")), "word", F.lit(None).cast("long").alias("n"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["n"].notna()].drop_duplicates("word")
        queries = rows[rows["n"].isna()]["word"].drop_duplicates().tolist()
        if not len(known) or not queries:
            return pd.DataFrame({"word": pd.Series([], dtype=object), "near": pd.Series([], dtype=object), "near_n": pd.Series([], dtype="int64")})
        words = known["word"].tolist()
        q, w = one_edit(BidirectionalIndex(words), queries)
        return pd.DataFrame({"word": np.array(queries, object)[q], "near": np.array(words, object)[w], "near_n": known["n"].to_numpy("int64")[w]})

    pairs = words.unionByName(asked).groupBy("shard").applyInPandas(search, "word string, near string, near_n long")
    return pairs.repartition("word").distinct()


def grouped(vocab: DataFrame, v: Variants = Variants()) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of a vocabulary."""
    vocab = frozen(vocab.select("word", "n"), "words")
    near = near_words(vocab, v)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    rows = vocab.join(best, "word", "left").withColumn("is_variant", F.coalesce(-F.col("best.minus") >= F.col("n") * v.ratio, F.lit(False)))
    rows = frozen(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_variant"), F.col("best.near")).alias("form"),
            F.when(F.col("is_variant"), -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    return rows.join(roots(rows.filter("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words that have a form. Counts at least double along a chain, so doubling the steps ends after a few rounds."""
    at = frozen(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = frozen(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, v: Variants = Variants()) -> DataFrame:
    """The vocabulary of ``docs`` with the near words, form and root of each word.

    Null texts have no words; a null id counts as an empty one in the hashes that delete code points. Repeated rows count again. Ties
    between forms go to the smaller word in code-point order. An empty table gives an empty table.
    """
    return grouped(vocabulary(docs, v), v)
