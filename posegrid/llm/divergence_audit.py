"""How far the sources of a language differ in their terms: Arrow counts inside tasks, merged shards, exact whole-number divergences.

Inside ``mapInArrow`` texts are lower-cased, split, dictionary-encoded and grouped by Arrow's own kernels, and a task hands on one row
for each group and term it met. Merged counts are dealt by term into columnar shards. A shard holds the counts of its terms for all
sources of a language as a matrix and adds up the divergences of all pairs of sources; only those sums leave it. Terms that neither
source of a pair has share one divergence, which is added by their number, so a shard never sees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, column, frozen, map_arrow, text_chunks

SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
PART = 31_250
COUNTS = "lang string, source string, term string, n long, docs long"
KEYS = ["lang", "source", "term"]
#: Rows of partial counts a task gathers before it merges them, and the merged rows that it hands on; rows in a batch handed on; and
#: numbers in a block of a shard's matrix.
HELD_ROWS = 350_000
SENT_ROWS = 1 << 16
BLOCK_CELLS = 1 << 20


@dataclass(frozen=True)
class Audit:
    """A term counts in a language with ``least_docs`` documents; ``top`` terms are listed for a group. ``shard_rows`` counts go to a
    shard on average, and no shard meets more than twice ``sources`` sources."""

    least_docs: int = 10
    top: int = 10
    shard_rows: int = 200_000
    sources: int = 1024


def merged(tables: list[pa.Table]) -> pa.Table:
    """Counts of equal keys added up."""
    t = pa.concat_tables(tables).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.rename_columns([*KEYS, "n", "docs"] if t.column_names[0] == "lang" else ["n", "docs", *KEYS])


def _coded(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = a.cast(pa.string()).fill_null("").dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def chunk_counts(texts: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Table:
    """Occurrences and documents of each term by group; the empty term marks that a group occurs."""
    (lc, langs), (sc, sources) = _coded(lang), _coded(source)
    group = lc * len(sources) + sc
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATOR)
    row = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = pc.list_flatten(parts).dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.not_equal(terms.dictionary, pa.scalar("", terms.dictionary.type)).to_numpy(zero_copy_only=False)
    real = found[code] if len(code) else np.zeros(0, bool)
    once = pa.table({"row": row[real], "code": code[real], "one": np.ones(int(real.sum()), np.int64)}).group_by(["row", "code"], use_threads=False).aggregate([("one", "sum")])
    t = pa.table({"g": group[once["row"].to_numpy()], "code": once["code"], "n": once["one_sum"]}).group_by(["g", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    seen = np.unique(group)
    g = np.concatenate([t["g"].to_numpy(), seen])
    words = pa.concat_arrays([terms.dictionary.cast(pa.large_string()), pa.array([""], pa.large_string())])
    at = np.concatenate([t["code"].to_numpy(), np.full(len(seen), len(terms.dictionary), np.int64)])
    zeros = np.zeros(len(seen), np.int64)
    n, docs = (np.concatenate([t[c].to_numpy().astype(np.int64), zeros]) for c in ("n_sum", "n_count"))
    return pa.table({"lang": langs.take(g // len(sources)), "source": sources.take(g % len(sources)), "term": words.take(at), "n": n, "docs": docs})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    held: list[pa.Table] = []
    rows, merged_rows = 0, 0

    def out(t: pa.Table) -> Iterator[dict]:
        for part in t.combine_chunks().to_batches(max_chunksize=SENT_ROWS):
            yield {c: part.column(c) for c in part.schema.names}

    for batch in batches:
        texts = column(batch, "text").cast(pa.large_string()).fill_null("")
        for i, j, _, _ in text_chunks(texts, CHUNK_BYTES):
            held.append(chunk_counts(texts.slice(i, j - i), column(batch, "lang").slice(i, j - i), column(batch, "source").slice(i, j - i)))
            rows += held[-1].num_rows
            # asked after each chunk, as a batch may have many
            if rows > merged_rows + HELD_ROWS:
                held = [merged(held)]
                rows = merged_rows = held[0].num_rows
                if merged_rows > HELD_ROWS:
                    yield from out(held[0])
                    held, rows, merged_rows = [], 0, 0
                    pa.default_memory_pool().release_unused()
    if held:
        yield from out(merged(held))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``; each group that occurs has a row of the empty term."""
    rows = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in ("text", "lang", "source")))
    part = map_arrow(rows, _counted, COUNTS)
    return part.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms)) without passing 64 bits: the factor is divided out in two steps."""
    d = total + 2 * terms
    first = (n + 2) * (SCALE // PART)
    return F.call_function("div", first, d) * PART + F.call_function("div", F.pmod(first, d) * PART, d) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    d = total + 2 * terms
    first = (n + 2) * (SCALE // PART)
    return first // d * PART + first % d * PART // d + 1


def shard_sums(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the divergences of all pairs of sources over the terms of a shard. ``groups`` lists the sources in question."""
    at = np.argsort(groups["at"].to_numpy(), kind="stable")
    ids, totals = groups["at"].to_numpy()[at], groups["total"].to_numpy()[at].astype(np.int64)
    left, right = (np.flatnonzero(ids // groups["sources"][0].as_py() == groups[c][0].as_py()) for c in ("low", "high"))
    terms = cells["term"].combine_chunks().dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(code, kind="stable")
    code, who, n = code[order], np.searchsorted(ids, cells["place"].to_numpy())[order], cells["n"].to_numpy()[order].astype(np.int64)
    sums = np.zeros((len(left), len(right)), np.int64)
    step = max(1, BLOCK_CELLS // len(ids))
    for lo in range(0, len(terms.dictionary), step):
        a, b = np.searchsorted(code, [lo, lo + step])
        m = np.zeros((len(ids), min(step, len(terms.dictionary) - lo)), np.int64)
        m[who[a:b], code[a:b] - lo] = n[a:b]
        p = shares(m, totals[:, None], groups["terms"][0].as_py())
        for i, x in enumerate(left):
            q = p[right[right > x]]
            sums[i, right > x] += ((p[x] - q) ** 2 // (p[x] + q)).sum(axis=1)
    i, j = np.nonzero(ids[left][:, None] < ids[right][None, :])
    k = len(i)
    seen = np.full(k, len(terms.dictionary), np.int64)
    return pa.table({"lang": pa.array([groups["lang"][0].as_py()] * k, pa.string()), "a": ids[left][i], "b": ids[right][j], "value": sums[i, j], "seen": seen})


def audited(docs: DataFrame, a: Audit = Audit()) -> DataFrame:
    """``lang, source, part, item, value, rank``. Part ``pair``: each other source of the language and the divergence from it; part
    ``term``: the terms a source uses more than its language, at most ``top``.

    Null text, language and source are empty strings; every row is a document. Ties go to the smaller item in UTF-8 order. A language
    without kept terms has pairs of value 0 and no terms, a language of one source has no pairs, an empty table gives an empty table.
    """
    counts = frozen(term_counts(docs), "term-counts")
    real = counts.filter("term <> ''")
    kept = real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= a.least_docs).drop("docs")
    cells = frozen(real.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "term-cells")
    used = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(used, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = frozen(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "sources")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    own, whole = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = cells.join(groups, ["lang", "source"]).withColumn("p", own).withColumn("q", whole).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= a.top)

    x, y = (groups.select("lang", *(F.col(c).alias(f"{s}_{c}") for c in ("source", "at", "total")), *(["terms"] if s == "x" else [])) for s in "xy")
    empty = gap(share(F.lit(0), F.col("x_total"), F.col("terms")), share(F.lit(0), F.col("y_total"), F.col("terms")))
    pairs = x.join(y, "lang").filter("x_at <> y_at").withColumn("a", F.least("x_at", "y_at")).withColumn("b", F.greatest("x_at", "y_at"))
    pairs = pairs.join(pair_sums(cells, groups, a), ["lang", "a", "b"], "left")
    value = F.when(F.col("terms") > 0, F.coalesce("value", F.lit(0)) + (F.col("terms") - F.coalesce("seen", F.lit(0))) * empty).otherwise(0)
    pairs = pairs.select("lang", F.col("x_source").alias("source"), F.lit("pair").alias("part"), F.col("y_source").alias("item"), value.cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(over)


def pair_sums(cells: DataFrame, groups: DataFrame, a: Audit) -> DataFrame:
    """``lang, a, b, value, seen``: divergence of two sources over the ``seen`` terms that any source of their blocks has."""
    shards = max(1, -(-cells.count() // a.shard_rows))
    blocks = groups.withColumn("last", F.max("at").over(Window.partitionBy("lang")))
    # a source meets every block of sources of its language; few sources make one block
    blocks = blocks.withColumn("own", F.expr(f"at div {a.sources}")).withColumn("other", F.explode(F.expr(f"sequence(0L, last div {a.sources})")))
    blocks = blocks.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    key = ["lang", "shard", "low", "high"]
    left = cells.join(blocks.select("lang", "source", "at", "low", "high"), ["lang", "source"]).withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    left = left.select(*(F.col(c).alias(f"c_{c}") for c in key), F.col("at").alias("place"), "term", "n")
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("sources", F.lit(a.sources))
    right = right.filter("terms > 0").select("lang", "shard", "low", "high", "at", "total", "terms", "sources")

    def sums(cells: pa.Table, groups: pa.Table) -> pa.Table:
        return shard_sums(cells, groups)

    out = left.groupBy(*(f"c_{c}" for c in key)).cogroup(right.groupBy(*key)).applyInArrow(sums, "lang string, a long, b long, value long, seen long")
    return out.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
