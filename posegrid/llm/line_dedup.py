"""Duplicate lines across documents, in DataFrame functions only: first occurrences stay, keep bitmaps are the result.

Every line gets a 96-bit hash of its key. The hashes are range-partitioned and sorted by hash, document and position, so that one pass
streams over each key and meets its first occurrence first. Lines of later documents clear a bit; the bits of a document are collected
in words of 64 lines, and words without a cleared bit are left out, which is the compressed keep bitmap. Texts are only touched again
where bitmaps are applied to them.

A key that makes up more than its share of all lines is found with a bounded sketch. Its first document is one small aggregation with
partial minima, and its lines are decided where they are stored: they never meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen

#: The characters that are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters outside ASCII that a full lower-casing could change; unassigned ones belong to a newer Unicode.
OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^\x00-\x7F]]"
WORD_BITS = 64


@dataclass(frozen=True)
class LineRule:
    """Keys of fewer than ``least`` code points are never duplicates. ``tracked`` bounds the sketch of frequent keys, ``hot_rows`` the
    lines that any key may bring into one task whatever its share."""

    least: int = 10
    tracked: int = 100_000
    hot_rows: int = 10_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the full lower-casing is far faster and used where it does the same."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(OTHER_CAPITALS)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``version`` (tells texts of a repeated id apart), ``text`` and ``row``, the whole input row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("version"), text.alias("text")
    )


def hashed_lines(docs: DataFrame, r: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``h1, h2, id, version, pos`` of each line whose key is long enough."""
    lines = _given(docs, id_col, text_col).select("id", "version", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).filter(F.char_length("key") >= r.least)
    return lines.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "id", "version", "pos")


def frequent_keys(lines: DataFrame, r: LineRule) -> DataFrame | None:
    """``h1, h2, first`` of the keys with more than half a task's share of all lines: at most twice as many as there are tasks."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(r.hot_rows, lines.count() // (2 * tasks))
    top = lines.agg(F.expr(f"approx_top_k(h1, {min(2 * tasks, r.tracked)}, {r.tracked})").alias("top"))
    hot = frozen(top.select(F.explode("top").alias("t")).filter(F.col("t.count") > share).select(F.col("t.item").alias("h1")), "hot-lines")
    if hot.isEmpty():
        return None
    return frozen(lines.join(F.broadcast(hot), "h1").groupBy("h1", "h2").agg(F.min("id").alias("first")), "hot-firsts")


def repeated_lines(lines: DataFrame, r: LineRule = LineRule()) -> DataFrame:
    """``id, version, pos`` of the lines whose key a smaller document holds. Rows without an id are one document, after all others."""
    hot = frequent_keys(lines, r)
    cold = lines if hot is None else lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    order = [F.asc_nulls_last("id"), F.asc("version"), F.asc("pos")]
    stream = Window.partitionBy("h1", "h2").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cold.repartitionByRange("h1", "h2").withColumn("first", F.first("id").over(stream))
    if hot is not None:
        placed = placed.unionByName(lines.join(F.broadcast(hot), ["h1", "h2"]))
    return placed.filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "version", "pos")


def keep_bitmaps(docs: DataFrame, r: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text that loses lines: ``id, version, n_dropped, words``, each word being a number (line // 64) and a long
    whose bits are 1 for lines that stay. Words that keep everything are left out."""
    gone = repeated_lines(frozen(hashed_lines(docs, r, id_col, text_col), "lines"), r).repartition("id", "version")
    word = gone.groupBy("id", "version", F.expr(f"pos div {WORD_BITS}").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD_BITS})")).alias("gone"))
    entry = F.struct(F.col("word").cast("int").alias("word"), F.bitwise_not("gone").alias("keep"))
    return word.groupBy("id", "version").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(entry)).alias("words"))


def kept_lines(lines: Column, words: Column) -> Column:
    """The lines whose bits are set: stretches between words are copied, only the lines of words are looked at one by one."""
    start = lambda w: w.getField("word") * WORD_BITS
    after = lambda i: F.when(i > 0, start(F.get(words, i - 1)) + WORD_BITS).otherwise(0)
    bit = lambda w, j: F.getbit(w.getField("keep"), j) == 1
    pieces = F.transform(words, lambda w, i: F.concat(F.slice(lines, after(i) + 1, start(w) - after(i)), F.filter(F.slice(lines, start(w) + 1, WORD_BITS), lambda _, j: bit(w, j))))
    end = start(F.element_at(words, -1)) + WORD_BITS
    return F.concat(F.flatten(pieces), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0))))


def applied(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the input row, whatever its columns), ``n_lines``, ``n_dropped`` and ``clean``, the text without the dropped lines."""
    rows = _given(docs, id_col, text_col)
    b = bitmaps.select(F.col("id").alias("b_id"), F.col("version").alias("b_version"), F.col("n_dropped").alias("b_dropped"), F.col("words").alias("b_words"))
    rows = rows.join(b, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("version") == F.col("b_version")), "left")
    # the one-element array makes the split lines a variable: written out, they would be split again for every word
    left = F.array_join(F.transform(F.array(F.split("text", "\n")), lambda lines: kept_lines(lines, F.col("b_words")))[0], "\n")
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select(
        "row", n_lines.alias("n_lines"), F.coalesce("b_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("b_id").isNull() & F.col("b_version").isNull(), F.col("text")).otherwise(left).alias("clean"),
    )


def deduplicated(docs: DataFrame, r: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with its line counts and its text without the lines that a smaller document holds.

    A null or empty text is one empty line. Lines repeated inside the first document of a key all stay. Rows with the same id are one
    document: none of them takes lines from another, and equal rows lose the same lines. An empty table gives an empty table.
    """
    return applied(docs, keep_bitmaps(docs, r, id_col, text_col), id_col, text_col)
