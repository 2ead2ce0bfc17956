"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged by itself: does it end like a sentence, is it navigation, is it boilerplate, is it made of symbols.
Failing lines go, and a document that loses too much of its text with them is rejected. The statistics of whole texts that decide the
base rules (word count, repeated word triples) are array expressions over the words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java regex class and plain characters of the word separators.
SEPARATOR = r"[ \t\n\x0B\f\r]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

NAVIGATION = r"(?:[|›»•→·].*){3}"
BOILERPLATE = r"(?i)(?:all rights reserved|privacy policy|terms of (?:use|service)|cookie (?:policy|settings)|accept (?:all )?cookies|subscribe to our|sign up for|click here|log ?in to|enable javascript|share this (?:page|article)|read more$)"
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]\s]*$"
SHOUTING = r"(?:!!|\?\?)"


@dataclass(frozen=True)
class Rules:
    """A line of fewer than ``heading`` words may lack a sentence end. ``loss`` is the largest share of the text's characters (outside
    white space) that may go with failing lines, in percent; ``symbols`` and ``shouting`` are percent of a line's characters and words."""

    heading: int = 8
    boilerplate_words: int = 30
    symbols: int = 10
    shouting: int = 20
    loss: int = 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR), "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def fails(line: Column, r: Rules) -> Column:
    """Whether a line goes; lines without a word stay."""
    dense = F.char_length(without(line, BLANKS))
    n = F.size(F.split(F.btrim(line, F.lit(BLANKS)), SEPARATOR))
    symbols = F.char_length(line) - F.char_length(without(line, SYMBOLS))
    shouts = F.size(F.split(line, SHOUTING)) - 1
    bad = (
        ((n >= r.heading) & ~line.rlike(SENTENCE_END))
        | line.rlike(NAVIGATION)
        | ((n <= r.boilerplate_words) & line.rlike(BOILERPLATE))
        | (symbols * 100 > dense * r.symbols)
        | ((shouts >= 3) & (shouts * 100 > n * r.shouting))
    )
    return (dense > 0) & bad


def judged(docs: DataFrame, r: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """``row`` (the input row, whatever its columns), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed,
    base_failed, kept and clean (the text without failing lines).

    Null texts have no words and fail the base rules; their clean text is null. Repeated rows are judged alike.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("given"))
    rows = rows.withColumn("text", F.coalesce("given", F.lit("")))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    word = lambda i: F.get(F.col("words"), i)
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    rows = rows.withColumn("h", F.when(F.size("words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("row", "given", "text", "lines", F.size("words").cast("long").alias("n_words"), "h")
    # only texts with two equal windows are sorted
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed)).drop("h")
    at = lambda i: F.get(F.col("s"), i).getField("h")
    twice = F.filter("s", lambda x, i: (x.getField("h") == at(i + 1)) | (F.when(i > 0, at(i - 1)) == x.getField("h")))
    rows = rows.withColumn("p", F.sort_array(F.transform(twice, lambda x: x.getField("i")))).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda a, p: F.struct((a.getField("n") + 3 - F.greatest(a.getField("end") - p, F.lit(0))).alias("n"), (p + 3).alias("end")))
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered.getField("n"), F.lit(0)).cast("long")).drop("p")
    rows = rows.withColumn("filled", F.filter("lines", lambda x: F.btrim(x, F.lit(BLANKS)) != "")).withColumn("good", F.filter("lines", lambda x: ~fails(x, r)))
    rows = rows.select(
        "row", "given", "n_words", "n_repeat_words", F.array_join("good", "\n").alias("left"),
        F.char_length(without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    lost = F.col("word_chars") - F.char_length(without(F.col("left"), BLANKS))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (lost * 100 <= F.col("word_chars") * r.loss))
    return rows.withColumn("clean", F.when(F.col("given").isNotNull(), F.col("left"))).drop("given", "left")


def passed(docs: DataFrame, r: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The ``judged`` rows that are kept. A row number stands between the columns and the filter: pushed below them, the filter would
    hold a copy of every array expression for each time the next one uses it."""
    numbered = judged(docs, r, text_col).withColumn("row_no", F.monotonically_increasing_id())
    return numbered.filter(F.col("kept") & (F.col("row_no") >= 0)).drop("row_no")
