"""Helpers shared by the text operators: byte-level tokens in numpy, Arrow mapping, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes of text handled at once inside a task; temporaries are a few times eight bytes for each.
CHUNK_BYTES = 1 << 20
#: Word separators of the contracts: space and U+0009 to U+000D.
SEPARATORS = b" \t\n\x0b\x0c\r"
SPACE = np.zeros(256, bool)
SPACE[list(SEPARATORS)] = True
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frozen(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared checkpoint folder and read back."""
    return materialize(df, f"llm-{name}")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` turns the batches of a partition into dicts of equally long columns, cast to ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f in target for c in [cols[f.name]]]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch], str], Iterator[pa.RecordBatch]], text_col: str) -> DataFrame:
    """``fn`` changes or drops rows; columns go in and come out by position, so dots in their names and repeated names do no harm. It
    is told which column has the text."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    text = f"c{df.columns.index(text_col)}"
    return plain.mapInArrow(lambda batches: fn(batches, text), plain.schema).toDF(*df.columns)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``i`` to ``j`` with their UTF-8 bytes and row offsets; a chunk passes ``limit`` only for one long text. Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    ends = np.frombuffer(off, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield i, j, raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words do not cross rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[buf]
    fresh = np.ones(len(buf) + 1, bool)
    fresh[1:-1] = ~word[:-1]
    fresh[offsets[offsets < len(buf)]] = True
    starts = np.flatnonzero(word & fresh[:-1])
    stop = np.ones(len(buf), bool)
    stop[:-1] = ~word[1:]
    inner = offsets[(offsets > 0) & (offsets <= len(buf))]
    stop[inner - 1] = True
    return starts, np.flatnonzero(word & stop) + 1


def class_spans(buf: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of one byte class (``kinds[byte]``, 0: separator) inside rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = kinds[buf]
    cut = np.ones(len(buf) + 1, bool)
    cut[1:-1] = k[1:] != k[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    inside = k[edges[:-1]] > 0
    return edges[:-1][inside], edges[1:][inside]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans, in blocks of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK_BYTES, "right")))
        hi = int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of ``width`` words, A-Z lower-cased; fewer words: the whole sequence; none: empty."""
    for _, _, buf, offsets in text_chunks(texts):
        buf = LOWER[buf]
        starts, ends = word_spans(buf, offsets)
        words = span_hashes(buf, starts, ends)
        cuts = np.searchsorted(starts, offsets)
        n = len(words)
        acc = words.copy()
        with np.errstate(over="ignore"):
            for k in range(1, width):
                m = max(0, n - k)
                acc[:m] = mix(acc[:m] * np.uint64(0xD6E8FEB86659FD93) + words[k:])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= width:
                yield np.unique(acc[a : b - width + 1])
            elif b > a:
                h = words[a : a + 1]
                for k in range(a + 1, b):
                    h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + 1])
                yield h ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def crc_of_id(c: str = "doc_id"):
    return F.crc32(F.col(c).cast("string"))
