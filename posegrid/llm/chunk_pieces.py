"""SentencePiece encoding over distinct marked words.

In the model's form of a text, spaces are word markers. If no piece has a marker after another character, merges never cross from a
word into the next marker, so a text is segmented word by word. Each worker keeps a table of distinct marked words with their ids,
segments only the words it has not met, and joins the ids back in the order of positions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow
from .packing import word_table

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Ids of marked words by the path of their model: a worker outlives the query it was started for.
_TABLES: dict[str, dict[str, str]] = {}
#: Distinct marked words a worker remembers; beyond that it starts afresh.
WORDS_KEPT = 300_000


#: Texts that tell whether a model leaves texts as they are but for one marker before them.
PROBES = ("Hello  big World", " a ", "ﬁne ① ＡＢ Ⅷ", "e\u0301 é\u00a0x", "tab\tline\nend\x00", "", "A" * 40)


def crossing_pieces(model) -> list[str]:
    """Pieces with a marker after another character; with any of them words can't be segmented alone."""
    return [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)]


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        if crossing_pieces(self.model):
            raise ValueError("this model has pieces that cross word markers")
        self.end = self.model.eos_id()
        self.table = word_table(_TABLES, path)
        # a model that normalizes texts, or puts no marker first, is asked for whole texts
        self.plain = True
        self.plain = self.encode(list(PROBES)) == self._whole(list(PROBES))

    def _whole(self, texts: list[str]) -> list[str]:
        return ["".join(f"{i} " for i in ids) + str(self.end) for ids in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by one space, end id included."""
        if not self.plain:
            return self._whole(texts)
        known = self.table
        if len(known) > WORDS_KEPT:
            known.clear()
        # the model puts one marker before a text that is not empty
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        unknown: dict[str, None] = {}
        for words in split:
            unknown.update(dict.fromkeys(w for w in words if w not in known))
        fresh = list(unknown)
        for i in range(0, len(fresh), 10_000):
            part = fresh[i : i + 10_000]
            for w, ids in zip(part, self.model.encode([w[1:] for w in part], num_threads=1), strict=True):
                # a lone marker is what the model adds to nothing, so it is asked for by its piece
                known[w] = "".join(f"{i} " for i in ids) if len(w) > 1 else f"{self.model.piece_to_id(MARK)} "
        return ["".join(map(known.__getitem__, words)) + str(self.end) for words in split]

    def decode(self, ids: list[str]) -> list[str]:
        return self.model.decode([list(map(int, t.split(" "))) for t in ids], num_threads=1)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each row, null texts as empty ones (the end id alone); a null id stays null.

    ``with_ids`` adds ids (decimal, joined by a space). Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = Codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                texts = [t or "" for t in column(batch, "text")[lo : lo + 128].to_pylist()]
                ids = codec.encode(texts)
                out = {"id": column(batch, "id")[lo : lo + 128], "n_tokens": [t.count(" ") + 1 for t in ids], "ids_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in ids]}
                if decode:
                    out["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in codec.decode(ids)]
                yield out | ({"ids": ids} if with_ids else {})

    schema = "id long, n_tokens long, ids_sha256 string" + ", decoded_sha256 string" * decode + ", ids string" * with_ids
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, schema).withColumnRenamed("id", id_col)
