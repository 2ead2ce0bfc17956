"""One test for each wrong answer that was found in the text operators."""

import random
import string
import uuid

import pyarrow as pa

import corpus_pipeline
from posegrid.llm import chat_format, chunk_pieces, near_dup, packing, quality_model, secret_scan, warc_store
from posegrid.llm.queries import tokenizer
from posegrid.session import shared_dir
from pyspark.sql import functions as F

TEXT = "Hello Big World, it's naïve"


def ids_of(path):
    import numpy as np

    (raw,) = packing._encoder(path)([TEXT.encode()])
    return np.frombuffer(raw, "<u4").tolist()


def test_tokenizers_of_one_worker_keep_apart():
    from tokenizers import Tokenizer

    paths = [tokenizer(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.json")]
    models = [Tokenizer.from_file(p) for p in paths]
    assert [packing.ends_words(m) for m in models] == [False, True, False]
    assert [ids_of(p) for p in paths] == [m.encode(TEXT, add_special_tokens=False).ids for m in models]


def test_pieces_of_one_worker_keep_apart(tmp_path):
    path, other = tokenizer("piece_bpe_32k.model"), str(tmp_path / "same.model")
    with open(path, "rb") as a, open(other, "wb") as b:
        b.write(a.read())
    codec = chunk_pieces.Codec(path)
    assert codec.plain and codec.encode([TEXT]) == codec._whole([TEXT]) and chunk_pieces._TABLES.keys() == {path}
    again = chunk_pieces.Codec(other)
    assert chunk_pieces._TABLES.keys() == {other} and again.encode([TEXT]) == codec._whole([TEXT])
    again.plain = False
    assert again.encode([TEXT, "", "  "]) == codec._whole([TEXT, "", "  "])


def test_unrelated_texts_of_one_id_stay(spark):
    a = " ".join(f"alpha{i}" for i in range(60))
    b = " ".join(f"beta{i}" for i in range(60))
    c = " ".join(f"gamma{i}" for i in range(60))
    rows = [(5, a, 1), (5, b, 2), (6, a, 3), (None, a, 4), (None, c, 5), (None, c, 6), (8, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    got = sorted((r["text"] or "", r["doc_id"] is None) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [("", False), ("", False), (a, False), (b, False), (c, True)]
    told = near_dup.told_apart(docs, "doc_id", "text", "n").collect()
    assert len({r["n"] for r in told}) == len(rows) and min(r["n"] for r in told) == 5
    plain = near_dup.told_apart(docs.filter("doc_id = 6"), "doc_id", "text", "n").collect()
    assert [r["n"] for r in plain] == [6]


def test_headers_are_exact(spark):
    urls = ["http://a/x\ty", "http://a/x\x7fy", "http://a/x%00y", "http://a/%0a%0A%25%20%2", "http://a/a+b c%\n\r", "http://a/é\x01%7f", "%", "%%0A", "%250A", "plain"]
    pages = spark.createDataFrame([(i, u, "same" if i % 2 else f"<p>{i}\r\n\r\nx") for i, u in enumerate(urls)], "page_id long, url string, html string")
    archive = warc_store.Archive(f"{shared_dir(spark)}/w-{uuid.uuid4().hex}")
    warc_store.write(pages, archive)
    rows = warc_store.warc(warc_store.records(spark, archive))
    plain = {r.page_id: r.asDict() for r in warc_store.described(rows).collect()}
    again = {r.page_id: r.asDict() for r in warc_store.described(warc_store.reread(rows.withColumn("head", F.lit("lost")))).collect()}
    assert [plain[i]["url"] for i in range(len(urls))] == urls and again == plain
    heads = [r.head.partition("\r\n\r\n")[0] for r in rows.collect()]
    assert all(ord(c) >= 32 and ord(c) != 127 for h in heads for line in h.split("\r\n") for c in line)


def test_records_with_optional_fields_keep_their_turns(spark):
    records = [
        '{"system": "s", "messages": [{"role": "user", "content": "u"}]}', '{"instruction": "i", "output": "o", "system": "s"}',
        '{"messages": [{"content": "first"}, {"role": "assistant", "content": "a"}]}', '{"system": "s", "conversations": [{"from": "human", "value": "h"}]}',
        '{"prompt": "p", "response": "r", "completion": "c"}',
    ]
    got = {}
    for r in chat_format.json_turns(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert got[0] == [("system", "s"), ("user", "u")] and got[1] == [("system", "s"), ("user", "i"), ("assistant", "o")]
    assert got[2] == [("", "first"), ("assistant", "a")] and got[3] == [("system", "s"), ("user", "h")] and got[4][0] == ("user", "p")
    typed = spark.createDataFrame([(1, "i", "o", "s"), (2, "i", "o", None)], "conv_id long, instruction string, output string, system string")
    turns = sorted((r.id, r.place, r.role, r.text) for r in chat_format.turns_of(typed).collect())
    assert turns == [(1, -1, "system", "s"), (1, 0, "user", "i"), (1, 1, "assistant", "o"), (2, 0, "user", "i"), (2, 1, "assistant", "o")]


def test_keys_beside_placeholders_and_of_letters_alone():
    draw = random.Random(6)
    hits = 0
    for _ in range(40):
        mixed = "".join(draw.choices(string.ascii_letters + string.digits, k=32))
        letters = "".join(draw.choices(string.ascii_letters, k=34))
        found = list(secret_scan.scan(pa.array([f"your_api_key_{mixed}", f"sample/{mixed}", f"ghp_{letters}"])))
        hits += sum(any(k == "entropy" for k, _, _ in f) for f in found)
    assert hits >= 114  # of 120
    plain = ["example_key_placeholder_value", "theQuickBrownFoxJumpsOverTheLazyDogAgain", "WWWAuthenticateHeaderParserFactoryBeanImplementation"]
    assert [[k for k, _, _ in f] for f in secret_scan.scan(pa.array(plain))] == [[], [], []]


def test_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "password = abcdefgh1234", 7), (2, None, 8)], "doc_id long, text string, `a.b` int")
    got = secret_scan.masked(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(1, "[SECRET]", 7), (2, None, 8)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    vectors, net = quality_model.train(docs, labels)
    assert quality_model.kept(docs, vectors, net).columns == docs.columns
