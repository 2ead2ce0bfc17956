"""Line dedup, spelling groups and the divergence audit against plain Python on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from posegrid.llm import divergence_audit, line_dedup, spelling_groups
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
LINES = ["A shared line of text", "  a SHARED line of text\t", "École à Paris, É", "école à paris, É", "Ⅰ roman numeral line", "ⅰ roman numeral line", "short", "", " ", "unique %d is here"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def line_rows():
    draw = random.Random(3)
    rows = [(i, "\n".join((l % i if "%d" in l else l) for l in draw.choices(LINES, k=draw.randint(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "A shared line of text\nonly without an id"), (None, "only without an id"), (7, "a second text of seven\nA shared line of text"), (7, "a second text of seven\nA shared line of text")]
    rows += [(200, "\n".join(f"long text line {i % 300}" for i in range(1000))), (201, "\n".join(f"long text line {i}" for i in range(290, 700)))]
    return rows


def brute_lines(rows, least=10):
    keys = lambda t: [lower(l.strip(BLANKS)) for l in (t or "").split("\n")]
    first = {}
    for d, t in rows:
        for k in keys(t):
            if len(k) >= least:
                old = first.get(k, d)
                first[k] = d if k not in first or old is None else old if d is None else min(old, d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [l for l, k in zip(lines, keys(t)) if len(k) < least or first[k] == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def key(r):
    return tuple((v is None, v) for v in r)


@pytest.mark.parametrize("rule", [line_dedup.LineRule(), line_dedup.LineRule(hot_rows=3, tracked=1000), line_dedup.LineRule(least=1)])
def test_lines(spark, rule):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, words string, version int, `a.b` int").repartition(4)
    got = line_dedup.deduplicated(docs, rule).select("row.doc_id", "row.`a.b`", "n_lines", "n_dropped", "clean").drop("a.b").collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_lines(rows, rule.least)))


def test_hot_keys_are_found(spark):
    docs = spark.createDataFrame([(i, f"the very common line\nrow number {i} of all") for i in range(500)], "doc_id long, text string")
    rule = line_dedup.LineRule(hot_rows=50)
    lines = line_dedup.frozen(line_dedup.hashed_lines(docs, rule), "t")
    assert line_dedup.frequent_keys(lines, rule).count() == 1
    assert line_dedup.deduplicated(docs, rule).filter("n_dropped = 1").count() == 499


def test_bitmaps_hold_only_touched_words(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"number {i} of one" for i in range(200))), (2, "\n" * 130 + "number 5 of one\nnumber 6 of one\n")], "doc_id long, text string")
    (row,) = line_dedup.keep_bitmaps(docs).collect()
    assert row.id == 2 and row.n_dropped == 2 and [(w.word, ~w.keep) for w in row.words] == [(2, 0b1100)]


def test_native_plan(spark, docs):
    out = line_dedup.deduplicated(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_lines(spark, no_docs):
    assert line_dedup.deduplicated(no_docs).count() == 0 and line_dedup.keep_bitmaps(no_docs).count() == 0
    assert spelling_groups.spelling_groups(no_docs).count() == 0 and divergence_audit.audited(no_docs).count() == 0


def brute_words(rows, v):
    n = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % v.slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= v.length and k >= v.least}


def brute_groups(n, ratio=2):
    near = defaultdict(set)
    cuts = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cuts[(i, w[:i] + w[i + 1 :], len(w))].add(w)
            if (c := w[:i] + w[i + 1 :]) in n:
                near[w].add(c)
                near[c].add(w)
    for group in cuts.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("v", [spelling_groups.Variants(slip=5), spelling_groups.Variants(slip=7, length=2, least=1, shard_words=8)])
def test_variants(spark, v):
    draw = random.Random(1)
    stem = ["aaaaa", "aaaab", "banana", "bananas", "Bánana", "ÿeti×s", "abcabcabc", "abcabcab", "xyzzy"]
    rows = [(i if i % 9 else None, " 1,".join(draw.choices(stem, k=60))) for i in range(60)] + [(70, None), (71, ""), (72, "é" * 3000), (72, "é" * 3000), (73, "é" * 2999 + " " + "é" * 2999), (74, "日本banana本" * 5), (75, "aaaaaa aaaaaaa " * 9)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, `a.b` int").repartition(3)
    n = brute_words(rows, v)
    got = spelling_groups.spelling_groups(docs, v).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_groups(n)))


def test_index_intervals_count_matches():
    """Both intervals of a match have the number of its occurrences, whichever way it was extended."""
    words = ["abab", "ba", "abba", "éa", "b"]
    index = spelling_groups.BidirectionalIndex(words)
    text = "\n" + "\n".join(words) + "\n"
    one = lambda c: index.coded(np.array([ord(c)]))
    draw = random.Random(5)
    for _ in range(300):
        state, said = index.whole(1), ""
        for _ in range(4):
            c, left = draw.choice("abé\n"), draw.random() < 0.5
            state = index.extend(left, one(c), *state)
            said = c + said if left else said + c
            assert state[2][0] == sum(text.startswith(said, i) for i in range(len(text)))
            if not state[2][0]:
                break
            spread = index.spread(True, *state)
            assert sorted(spread[1].tolist()) == sorted({0 if i == 0 else int(one(text[i - 1])[0]) for i in range(len(text)) if text.startswith(said, i)})


def test_shared_halves_are_split(spark):
    v = spelling_groups.Variants(length=5, least=1, shard_words=50)
    words = [f"prefix{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    vocab = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = spelling_groups.grouped(vocab, v).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == brute_groups({w: i + 1 for i, w in enumerate(words)})


def test_crc_goes_on():
    import pyarrow as pa

    words = pa.array(["", "a", "é" * 100, "banana", "z" * 64, "z" * 65], pa.large_string())
    before = [zlib.crc32(f"{i}:".encode()) for i in range(6)]
    got = spelling_groups.crc32_after(np.array(before, np.uint32), words, np.arange(6))
    assert got.tolist() == [zlib.crc32(w.encode(), b) for w, b in zip(words.to_pylist(), before)]


def brute_audit(rows, least, top):
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    found = [(l, s, [w for w in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) if w]) for t, l, s in rows]
    out = []
    for lang in {l for l, _, _ in found}:
        own = [(s, w) for l, s, w in found if l == lang]
        docs = Counter(x for _, w in own for x in set(w))
        kept = {x for x, k in docs.items() if k >= least}
        count = {s: Counter(x for t, w in own if t == s for x in w if x in kept) for s in {s for s, _ in own}}
        whole = sum(count.values(), Counter())

        def p(c, x):
            return 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in count.items():
            pairs = [(sum(f(p(c, x), p(d, x)) for x in kept), t) for t, d in count.items() if t != s]
            terms = [(f(p(c, x), p(whole, x)), x) for x in kept if c[x] > 0 and p(c, x) > p(whole, x)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("a", [divergence_audit.Audit(least_docs=3), divergence_audit.Audit(least_docs=2, top=3, shard_rows=7, sources=2)])
def test_divergences(spark, a):
    draw = random.Random(2)
    words = ["Alpha", "beta", "gamma", "été", "日本", "z1z", "x", "\x00nul", "a-b", "delta", "epsilon"]
    rows = [(" ".join(draw.choices(words, k=draw.randint(0, 12))), draw.choice(["en", "fr", None]), draw.choice(["s0", "s0", "s1", "s2", "s3", "", None])) for _ in range(120)]
    rows += [(None, "de", "s1"), ("", "de", "s2"), ("lonely words", "it", "s9"), ("alpha " * 5000, "en", "s4")] + [("beta gamma", "en", "s0")] * 3
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, source string, `a.b` int, term string").repartition(5)
    assert sorted(tuple(r) for r in divergence_audit.audited(docs, a).collect()) == sorted(brute_audit(rows, a.least_docs, a.top))


def test_shares_are_exact(spark):
    draw = random.Random(4)
    rows = [(n, n + draw.randint(0, 10**12), draw.randint(1, 10**9)) for n in [0, 1, 10**10, 10**12, *(draw.randint(0, 10**11) for _ in range(200))]]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    want = [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]
    assert [r[0] for r in df.select(divergence_audit.share(F.col("n"), F.col("total"), F.col("terms"))).collect()] == want
    assert [int(divergence_audit.shares(np.array([n]), np.array([t]), v)[0]) for n, t, v in rows] == want


def test_text_digest_matches(spark, texts):
    docs = spark.createDataFrame([(d, t) for d, t in texts], "doc_id long, text string")
    got = line_dedup.deduplicated(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("clean", 256).alias("h")).collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(texts)]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_counts_of_one_large_batch_are_handed_on_in_parts(monkeypatch):
    """A batch of many chunks must not be held whole: nothing handed on passes the bound, and the sums stay right."""
    monkeypatch.setattr(divergence_audit, "HELD_ROWS", 300)
    monkeypatch.setattr(divergence_audit, "SENT_ROWS", 64)
    monkeypatch.setattr(divergence_audit, "CHUNK_BYTES", 1000)
    held = []
    merged = divergence_audit.merged
    monkeypatch.setattr(divergence_audit, "merged", lambda tables: held.append(sum(t.num_rows for t in tables)) or merged(tables))
    word = lambda k: "W" + chr(97 + k // 26) + chr(97 + k % 26)
    texts = [" ".join(word((i * 7 + k) % 600) for k in range(40)) for i in range(200)]
    batch = pa.record_batch({"text": texts, "lang": ["en"] * 200, "source": [f"s{i % 3}" for i in range(200)]})
    parts = [pa.table(t) for t in divergence_audit._counted(iter([batch, batch.take(pa.array(range(50, 80)))]))]
    assert max(t.num_rows for t in parts) <= 64 and max(held) <= 3 * 300
    got, want = Counter(), Counter()
    for r in pa.concat_tables(parts).to_pylist():
        got[r["source"], r["term"]] += r["n"]
    for i in [*range(200), *range(50, 80)]:
        want.update((f"s{i % 3}", w.lower()) for w in texts[i].split())
    assert {k: n for k, n in got.items() if k[1]} == want
