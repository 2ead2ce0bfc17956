"""Near-duplicate classes: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Rows become word-shingle sets. Equal sets collapse to one class; only classes are compared. Bands of MinHash values find candidate
pairs, batches of further signature values prune those whose posterior chance of reaching the threshold falls below the miss
probability, and the survivors are confirmed on full sets. Links join classes to components by star contraction.

Large buckets never become all pairs. Two rounds link each bucket to one hub; members that are then in one component need no further
comparison. What is left is compared block by block, only across components: signatures first, then full sets, and only links leave
a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, frozen, map_arrow, mix, shingle_sets


@dataclass(frozen=True)
class Similarity:
    """``width`` words to a shingle; links have Jaccard of at least ``percent`` / 100. A linked pair is missed by the bands, or
    pruned, with probability ``miss`` at most for each."""

    width: int = 5
    percent: int = 80
    miss: float = 1e-6
    rows: int = 5
    batch: int = 20

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(p: Similarity, compared: int) -> int:
    """Fewest equal values among ``compared`` for which P(similarity >= threshold) still reaches the miss probability, under a
    uniform prior."""
    j = (np.arange(20_000) + 0.5) / 20_000
    for m in range(compared + 1):
        like = m * np.log(j) + (compared - m) * np.log1p(-j)
        w = np.exp(like - like.max())
        if w[j >= p.percent / 100].sum() / w.sum() >= p.miss:
            return m
    return compared


def survivors(a: np.ndarray, b: np.ndarray, p: Similarity) -> np.ndarray:
    """Indexes of the rows of two signature matrices that no batch prunes."""
    alive, same = np.arange(len(a)), np.zeros(len(a), np.int32)
    for lo in range(0, p.hashes, p.batch):
        hi = min(p.hashes, lo + p.batch)
        same[alive] += (a[alive, lo:hi] == b[alive, lo:hi]).sum(axis=1, dtype=np.int32)
        alive = alive[same[alive] >= least(p, hi)]
        if not len(alive):
            break
    return alive


_LEAST: dict[tuple[Similarity, int], int] = {}


def least(p: Similarity, compared: int) -> int:
    if (p, compared) not in _LEAST:
        _LEAST[p, compared] = least_matches(p, compared)
    return _LEAST[p, compared]


def sketches(docs: DataFrame, p: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, key (digest of the set, null for an empty one), sig (16 bits of each MinHash value) and bands (64-bit keys)."""
    rng = np.random.default_rng(20_240_607)
    mult = (rng.integers(1, 1 << 32, p.hashes, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 1 << 32, p.hashes, dtype=np.uint64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n, keys = [], []
            mins = np.full((batch.num_rows, p.hashes), 0xFFFFFFFF, np.uint32)
            for i, s in enumerate(shingle_sets(column(batch, "text"), p.width)):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
                for at in range(0, len(s), 4096):
                    np.minimum(mins[i], (mult[:, None] * low[at : at + 4096] + add[:, None]).min(axis=1), out=mins[i])
            sig = ((mins * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
            rows = mins.reshape(batch.num_rows, p.bands, p.rows).astype(np.uint64)
            band = np.broadcast_to(np.arange(p.bands, dtype=np.uint64), rows.shape[:2])
            for k in range(p.rows):
                band = mix(band * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, k])
            flat = pa.array(band.reshape(-1).view(np.int64))
            yield {"id": column(batch, "id"), "n_shingles": n, "key": keys, "sig": [r.tobytes() for r in sig], "bands": pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * p.bands, flat)}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, n_shingles long, key binary, sig binary, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for each node of the edges ``a``, ``b``, by alternating star contraction."""
    now = frozen(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        # each node hands its larger neighbours to the least of its neighbourhood, then its smaller neighbours and itself
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least_of = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = frozen(both.filter("b > a").join(least_of, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least_of = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least_of, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = frozen(small.union(least_of.select("a", F.col("m").alias("b"))).distinct(), "edges")
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if got == before or not got[0]:
            break
        before = got
    found = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())


def _pruned(pairs: DataFrame, sigs: DataFrame, p: Similarity) -> DataFrame:
    """Candidate pairs (a, b) of classes that pass every batch."""
    wide = pairs.join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = [np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint16).reshape(batch.num_rows, p.hashes) for c in ("sa", "sb")]
            keep = pa.array(survivors(m[0], m[1], p))
            yield {"a": column(batch, "a").take(keep), "b": column(batch, "b").take(keep)}

    return map_arrow(wide.select("a", "b", "sa", "sb"), run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, p: Similarity) -> DataFrame:
    """key, items (the whole shingle set) of the wanted classes. ``docs``: id, text; ``wanted``: key, rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            items = list(shingle_sets(column(batch, "text"), p.width))
            yield {"key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in items], "items": [s.view(np.int64) for s in items]}

    texts = docs.join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("text")
    # a repeated id may bring other texts too: their keys are wanted by nobody or equal to wanted ones
    return map_arrow(texts, run, "key binary, items array<long>").groupBy("key").agg(F.first("items").alias("items"))


def _verified(pairs: DataFrame, sets: DataFrame, p: Similarity) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("total"))
    return both.filter((F.col("shared") * 100) >= (F.col("total") - F.col("shared")) * p.percent).select("a", "b")


def _hubs(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("bucket").agg(F.max(F.struct("weight", "key", "component")).alias("h")).select("bucket", F.col("h.key").alias("hub"), F.col("h.component").alias("hub_component"))


def _stars(buckets: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs of each bucket's hub with its members of other components."""
    pairs = buckets.join(hubs, "bucket").filter("component <> hub_component")
    return pairs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def _across(open_: DataFrame, one: DataFrame, sets: DataFrame, p: Similarity, members: int = 512, items: int = 1_000_000) -> DataFrame:
    """Links across the components of open buckets, confirmed on full sets.

    A bucket is cut into blocks of about ``members`` rows and ``items`` shingles, and each pair of blocks is one task's group. First the
    signatures of a group are compared, each pair only in the first band it shares; pairs that sizes or signatures rule out are never
    written. The members that have partners left then meet with their sets, once for each group, and of the confirmed links those that
    join nothing new in the group are left out.
    """
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["bucket", "i", "j"]
    sized = open_.groupBy("bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / members, F.sum("n") / items)).cast("int").alias("blocks"))
    at = open_.join(sized, "bucket").withColumn("k", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("k", "o")).withColumn("j", F.greatest("k", "o"))
    placed = placed.join(one.select("key", "sig", "bands"), "key").select(*group, "band", "k", "key", "component", "n", "sig", "bands")

    def candidates(g: pd.DataFrame) -> pd.DataFrame:
        i, j, band = int(g["i"].iloc[0]), int(g["j"].iloc[0]), int(g["band"].iloc[0])
        sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), p.hashes)
        early = np.stack(list(g["bands"]))[:, :band]
        k, n, comp = g["k"].to_numpy(), g["n"].to_numpy(), g["component"].factorize()[0]
        left, right, partners = np.flatnonzero(k == i), np.flatnonzero(k == j), {}
        for at, x in enumerate(left):
            r = right[at + 1 :] if i == j else right
            r = r[comp[r] != comp[x]]
            r = r[np.minimum(n[r], n[x]) * 100 >= np.maximum(n[r], n[x]) * p.percent]
            r = r[~(early[r] == early[x]).any(axis=1)]
            if len(r):
                r = r[survivors(np.broadcast_to(sig[x], (len(r), p.hashes)), sig[r], p)]
                if len(r):
                    partners[x] = r
        if not partners:
            return pd.DataFrame(columns=[*group, "key", "component", "place", "partners"])
        used = sorted(set(partners).union(*(r.tolist() for r in partners.values())))
        out = g.iloc[used][[*group, "key", "component"]].copy()
        out["place"] = np.array(used, np.int32)
        out["partners"] = [partners.get(x, np.zeros(0, np.int64)).astype(np.int32) for x in used]
        return out

    def confirmed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        where = {x: at for at, x in enumerate(g["place"])}
        keys, sets_of = g["key"].to_numpy(), [np.sort(x) for x in g["items"]]
        group_of = g["component"].factorize()[0]
        out = []
        for x, partners in enumerate(g["partners"]):
            r = np.array([where[y] for y in partners], np.int64)
            r = r[group_of[r] != group_of[x]]
            if not len(r):
                continue
            size = np.array([len(sets_of[y]) for y in r])
            flat = np.concatenate([sets_of[y] for y in r])
            place = np.minimum(np.searchsorted(sets_of[x], flat), len(sets_of[x]) - 1)
            shared = np.add.reduceat((sets_of[x][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
            for y in r[shared * 100 >= (size + len(sets_of[x]) - shared) * p.percent]:
                if group_of[y] != group_of[x]:
                    out.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
                    group_of[group_of == group_of[y]] = group_of[x]
        return pd.DataFrame(out, columns=["a", "b"])

    shape = "bucket long, i int, j int, key binary, component binary, place int, partners array<int>"
    found = placed.repartition(parts, *group).groupBy(*group).applyInPandas(candidates, shape)
    found = frozen(found, "candidates").join(sets, "key").select(*group, "key", "component", "place", "partners", "items")
    return found.groupBy(*group).applyInPandas(confirmed, "a binary, b binary")


def told_apart(docs: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """The rows with a number of their own in ``out``: their id, but for rows that share an id or lack one. Of those with an id the one
    with the smallest hash of its text keeps it; the others get numbers above all ids."""
    ids = docs.groupBy(F.col(id_col)).agg(F.count(F.lit(1)).alias("n"))
    shared = frozen(ids.filter(F.col(id_col).isNull() | (F.col("n") > 1)).select(F.col(id_col).alias("_told_id")), "shared-ids")
    plain = docs.withColumn(out, F.col(id_col).cast("long"))
    if shared.isEmpty():
        return plain
    top = docs.agg(F.max(id_col)).first()[0]
    same = F.col(id_col).eqNullSafe(F.col("_told_id"))
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), F.hash(text_col))
    many = docs.join(shared, same, "left_semi").withColumn("_told_turn", F.row_number().over(first)).withColumn("_told_number", F.monotonically_increasing_id())
    # written, so that the numbers stay whatever is computed again
    many = frozen(many, "shared-rows")
    number = F.when(F.col(id_col).isNotNull() & (F.col("_told_turn") == 1), F.col(id_col)).otherwise(F.col("_told_number") + F.lit((-1 if top is None else int(top)) + 1))
    return docs.join(shared, same, "left_anti").withColumn(out, F.col(id_col).cast("long")).unionByName(many.withColumn(out, number.cast("long")).drop("_told_turn", "_told_number"))


def near_duplicates(docs: DataFrame, p: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, n_shingles, component_id (smallest id reachable over links and equal ids).

    Null or word-less texts have n_shingles 0 and are linked with nothing. Rows that repeat an id count as one document with all their
    texts. A null id is never linked and has a null component. Other columns are ignored, whatever their names.
    """
    rows = frozen(sketches(docs, p, id_col, text_col), "sketches")
    linked = rows.filter("key is not null and id is not null")
    classes = frozen(linked.groupBy("key").agg(F.min("id").alias("rep")), "classes")
    several = linked.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi")
    same_id = linked.join(several, "id").filter("key <> lo").select(F.col("lo").alias("a"), F.col("key").alias("b")).distinct()
    # equal sets have equal signatures, so any row of its representative stands for a class
    one = linked.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key"])
    one = frozen(one.select("key", F.col("id").alias("rep"), F.col("n_shingles").alias("n"), "sig", "bands"), "keyed")
    sigs = one.select("key", "sig")

    placed = one.select("key", "n", F.posexplode("bands").alias("band", "value")).select("key", "n", "band", F.xxhash64("band", "value").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = frozen(placed.join(sizes, "bucket").select("bucket", "band", "key", "n", "size"), "buckets")
    # the hub of a bucket is the member in the most and fullest buckets: the likely original of a group of near copies
    weight = buckets.groupBy("key").agg(F.sum("size").alias("weight"))
    open_ = frozen(buckets.join(weight, "key").select("bucket", "band", "key", "n", F.col("key").alias("component"), "weight"), "open")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = frozen(_sets(plain, one.join(weight.select("key"), "key", "left_semi"), p), "sets")

    links = None
    for stage in ("hub", "second hub", "blocks"):
        if links is not None:
            grown = components(links)
            moved = open_.drop("component").join(grown.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
            split = moved.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
            open_ = frozen(moved.join(split, "bucket", "left_semi").select("bucket", "band", "key", "n", "component", "weight"), "open")
        if stage == "blocks":
            got = frozen(_across(open_, one, sets, p), "links")
        else:
            hubs = _hubs(open_)
            if stage != "hub":
                hubs = _hubs(open_.join(hubs, "bucket").filter("component <> hub_component").select("bucket", "key", "component", "weight"))
            got = frozen(_verified(frozen(_pruned(_stars(open_, hubs), sigs, p), "survivors"), sets, p), "links")
        links = got if links is None else links.union(got)

    joined = components(links.union(same_id)).withColumnRenamed("node", "key")
    least = classes.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = least.join(smallest, "component").select("key", "component_id")
    out = rows.select("id", "n_shingles", "key").join(final, "key", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))
