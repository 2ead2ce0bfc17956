"""Nearest neighbours by balanced posting lists.

Centroids of a bounded sample (k-means with a price on full clusters) name the lists. Every vector goes to its nearest centroid and, near
a boundary, to further ones that lie in other directions. A graph of the centroids, held in memory by each task, is walked to find the
nearest centroids of a vector; a query is compared with all centroids and visits every list whose distance is within a ratio of its
nearest. It visits its nearest lists first, and the others return only what reaches the last place found there. Inner products are turned
to distances by one more coordinate that gives all vectors the same length.

A query goes once to a run of neighbouring lists, with the numbers of those that it visits, so its vector is not copied for each list.

Equal vectors are one entry with their smallest ids, so a vector that a third of all rows share is searched once. Lists are scored in
blocks of bounded size, queries too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, frozen, map_arrow


@dataclass(frozen=True)
class Settings:
    """Centroids come from ``sample`` distinct vectors, one for ``per_list`` vectors of the corpus, ``most_lists`` at most. A vector has
    up to ``copies`` entries, in lists within ``copy_ratio`` of its nearest whose centroids are at least ``apart`` times as far from each
    other as from the vector; a query visits its ``least_probes`` nearest lists and all others within a ratio that finds ``recall`` of
    the neighbours in the sample. It goes to at most ``run`` lists in one row."""

    sample: int = 20_000
    per_list: int = 256
    least_lists: int = 8
    most_lists: int = 4096
    copies: int = 4
    copy_ratio: float = 1.05
    apart: float = 0.5
    least_probes: int = 16
    recall: float = 0.96
    degree: int = 24
    beam: int = 32
    block: int = 2048
    run: int = 32
    seed: int = 11


@dataclass
class Index:
    """Centroids in the lengthened space, their graph, where walks start, and the common length of vectors."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    length: float
    ratio: float = 1.0

    def lengthened(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length**2 - (v * v).sum(axis=1), 0))
        return np.hstack([v, rest[:, None]])

    def pointed(self, q: np.ndarray) -> np.ndarray:
        """Queries with the common length: their order of inner products is that of distances."""
        return np.hstack([q * (self.length / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))])

    def nearest(self, x: np.ndarray, many: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and distances by a best-first walk of all rows at once, nearest first."""
        c, k = self.centroids, len(self.centroids)
        many, beam = min(many, k), min(max(beam, many), k)
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), k), bool)
        ids = np.tile(self.entries, (len(x), 1))
        seen[rows, ids] = True
        dist = self._distance(x, ids)
        done = np.zeros(ids.shape, bool)
        while True:
            wait = np.where(done, np.inf, dist)
            pick = np.argmin(wait, axis=1)
            live = np.flatnonzero(np.isfinite(wait[np.arange(len(x)), pick]))
            if not len(live):
                break
            done[live, pick[live]] = True
            more = self.graph[ids[live, pick[live]]]
            fresh = ~seen[live[:, None], more]
            seen[live[:, None], more] = True
            d = np.full((len(x), more.shape[1]), np.inf)
            d[live] = np.where(fresh, self._distance(x[live], more), np.inf)
            wide = np.zeros((len(x), more.shape[1]), ids.dtype)
            wide[live] = more
            ids, dist, done = np.hstack([ids, wide]), np.hstack([dist, d]), np.hstack([done, ~np.isfinite(d)])
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = ids[rows, keep], dist[rows, keep], done[rows, keep]
        order = np.argsort(dist, axis=1, kind="stable")[:, :many]
        return ids[rows, order], np.sqrt(np.maximum(dist[rows, order], 0))

    def _distance(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        c = self.centroids[ids]
        return (c * c).sum(axis=2) - 2 * np.einsum("bkd,bd->bk", c, x) + (x * x).sum(axis=1)[:, None]


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


def fit(sample: np.ndarray, lists: int, length: float, s: Settings) -> Index:
    """Balanced k-means: a cluster's size, against the mean, adds to its distances, so that lists come out alike."""
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), np.int64), np.zeros(0, np.int64), length)
    x, rng = index.lengthened(sample), np.random.default_rng(s.seed)
    k = min(lists, len(x))
    c, price = x[rng.choice(len(x), k, replace=False)].copy(), np.zeros(k)
    for _ in range(12):
        near = np.concatenate([np.argmin(_squared(x[i : i + 2048], c) + price, axis=1) for i in range(0, len(x), 2048)])
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[size > 0] = sums[size > 0] / size[size > 0][:, None]
        c[size == 0] = x[rng.integers(0, len(x), int((size == 0).sum()))]
        spread = ((x - c[near]) ** 2).sum(axis=1).mean()
        price = 0.5 * price + 0.1 * spread * (size / size.mean() - 1)
    degree = min(s.degree, k)
    graph = np.empty((k, degree), np.int64)
    for i in range(0, k, 1024):
        d = _squared(c[i : i + 1024], c)
        graph[i : i + 1024] = np.argsort(d, axis=1, kind="stable")[:, :degree]
    if k > degree:  # every third edge is a long one, so that walks leave their neighbourhood
        graph[:, 2::3] = rng.integers(0, k, graph[:, 2::3].shape)
    index.centroids, index.graph, index.entries = c, graph, rng.choice(k, min(k, 16), replace=False)
    return index


def spread_out(index: Index, ids: np.ndarray, dist: np.ndarray, s: Settings) -> np.ndarray:
    """Which of the nearest centroids of each row get an entry: the first, and those within the ratio that no chosen one is nearer to."""
    chosen = np.zeros(ids.shape, bool)
    chosen[:, 0] = True
    for k in range(1, ids.shape[1]):
        ok = (dist[:, k] <= dist[:, 0] * s.copy_ratio) & (chosen.sum(axis=1) < s.copies)
        for j in range(k):
            gap = index.centroids[ids[:, k]] - index.centroids[ids[:, j]]
            ok &= ~chosen[:, j] | (np.sqrt((gap * gap).sum(axis=1)) > dist[:, k] * s.apart)
        chosen[:, k] = ok
    return chosen


def probe_ratio(index: Index, sample: np.ndarray, k: int, s: Settings, queries: int = 256) -> float:
    """The ratio of distances within which lists hold ``recall`` of the ``k`` nearest of some sample vectors in the sample itself. The
    sample is sparser than the corpus, so its neighbours are farther and the ratio is on the safe side."""
    asked = sample[:: max(1, len(sample) // queries)]
    where = [index.nearest(index.lengthened(sample[i : i + 512]), 2 * s.copies, s.beam) for i in range(0, len(sample), 512)]
    ids, dist = (np.concatenate([w[j] for w in where]) for j in (0, 1))
    chosen = spread_out(index, ids, dist, s)
    to = np.sqrt(np.maximum(_squared(index.pointed(asked), index.centroids), 0))
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    need = [np.where(chosen[n], to[q][ids[n]], np.inf).min(axis=1) / max(to[q].min(), 1e-12) for q, n in enumerate(near)]
    return float(np.quantile(np.concatenate(need), s.recall)) if near.shape[1] else 1.0


def _vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (bytes of doubles) of the vectors that take part: of the commonest length, finite, not all zero."""
    v = F.col(f"`{vec_col}`")
    inf = F.lit(float("inf"))
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    kept = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    common = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = common[0]["n"] if common else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            flat = column(batch, "v").flatten().to_numpy().astype("<f8") + 0.0  # one form of zero
            m = flat.reshape(batch.num_rows, dims)
            yield {"id": column(batch, "id"), "vec": [r.tobytes() for r in m]}

    return map_arrow(kept.filter(F.size("v") == dims), run, "id long, vec binary")


def matrix(column_: pa.Array | pd.Series) -> np.ndarray:
    items = column_.to_pylist() if isinstance(column_, pa.Array) else list(column_)
    return np.frombuffer(b"".join(items), "<f8").reshape(len(items), -1) if items else np.zeros((0, 1))


def _best(q: np.ndarray, c: np.ndarray, ids: list[np.ndarray], k: int, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ``k`` ids with the largest inner products that reach its ``floor``, ties to the smaller id."""
    rough = q @ c.T
    for row, v, low in zip(rough, q, floor, strict=True):
        near = np.flatnonzero(row >= low - 1e-9 * max(1.0, abs(low))) if np.isfinite(low) else np.arange(len(c))
        if len(near) > k:
            least = np.partition(row[near], len(near) - k)[len(near) - k]
            near = near[row[near] >= least - 1e-9 * max(1.0, abs(least))]
        exact = (c[near] * v).sum(axis=1)
        near, exact = near[exact >= low], exact[exact >= low]
        if not len(near):
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        flat = np.concatenate([ids[i] for i in near])
        score = np.repeat(exact, [len(ids[i]) for i in near])
        order = np.lexsort((flat, -score))[:k]
        yield flat[order], score[order]


ROWS_AT_ONCE = 8192  # that a task hands on, whatever the number of lists


def in_runs(go: np.ndarray, run: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Row, run of lists, and the lists in it, of the marked lists of each row, some thousand of them at a time."""
    step = max(1, ROWS_AT_ONCE // -(-go.shape[1] // run))
    for lo in range(0, len(go), step):
        r, j = np.nonzero(go[lo : lo + step])
        if len(r):
            first = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(j // run) != 0)])
            yield r[first] + lo, j[first] // run, pa.ListArray.from_arrays(pa.array(np.r_[first, len(r)], pa.int32()), pa.array(j, pa.int32()))


def search(rows: DataFrame, is_query, k: int = 20, s: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets ``is_query`` (a condition on ``id``) its ``k`` nearest other ids by inner
    product, fewer only where there are fewer. Rows without a usable vector, or with a null id, are neither queries nor candidates.
    """
    spark = rows.sparkSession
    plain = frozen(_vectors(rows, id_col, vec_col), "vectors")
    # the k + 1 smallest ids of equal vectors are all that can be among the nearest of any query
    ranked = plain.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("n") <= k + 1)
    distinct = frozen(ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    n = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    dims = len(distinct.first()["vec"]) // 8

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"norm": np.linalg.norm(matrix(column(batch, "vec")), axis=1)} if batch.num_rows else {"norm": []}

    length = map_arrow(distinct.select("vec"), norms, "norm double").agg(F.max("norm")).first()[0]
    sample = matrix(pa.array([r["vec"] for r in distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(s.sample).collect()], pa.binary()))
    lists = min(max(s.least_lists, -(-n // s.per_list)), s.most_lists)
    index = fit(sample, lists, length, s)
    index.ratio = probe_ratio(index, sample, k, s)
    shared = spark.sparkContext.broadcast(index)  # most_lists centroids at most

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = shared.value.lengthened(matrix(column(part, "vec")))
                ids, dist = shared.value.nearest(x, 2 * s.copies, s.beam)
                r, j = np.nonzero(spread_out(shared.value, ids, dist, s))
                take = pa.array(r)
                yield {"list": ids[r, j], "vec": column(part, "vec").take(take), "ids": column(part, "ids").take(take)}

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The nearest lists of each vector where ``floor`` is null, else all further ones within the ratio, or all where it is infinite."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                floor = column(part, "floor")
                later = floor.is_valid().to_numpy(zero_copy_only=False)
                dist = np.sqrt(np.maximum(_squared(shared.value.pointed(matrix(column(part, "vec"))), shared.value.centroids), 0))
                first = np.argsort(dist, axis=1, kind="stable")[:, : s.least_probes]
                reach = np.where(np.isneginf(floor.fill_null(0.0).to_numpy()), np.inf, dist.min(axis=1) * shared.value.ratio)
                go = later[:, None] & (dist <= reach[:, None])
                np.put_along_axis(go, first, ~later[:, None], axis=1)
                for r, at, wanted in in_runs(go, run):
                    take = pa.array(r)
                    yield {"run": at, "vec": column(part, "vec").take(take), "floor": floor.take(take).fill_null(-np.inf), "lists": wanted}

    asked = plain.filter(is_query).distinct()
    run = max(1, min(s.run, lists // 16))
    posted = frozen(map_arrow(distinct, entries, "list int, vec binary, ids array<long>"), "postings").withColumn("run", F.floor(F.col("list") / run).cast("int"))
    blocks = lambda df, rows: df.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n"))
    cb = frozen(blocks(posted, s.block * 8).withColumnRenamed("n", "cn"), "blocks")  # one row for each run of lists
    place = lambda own: F.pmod(F.xxhash64("vec"), F.col(own)).cast("int")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"vec": [], "ids": [], "scores": []})
        c, ids, held = matrix(a["vec"]), [np.asarray(i) for i in a["ids"]], a["list"].to_numpy()
        q, vec, floor = matrix(b["vec"]), b["vec"].to_numpy(), b["floor"].to_numpy()
        wanted, who = np.concatenate(b["lists"].to_numpy()), np.repeat(np.arange(len(b)), b["lists"].map(len).to_numpy())
        out = []
        for at in np.unique(held):
            own, asked = np.flatnonzero(held == at), who[wanted == at]
            found = _best(q[asked], c[own], [ids[i] for i in own], k + 1, floor[asked])
            out += [(vec[w], *f) for w, f in zip(asked, found, strict=True) if len(f[0])]
        return pd.DataFrame({n: [o[i] for o in out] for i, n in enumerate(("vec", "ids", "scores"))})

    def visited(vectors: DataFrame, name: str) -> DataFrame:
        """vec, id, score of what the lists that ``vectors`` (vec, floor) ask for return."""
        asking = frozen(map_arrow(vectors, probes, "run int, vec binary, floor double, lists array<int>"), name)
        both = frozen(cb.join(blocks(asking, s.block).withColumnRenamed("n", "qn"), "run"), name + "-blocks")
        left = posted.join(both, "run").withColumn("c", place("cn")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))).select("run", "c", "q", "list", "vec", "ids")
        right = asking.join(both, "run").withColumn("q", place("qn")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cn") - 1))).select("run", "c", "q", "vec", "floor", "lists")
        found = left.groupBy("run", "c", "q").cogroup(right.groupBy("run", "c", "q")).applyInPandas(score, "vec binary, ids array<long>, scores array<double>")
        return found.select("vec", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("vec", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))

    order = [F.desc("score"), F.col("id")]
    ahead = F.row_number().over(Window.partitionBy("vec").orderBy(*order))
    top = lambda pairs: pairs.groupBy("vec", "id").agg(F.max("score").alias("score")).withColumn("n", ahead).filter(F.col("n") <= k + 1)
    vectors = asked.select("vec").distinct()
    nearby = frozen(top(visited(vectors.withColumn("floor", F.lit(None).cast("double")), "probes")), "nearby")
    last = nearby.filter(F.col("n") == k + 1).select("vec", F.col("score").alias("floor"))
    wider = visited(vectors.join(last, "vec", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "wider")
    near = top(nearby.drop("n").unionByName(wider))
    mine = asked.withColumnRenamed("id", "query_id").join(near.drop("n"), "vec").filter("id <> query_id")
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    assert dims > 0
    return mine.withColumn("rank", ranks).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
