"""Exact top-k search by inner product with M-trees.

Inner products become distances: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest points. Equal vectors are stored
once, with their smallest ids (as many as can matter). Vectors are dealt to shards by the nearest of a few
pivots; those of a pivot with many vectors go by the nearest of its own second pivots, so a shard has a ball of
its own, and only what these don't part goes by a hash. Each shard is an M-tree of pages; a page keeps for
each entry its distance to the page's routing object, and for each subtree its covering radius.

A query first searches its home shard best-first; the k-th score found there bounds every other one, and it
goes on to those shards only whose covering ball can hold a better point. A tree goes to a task only with
queries that ask for it, once for each ``BLOCK`` of them; these walk its pages together, nearest page first,
each query only where its own bounds let it. An entry whose stored distance already rules it out for a query by
the triangle inequality gives that query no candidate and no page.

Pivots are chosen from at most ``SAMPLE`` vectors; every vector is indexed and the search is exact.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, saved, task_shares

#: Vectors that choose pivots; pivots at most; distinct vectors of a shard on average, or more if there were
#: more than ``SHARDS`` shards (each shard's centre goes with the tasks that route queries); entries of a page.
SAMPLE, PIVOTS, SHARD, SHARDS, PAGE = 4_096, 256, 4_096, 65_536, 64
#: Queries that search a shard in one task.
BLOCK = 2_000
#: Bytes of all shards' centres, which routing tasks hold; bytes of distances of queries to centres at a time.
CENTRES, ROUTING = 128 << 20, 32 << 20
#: Vectors that Python works on at a time.
PIECE = 4_000
#: Below such sums, products of whole numbers are exact in floating point.
EXACT = float(1 << 53)
#: Relative room for rounding in squared distances, and in distances near 0.
SLACK, ROOM = 1e-9, 1e-6


def quantised(column: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def lifted(x: np.ndarray, m: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(m * m - (x * x).sum(1), 0))[:, None]], 1)


class Tree:
    """Pages of an M-tree over lifted vectors, built from the top by nearest routing objects."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], m: float, page: int = PAGE):
        self.m, self.ids, self.ints = m, ids, np.asarray(x, np.int64)
        y = lifted(self.ints.astype(float), m)
        self.repeats = sum(map(len, ids)) != len({i for x in ids for i in x})  # an id with several vectors
        self.pages: list[dict] = []
        rng = np.random.default_rng(7)
        self.centre = y.mean(0)
        self.radius = float(np.sqrt(((y - self.centre) ** 2).sum(1).max())) if len(y) else 0.0
        if len(y):
            self._build(y, np.arange(len(y)), self.centre, page, rng)

    def _build(self, y: np.ndarray, rows: np.ndarray, centre: np.ndarray, page: int, rng: np.random.Generator) -> int:
        at = len(self.pages)
        self.pages.append({})
        if len(rows) <= page:
            self.pages[at] = {"leaf": True, "rows": rows, "parent": np.sqrt(((y[rows] - centre) ** 2).sum(1))}
            return at
        fan = min(16, -(-len(rows) // (page // 2)))
        seeds = [y[rows[rng.integers(len(rows))]]]
        near = ((y[rows] - seeds[0]) ** 2).sum(1)
        while len(seeds) < fan and near.max() > 0:
            seeds.append(y[rows[near.argmax()]])
            near = np.minimum(near, ((y[rows] - seeds[-1]) ** 2).sum(1))
        for _ in range(2):
            owner = np.stack([((y[rows] - s) ** 2).sum(1) for s in seeds], 1).argmin(1)
            seeds = [y[rows[owner == k]].mean(0) if (owner == k).any() else s for k, s in enumerate(seeds)]
        parts = [rows[owner == k] for k in range(len(seeds))]
        if max(map(len, parts)) == len(rows):  # points that seeds don't part
            parts = np.array_split(rows, fan)
            seeds = [y[p].mean(0) for p in parts]
        kept = [(s, p) for s, p in zip(seeds, parts) if len(p)]
        centres = np.stack([s for s, _ in kept])
        self.pages[at] = {
            "leaf": False,
            "centres": centres,
            "radii": np.array([np.sqrt(((y[p] - s) ** 2).sum(1).max()) for s, p in kept]),
            "parent": np.sqrt(((centres - centre) ** 2).sum(1)),
            "children": [self._build(y, p, s, page, rng) for s, p in kept],
        }
        return at

    def search(self, queries: np.ndarray, k: int, floors: list[int | None]) -> list[list[tuple[int, int]]]:
        """Of each query its k best (score, id), each id once, ties to smaller ids; with a floor, only scores of at least that."""
        best: list[dict[int, int]] = [{} for _ in floors]
        if not self.pages or not floors:
            return [[] for _ in floors]
        ints = np.asarray(queries, np.int64)
        lq = np.concatenate([ints.astype(float), np.zeros((len(ints), 1))], 1)
        own = (lq * lq).sum(1)
        norm = own + self.m * self.m
        least = np.iinfo(np.int64).min
        low = np.array([least if x is None else x for x in floors], np.int64)  # scores below can't matter
        exact = float(np.sqrt(own.max())) * self.m < EXACT / 2

        def reach(rows: np.ndarray) -> np.ndarray:
            """Largest distance at which a point can still matter to each query."""
            far = np.sqrt(np.maximum(norm[rows] - 2 * low[rows].astype(float), 0) + SLACK * (norm[rows] + 1))
            return np.where(low[rows] == least, np.inf, far)

        def far_from(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
            part = lq[rows]
            return np.sqrt(np.maximum(own[rows][:, None] - 2 * part @ points.T + (points * points).sum(1), 0))

        everyone = np.arange(len(floors))
        first = far_from(everyone, self.centre[None, :])[:, 0]
        bounds = np.maximum(0.0, first - self.radius)
        queue, number = [(float(bounds.min()), 0, 0, everyone, bounds, first)], 0
        while queue:
            _, _, at, rows, bounds, to_centre = heapq.heappop(queue)
            limit = reach(rows)
            on = bounds <= limit
            if not on.any():
                continue
            rows, limit, page = rows[on], limit[on], self.pages[at]
            room = ROOM * np.sqrt(norm[rows] + 1)
            ruled_in = np.abs(to_centre[on][:, None] - page["parent"]) - room[:, None]
            if page["leaf"]:
                ask = ruled_in <= limit[:, None]
                some = np.flatnonzero(ask.any(0))
                entries = self.ints[page["rows"][some]]
                scores = np.rint(lq[rows, :-1] @ entries.T.astype(float)).astype(np.int64) if exact else ints[rows] @ entries.T
                floor = low[rows]
                if len(some) > k and not self.repeats:  # below the k-th of this page nothing can matter
                    floor = np.maximum(floor, np.partition(np.where(ask[:, some], scores, least), -k, 1)[:, -k])
                i, j = np.nonzero(ask[:, some] & (scores >= floor[:, None]))
                for query, row, score in zip(rows[i].tolist(), page["rows"][some][j].tolist(), scores[i, j].tolist()):
                    if score >= low[query]:
                        low[query] = self._offer(best[query], score, self.ids[row], k, low[query])
                continue
            for j in np.flatnonzero((ruled_in - page["radii"] <= limit[:, None]).any(0)).tolist():
                own_rows = np.flatnonzero(ruled_in[:, j] - page["radii"][j] <= limit)
                far = far_from(rows[own_rows], page["centres"][j][None, :])[:, 0]
                bound = np.maximum(0.0, far - page["radii"][j] - room[own_rows])
                near = bound <= limit[own_rows]
                if near.any():
                    number += 1
                    heapq.heappush(queue, (float(bound[near].min()), number, page["children"][j], rows[own_rows][near], bound[near], far[near]))
        return [sorted(((s, i) for i, s in found.items()), key=lambda r: (-r[0], r[1])) for found in best]

    @staticmethod
    def _offer(found: dict[int, int], score: int, ids: list[int], k: int, low: int) -> int:
        """Takes ids (ascending) at such a score into the k best; the least score that still matters."""
        for i in ids:
            if found.get(i, score - 1) >= score:
                continue
            if i not in found and len(found) == k:
                worst = min(found, key=lambda x: (found[x], -x))
                if (score, -i) <= (found[worst], -worst):
                    break  # ids ascend
                del found[worst]
            found[i] = score
        return max(low, min(found.values())) if len(found) == k else low


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of so many numbers; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


def pivots_of(x: np.ndarray, count: int) -> np.ndarray:
    """Rows far from one another."""
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def top_k(table: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by every.

    Candidates are all rows but the query's own. Vectors that are null or hold null or non-finite components
    and rows without id take no part; the product of vectors of unlike length is that of their common part;
    repeated rows are one candidate; an id with several vectors is one candidate and one query, whose score is
    the best of their products; ids are whole numbers (text that isn't one fails the job); no query or no other
    row gives no rows. Extra columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(vector).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = saved(rows.distinct(), "vectors")
    # of equal vectors, the k + 1 smallest ids can matter; the limit holds before the shuffle too
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    points = saved(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    n, width, m2 = points.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()
    if not n:
        return empty
    m = float(np.sqrt(m2 or 0))
    shard_rows = max(shard_rows, n // max(1, min(SHARDS, CENTRES // (8 * (width + 1)))))
    sample = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow().column("v").combine_chunks()
    sample = _matrix(sample, width).astype(float)
    lifted_sample = lifted(sample, m)
    pivots = pivots_of(lifted_sample, max(1, min(PIVOTS, -(-n // shard_rows))))
    second: dict[int, np.ndarray] = {}

    def nearest(y: np.ndarray, points: np.ndarray) -> np.ndarray:
        return ((y * y).sum(1)[:, None] - 2 * y @ points.T + (points * points).sum(1)).argmin(1)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            if batch.num_rows:
                y = lifted(_matrix(batch.column(0), width).astype(float), m)
                near = nearest(y, pivots)
                inner = np.zeros(len(near), np.int64)
                for p in set(near.tolist()) & set(second):
                    inner[near == p] = nearest(y[near == p], second[p])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(inner, pa.int32())], names=[*batch.schema.names, "pivot", "second"])

    dealt = points.mapInArrow(home, "v array<long>, ids array<long>, pivot int, second int")
    # a pivot with the vectors of several shards has as many second pivots, from its part of the sample
    many = {r.pivot: -(-r["count"] // shard_rows) for r in dealt.groupBy("pivot").count().collect() if r["count"] > 2 * shard_rows}
    owner = nearest(lifted_sample, pivots)
    second |= {p: pivots_of(lifted_sample[owner == p], parts) for p, parts in many.items() if (owner == p).any()}
    dealt = saved(points.mapInArrow(home, "v array<long>, ids array<long>, pivot int, second int"), "dealt")
    cells = sorted(((r.pivot, r.second), -(-r["count"] // (2 * shard_rows))) for r in dealt.groupBy("pivot", "second").count().collect())
    starts = np.cumsum([0] + [x for _, x in cells]).tolist()
    places = spark.createDataFrame([(p, i, start, parts) for ((p, i), parts), start in zip(cells, starts)], "pivot int, second int, start int, parts int")
    # at most SHARDS and PIVOTS rows together
    dealt = dealt.join(F.broadcast(places), ["pivot", "second"])
    shard = F.col("start") + F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, ids = None, [], []

        def tree() -> pa.RecordBatch:
            t = Tree(np.concatenate(x), ids, m)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([t.centre.tolist()], pa.list_(pa.float64())), pa.array([t.radius]), pa.array([pickle.dumps(t, 5)], pa.binary())], names=["shard", "centre", "radius", "tree"])

        for batch in pieces(batches, PIECE):
            shards = batch.column(2).to_numpy()
            matrix, lists = _matrix(batch.column(0), width), batch.column(1).to_pylist()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for part in np.split(np.arange(len(shards)), cuts):
                if not len(part):
                    continue
                if at is not None and shards[part[0]] != at:
                    yield tree()
                    x, ids = [], []
                at = int(shards[part[0]])
                x.append(matrix[part])
                ids += [lists[i] for i in part.tolist()]
        if ids:
            yield tree()

    trees = dealt.select("v", "ids", shard.alias("shard")).repartition(task_shares(table), "shard").sortWithinPartitions("shard")
    trees = saved(trees.mapInArrow(build, "shard int, centre array<double>, radius double, tree binary"), "trees")
    roots = trees.select("shard", "centre", "radius").orderBy("shard").toArrow()  # a row for each shard
    root_ids = roots.column("shard").to_numpy()
    # sent once to each executor: CENTRES bytes at most
    balls = spark.sparkContext.broadcast((np.array(roots.column("centre").to_pylist()), roots.column("radius").to_numpy(), root_ids))
    step = max(1, ROUTING // (8 * len(root_ids)))

    asked = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    keys = saved(asked.groupBy("v").agg(F.min("vec_id").alias("key")), "keys")

    def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
        q = np.concatenate([v.astype(float), np.zeros((len(v), 1))], 1)
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ centres.T + (centres * centres).sum(1), 0))

    def to_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii, ids = balls.value
        for batch in pieces(batches, min(PIECE, step)):
            if batch.num_rows:
                d = distances(_matrix(batch.column(0), width), centres) - radii
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(ids[d.argmin(1)], pa.int32()), pa.nulls(batch.num_rows, pa.int64())], names=["key", "v", "shard", "floor"])

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii, ids = balls.value
        for batch in pieces(batches, min(PIECE, step)):
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(0), width)
            own = distances(v, centres)
            floors = batch.column(3).to_numpy(zero_copy_only=False)
            norm = (v.astype(float) ** 2).sum(1) + m * m
            reach = np.where(np.isnan(floors.astype(float)), np.inf, np.sqrt(np.maximum(norm - 2 * floors.astype(float), 0) + SLACK * (norm + 1)))
            go = (own - radii <= reach[:, None]) & (ids[None, :] != batch.column(2).to_numpy()[:, None])
            i, j = np.nonzero(go)
            for a in range(0, len(i), PIECE):  # a query may go to every shard
                x, y = i[a : a + PIECE], j[a : a + PIECE]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(x)), batch.column(0).take(pa.array(x)), pa.array(ids[y], pa.int32()), batch.column(3).take(pa.array(x))], names=["key", "v", "shard", "floor"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, asked = None, ([], [], [])  # keys, vectors, floors of the block so far

        def answers() -> pa.RecordBatch:
            keys, vectors, floors = asked
            q = np.zeros((len(keys), width), np.int64)
            for i, v in enumerate(vectors):
                q[i, : len(v)] = v
            found = tree.search(q, k + 1, floors)
            flat = [(key, s, i) for key, best in zip(keys, found) for s, i in best]
            for x in asked:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[2] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64())], names=["key", "vec_id", "score"])

        for batch in pieces(batches, PIECE):
            for row in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if row[3] is not None:  # the block's tree comes before its queries
                    if asked[0]:
                        yield answers()
                    tree = pickle.loads(row[3])
                    continue
                for column, x in zip(asked, row):
                    column.append(x)
                if len(asked[0]) >= 2 * BLOCK:
                    yield answers()
        if asked[0]:
            yield answers()

    plan = "key long, v array<long>, shard int, floor long"

    def searched(queries: DataFrame) -> DataFrame:
        """key, vec_id, score: the queries' best of the shards they ask for. A shard's tree comes once for each block of its queries."""
        queries = saved(queries, "asked")
        blocks = queries.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each shard
        queries = queries.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        pages = trees.join(F.broadcast(blocks), "shard").select(F.lit(None).cast("long").alias("key"), F.lit(None).cast("array<long>").alias("v"), "shard", F.lit(None).cast("long").alias("floor"), "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        both = queries.select("key", "v", "shard", "floor", F.lit(None).cast("binary").alias("tree"), "block").unionByName(pages)
        both = both.repartition(task_shares(table), "shard", "block").sortWithinPartitions("shard", "block", F.col("tree").isNull())
        return both.select("key", "v", "floor", "tree").mapInArrow(find, "key long, vec_id long, score long")

    homes = saved(keys.mapInArrow(to_home, plan), "homes")
    found = at_home = saved(searched(homes), "home")
    if len(root_ids) > 1:
        # a full list's last score bounds what else can matter
        bound = at_home.groupBy("key").agg(F.when(F.count("*") == k + 1, F.min("score")).alias("floor"))
        rest = homes.drop("floor").join(bound, "key").select("v", "key", "shard", "floor").mapInArrow(to_others, plan)
        found = found.unionAll(searched(rest))
    order = lambda by: Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(order("key"))).where(F.col("n") <= k + 1).select("key", F.col("vec_id").alias("i"), "score")
    query = asked.join(keys, "v").select(F.col("vec_id").alias("query_id"), "key")
    out = query.join(best, "key").where(F.col("i") != F.col("query_id")).groupBy("query_id", F.col("i").alias("vec_id")).agg(F.max("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
