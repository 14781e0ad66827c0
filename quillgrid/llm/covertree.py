"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are dealt to the nearest of at most ``CENTRES`` centres, farthest-first picks
of a bounded sample; what one centre holds beyond ``block_rows`` is split by hash.  Each
block's cover tree is built once and written, with its ball (centre and radius).

1. Every query visits the block whose ball promises most, which gives it a floor: the
   kth best score there.
2. For every query the balls of all other blocks are bounded by the largest inner
   product they allow, q.c + |q| r.  Blocks below the floor are pruned; neither they nor
   the query travel.  The rest are searched in groups of ``group_rows`` queries of one
   neighbourhood: both sides' trees are walked at once (Curtin and Ram 2014) and a pair of
   nodes is pruned when qc.rc + |qc| rr + |rc| rq + rq rr is below the worst floor in
   the query node.
3. What the visits give, k rows each, is merged by a ranked window.

Equal vectors are one point with its k + 1 smallest ids: by the tie rule no other
id of theirs can be among any query's best k, its own row left out.

Exact search has no index to give up: where vectors do not cluster (and in a small
table), nothing can be pruned, and the pairs are queries times rows.
:func:`search_report` says how many pairs were evaluated.

Defined cases: vectors that are null, or hold null or non-finite components, take
no part, as query or candidate; vectors meet only those of their own length; rows
that share the query's vec_id are its own row; repeated rows are one; null ids take no
part; fewer candidates than k give fewer rows; empty tables give none.  Components and
scores beyond 64 bits are the nearest end of that range, as in Spark's floor; sums are
exact before that.  Other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SCALE, K, BLOCK_ROWS, GROUP_ROWS, LEAF = 1024, 10, 16_384, 1_024, 64
#: Centres, and vectors they are picked from.
CENTRES, SAMPLE = 2_048, 8_192
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Tree:
    """A cover tree: nodes of one level are separated by, and cover their points
    within, the level's scale, which falls by half where 24 nodes can do that, else to
    what the 24 that are farthest apart cover.

    ``order`` lists the points so that every node is a range of it."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow()

    def _grow(self) -> None:
        todo = [(0, len(self.points), 0, -1)]
        while todo:  # no recursion: scales may fall slowly
            a, b, center, parent = todo.pop()
            node = len(self.center)
            own = self.order[a:b]
            reach = np.sqrt(((self.points[own] - self.points[center]) ** 2).sum(1))
            self.center.append(center)
            self.radius.append(float(reach.max()) * (1 + 1e-12))
            self.span.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= self.leaf or not reach.any():
                continue
            half = float(reach.max()) / 2
            near = reach.copy()
            heads, owner = [center], np.zeros(b - a, np.int64)
            while near.max() > half and len(heads) < 24:  # farthest first
                far = int(own[near.argmax()])
                d = np.sqrt(((self.points[own] - self.points[far]) ** 2).sum(1))
                closer = d < near
                owner[closer] = len(heads)
                near[closer] = d[closer]
                heads.append(far)
            self.order[a:b] = own[np.argsort(owner, kind="stable")]
            at = a
            for h, n in enumerate(np.bincount(owner, minlength=len(heads))):
                if n:
                    todo.append((at, at + int(n), heads[h], node))
                    at += int(n)


class _Best:
    """The best k (score, id) of each query so far."""

    def __init__(self, own: np.ndarray, k: int, only: np.ndarray, alone: np.ndarray):
        """``only``: the first id of each vector; ``alone``: that it has no other."""
        self.own, self.k, self.only, self.alone = own, k, only, alone
        self.score = np.full((len(own), k), _LOW)
        self.id = np.full((len(own), k), _HIGH)
        self.there = np.zeros((len(own), k), bool)
        self.floor = np.full(len(own), _LOW)

    def worst(self, q: np.ndarray) -> int:
        """The least score that may still count for some of the queries."""
        return np.maximum(self.floor[q], self.score[q, -1]).min()

    def offer(self, q: np.ndarray, scores: np.ndarray, r: np.ndarray, ids: list[np.ndarray]) -> None:
        worst = np.maximum(self.floor[q], self.score[q, -1])
        for row in np.flatnonzero((scores >= worst[:, None]).any(1)):
            i = q[row]
            # the query's own row takes no place among the k
            hit = np.flatnonzero((scores[row] >= worst[row]) & ~(self.alone[r] & (self.only[r] == self.own[i])))
            if not len(hit):
                continue
            if len(hit) > self.k:  # the k best distinct vectors, and all that tie with the last
                cut = np.partition(scores[row][hit], -self.k)[-self.k]
                hit = hit[scores[row][hit] >= cut]
            some = [ids[j] for j in r[hit]]
            new = np.concatenate(some)
            s = np.repeat(scores[row][hit], [len(x) for x in some])
            there = new != self.own[i]
            s, new = np.concatenate([self.score[i], s[there]]), np.concatenate([self.id[i], new[there]])
            real = np.concatenate([self.there[i], np.ones(int(there.sum()), bool)])
            top = np.lexsort((new, ~s, ~real))[: self.k]  # ~s: -s - 1, which never overflows
            self.score[i], self.id[i], self.there[i] = s[top], new[top], real[top]


class Points:
    """The distinct vectors of a block, the k + 1 least ids of each, and their tree."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int):
        order = np.lexsort((ids, *points.T[::-1])) if points.shape[1] else np.argsort(ids)
        first = np.append(True, (points[order][1:] != points[order][:-1]).any(1))
        cut = np.append(np.flatnonzero(first), len(order))
        self.same = [np.unique(ids[order[a:b]])[: k + 1] for a, b in zip(cut, cut[1:], strict=False)]
        self.vectors = points[order[first]]
        self.tree = Tree(self.vectors.astype(float))


def _products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products, at the ends of 64 bits where they are beyond."""
    wide = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(r.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if wide < 2**52:
        return (q.astype(float) @ r.astype(float).T).astype(np.int64)
    if wide < 2**62:
        return q @ r.T
    return np.clip(q.astype(object) @ r.astype(object).T, _LOW, _HIGH).astype(np.int64) if q.shape[1] else np.zeros((len(q), len(r)), np.int64)


def search(queries: np.ndarray, own: np.ndarray, held: Points, k: int = K, floor: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(query id, id, score) of each query's best k in a block, but those below its
    ``floor``; and the number of pairs whose product was taken."""
    if not len(queries) or not len(held.vectors):
        return [], 0
    r_tree, same = held.tree, held.same
    q_tree = Tree(queries.astype(float))
    q_norm, r_norm = (np.sqrt((x.points**2).sum(1)) for x in (q_tree, r_tree))
    best = _Best(own, k, np.array([x[0] for x in same]), np.array([len(x) == 1 for x in same]))
    if floor is not None:
        best.floor = floor

    def bound(a: int, nodes: list[int]) -> np.ndarray:
        qc, rc = q_tree.center[a], [r_tree.center[b] for b in nodes]
        rr, rq = np.array([r_tree.radius[b] for b in nodes]), q_tree.radius[a]
        most = q_norm[qc] * rr + r_norm[rc] * rq + rq * rr
        return r_tree.points[rc] @ q_tree.points[qc] + most + _room(q_norm[qc] * r_norm[rc] + most)

    todo, evaluated = [(0, 0, float("inf"))], 0
    while todo:
        a, b, most = todo.pop()
        if most < float(best.worst(q_tree.order[slice(*q_tree.span[a])])):
            continue
        down_q, down_r = q_tree.children[a], r_tree.children[b]
        if not down_q and not down_r:
            q, r = q_tree.order[slice(*q_tree.span[a])], r_tree.order[slice(*r_tree.span[b])]
            best.offer(q, _products(queries[q], held.vectors[r]), r, same)
            evaluated += len(q) * len(r)
            continue
        if down_r and (not down_q or r_tree.radius[b] >= q_tree.radius[a]):
            pairs = [(a, x, m) for x, m in zip(down_r, bound(a, down_r), strict=True)]
        else:
            pairs = [(x, b, float(bound(x, [b])[0])) for x in down_q]
        todo += sorted(pairs, key=lambda p: p[2])  # the most promising is taken next
    return [(int(own[i]), int(best.id[i, j]), int(best.score[i, j])) for i in range(len(own)) for j in range(k) if best.there[i, j]], evaluated


def _room(size):
    """Room for rounding, by the size of what is summed."""
    return 1e-9 * size + 1e-6


def whole_numbers(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with v = floor(scale * component), of the vectors that take part."""
    usable = f"vec_id is not null and {column} is not null and not exists({column}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return vectors.where(usable).select("vec_id", F.expr(f"transform({column}, x -> cast(floor({scale} * cast(x as double)) as long))").alias("v"))


def _centres(vectors: DataFrame, block_rows: int) -> dict[int, np.ndarray]:
    """Centres by vector length: farthest-first picks among ``SAMPLE`` vectors, those
    with the least hash of their id."""
    n = vectors.count()
    want = int(min(CENTRES, max(1, -(-2 * n // block_rows))))
    some = vectors.select("v").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id", "v").limit(min(SAMPLE, 8 * want)).collect() if n else []
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r.v), []).append(r.v)
    out = {}
    for d, vs in by_size.items():
        x = np.array(vs, dtype=float).reshape(len(vs), d)
        heads = [0]
        near = ((x - x[0]) ** 2).sum(1)
        while len(heads) < want and near.max() > 0:
            heads.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[heads[-1]]) ** 2).sum(1))
        out[d] = x[heads]
    return out


def _arrays(table) -> tuple[np.ndarray, np.ndarray]:
    n = table.num_rows
    flat = pa.concat_arrays([x.flatten() for x in table.column("v").chunks]) if table.column("v").num_chunks else pa.array([], pa.int64())
    return table.column("vec_id").to_numpy().astype(np.int64), flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1 if n and len(flat) else 0)


def _nearest(centres: dict[int, np.ndarray], own: np.ndarray) -> tuple[int, float]:
    at = centres.get(len(own))
    if at is None:  # a length that the sample has not: one ball about zero
        return 0, float(np.sqrt((own**2).sum()))
    far = ((at - own) ** 2).sum(1)
    return int(far.argmin()), float(np.sqrt(far.min()))


def _visits(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int, group_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of all visits, and a row (null, null, pairs) of each."""
    spark = vectors.sparkSession
    vectors, queries = c.staged(vectors.select("vec_id", "v"), "vectors"), c.staged(queries.select("vec_id", "v"), "queries")
    centres = _centres(vectors, block_rows)

    def assign(batches):
        for batch in batches:
            own = [_nearest(centres, np.array(v, float)) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([len(v) for v in batch.column("v").to_pylist()], pa.int32()), pa.array([x[0] for x in own], pa.int32()), pa.array([x[1] for x in own], pa.float64())], names=["vec_id", "v", "d", "ball", "away"])

    dealt = c.staged(vectors.mapInArrow(assign, "vec_id long, v array<long>, d int, ball int, away double"), "dealt")
    # a row for each ball: at most CENTRES for each length in the sample, one for others
    balls = {(r.d, r.ball): (r.n, r.radius) for r in dealt.groupBy("d", "ball").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    subs = {key: -(-n // block_rows) for key, (n, _) in balls.items()}
    table = spark.createDataFrame([(d, b, s) for (d, b), s in subs.items()] or [(-1, 0, 1)], "d int, ball int, subs long")
    split = dealt.join(F.broadcast(table), ["d", "ball"]).select("d", "ball", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("subs")).cast("int").alias("sub"), "vec_id", "v")

    def build(key, rows):
        ids, points = _arrays(rows)
        return pa.table([pa.array([x.as_py()], pa.int32()) for x in key] + [pa.array([pickle.dumps(Points(points, ids, k), protocol=5)], pa.binary())], names=["d", "ball", "sub", "tree"])

    trees = c.staged(split.groupBy("d", "ball", "sub").applyInArrow(build, "d int, ball int, sub int, tree binary"), "trees")
    by_size: dict[int, list] = {}
    for (d, b), (n, radius) in sorted(balls.items()):
        center = centres[d][b] if d in centres else np.zeros(d)
        by_size.setdefault(d, []).append((b, n, radius, center))
    books = {d: (np.array([x[0] for x in xs]), np.array([x[1] for x in xs]), np.array([x[2] for x in xs]), np.array([x[3] for x in xs]).reshape(len(xs), d)) for d, xs in by_size.items()}

    def promise(v: np.ndarray):
        ball, n, radius, center = books[len(v)]
        norm = np.sqrt((v**2).sum())
        most = norm * radius
        return ball, center @ v + most + _room(norm * np.sqrt((center**2).sum(1)) + most)

    groups = max(1, -(-queries.count() // group_rows))

    def plan(first: bool):
        """The blocks to visit: the most promising one, or all others not below the floor."""

        def run(batches):
            for batch in batches:
                rows = []
                floors = [None] * batch.num_rows if first else batch.column("floor").to_pylist()
                for i, v, floor in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), floors, strict=True):
                    v_ = np.array(v, float)
                    if len(v) not in books:
                        continue
                    ball, most = promise(v_)
                    top, sub = int(most.argmax()), 0
                    visited = (int(ball[top]), int(c.mix_int(i) % subs[len(v), int(ball[top])]))
                    if first:
                        rows.append((len(v), *visited, i, v, None))
                        continue
                    for b in ball[most >= (-np.inf if floor is None else floor)].tolist():
                        rows += [(len(v), b, sub, i, v, floor) for sub in range(subs[len(v), b]) if (b, sub) != visited]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["d", "ball", "sub", "vec_id", "v", "floor"])

        return run

    def visit(q, held):
        names = ["query_id", "vec_id", "score", "pairs"]
        own, points = _arrays(q)
        floor = np.array([_LOW if x is None else x for x in q.column("floor").to_pylist()], np.int64)
        found, pairs = ([], 0) if not held.num_rows else search(points, own, pickle.loads(held.column("tree")[0].as_py()), k, floor)
        found = [(*x, None) for x in found] + ([(None, None, None, pairs)] if len(own) else [])
        return pa.table([pa.array([x[j] for x in found], pa.int64()) for j in range(4)], names=names)

    def visited(planned: DataFrame) -> DataFrame:
        # queries of one neighbourhood share a group; only trees that a group asks for travel
        asked = c.staged(planned.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "asked")
        key = ["d", "ball", "sub", "g"]
        block = trees.select(*(F.col(x).alias(f"of_{x}") for x in key[:3]), "tree")
        wanted = asked.select(*(F.col(x).alias(f"of_{x}") for x in key)).distinct().join(block, [f"of_{x}" for x in key[:3]])
        return c.staged(asked.groupBy(*key).cogroup(wanted.groupBy(*(f"of_{x}" for x in key))).applyInArrow(visit, "query_id long, vec_id long, score long, pairs long"), "visits")

    schema = "d int, ball int, sub int, vec_id long, v array<long>, floor long"
    one = visited(queries.mapInArrow(plan(True), schema))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floor = one.where("query_id is not null").distinct().withColumn("at", F.row_number().over(by)).where(F.col("at") == k).select("query_id", F.col("score").alias("floor"))
    rest = visited(queries.join(floor, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "floor").mapInArrow(plan(False), schema))
    return one.union(rest)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): both sides (vec_id, v)."""
    return _ranked(_visits(vectors, queries, k, block_rows, group_rows), k)


def _ranked(visits: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = visits.where("query_id is not null").select("query_id", "vec_id", "score").distinct()
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, int, int]:
    """:func:`top_k`, the pairs whose product was taken, and all pairs."""
    visits = _visits(vectors, queries, k, block_rows, group_rows)
    done = visits.agg(F.sum("pairs")).first()[0] or 0
    return _ranked(visits, k), done, vectors.count() * queries.count()


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(c.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
