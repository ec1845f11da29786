"""Exact top-k inner-product search by pivot-table elimination.

The pivot table holds each vector's distances to the pivots, computed once. |q - x| is at least the greatest
|d(q, p) - d(x, p)| over the pivots p, so q.x is at most (q.q + x.x - bound^2) / 2. Candidates stand in blocks by their
nearest pivot; the least and greatest distances of a block bound all of it. A query first searches a block of its own
cell, which gives it a k-th score, and then only the blocks whose bound reaches that score; in a block it scores
candidates in the order of their bounds until these fall below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, shuffle_partitions, written

PIVOTS = 32
PIVOT_SAMPLE = 1024
#: Rows of a block, on average at most; a task holds one block and a batch of queries.
CANDIDATE_ROWS = 8192
#: Blocks whose bounds a task holds at a time.
BLOCKS_AT_A_TIME = 1 << 16
_LONG = (1 << 63) - 1


def integer_vector(c: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double, at the nearest long where it fits none; null if the vector or a
    component is null or not finite."""
    v = F.transform(F.col(c), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(F.col(c).isNotNull() & ~bad, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)))


def spread_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n vectors of the sample, each the farthest from those before it."""
    if len(sample) == 0:
        return sample
    x = sample.astype(np.float64)
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _products(q: np.ndarray, c: np.ndarray):
    """A function (candidate rows, query row) -> their exact integer inner products, or the nearest longs."""
    reach = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if reach < 2.0**53 else np.int64 if reach < 2.0**62 else object
    qk, ck = q.astype(kind), c.astype(kind)
    if kind is object:
        return lambda rows, i: np.array([max(-_LONG - 1, min(_LONG, v)) for v in ck[rows] @ qk[i]], np.int64)
    return lambda rows, i: (ck[rows] @ qk[i]).astype(np.int64)


def search_block(q_own, q, qd, qq, floor, c_ids, c_own, c, cd, cc, k):
    """The k best candidates of this block for each query as (query index, candidate index, score) arrays.

    qd and cd are distances to the pivots, qq and cc squared lengths, ``floor`` the score that a query's k-th is known
    to reach; a candidate whose ``own`` number is the query's is the query itself. Candidates are scored in order of their limit until it falls below the k-th score or the floor.
    """
    score, cd = _products(q, c), np.ascontiguousarray(cd.T)
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        bound = np.zeros(len(c))
        for p in range(len(cd)):
            np.maximum(bound, np.abs(cd[p] - qd[i, p]), out=bound)
        limit = (qq[i] + cc - bound * bound) / 2 + 1e-9 * (qq[i] + cc) + 1
        some = np.nonzero((limit >= floor[i]) & (c_own != q_own[i]))[0]
        order = some[np.argsort(-limit[some], kind="stable")]
        best_c, best_s, at, step = np.zeros(0, np.int64), None, 0, 64
        while at < len(order) and (len(best_c) < k or limit[order[at]] >= best_s[-1]):
            rows = order[at : at + step]
            at, step = at + step, min(2 * step, 4096)
            cand, found = np.concatenate([best_c, rows]), score(rows, i)
            found = found if best_s is None else np.concatenate([best_s, found])
            top = np.lexsort((c_ids[cand], ~found))[:k]  # ~: descending, for the least long too
            best_c, best_s = cand[top], found[top]
        if len(best_c):
            out_q.append(np.full(len(best_c), i))
            out_c.append(best_c)
            out_s.append(best_s)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s))


_TABLE = "vec_id long, unnamed boolean, own long, row long, vector array<long>, dim int, cell int, norm double, dist array<double>"


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id (a null one, ``unnamed``, as the largest long), own, row, vector, its length ``dim``, the nearest pivot ``cell``, the squared length and all distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(4).value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.nonzero(dims == dim)[0]))
                x = part.column(4).flatten().to_numpy().reshape(part.num_rows, dim).astype(np.float64)
                d = _distances(x, pivots.get(int(dim), np.zeros((1, dim))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.reshape(-1)))
                yield batch(vec_id=part.column(0), unnamed=part.column(1), own=part.column(2), row=part.column(3), vector=part.column(4), dim=pa.array(np.full(len(x), dim, np.int32)), cell=pa.array(d.argmin(axis=1).astype(np.int32)), norm=pa.array((x * x).sum(axis=1)), dist=lists)

    named = F.coalesce(F.col("vec_id").cast("long"), F.lit(_LONG)).alias("vec_id")
    return vectors.select(named, F.col("vec_id").isNull().alias("unnamed"), F.col("own").cast("long").alias("own"), F.monotonically_increasing_id().alias("row"), F.col("vector").cast("array<long>").alias("vector")).mapInArrow(run, _TABLE)


def search_blocks(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, row, vec_id, unnamed, score): the k best of each block for each of its queries. ``rows`` has the columns of the
    pivot table, ``block``, ``kind`` (0: candidate, 1: query) and ``floor``. A task holds one block's candidates, which
    come first, and takes its queries as they come."""
    ready = rows.repartition(shuffle_partitions(rows.sparkSession), "block").sortWithinPartitions("block", "kind").select("block", "kind", "vec_id", "unnamed", "own", "row", "norm", "floor", "vector", "dist")

    def arrays(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        n = t.num_rows
        lists = [t.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0)) for c in ("vector", "dist")]
        return [t.column(c).to_numpy() for c in ("vec_id", "unnamed", "own", "row", "norm", "floor")] + lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            keys = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            edges = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                at, kind = divmod(int(keys[a]), 2)
                if at != now:
                    now, held, block = at, [], None
                if kind == 0:
                    held.append(b.slice(a, z - a))
                elif held or block:
                    block, held = block or arrays(held), []
                    c_ids, unnamed, c_own, _, cc, _, c, cd = block
                    q_ids, _, q_own, q_rows, qq, floor, q, qd = arrays([b.slice(a, z - a)])
                    i, j, s = search_block(q_own, q, qd, qq, floor, c_ids, c_own, c, cd, cc, k)
                    if len(i):
                        yield batch(query_id=pa.array(q_ids[i]), row=pa.array(q_rows[i]), vec_id=pa.array(c_ids[j]), unnamed=pa.array(unnamed[j]), score=pa.array(s))

    return ready.mapInArrow(run, "query_id long, row long, vec_id long, unnamed boolean, score long")


def _blocks_to_search(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows of queries, which have ``first`` (the block searched already) and ``floor``, once for each other block
    whose bound reaches the floor. BLOCKS_AT_A_TIME bounds at most reach the driver and a task at once."""
    spark, out, start = queries.sparkSession, None, 0
    last = bounds.agg(F.max("block")).first()[0]
    while start <= last:
        some = bounds.where(F.col("block").between(start, start + BLOCKS_AT_A_TIME - 1)).orderBy("block").toArrow()
        by_dim: dict[int, tuple] = {}
        dims = some["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            t = some.filter(pa.array(dims == dim))
            near, far = (np.array(t[c].to_pylist(), dtype=np.float64).reshape(t.num_rows, -1) for c in ("near", "far"))
            by_dim[dim] = t["block"].to_numpy(), near, far, t["longest"].to_numpy()
        shared = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for dim, norm, floor, first, dist in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                    if dim not in shared.value:
                        out.append([])
                        continue
                    block, near, far, longest = shared.value[dim]
                    d = np.array(dist)[None]
                    gap = np.maximum(near - d, d - far).max(axis=1, initial=0.0)
                    limit = (norm + longest - gap * gap) / 2 + 1e-9 * (norm + longest) + 1
                    out.append(block[(limit >= floor) & (block != first)].tolist())
                yield batch(row=b.column(0), blocks=pa.array(out, pa.list_(pa.int64())))

        chosen = queries.select("row", "dim", "norm", "floor", "first", "dist").mapInArrow(run, "row long, blocks array<long>")
        more = queries.join(chosen.select("row", F.explode("blocks").alias("block")), "row")
        out = more if out is None else out.unionByName(more)
        start += BLOCKS_AT_A_TIME
    return out


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, own: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row, ties to smaller vec_id,
    null last.

    Both inputs have (vec_id, vector array<long>) and the column ``own``, a number that tells which candidate is the
    query itself, which takes no part: by default vec_id; where ids repeat, a number of the row. Null vectors and
    vectors of another length take no part, nor do queries without an id. A candidate without one does, and without
    an ``own`` number it is no query's own row. A repeated query row is answered once for each row; a repeated
    candidate row counts once for each row. Products are exact whatever their size; one beyond
    the range of a long counts as the nearest long, in the ranking too. An empty side gives an empty result; other
    columns are ignored.

    Candidates move once, to blocks of CANDIDATE_ROWS rows or so; queries move to the blocks that they search. A block
    returns k rows a query, which meet in a window for each query. Pivots come from a bounded sample of PIVOT_SAMPLE
    rows; they only steer order and elimination, so the result does not depend on them.
    """
    unknown = F.lit(-_LONG - 1)  # of candidates; a query without a number of its own has another
    queries = queries.where("vec_id is not null and vector is not null").select("vec_id", F.coalesce(F.col(own), F.lit(_LONG)).alias("own"), "vector")
    candidates = candidates.where("vector is not null").select("vec_id", F.coalesce(F.col(own), unknown).alias("own"), "vector")
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("vector").collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["vector"]), []).append(r["vector"])
    pivots = {d: spread_pivots(np.array(v, dtype=np.float64).reshape(len(v), d)) for d, v in by_size.items()}
    q, c = written(pivot_table(queries, pivots)), written(pivot_table(candidates, pivots))
    none = queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = c.groupBy("dim", "cell").agg(F.ceil(F.count("*") / CANDIDATE_ROWS).cast("long").alias("parts")).orderBy("dim", "cell").collect()
    if not cells:
        return none
    ends = np.cumsum([r["parts"] for r in cells])
    named = queries.sparkSession.createDataFrame([(r["dim"], r["cell"], r["parts"], int(e) - r["parts"]) for r, e in zip(cells, ends, strict=True)], "dim int, cell int, parts long, base long")
    block = F.col("base") + F.pmod(F.xxhash64("row"), F.col("parts"))
    rows = c.join(F.broadcast(named), ["dim", "cell"]).withColumn("block", block).drop("parts", "base")
    dist = lambda f: F.array(*[f(F.get("dist", F.lit(i))) for i in range(PIVOTS)])
    bounds = written(rows.groupBy("block", "dim").agg(dist(F.min).alias("near"), dist(F.max).alias("far"), F.max("norm").alias("longest")).withColumns({n: F.filter(n, lambda x: x.isNotNull()) for n in ("near", "far")}))
    rows = rows.withColumn("kind", F.lit(0)).withColumn("floor", F.lit(0.0))
    lowest = F.lit(float("-inf"))
    placed = q.join(F.broadcast(named), ["dim", "cell"], "left").withColumn("first", F.coalesce(block, F.lit(-1).cast("long"))).drop("parts", "base")
    home = placed.where("first >= 0").withColumn("block", F.col("first")).withColumn("kind", F.lit(1)).withColumn("floor", lowest)
    found = written(search_blocks(rows.unionByName(home.select(*rows.columns)), k))
    kth = found.groupBy("row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    reached = F.when((F.col("n") == k) & (F.col("least") > -_LONG - 1), F.col("least").cast("double"))
    placed = written(placed.join(kth, "row", "left").withColumn("floor", F.coalesce(reached, lowest)).drop("least", "n"))
    rest = _blocks_to_search(placed, bounds).withColumn("kind", F.lit(1))
    found = found.unionByName(search_blocks(rows.unionByName(rest.select(*rows.columns)), k))
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "unnamed", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.when(~F.col("unnamed"), F.col("vec_id")).alias("vec_id"), "score")


def top_k_report(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose vec_id is divisible by 50, against every row but the query's own."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector("embedding").alias("vector"), F.monotonically_increasing_id().alias("number"))
    vectors = written(vectors.where("vector is not null"))
    return exact_top_k(vectors.where("vec_id % 50 = 0"), vectors, 5, own="number")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS number, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.number, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.number <> q.number AND len(c.vector) = len(q.vector) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, number ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
