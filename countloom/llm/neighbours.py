"""Nearest neighbours by a block matrix join: int8 tiles bound the scores, survivors are recomputed, heaps merge."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, discard, stored, table

#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES, STRIP = 8192, 4096, 256

_BLOCK = "dim int, n int, ids binary, tags binary, codes binary, scales binary, norms binary, errors binary"


def usable(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector of the rows that take part: not null, not empty, finite in every component, not zero."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embeddings.filter(F.col(id_column).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).select(
        F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("vector"))


def quantised(vectors: np.ndarray):
    """int8 codes and scale of every row, norm of what the codes stand for, and norm of the rest."""
    scales = np.abs(vectors).max(axis=1) / 127
    scales[scales == 0] = 1.0
    codes = np.rint(vectors / scales[:, None]).astype(np.int8)
    stands = codes * scales[:, None]
    return codes, scales, np.linalg.norm(stands, axis=1), np.linalg.norm(vectors - stands, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def tagged(rows: DataFrame) -> DataFrame:
    """id, vector and tag (hash of the vector, which tells vectors of one id apart); rows that repeat id and vector once."""
    return rows.dropDuplicates(["id", "vector"]).withColumn("tag", F.xxhash64("vector"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (id, vector, tag) packed into blocks of about size rows of one dimension, numbered from 0: column number.

    A block holds int8 codes and bounds, an eighth of the vectors' bytes; the vectors themselves stay where they are.
    """
    n = rows.count()
    parts = max(1, -(-n // size))

    def pack(key, group):
        import pyarrow as pa

        dim = key[0].as_py()
        ids, tags = group.column("id").to_numpy(), group.column("tag").to_numpy()
        vectors = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.lexsort((tags, ids))
        ids, tags, vectors = ids[order], tags[order], vectors[order]
        codes, scales, norms, errors = quantised(vectors)
        values = [[dim], [len(ids)], *([x.tobytes()] for x in (ids, tags, codes, scales, norms, errors))]
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    keyed = rows.select(F.size("vector").alias("_dim"), F.pmod(F.xxhash64("id", "tag"), F.lit(parts)).alias("_part"), "id", "tag", "vector")
    return keyed.groupBy("_dim", "_part").applyInArrow(pack, _BLOCK).withColumn("number", F.monotonically_increasing_id())


def _unpacked(row, prefix: str):
    dim, n = row[f"{prefix}dim"], row[f"{prefix}n"]
    ids, tags = (np.frombuffer(row[prefix + k], np.int64) for k in ("ids", "tags"))
    codes = np.frombuffer(row[f"{prefix}codes"], np.int8).reshape(n, dim)
    return ids, tags, codes, *(np.frombuffer(row[prefix + k], np.float64) for k in ("scales", "norms", "errors"))


def first_of_equal(row: np.ndarray, tag: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that are among the k smallest ids of their query and vector: of equal vectors no others can be nearest."""
    order = np.lexsort((ids, tag, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (tag[order][1:] != tag[order][:-1])
    place = np.arange(len(order))
    return np.sort(order[place - np.maximum.accumulate(np.where(new, place, 0)) < k])


class Survivors:
    """Candidates of a block of queries whose upper bound reaches the k-th largest lower bound seen so far.

    |q.c - q^.c^| <= |q - q^| |c| + |q^| |c - c^| for codes q^ and c^, so a candidate below that cannot be among the k nearest.
    """

    def __init__(self, query, k: int):
        self.query, self.k = query, k
        self.best = np.full((len(query[0]), k), -np.inf)
        self.found: list[tuple] = []

    def add(self, candidate) -> None:
        qi, _, qc, qs, qn, qe = self.query
        ci, ct, cc, cs, cn, ce = candidate
        # products of int8 codes are whole numbers, exact in float32 up to 2**24 and in float64 beyond
        kind = np.float32 if qc.shape[1] * 127 * 127 < 1 << 24 else np.float64
        right = np.ascontiguousarray(cc.T).astype(kind)
        length = cn + ce
        for at in range(0, len(qi), STRIP):
            part = slice(at, at + STRIP)
            about = (qc[part].astype(kind) @ right).astype(np.float64) * qs[part, None] * cs
            error = (qe[part, None] * length + qn[part, None] * ce) * (1 + 1e-9) + 1e-9 * (qn + qe)[part, None] * length
            about[qi[part, None] == ci] = -np.inf
            lower = about - error
            both = np.hstack([self.best[part], lower])
            self.best[part] = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :]
            upper = about + error
            rows, columns = np.nonzero((upper >= self.best[part].min(axis=1)[:, None]) & (about > -np.inf))
            few = first_of_equal(rows, ct[columns], ci[columns], self.k)
            rows, columns = rows[few], columns[few]
            self.found.append((at + rows, ci[columns], ct[columns], lower[rows, columns], upper[rows, columns]))

    def rows(self):
        """(query_id, query_tag, id, tag, lower, upper), those pruned that later tiles have ruled out."""
        import pyarrow as pa

        row, ids, tags, lower, upper = (np.concatenate(x) for x in zip(*self.found))
        near = np.flatnonzero(upper >= self.best.min(axis=1)[row])
        near = near[first_of_equal(row[near], tags[near], ids[near], self.k)]
        columns = [self.query[0][row], self.query[1][row], ids, tags, lower, upper]
        return pa.RecordBatch.from_arrays([pa.array(c[near]) for c in columns], ["query_id", "query_tag", "id", "tag", "lower", "upper"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k candidates of largest inner product per query: query_id, rank (from 1), id, score; ties to the smaller id.

    Both frames have id and vector (see usable).  A query never meets a row of its own id; vectors meet
    those of their own dimension only; rows that repeat id and vector count once, and an id's other vectors are candidates
    of their own; of equal vectors the k smallest ids are kept at most, however many there are.  With fewer than k candidates all are returned; no queries or no candidates give no rows.

    Every pair of a query block and a candidate block is one tile of int8 codes; tiles of a query block that meet in a task
    share its bounds.  Survivors are then pruned over all tasks, their vectors fetched by id, recomputed in double and merged by heaps.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted, given = tagged(queries), tagged(candidates)
    cand = stored(blocks(given, CANDIDATES), "candidates")
    quer = stored(blocks(wanted, QUERIES), "queries")
    pairs = quer.select(F.col("number").alias("qb"), F.col("dim").alias("qd")).join(
        cand.select(F.col("number").alias("cb"), F.col("dim").alias("cd")), F.col("qd") == F.col("cd")).select("qb", "cb")
    left = quer.select(F.col("number").alias("qb"), *(F.col(c).alias(f"q_{c}") for c in quer.columns if c != "number"))
    right = cand.select(F.col("number").alias("cb"), *(F.col(c).alias(f"c_{c}") for c in cand.columns if c != "number"))
    # a task gets several tiles of one query block where there are more tiles than tasks
    share = max(1, -(-4 * max(8, parts) // max(1, quer.count())))
    tiles = pairs.join(right, "cb").join(left, "qb").withColumn("share", F.pmod("cb", F.lit(share))).repartition(max(8, parts), "qb", "share").sortWithinPartitions("qb")

    def search(batches):
        current, held = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["qb"] != current:
                    if held is not None:
                        yield held.rows()
                    current, held = row["qb"], Survivors(_unpacked(row, "q_"), k)
                held.add(_unpacked(row, "c_"))
        if held is not None:
            yield held.rows()

    found = stored(tiles.mapInArrow(search, "query_id long, query_tag long, id long, tag long, lower double, upper double"), "found")
    discard(cand, quer)
    # over all tasks: a query has about k rows a task
    each = W.partitionBy("query_id", "query_tag")
    equal = F.row_number().over(W.partitionBy("query_id", "query_tag", "tag").orderBy("id"))
    ranked = found.withColumn("e", equal).filter(F.col("e") <= k).withColumn("r", F.row_number().over(each.orderBy(F.desc("lower"))))
    near = ranked.withColumn("floor", F.max(F.when(F.col("r") == k, F.col("lower"))).over(each)).filter("floor IS NULL OR upper >= floor")
    scored = near.select("query_id", "query_tag", "id", "tag").join(
        wanted.select(F.col("id").alias("query_id"), F.col("tag").alias("query_tag"), F.col("vector").alias("q")), ["query_id", "query_tag"]).join(
        given.select("id", "tag", F.col("vector").alias("c")), ["id", "tag"])
    # from the first component to the last
    score = F.aggregate(F.zip_with("q", "c", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)

    def merge(batches):
        import pyarrow as pa

        heaps: dict = {}
        for batch in batches:
            for q, c, s in zip(*(x.to_pylist() for x in batch.columns)):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -c))
                elif (s, -c) > heap[0]:
                    heapq.heapreplace(heap, (s, -c))
        rows = [(q, rank, -minus, s) for q, heap in heaps.items() for rank, (s, minus) in enumerate(sorted(heap, reverse=True), 1)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["query_id", "rank", "id", "score"])

    return scored.select("query_id", "id", score.alias("score")).repartition(parts, "query_id").mapInArrow(merge, "query_id long, rank int, id long, score double")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20; rows and edge cases as nearest states."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows.filter("id % 20 = 0"), rows, 20).withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
