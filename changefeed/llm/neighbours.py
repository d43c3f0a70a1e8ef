"""Nearest neighbours by randomly rotated one-bit codes.

A vector minus the centre, scaled to length one and rotated, is kept as the signs of its components: one bit each, with
two scalars (its length, and its inner product with its own code). From bits and scalars the inner product with a query is
estimated without bias, with an error bound that holds with high probability. Candidates whose
lower bound on the distance is not above the k-th least upper bound are ranked again by the original vectors.

Codes and vectors lie in blocks of about ``BLOCK`` rows, dealt by a hash; queries lie in blocks of ``QUERIES``. Each
pair of blocks is one step of bounded memory in some task, and yields k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changefeed.llm.common import materialise

BLOCK, QUERIES = 8192, 512
EPSILON = 4.0  # standard deviations of the estimate's error
SEED = 20240101


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(v: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, lengths and inner products with the own code."""
    rest = vectors - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    unit = (rest / np.where(length > 0, length, 1)[:, None]) @ rotation(vectors.shape[1])
    own = np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(unit > 0, axis=1), length, np.where(length > 0, own, 1.0)


def estimate(codes, length, own, queries, centre, epsilon: float = EPSILON):  # noqa: ANN001, ANN201
    """Squared distances and error bounds, a row for each query."""
    dim = queries.shape[1]
    rest = queries - centre
    span = np.sqrt((rest * rest).sum(axis=1))
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    product = (rest @ rotation(dim)).astype(np.float32) @ signs.T / np.sqrt(dim) / own * length
    spread = np.sqrt(np.maximum(1 - own * own, 0)) / own / np.sqrt(max(dim - 1, 1))
    squared = length**2 + (span**2)[:, None] - 2 * product
    slack = 1e-4 * (length**2 + (span**2)[:, None])  # single precision of the product
    return squared, 2 * epsilon * span[:, None] * (length * spread)[None, :] + slack


def _floats(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def search(rows: DataFrame, is_query: Column, k: int, block: int = BLOCK, queries: int = QUERIES, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows by Euclidean distance to each query row.

    ``rows`` has vec_id and embedding. Unusable vectors take no part, nor do those that lack an id or whose dimension is
    not the most common one (the smallest of equals). A row is never its own neighbour; repeated rows are rows of their own,
    so copies are at distance zero. Ties go to the smaller id. Without usable rows the result is empty.
    """
    v = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = good.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))
    dims = good.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim, n = (dims["dim"], dims["count"]) if dims else (1, 0)
    good = good.where(F.col("dim") == dim).withColumn("row", F.monotonically_increasing_id())
    good = materialise(good.select("row", "vec_id", "v"), "vectors")
    means = good.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).collect() if n else []
    centre = np.array([r["x"] for r in sorted(means, key=lambda r: r["i"])])  # one number a dimension
    blocks = max(1, -(-n // block))

    def pack(t: pa.Table) -> pa.Table:
        vectors = _floats(t.column("v"))
        codes, length, own = encode(vectors, centre)
        values = [t.column("block")[0].as_py(), *[np.ascontiguousarray(x).tobytes() for x in (t.column("row").to_numpy(), t.column("vec_id").to_numpy(), vectors, codes, length, own)]]
        kinds = [pa.int64()] + [pa.binary()] * 6
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["block", "rows", "ids", "vectors", "codes", "length", "own"])

    dealt = good.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    schema = "block long, rows binary, ids binary, vectors binary, codes binary, length binary, own binary"
    index = materialise(dealt.groupBy("block").applyInArrow(pack, schema), "codes")
    asked = good.where(is_query)
    asks = max(1, -(-asked.count() // queries))
    asked = asked.withColumn("ask", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(asks)))

    def pack_queries(t: pa.Table) -> pa.Table:
        parts = [t.column("row").to_numpy(), t.column("vec_id").to_numpy(), _floats(t.column("v"))]
        return pa.table([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], ["q_rows", "q_ids", "q_vectors"])

    questions = asked.groupBy("ask").applyInArrow(pack_queries, "q_rows binary, q_ids binary, q_vectors binary")
    questions = materialise(questions, "queries").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = {name: b.column(name)[i].as_py() for name in b.schema.names if name != "block"}
                row, ids, q_row, q_ids = (np.frombuffer(raw[x], np.int64) for x in ("rows", "ids", "q_rows", "q_ids"))
                vectors, q = (np.frombuffer(raw[x], np.float64).reshape(-1, dim) for x in ("vectors", "q_vectors"))
                codes = np.frombuffer(raw["codes"], np.uint8).reshape(len(row), -1)
                length, own = (np.frombuffer(raw[x], np.float64) for x in ("length", "own"))
                squared, bound = estimate(codes, length, own, q, centre, epsilon)
                upper = squared + bound
                most = min(k, len(row) - 1)  # the own row may be among the best
                limit = np.partition(upper, most, axis=1)[:, most] if len(row) > k else np.full(len(q), np.inf)
                out = []
                for j in range(len(q)):
                    near = np.flatnonzero((squared[j] - bound[j] <= limit[j]) & (row != q_row[j]))
                    away = np.sqrt(((vectors[near] - q[j]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], away))[:k]
                    out.append((np.full(len(best), q_row[j]), np.full(len(best), q_ids[j]), ids[near][best], away[best]))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q_row", "query_id", "vec_id", "score"])

    found = questions.join(index, "block").mapInArrow(find, "q_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q_row").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
