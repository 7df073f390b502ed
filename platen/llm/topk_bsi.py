"""Exact top-k search over a bit-sliced index.

Rows are dealt into blocks. A block's index holds, for each attribute and bit, a bitmap over its rows. A query adds the
attributes' slices, shifted by the bits of its own components, with carry-save adders: bitmap arithmetic that leaves the
slices of every row's score. Top rows are then found from the most significant slice downward: a set of rows that surely
belong, and one of rows still tied. Rows tied to the end have one score, and the smaller ids win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

#: Rows of a block at most and at least, and components; queries that meet one copy of a block, at most and, where there are more tasks than blocks, at least.
BLOCK_ROWS, LEAST_ROWS, BLOCK_VALUES, QUERY_ROWS, LEAST_QUERIES = 1 << 16, 1 << 15, 1 << 22, 1 << 16, 16


class BitSlices:
    """Index of int vectors (rows x attributes)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], vectors[order].astype(np.int64)
        pad = -len(ids) % 64
        low = self.rows.min(axis=0)
        self.reach = np.abs(self.rows.astype(float)).max(axis=0)
        self.slices: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for column in (self.rows - low).view(np.uint64).T:  # differences of 64-bit numbers fit 64 bits without a sign
            bits = max(1, int(column.max()).bit_length())
            own = [self._packed(column >> np.uint64(b) & np.uint64(1), pad) for b in range(bits)]
            self.slices.append([(s, ~s) for s in own])
        self.all = self._packed(np.ones(len(ids), np.int64), pad)

    @staticmethod
    def _packed(flags: np.ndarray, pad: int) -> np.ndarray:
        return np.packbits(np.pad(flags.astype(bool), (0, pad)), bitorder="little").view(np.uint64)

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of each row's inner product with `query` less a constant."""
        waiting: dict[int, list[np.ndarray]] = {}
        for q, own in zip(query.tolist(), self.slices, strict=False):  # what one of them lacks is 0
            # below 0 the complement counts: q * v = |q| * (all ones - v) - |q| * all ones
            side, weight = int(q < 0), abs(q)
            for i in range(weight.bit_length()):
                if weight >> i & 1:
                    for j, pair in enumerate(own):
                        waiting.setdefault(i + j, []).append(pair[side])
        out, w = [], 0
        while waiting and w <= max(waiting):
            line = waiting.get(w, [])
            carry = waiting.setdefault(w + 1, []) if len(line) > 1 else []
            while len(line) > 1:
                a, b = line.pop(), line.pop()
                half = a ^ b
                if line:
                    c = line.pop()
                    carry.append(a & b | half & c)
                    line.append(half ^ c)
                else:
                    carry.append(a & b)
                    line.append(half)
            out.append(line[0] if line else np.zeros_like(self.all))
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows with the highest scores, ties to smaller ids; rows with id `but` don't take part."""
        tied, sure = self.all.copy(), np.zeros_like(self.all)
        if but is not None:
            lo, hi = np.searchsorted(self.ids, [but, but + 1])
            for i in range(lo, hi):
                tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        for part in reversed(self.add(query)):
            ones = tied & part
            n = int(np.bitwise_count(sure | ones).sum())
            if n > k:
                tied = ones
            else:
                sure |= ones
                tied &= ~part
                if n == k:
                    tied[:] = 0
                    break
        at = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: k - len(at)]  # rows stand in order of ids
        at = np.concatenate((at, rest))
        n = min(len(query), self.rows.shape[1])
        if float(self.reach[:n] @ np.abs(query[:n].astype(float))) < 2.0**62:
            return self.ids[at], self.rows[at, :n] @ query[:n]
        scores = [sum(a * b for a, b in zip(row, query.tolist(), strict=False)) for row in self.rows[at].tolist()]
        if any(abs(s) >= 1 << 63 for s in scores):
            raise ValueError("a score doesn't fit 64 bits")
        return self.ids[at], np.array(scores, np.int64)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and v (array<long>): floor(scale * component) of the vectors that take part."""
    v = F.col(vector_col)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    unfit = F.raise_error(F.lit("a component doesn't fit 64 bits after scaling")).cast("long")
    digit = lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(unfit)
    return vectors.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: digit(x.cast("double") * scale)).alias("v"))


def _dense(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of one width; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0)) if width is None else width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k rows of highest integer inner product for each query (a row whose id `every` divides).

    Candidates are all rows but those of the query's own id. Rows with a null id, a null vector, null or non-finite
    components take no part. Of vectors of different lengths the shorter one counts as if zeros followed. Repeated rows are
    each candidates; of the query rows of one id the least vector asks, so there is one answer. An empty table gives no rows. Components and scores are
    64-bit integers; one that doesn't fit ends the job with an error.

    Rows are dealt into blocks, and a task reads a block first, indexes it, and then streams the queries past it. A block
    is sent once for every QUERY_ROWS queries, a query once to every block. Where there are fewer blocks than tasks, queries are
    split instead, and a block is sent once to each part of them.
    """
    rows = cut(quantised(vectors, id_col, vector_col, scale))
    n, wide = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    size = max(64, min(BLOCK_ROWS, BLOCK_VALUES // max(1, wide), max(LEAST_ROWS, -(-n // tasks))))
    n_blocks, asks = max(1, -(-n // size)), queries.count()
    n_parts = max(1, -(-asks // QUERY_ROWS), min(-(-tasks // n_blocks), -(-asks // LEAST_QUERIES)))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    blocks = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int")).withColumn("part", spread(n_parts))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int")).withColumn("block", spread(n_blocks))
    names = ["block", "part", "asks", "id", "v"]
    both = blocks.withColumn("asks", F.lit(False)).select(names).union(asked.withColumn("asks", F.lit(True)).select(names))
    dealt = both.repartition(n_blocks * n_parts, "block", "part").sortWithinPartitions("block", "part", "asks", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, index = None, [], None
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * n_parts + batch.column(1).to_numpy()
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(key * 2 + asks)) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                if key[a] != here:
                    here, own, index = key[a], [], None
                if not asks[a]:
                    own.append(part)
                    continue
                if index is None and own:
                    width = max(np.diff(p.column(4).offsets.to_numpy()).max() for p in own)
                    index, own = BitSlices(np.concatenate([p.column(3).to_numpy() for p in own]), np.concatenate([_dense(p.column(4), width) for p in own])), []
                found = [(q, *index.top(v, k, q)) for q, v in zip(part.column(3).to_pylist(), _dense(part.column(4)), strict=True)] if index else []
                if found:
                    columns = np.repeat([f[0] for f in found], [len(f[1]) for f in found]), *(np.concatenate([f[i] for f in found]) for i in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    near = dealt.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op7_bit_sliced_topk(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over all embeddings."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
