"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are read as sparse rows of integer weights floor(64 x). Queries and candidates are dealt to the cells of a
grid, so each cell holds a bounded block of either. A cell goes through the dimensions: the weights of its queries
there are scattered over the postings of that dimension (the candidates with a weight) into dense score arrays.
Each query's best k of a cell are selected by partition and the cells' lists merged.

Vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id; rows that
share the query's id are its own. Rows that share a query's id and vector are one query, those of another vector are
queries of their own, each with its k best, told apart by ``query_hash``. Vectors of different lengths are compared over the dimensions both have. Scores
are exact as long as they fit 64-bit integers. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 16384
SCALE = 64


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids in order, hashes of rows, whether a row is a query, and a matrix of weights padded with zeros."""
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    weights = table.column("w").combine_chunks()
    lens = weights.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lens.max()) if len(lens) else 0
    out = np.zeros((len(table), width), np.int64)
    out[np.repeat(np.arange(len(table)), lens), np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)] = weights.flatten().to_numpy()
    return table.column("id").to_numpy(), table.column("h").to_numpy(), table.column("side").to_numpy(), out, width


def _cell(k: int):
    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        ids, hashes, side, weights, width = _rows(table)
        qs, cs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(qs) or not len(cs):
            return
        q, c, c_ids = weights[qs], np.ascontiguousarray(weights[cs].T), ids[cs]
        bound = float(np.abs(q).max()) * float(np.abs(c).max()) * width
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # all exact
        q, c = q.astype(kind), c.astype(kind)
        postings = [np.flatnonzero(c[d]) for d in range(width)]
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(0, len(qs), 64):
            block = q[i : i + 64]
            scores = np.zeros((len(block), len(cs)), kind)
            part = np.empty_like(scores)
            for d in range(width):
                if 2 * len(postings[d]) >= len(cs):
                    scores += np.multiply(block[:, d, None], c[d], out=part)
                elif len(postings[d]):
                    for r in np.flatnonzero(block[:, d]):
                        scores[r, postings[d]] += block[r, d] * c[d, postings[d]]
            for r, (own, h) in enumerate(zip(ids[qs[i : i + 64]], hashes[qs[i : i + 64]], strict=True)):
                there = np.flatnonzero(c_ids != own) if np.searchsorted(c_ids, own, "right") > np.searchsorted(c_ids, own) else None
                s = scores[r] if there is None else scores[r, there]
                if not len(s):
                    continue
                m = min(k, len(s))
                least = np.partition(s, len(s) - m)[len(s) - m]
                above = np.flatnonzero(s > least)
                best = np.concatenate((above, np.flatnonzero(s == least)[: m - len(above)]))  # ids ascend
                best_ids = c_ids[best if there is None else there[best]]
                out.append((np.full(m, own), np.full(m, h), best_ids, s[best].astype(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "query_hash", "vec_id", "score"])

    return cell


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, query_hash: the ``k`` best of all other rows for each row whose id is divisible by ``every``."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fit = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("w"))
    rows = staged(rows, "topk-rows")
    n, nq = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    across, down = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    # Dealt by a hash of the whole row and its place in the input, so that repeated ids spread too.
    dealt = F.pmod(F.xxhash64("id", "w", F.monotonically_increasing_id()), F.lit(1 << 30))
    queries = rows.where(F.col("id") % every == 0).groupBy("id", "w").count().drop("count")
    queries = queries.select("id", F.xxhash64("id", "w").alias("h"), "w", F.lit(0).alias("side"), F.pmod(F.xxhash64("id", "w"), F.lit(down)).cast("long").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("c"))
    candidates = rows.select("id", F.lit(0).cast("long").alias("h"), "w", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("q"), (dealt % across).cast("long").alias("c"))
    cells = queries.unionByName(candidates).groupBy("q", "c").applyInArrow(_cell(k), "query_id long, query_hash long, vec_id long, score long")
    order = W.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_hash")
