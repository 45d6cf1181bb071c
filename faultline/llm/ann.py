"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors in double precision, heaps.

A vector x is s * x8 + e with x8 of int8 components, so q.x is within |q||e_x| + |e_q||s x8| of s_q s_x (q8.x8). A tile of
such products gives bounds of all its pairs; a pair whose upper bound is under the k-th largest lower bound of its query
can't be among the k nearest. What survives is computed from the original vectors and merged in a heap of each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells

#: Sides of a tile: queries, candidates.
TILE = 256, 4_096


def to_int8(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 components (as float32, which multiplies them exactly up to 1,040 components), scales, norms of the errors, norms of what the components stand for."""
    scale = np.abs(vectors).max(1, initial=0) / 127
    scale[scale == 0] = 1
    whole = np.rint(vectors / scale[:, None])
    stood = whole * scale[:, None]
    return whole.astype(np.int8).astype(np.float32), scale, np.linalg.norm(vectors - stood, axis=1), np.linalg.norm(stood, axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def _search(k: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        np.seterr(over="ignore", invalid="ignore")  # in the worker
        xs, qs = cells.matrix(c["v"], "<f8"), cells.matrix(q["v"], "<f8")
        ids, query_ids, query_keys = c["vec_id"].to_numpy(), q["vec_id"].to_numpy(), q["_key"].tolist()
        (x8, x_scale, x_error, x_norm), (q8, q_scale, q_error, _) = to_int8(xs), to_int8(qs)
        q_norm = np.linalg.norm(qs, axis=1)
        exact = 127 * 127 * qs.shape[1] < 1 << 24
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(qs))]
        least = q["floor"].to_numpy(np.float64)
        floor = least.copy()  # k-th best so far, or what the sample has
        for b in range(0, len(xs), TILE[1]):
            cols = slice(b, b + TILE[1])
            for a in range(0, len(qs), TILE[0]):
                rows = slice(a, a + TILE[0])
                tile = (q8[rows] @ x8[cols].T).astype(np.float64) if exact else q8[rows].astype(np.float64) @ x8[cols].T.astype(np.float64)
                near = tile * q_scale[rows, None] * x_scale[None, cols]
                slack = (q_norm[rows, None] * x_error[None, cols] + q_error[rows, None] * x_norm[None, cols]) * (1 + 1e-9) + 1e-12 * (q_norm[rows, None] * (x_norm + x_error)[None, cols])
                lower = near - slack
                lower[~np.isfinite(lower)] = -np.inf  # a product that overflows bounds nothing
                own = ids[None, cols] == query_ids[rows, None]
                lower[own] = -np.inf
                kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k] if lower.shape[1] >= k else np.full(len(lower), -np.inf)
                survives = ~(near + slack < np.maximum(kth, floor[rows])[:, None]) & ~own
                i, j = np.nonzero(survives)
                step = 1 << 19
                for p in range(0, len(i), step):
                    scores = products(qs[rows][i[p : p + step]], xs[cols][j[p : p + step]])
                    scores[np.isnan(scores)] = -np.inf
                    for line, score, vec in zip((i[p : p + step] + a).tolist(), scores.tolist(), (-ids[cols][j[p : p + step]]).tolist()):
                        heap = heaps[line]
                        if len(heap) < k:
                            heapq.heappush(heap, (score, vec))
                        elif (score, vec) > heap[0]:
                            heapq.heapreplace(heap, (score, vec))
                floor[rows] = np.maximum(least[rows], [h[0][0] if len(h) == k else -np.inf for h in heaps[rows]])
        out = [(key, int(own), -vec, score) for key, own, heap, bound in zip(query_keys, query_ids, heaps, least.tolist()) for score, vec in heap if score >= bound]
        return pd.DataFrame(out, columns=["query_key", "query_id", "vec_id", "score"])

    return run


def _given(rows: DataFrame) -> DataFrame:
    """The rows that take part."""
    vector = F.col("embedding")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & cells.valid(vector) & F.exists(vector, lambda x: x != 0))


def nearest(rows: DataFrame, *, is_query: Column, k: int = 20) -> DataFrame:
    """The k largest inner products for each query row: query_id, rank, vec_id, score (double).

    rows: vec_id, embedding; is_query: a condition on vec_id. Other columns are left aside. A row is no candidate for a
    query of its own vec_id. Vectors that are null, zero or hold null or non-finite components take no part, nor does a
    null vec_id; only vectors of equal length are compared. Ties go to the smaller vec_id. Bounds are exact, so recall
    against brute force is 1. Repeated query rows are queries of their own. A product that overflows to no number
    counts as minus infinity. Each query's floor is its k-th best score in a bounded sample.
    """
    known = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in cells.drawn(_given(rows))]
    sample = {dim: (np.array([i for i, v in known if len(v) == dim]), np.array([v for _, v in known if len(v) == dim])) for dim in {len(v) for _, v in known}}

    def floor_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore", invalid="ignore")  # in the worker
        for batch in batches:
            out = []
            for own, raw in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                v = np.frombuffer(raw, "<f8")
                ids, others = sample.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)))))
                scores = products(np.broadcast_to(v, others.shape), others)[ids != own]
                kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
                out.append(kth if np.isfinite(scores).all() else -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "floor"])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, np.float64) for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(v) for v in vectors], pa.int64()), pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "dim", "v"])

    ready, kind = _given(rows).mapInArrow(prepare, "vec_id long, dim long, v binary"), "vec_id long, dim long, v binary, _key long, floor double"
    return cells.best(ready, _search(k), is_query=is_query, k=k, score="double", floors=lambda asked: asked.mapInArrow(floor_of, kind))
