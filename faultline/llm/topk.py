"""Exact top-k by inner product: pivot-table elimination.

Each vector carries its distances to many pivots. For a query q and a candidate x the largest |d(q, p) - d(x, p)| over
the pivots is a lower bound of d(q, x), and (|q|^2 + |x|^2 - bound^2) / 2 an upper bound of their inner product.
Candidates are evaluated in the order of that bound, until it falls under the k-th best score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells

#: Pivots; they are chosen among the sampled vectors.
PIVOTS = 32
#: Candidates evaluated between two looks at the bound.
STEP = 128
#: Scores are kept within a long.
MOST = (1 << 63) - 1


def quantised(vectors: list[list[float]] | np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * component) of vectors of equal length, held within 2^62."""
    return np.clip(np.floor(np.asarray(vectors, np.float64) * scale), -(2.0**62), 2.0**62).astype(np.int64)


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the vector farthest from those taken."""
    if not len(vectors):
        return vectors
    taken, away = [0], np.linalg.norm(vectors - vectors[0], axis=1)
    while len(taken) < min(count, len(vectors)) and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(vectors - vectors[taken[-1]], axis=1))
    return vectors[taken]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(vectors), 0))


def _search(k: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("vec_id", kind="stable")
        dim = int(q["dim"].iloc[0])
        xs, qs = (cells.matrix(d["v"], "<i8").reshape(len(d), dim) for d in (c, q))
        xd, qd = (cells.matrix(d["pivots"], "<f8") if len(d["pivots"].iloc[0]) else np.zeros((len(d), 0)) for d in (c, q))
        ids, keys, query_ids, query_keys = c["vec_id"].to_numpy(), c["_key"].to_numpy(), q["vec_id"].tolist(), q["_key"].tolist()
        large = max(int(np.abs(xs).max(initial=0)), 1) * max(int(np.abs(qs).max(initial=0)), 1) * max(dim, 1) >= 1 << 62
        if large:
            xs, qs = xs.astype(object), qs.astype(object)
        floors = q["floor"].tolist()
        norms, table = (xs.astype(np.float64) ** 2).sum(1), np.ascontiguousarray(xd.T)
        out = []
        for i in range(len(qs)):
            norm, lower = float((qs[i].astype(np.float64) ** 2).sum()), np.zeros(len(xs))
            for p in range(len(table)):
                np.maximum(lower, np.abs(table[p] - qd[i, p]), out=lower)
            upper = (norm + norms - lower * lower) / 2
            upper += 1e-9 * (norm + norms) + 1  # more than rounding can take away
            upper[ids == query_ids[i]] = -np.inf
            order = np.flatnonzero(upper >= max(float(floors[i]), -3e38))  # others can't be among the best
            order = order[np.argsort(-upper[order], kind="stable")]
            scores, places = np.zeros(0, xs.dtype), np.zeros(0, np.int64)
            for a in range(0, len(order), STEP):
                if len(scores) == k and upper[order[a]] < scores[-1]:
                    break
                some = order[a : a + STEP]
                scores, places = np.concatenate([scores, xs[some] @ qs[i]]), np.concatenate([places, some])
                first = np.lexsort((places, -scores)) if not large else np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], places[j])), np.int64)
                scores, places = scores[first[:k]], places[first[:k]]  # candidates stand in the order of vec_id
            out += [(query_keys[i], query_ids[i], int(ids[p]), max(-MOST, min(MOST, int(s)))) for s, p in zip(scores, places)]
        return pd.DataFrame(out, columns=["query_key", "query_id", "vec_id", "score"])

    return run


def exact_top_k(rows: DataFrame, *, is_query: Column, k: int = 10, scale: float = 1024.0, pivots: int = PIVOTS) -> DataFrame:
    """The k largest inner products of floor(scale * vector) for each query row: query_id, rank, vec_id, score.

    rows: vec_id, embedding; is_query: a condition on vec_id. Other columns are left aside. A row is no candidate for a
    query of its own vec_id. Vectors that are null or hold null or non-finite components take no part, nor does a null
    vec_id; only vectors of equal length are compared; scores beyond a long are held at its ends. Ties go to the
    smaller vec_id. Repeated query rows are queries of their own. Pivots are chosen in a bounded sample, and each query's
    floor is its k-th best score there.
    """
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & cells.valid(F.col("embedding")))
    chosen: dict[int, list] = {}
    for r in cells.drawn(given):
        chosen.setdefault(len(r["embedding"]), []).append((r["vec_id"], r["embedding"]))
    sample = {dim: (np.array([i for i, _ in some]), quantised([v for _, v in some], scale).astype(np.float64)) for dim, some in chosen.items()}
    table = {dim: far_apart(vectors, pivots) for dim, (_, vectors) in sample.items()}

    def floor_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, raw in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                v = np.frombuffer(raw, "<i8").astype(np.float64)
                ids, others = sample.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)))))
                exact = np.abs(v).max(initial=0) * np.abs(others).max(initial=0) * max(1, len(v)) < 2.0**52
                scores = (others @ v)[ids != own] if exact else np.zeros(0)
                out.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -MOST)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "floor"])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, places in by_dim.items():
                whole = quantised([vectors[i] for i in places], scale).reshape(len(places), dim)
                away = distances(whole.astype(np.float64), table.get(dim, np.zeros((0, dim))))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in places], pa.int64()), pa.array([dim] * len(places), pa.int64()), pa.array([x.tobytes() for x in whole], pa.binary()), pa.array([x.tobytes() for x in away], pa.binary())], ["vec_id", "dim", "v", "pivots"])

    ready = given.mapInArrow(prepare, "vec_id long, dim long, v binary, pivots binary")
    kind = "vec_id long, dim long, v binary, pivots binary, _key long, floor long"
    return cells.best(ready, _search(k), is_query=is_query, k=k, score="long", floors=lambda asked: asked.mapInArrow(floor_of, kind))
