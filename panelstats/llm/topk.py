"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the standard deviation are kept. For two vectors the sum over
segments of m * ((mean - mean)^2 + (dev - dev)^2) is a lower bound of their squared distance, hence of
|q|^2 + |x|^2 - 2 q.x, hence an upper bound of the inner product; more segments give a tighter bound. Candidates are
looked at coarse to fine, those whose bound falls below the score already reached are dropped, and the rest is computed
exactly in integers.

Vectors are gathered into blocks of rows; every query block meets every candidate block, as blocks, so a pair of blocks
is one row. Only the best k of a pair of blocks leave the task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.session import materialise


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of usable vectors. Rows without an id, and vectors that are missing, empty or hold a
    missing or non-finite component, are left out; of rows that share an id the smallest vector counts."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(usable, F.lit(False)))
        .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def _blocks(vectors: DataFrame, rows: int, prefix: str) -> tuple[DataFrame, int]:
    """One row per block: dim, number, ids and matrix as bytes; and how many blocks there are."""
    count = max(1, math.ceil(vectors.count() / rows))

    def gather(key, frame):
        import pandas as pd

        order = np.argsort(frame["vec_id"].to_numpy(), kind="stable")
        matrix = np.stack(frame["v"].to_list())[order].astype("<i8")
        return pd.DataFrame({
            f"{prefix}dim": [int(key[0])], f"{prefix}block": [int(key[1])],
            f"{prefix}ids": [frame["vec_id"].to_numpy("<i8")[order].tobytes()], f"{prefix}matrix": [matrix.tobytes()],
        })

    dealt = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("block"))
    schema = f"{prefix}dim int, {prefix}block long, {prefix}ids binary, {prefix}matrix binary"
    return materialise(dealt.groupBy("dim", "block").applyInPandas(gather, schema), "blocks"), count


def statistics(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that the product of two rows bounds their inner product from above."""
    edges = np.linspace(0, matrix.shape[1], segments + 1).astype(int)
    parts = []
    for a, b in zip(edges, edges[1:]):
        seg = matrix[:, a:b]
        mean = seg.mean(axis=1)
        dev = np.sqrt(np.maximum(((seg - mean[:, None]) ** 2).mean(axis=1), 0))
        parts += [mean * math.sqrt(b - a), dev * math.sqrt(b - a)]
    return np.stack(parts, axis=1)


def best_of_block(q_ids, q, c_ids, c, k: int, levels: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best candidates, ties to smaller ids; candidates come sorted by id."""
    top = int(max(np.abs(q).max(), np.abs(c).max()))
    exact = np.int64 if top * top * q.shape[1] < 1 << 62 else object  # beyond that, Python's whole numbers
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    slack = 1e-9 * (1 + np.linalg.norm(qf, axis=1).max() * np.linalg.norm(cf, axis=1).max())
    usable = [s for s in levels if s <= q.shape[1]] or [1]
    stats = [(statistics(qf, s), statistics(cf, s)) for s in usable]
    whole = c.astype(exact)
    out = []
    for begin in range(0, len(q), 256):
        coarse = stats[0][0][begin:begin + 256] @ stats[0][1].T
        for row in range(coarse.shape[0]):
            i, bound = begin + row, coarse[row]
            mine = c_ids == q_ids[i]
            bound[mine] = -np.inf
            want = min(k, len(c) - int(mine.sum()))
            if want <= 0:
                continue
            query = q[i].astype(exact)
            seed = np.argpartition(-bound, want - 1)[:want]
            reached = np.sort((whole[seed] @ query).astype(np.float64))[0]  # want candidates score at least this
            alive = np.flatnonzero(bound >= reached - slack)
            for of_q, of_c in stats[1:]:
                alive = alive[of_c[alive] @ of_q[i] >= reached - slack]
            score = whole[alive] @ query
            order = np.lexsort((c_ids[alive], -score))[:want]
            out.append((q_ids[i], c_ids[alive][order], score[order]))
    return out


def search(vectors: DataFrame, queries_where, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 64, query_rows: int = 1024, candidate_rows: int = 4096,
           levels: tuple[int, ...] = (4, 16)) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query among all other usable vectors.

    `queries_where` is a condition on vec_id. Vectors meet only those of the same length. With fewer than k candidates
    all are returned; a query without any has no row.
    """
    usable = materialise(whole_vectors(vectors, id_col, vector_col, scale), "vectors")
    asked, parts = _blocks(usable.where(queries_where), query_rows, "q_")
    stored, _ = _blocks(usable, candidate_rows, "c_")
    meeting = stored.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("q_dim", F.col("c_dim"))
    pairs = meeting.join(asked, ["q_dim", "q_block"])

    def run(frames):
        import pandas as pd

        for frame in frames:
            for dim, qi, qm, ci, cm in zip(frame["q_dim"], frame["q_ids"], frame["q_matrix"], frame["c_ids"], frame["c_matrix"]):
                q_ids, c_ids = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
                q, c = (np.frombuffer(m, "<i8").reshape(-1, dim) for m in (qm, cm))
                found = best_of_block(q_ids, q, c_ids, c, k, levels)
                if found:
                    yield pd.DataFrame({
                        "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                        "vec_id": np.concatenate([f[1] for f in found]),
                        "score": np.concatenate([f[2] for f in found]).astype(np.int64),
                    })

    near = pairs.select("q_dim", "q_ids", "q_matrix", "c_ids", "c_matrix").mapInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
