"""Near-duplicate vectors by int8 tile products with error bounds.

Each unit vector u is kept as int8 values q with one step s and the length e of what
quantising lost: u = s*q + r, |r| = e. For two vectors

    |u.v - s_u s_v q_u.q_v| <= e_u (1 + e_v) + e_v

so a pair whose quantised cosine plus this bound stays below the threshold can't be a
link. Only the others are computed again, from the vectors as given, in double
precision. Vectors are dealt by a hash of their id into blocks of about ``tile`` rows,
and every pair of blocks is one task: memory is two blocks and one product of them,
whatever the number of vectors. Comparing all tiles is the method; it grows with the
square of the number of different vectors, on bounded tasks.

Equal vectors collapse first and count with their number. A tile returns one row per
vector: how many vectors it is linked with there, and the least vector it reaches
inside the tile. Pairs are never written out.

Vectors that are null, empty, zero or hold null or non-finite values link with nothing;
so do rows with a null id, and vectors of different lengths. Rows that repeat an id and
its vector count as one vector. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, flat, stored
from .components import connected

by_value(__name__)

_EXACT = 1024  # int8 products summed in float32 stay whole numbers below 2**24 for so many dimensions


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in double precision, int8 values, steps and quantisation errors."""
    unit = vectors.astype(np.float64)
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / step[:, None]).astype(np.int8)
    lost = unit - q * step[:, None]
    return unit, q, step, np.sqrt((lost * lost).sum(axis=1)) * (1 + 1e-9) + 1e-12


def _quantised(kind: str):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            q, step, error, cut = [None] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes)), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                _, small, step[rows], error[rows] = quantise(values[cut[rows][:, None] + np.arange(d)])
                for i, r in enumerate(rows):
                    q[r] = small[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), pa.array(sizes, pa.int32()), pa.array(q, pa.binary()), pa.array(step), pa.array(error),
                 pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["rep", "n", "dim", "q", "step", "error", "vector"],
            )

    return run


def links(q1, s1, e1, u1, q2, s2, e2, u2, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles with cosine >= threshold: quantised first, then exact."""
    product = np.zeros((len(q1), len(q2)), np.float32)
    for k in range(0, q1.shape[1], _EXACT):
        part = q1[:, k : k + _EXACT].astype(np.float32) @ q2[:, k : k + _EXACT].astype(np.float32).T
        product += part * (s1[:, None].astype(np.float32)) * s2.astype(np.float32)
    reach = 1 + (e2.max() if len(e2) else 0.0)
    product += (e1 * reach).astype(np.float32)[:, None]
    product += e2.astype(np.float32)
    i, j = np.nonzero(product >= np.float32(threshold - 1e-5))  # float32 rounding is far below the slack
    if not len(i):
        return i, j
    rows, cols = np.unique(i), np.unique(j)
    if len(i) * 20 > len(rows) * len(cols):
        dense = np.zeros(len(i), bool)
        at = np.searchsorted(rows, i), np.searchsorted(cols, j)
        for k in range(0, len(rows), 512):
            inside = (at[0] >= k) & (at[0] < k + 512)
            dense[inside] = (u1[rows[k : k + 512]] @ u2[cols].T)[at[0][inside] - k, at[1][inside]] >= threshold
        return i[dense], j[dense]
    sure = np.concatenate([np.einsum("ij,ij->i", u1[i[k : k + 65536]], u2[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)])
    return i[sure], j[sure]


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``n`` nodes over the edges (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile(kind: str, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table["rep"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
        block, low, high = table["block"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py()
        q = flat(table["q"].combine_chunks())[0].view(np.int8).reshape(len(rep), -1)
        vectors = flat(table["vector"].combine_chunks())[0].view(kind).reshape(len(rep), -1)
        unit = vectors.astype(np.float64)
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        step, error = table["step"].to_numpy(), table["error"].to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        i, j = links(q[left], step[left], error[left], unit[left], q[right], step[right], error[right], unit[right], threshold)
        a, b = left[i], right[j]
        if low == high:
            a, b = a[a < b], b[a < b]
        count = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        root = least_reached(len(rep), a, b)
        hit = np.flatnonzero(count)
        return pa.table({"id": pa.array(rep[hit]), "n": pa.array(count[hit].astype(np.int64)), "root": pa.array(rep[root[hit]])})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tile: int = 2048) -> DataFrame:
    """One row per row: id, n_links (other vectors with cosine >= ``threshold``), component_id (least id reachable), kept."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding"))
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    usable = F.expr(
        "id is not null and embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    fit = rows.where(usable)
    classes = stored(fit.distinct().groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    blocks = max(1, -(-classes.count() // tile))
    schema = "rep bigint, n bigint, dim int, q binary, step double, error double, vector binary"
    small = stored(classes.mapInArrow(_quantised(kind), schema), "quantised")
    dealt = small.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paired = dealt.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other")
    found = stored(paired.groupBy("dim", "low", "high").applyInArrow(_tile(kind, threshold), "id bigint, n bigint, root bigint"), "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("others"))
    roots = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    info = stored(
        classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
            "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
        ), "info"
    )
    out = fit.join(info, "embedding", "left").select("id", "n_links", F.col("component").alias("component_id"))
    rest = rows.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(rest).select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
