"""Sums of products of all column pairs in one scan, whatever the number of columns.

Every task keeps four matrices over its rows, with gaps as zeros and a matrix of what is present: counts,
sums, sums of squares and products, each over the rows where both columns are present. Values are taken around a pilot
mean, so nothing cancels. The matrices leave the task in square blocks; blocks of one place are added where they meet,
one at a time, so that a merging task holds a few blocks and never a whole matrix of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col
from tablescope.plans.runtime import ship_package

#: Columns of one block of a matrix.
BLOCK = 64
#: Columns whose matrices (32 bytes a pair) one task holds; wider tables take a scan per pair of such groups.
WIDTH = 2_000
#: A variance below this part of the sum of squares is rounding, and the column is constant.
FLAT = 1e-12


def pilot_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of every column from one scan; 0 without values."""
    flat = df.select(*[col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    flat = flat.unpivot([], [F.col(f"_c{i}") for i in range(len(columns))], "c", "x").where("NOT isnan(x)")
    # one row per column
    found = {r["c"]: r["m"] for r in flat.groupBy("c").agg(F.avg("x").alias("m")).collect()}
    return {c: found.get(f"_c{i}") or 0.0 for i, c in enumerate(columns)}


def _task_sums(left: int, means: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(means)
        total = np.zeros((6, left, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - means
            there = ~np.isnan(x)
            x[~there] = 0.0
            there = there.astype(float)
            a, m, b, n = x[:, :left], there[:, :left], x, there
            total += np.stack([m.T @ n, a.T @ n, m.T @ b, (a * a).T @ n, m.T @ (b * b), a.T @ b])
        rows = {"i": [], "j": [], "sums": []}
        for i in range(0, left, BLOCK):
            for j in range(0, width, BLOCK):
                if i <= j:
                    rows["i"].append(i)
                    rows["j"].append(j)
                    rows["sums"].append(total[:, i:i + BLOCK, j:j + BLOCK].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(rows["i"]), pa.array(rows["j"]), pa.array(rows["sums"], pa.list_(pa.float64()))], ["i", "j", "sums"])

    return run


def _correlate(left: int, width: int):
    """Adds the blocks of each place and turns them into (i, j, n, r) with i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, k in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), range(batch.num_rows)):
                sums = batch.column("sums")[k].values.to_numpy(zero_copy_only=False)
                total[i, j] = total[i, j] + sums if (i, j) in total else sums.copy()
        for (i, j), sums in total.items():
            h, w = min(BLOCK, left - i), min(BLOCK, width - j)
            n, sa, sb, qa, qb, p = sums.reshape(6, h, w)
            va, vb = n * qa - sa * sa, n * qb - sb * sb
            with np.errstate(invalid="ignore", divide="ignore"):
                r = (n * p - sa * sb) / np.sqrt(va * vb)
            none = (n < 2) | (va <= FLAT * n * qa) | (vb <= FLAT * n * qb)
            a, b = np.meshgrid(np.arange(i, i + h), np.arange(j, j + w), indexing="ij")
            keep = a <= b
            r = np.where(a == b, 1.0, np.clip(r, -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(n[keep].astype(np.int64)), pa.array(r[keep], mask=none[keep])],
                                             ["i", "j", "n", "r"])

    return run


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, n, r)`` with column numbers i <= j: rows where both are present, and Pearson's r (null where undefined).

    Two scans for up to WIDTH columns: one for the pilot means, one for all sums.
    """
    ship_package(df.sparkSession)
    columns = list(columns)
    means = pilot_means(df, columns)
    groups = [columns[s:s + WIDTH] for s in range(0, len(columns), WIDTH)]
    out = None
    for g, first in enumerate(groups):
        for h, second in enumerate(groups[g:], g):
            names = first if g == h else [*first, *second]
            left = len(first)
            numbers = df.select(*[col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(names)])
            sums = numbers.mapInArrow(_task_sums(left, np.array([means[c] for c in names])), "i long, j long, sums array<double>")
            part = sums.repartition("i", "j").mapInArrow(_correlate(left, len(names)), "i long, j long, n long, r double")
            if g != h:
                part = part.where(F.col("j") >= left)
            at = lambda c: F.when(c < left, c + g * WIDTH).otherwise(c - left + h * WIDTH)
            part = part.select(at(F.col("i")).alias("i"), at(F.col("j")).alias("j"), "n", "r")
            out = part if out is None else out.unionByName(part)
    return out
