"""Labelled rows for classifiers: the held-out split, bounded samples, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Held out: rows whose crc32 of the identifier's text leaves remainder 0.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_ids(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, half): at most about ``most`` labelled rows that aren't held out, chosen by a hash of the identifier.

    Rows with a null identifier or label aren't used; of repeated identifiers the largest label counts.
    ``half`` splits them in two, so that what is learned on one part is weighed on the other.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = rows.count()
    share = 1.0 if n <= most else most / n
    pick = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000))
    return rows.where(pick < int(share * 1_000_000)).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))


def isotonic(scores: np.ndarray, labels: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the best rising fit, each block smoothed towards the mean by ``prior`` rows."""
    if not len(scores):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(scores, kind="stable")
    x, y = scores[order], labels[order].astype(float)
    mean = y.mean()
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for xi, yi in zip(x.tolist(), y.tolist(), strict=True):
        if blocks and blocks[-1][3] == xi:
            blocks[-1][0] += yi
            blocks[-1][1] += 1
        else:
            blocks.append([yi, 1.0, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    value = np.array([(s + prior * mean) / (n + prior) for s, n, _, _ in blocks])
    value = np.maximum.accumulate(value)
    return np.array([v for b in blocks for v in b[2:4]]), np.repeat(value, 2)


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(raw, *knots), 0.0, 1.0)
