"""Quality scores: kernel ridge regression by random Fourier features over document statistics.

Each whole text becomes a vector of statistics in one pass. They are standardised and sent through
random cosines whose expectation is a Gaussian kernel; each partition sums its part of the normal
equations, the parts are summed by entry, and the ridge solution of that fixed-size system scores
every document. An isotonic fit on the other half of the labelled rows turns scores into
probabilities of label 1.

Only a sample of at most ``TRAIN_ROWS`` labelled rows is fitted; everything is scored.

Defined results: a null text counts as empty; empty texts have statistics of zero and get a score.
A null identifier is not held out. With no usable labels every score is 0.5. Rows that repeat are
scored each. An empty table gives an empty result. Only identifier and text are read from documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapforge.llm.labelled import calibrated, held_out, isotonic, training_ids
from hapforge.shared import materialize

#: Most labelled rows that are fitted and calibrated on.
TRAIN_ROWS = 24_000
#: Random Fourier features, the kernel's width, and the ridge penalty a row.
COSINES, WIDTH, RIDGE = 192, 3.0, 1e-3
SEED = 20_240

STATISTICS = (
    "log_bytes", "log_words", "word_length", "letter_share", "upper_share", "digit_share", "space_share", "symbol_share", "pipe_share", "shout_share", "stop_share", "comma_share",
    "distinct_words", "distinct_lines", "top_word", "log_lines", "line_length", "short_words", "long_words", "high_share", "symbol_words",
)

_UPPER, _DIGIT, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
_SYMBOLS, _PIPE, _SHOUT, _COMMA = b"#$%&*+<>=@\\^_`{}~[]/", b"|", b"!?", b",;:."
_HIGH = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    lower = data.lower()
    words = lower.split()
    m = len(words)
    if not m:
        return [float(np.log1p(n)), *[0.0] * 5, 1.0, *[0.0] * (len(STATISTICS) - 7)]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = list(map(len, words))
    lines = data.split(b"\n")
    upper, digit, space, symbol, high = share(_UPPER), share(_DIGIT), share(_SPACE), share(_SYMBOLS), share(_HIGH)
    pipe, shout, comma = share(_PIPE), share(_SHOUT), share(_COMMA)
    letters = 1.0 - digit - space - symbol - pipe - shout - comma
    tail = sum(1 for w in words if w[-1] in _SYMBOLS or w[-1] in b"!|")
    return [
        float(np.log1p(n)), float(np.log1p(m)), (n - n * space) / m, letters, upper, digit, space, symbol, pipe, shout, sum(c for w, c in counts.items() if len(w) <= 3) / m, comma,
        len(counts) / m, len(set(lines)) / len(lines), max(counts.values()) / m, float(np.log1p(len(lines))), n / len(lines) / 1000, sum(x <= 3 for x in lengths) / m, sum(x >= 12 for x in lengths) / m, high, tail / m,
    ]


def statistic_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) with the statistics of every whole text."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            flat = np.array(rows, float).reshape(-1)
            offsets = pa.array((np.arange(batch.num_rows + 1) * len(STATISTICS)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, x array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


class KernelRidge:
    """Standardised statistics -> cosines -> ridge weights -> probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, cosines: int = COSINES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, 1.0 / width, (len(mean), cosines))
        self.b = rng.uniform(0.0, 2 * np.pi, cosines)
        self.weights = np.zeros(cosines + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6.0, 6.0)
        c = np.cos(z @ self.w + self.b) * np.sqrt(2.0 / self.w.shape[1])
        return np.hstack([c, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.raw(x), self.knots)


def normal_equations(rows: DataFrame, model: KernelRidge) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over (x, label): each partition emits its sums, Spark adds them entry by entry.

    What comes to the driver is one fixed-size system, whatever the number of rows.
    """
    width = len(model.mean)

    def run(batches):
        total = None
        for batch in batches:
            z, y = model.cosines(_matrix(batch.column(0), width)), batch.column(1).to_numpy(zero_copy_only=False)
            part = np.hstack([z.T @ z, (z.T @ y)[:, None]])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    summed = rows.select("x", F.col("label").cast("double").alias("y")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    d = len(model.weights)
    out = np.zeros((d, d + 1))
    out[summed.i, summed.j] = summed.v
    return out[:, :d], out[:, d]


def fit(rows: DataFrame) -> KernelRidge | None:
    """From (x, label, half): half 0 is fitted, half 1 calibrates."""
    n = len(STATISTICS)
    # The sample is bounded by TRAIN_ROWS, so its moments and calibration rows fit the driver.
    first = rows.where("half = 0")
    cols = [f(F.col("x")[i]).alias(f"{g}{i}") for i in range(n) for g, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = first.agg(F.count(F.lit(1)).alias("rows"), *cols).first()
    if not stats["rows"]:
        return None
    mean = np.array([stats[f"m{i}"] for i in range(n)])
    scale = np.array([max(stats[f"s{i}"], 1e-3) for i in range(n)])
    model = KernelRidge(mean, scale)
    zz, zy = normal_equations(first, model)
    penalty = RIDGE * stats["rows"] / COSINES * np.eye(len(zz))
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(zz + penalty, zy)
    rest = rows.where("half = 1").select("x", "label").toPandas()
    if len(rest):
        model.knots = isotonic(model.raw(np.stack(rest.x.to_numpy())), rest.label.to_numpy())
    return model


def score(stats: DataFrame, model: KernelRidge | None, threshold: float) -> DataFrame:
    width = len(STATISTICS)

    def run(batches):
        for batch in batches:
            p = model.probability(_matrix(batch.column(1), width)) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = stats.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = materialize(statistic_rows(docs, id_col, text_col), "statistics")
    sample = F.broadcast(materialize(training_ids(labels, label_col, most), "train-ids"))  # at most `most` rows
    rows = materialize(stats.join(sample, "doc_id").select("x", "label", "half"), "train-rows")
    return score(stats, fit(rows), threshold)
