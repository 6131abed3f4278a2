"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is mined from one half of the labelled sample: words, and beginnings of words, that are far
more frequent in toxic documents. The features of a whole text are densities of lexicon words, how
close they stand to words of the second person, capitals, punctuation, and words obfuscated by
digits or signs, which are also looked up as they would be read. Trees are boosted on the other half,
less a part that calibrates them.

Only a sample of at most ``TRAIN_ROWS`` labelled rows is learned from; everything is scored.

Defined results: a null text counts as empty; empty texts have features of zero and get a score. A
null identifier is not held out. With no usable labels every score is 0. Rows that repeat are scored
each. An empty table gives an empty result. Only identifier and text are read from documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapforge.llm.exact_dedup import sha256_text
from hapforge.llm.labelled import calibrated, held_out, isotonic, training_ids
from hapforge.shared import materialize, temporary

#: Most labelled rows that are learned from, and most lexicon entries.
TRAIN_ROWS, LEXICON = 30_000, 600
#: An entry stands in this many toxic documents of the sample, and is this many times as frequent in them.
SUPPORT, LIFT = 6, 4.0
#: Lengths of word beginnings that can be entries.
STEMS = range(4, 9)
TREES, DEPTH, RATE, BINS, LEAF = 120, 3, 0.12, 32, 12
#: Words a worker remembers; then it starts anew.
MEMO = 100_000
#: Rows of a batch that a worker takes up at once.
SLICE = 512
#: Words between a lexicon word and one of the second person.
NEAR = 5
#: Most digests of toxic texts that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 125_000

#: Pronouns of the second person, and readings of signs in obfuscated words.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi ton ta tes vous votre vos ti tuyo tus usted ustedes su".split())
READ = str.maketrans("013457@$!|", "oieastasil")

FEATURES = (
    "log_words", "strong", "strong_share", "best", "weight", "weight_share", "distinct", "stems", "stem_share", "near_second", "near_share", "second_share",
    "upper_share", "shout_share", "symbol_share", "obfuscated_share", "obfuscated_hits", "digit_share", "word_length", "pipe_share", "whole_best",
)

_LETTERS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[^\W\d_]+[0-9@$!|*]+[^\W\d_]+\b")
_UPPER, _SHOUT, _SYMBOLS, _DIGIT = bytes(range(65, 91)), b"!?", b"#$%&*+<>=@\\^_`{}~", bytes(range(48, 58))


class Lexicon(dict):
    """Lower-case word -> (weight, 1 for a whole word or 2 for a beginning), or None."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.words = {k[1:]: v for k, v in entries.items() if k[0] == "="}
        self.stems = {k[1:]: v for k, v in entries.items() if k[0] == "^"}

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.clear()
        found = (self.words[word], 1) if word in self.words else None
        stem = max((self.stems[s] for n in STEMS if len(word) >= n and (s := word[:n]) in self.stems), default=0.0)
        if stem and (found is None or stem > found[0]):
            found = (stem, 2)
        self[word] = found
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    data = text.encode()
    n = len(data)
    words = _LETTERS.findall(text.lower())
    m = len(words)
    if not m:
        return [0.0] * len(FEATURES)
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    found = list(map(lexicon.__getitem__, words))
    hits = [(i, h) for i, h in enumerate(found) if h is not None]
    masked = [w.lower().translate(READ).replace("*", "") for w in _MASKED.findall(text)]
    masked_hits = [h for w in masked if (h := lexicon[w]) is not None]
    whole = [h[0] for _, h in hits if h[1] == 1]
    weights = [h[0] for _, h in hits] + [h[0] for h in masked_hits]
    second = [i for i, w in enumerate(words) if w in SECOND]
    near = 0
    if second and hits:
        at = np.array(second)
        pos = np.searchsorted(at, [i for i, _ in hits])
        where = np.array([i for i, _ in hits])
        gap = np.minimum(np.abs(where - at[np.minimum(pos, len(at) - 1)]), np.abs(where - at[np.maximum(pos - 1, 0)]))
        near = int((gap <= NEAR).sum())
    stems = len(hits) - len(whole)
    return [
        float(np.log1p(m)), float(len(whole)), 100 * len(whole) / m, max(weights, default=0.0), sum(weights), 100 * sum(weights) / m, float(len({words[i] for i, _ in hits})), float(stems), 100 * stems / m,
        float(near), near / max(1, len(hits)), 100 * len(second) / m, share(_UPPER), share(_SHOUT), share(_SYMBOLS), len(masked) / m, float(len(masked_hits)), share(_DIGIT), sum(map(len, words)) / m, share(b"|"), max(whole, default=0.0),
    ]


def _entries(text: str) -> set[str]:
    words = set(_LETTERS.findall(text.lower()))
    return {"=" + w for w in words} | {"^" + w[:n] for w in words for n in STEMS if len(w) >= n}


def mine_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries from (text, label): partitions count documents, Spark adds the counts, and the best by smoothed log ratio are kept."""

    totals = {bool(r["toxic"]): r["count"] for r in rows.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}
    if not totals.get(True) or not totals.get(False):
        return {}

    def counted(part: DataFrame, among: frozenset[str] | None) -> DataFrame:
        def run(batches):
            counts: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    counts.update(_entries(text) if among is None else _entries(text) & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

        return part.select("text").mapInArrow(run, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))

    # Both lists come from a sample of bounded size.
    toxic = {r["entry"]: r["n"] for r in counted(rows.where("label > 0"), None).where(F.col("n") >= SUPPORT).collect()}
    clean = {r["entry"]: r["n"] for r in counted(rows.where("label <= 0"), frozenset(toxic)).collect()}
    lift = {k: (n / totals[True]) / ((clean.get(k, 0) + 1.0) / (totals[False] + 1.0)) for k, n in toxic.items()}
    ranked = sorted((k for k in toxic if lift[k] >= LIFT), key=lambda k: (-toxic[k] * np.log(lift[k]), k))
    return {k: float(np.log(lift[k])) for k in ranked[:LEXICON]}


class BoostedTrees:
    """Trees of one depth over binned features, boosted on the logistic loss."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate
        self.base = 0.0
        self.cuts: list[np.ndarray] = []
        self.feature = np.zeros((0, 0), int)
        self.bound = np.zeros((0, 0))
        self.value = np.zeros((0, 0))
        self.knots = (np.array([0.0]), np.array([0.0]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        inner = 2**self.depth - 1
        feature, bound, value = [], [], []
        raw = np.full(len(x), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(x), int)
            f, b = np.zeros(inner, int), np.full(inner, np.inf)
            for level in range(self.depth):
                for at in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == at)
                    if len(rows) >= 2 * LEAF and (split := self._split(bins[rows], g[rows], h[rows])):
                        f[at], cut = split
                        b[at] = self.cuts[f[at]][cut]
                rows_b = x[np.arange(len(x)), f[node]] > b[node]
                node = 2 * node + 1 + rows_b
            leaf = node - inner
            gain, weight = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            v = self.rate * gain / (weight + 1.0)
            raw += v[leaf]
            feature.append(f)
            bound.append(b)
            value.append(v)
        self.feature, self.bound, self.value = np.array(feature), np.array(bound), np.array(value)
        return self

    def _split(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, at, all_g, all_h = 1e-3, None, g.sum(), h.sum()
        base = all_g**2 / (all_h + 1.0)
        for j, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            size = len(cuts) + 1
            gs, hs, ns = (np.cumsum(np.bincount(bins[:, j], w, size))[:-1] for w in (g, h, np.ones(len(g))))
            gain = gs**2 / (hs + 1.0) + (all_g - gs) ** 2 / (all_h - hs + 1.0) - base
            gain[(ns < LEAF) | (len(g) - ns < LEAF)] = 0.0
            if gain.max() > best:
                best, at = gain.max(), (j, int(gain.argmax()))
        return at

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        for f, b, v in zip(self.feature, self.bound, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += v[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.raw(x), self.knots)


def feature_rows(docs: DataFrame, entries: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, x) with the features of every whole text, and its digest if ``keyed``."""
    sent = docs.sparkSession.sparkContext.broadcast(entries)  # at most LEXICON entries

    def run(batches):
        lexicon = Lexicon(sent.value)
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            flat = np.array([features(t, lexicon) for t in batch.column(1).to_pylist()], float).reshape(-1)
            offsets = pa.array((np.arange(batch.num_rows + 1) * len(FEATURES)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), *batch.columns[2:]], ["doc_id", "x", *batch.schema.names[2:]])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([sha256_text(text).alias("digest")] if keyed else []))
    return rows.mapInArrow(run, f"doc_id bigint, x array<double>{', digest string' if keyed else ''}")


def fit(rows: DataFrame) -> BoostedTrees | None:
    """From (doc_id, x, label), at most TRAIN_ROWS of them: three quarters grow trees, the rest calibrates."""
    data = rows.orderBy("doc_id").toPandas()
    if not len(data) or data.label.nunique() < 2:
        return None
    x, y = np.stack(data.x.to_numpy()), (data.label.to_numpy() > 0).astype(float)
    rest = np.arange(len(x)) % 4 == 3
    model = BoostedTrees().fit(x[~rest], y[~rest])
    model.knots = isotonic(model.raw(x[rest]), y[rest], prior=0.5)
    return model


def score(rows: DataFrame, model: BoostedTrees | None, threshold: float) -> DataFrame:
    width = len(FEATURES)
    key = [c for c in rows.columns if c == "digest"]

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            p = model.probability(x) if model is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), *batch.columns[2:]], ["doc_id", "score", *key])

    scored = rows.select("doc_id", "x", *key).mapInArrow(run, f"doc_id bigint, score double{', digest string' if key else ''}")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *key)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, most: int = TRAIN_ROWS, keyed: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and the digest of its text if ``keyed``."""
    sample = materialize(training_ids(labels, label_col, most), "train-ids")
    lexicon_ids = F.broadcast(sample.where("half = 0").select(F.col("doc_id").alias("__id"), "label"))  # at most `most` rows
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    entries = mine_lexicon(materialize(texts.join(lexicon_ids, "__id").select("text", "label"), "lexicon-texts"))
    rows = materialize(feature_rows(docs, entries, id_col, text_col, keyed), "features")
    known = rows.join(F.broadcast(sample.where("half = 1").drop("half")), "doc_id").select("doc_id", "x", "label")
    return score(rows, fit(known), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't scored as toxic. Texts decide, as a score depends on nothing else."""
    with temporary(docs.sparkSession) as scratch:
        bad = toxicity_scores(docs, labels, id_col, text_col, threshold=threshold, keyed=True).where("predicted = 1")
        bad = materialize(bad.select(F.col("digest").alias("__bad")).distinct(), "toxic-texts")
        scratch.keep(bad)
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    tagged = docs.withColumn("__digest", sha256_text(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return tagged.join(bad, F.col("__digest") == F.col("__bad"), "left_anti").drop("__digest")
