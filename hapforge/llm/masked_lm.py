"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts a word from the words at both its sides: embeddings of the two neighbours, a
tanh layer, and a softmax over frequent words and hash buckets of all others. It is trained in numpy
on how often each (left, word, right) triple of these classes occurs in the whole corpus, a table of
fixed size. Every word of the corpus is predicted as itself: one in a bucket has the probability of
its bucket times its share of the bucket's words. The counts behind the shares are a distributed
table of all words, which grows with the corpus; the frequent end of it is broadcast, and rarer
words meet it in a join. A document's score is the sum of the log-probabilities of its words, each
given both neighbours, in whole texts. Neighbours are seen as one of ``CONTEXTS`` classes.

Defined results: a null text counts as empty; a text without words has 0 tokens, a sum of 0 and a
null mean. Rows that repeat are scored each and counted each. An empty table gives an empty result.
Only the identifier and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapforge.shared import materialize

#: Output vocabulary: frequent words, then hash buckets. Contexts: the edge, frequent words, then hash buckets.
WORDS, BUCKETS = 448, 64
CONTEXT_WORDS, CONTEXT_BUCKETS = 39, 8
OUTPUTS, CONTEXTS = WORDS + BUCKETS, 1 + CONTEXT_WORDS + CONTEXT_BUCKETS
#: Size of an embedding, of the hidden layer, steps and rate of training, and smoothing of the counts.
EMBED, HIDDEN, STEPS, RATE, SMOOTH = 16, 32, 240, 0.03, 1e-4
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
#: Most words in buckets whose shares are broadcast; the shares of all others are joined by shuffle.
HEAD = 200_000
SEED = 7

_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(None, _SIGNS).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over every document."""

    def run(batches):
        def packed(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > HELD:
                    yield packed(counts)
                    counts = Counter()
        yield packed(counts)

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Word -> output; words that aren't listed fall into a bucket by their crc32."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: i for i, w in enumerate(words)})

    def __missing__(self, word: bytes) -> int:
        return WORDS + zlib.crc32(word) % BUCKETS

    def outputs(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_shares(counted: DataFrame, words: list[bytes]) -> DataFrame:
    """(word, n, share) of every word that isn't listed: share is the log of its part in its bucket."""
    listed = counted.sparkSession.createDataFrame([(w,) for w in words], "word binary")
    rest = counted.join(F.broadcast(listed), "word", "left_anti").withColumn("bucket", F.crc32("word") % BUCKETS)
    totals = rest.groupBy("bucket").agg(F.sum("n").alias("total"))  # at most BUCKETS rows
    return rest.join(F.broadcast(totals), "bucket").select("word", "n", F.log(F.col("n") / F.col("total")).alias("share"))


def least_count(shares: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` words are counted as often as."""
    sizes = {r["k"]: r["count"] for r in shares.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}
    k, held = max(sizes, default=-1) + 1, 0
    while k > 0 and held + sizes.get(k - 1, 0) <= most:
        k -= 1
        held += sizes.get(k, 0)
    return 2**k


def contexts(outputs: np.ndarray) -> np.ndarray:
    return np.where(outputs < CONTEXT_WORDS, 1 + outputs, 1 + CONTEXT_WORDS + outputs % CONTEXT_BUCKETS)


def cells(outputs: np.ndarray) -> np.ndarray:
    """For each word the cell of its (left, right, word) triple; the edges of a text are a context of their own."""
    c = np.concatenate([[0], contexts(outputs), [0]])
    return (c[:-2] * CONTEXTS + c[2:]) * OUTPUTS + outputs


def triple_counts(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(cell, n) over every document."""

    def run(batches):
        vocabulary, total = Vocabulary(words), np.zeros(CONTEXTS * CONTEXTS * OUTPUTS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, cells(vocabulary.outputs(text)), 1)
        some = np.flatnonzero(total)
        for lo in range(0, len(some), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[lo : lo + 200_000]), pa.array(total[some[lo : lo + 200_000]])], ["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


class WindowNetwork:
    """softmax(tanh([E_l ; E_r] W + b) V + c) over all pairs of contexts at once."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "left": rng.normal(0, 0.3, (CONTEXTS, EMBED)), "right": rng.normal(0, 0.3, (CONTEXTS, EMBED)),
            "w": rng.normal(0, 0.3, (2 * EMBED, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.1, (HIDDEN, OUTPUTS)), "c": np.zeros(OUTPUTS),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.l, self.r = np.divmod(np.arange(CONTEXTS * CONTEXTS), CONTEXTS)

    def forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        e = np.hstack([p["left"][self.l], p["right"][self.r]])
        h = np.tanh(e @ p["w"] + p["b"])
        z = h @ p["v"] + p["c"]
        z -= z.max(1, keepdims=True)
        return e, h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, counts: np.ndarray, steps: int = STEPS) -> list[float]:
        """Full-batch Adam on the cross entropy of the counted triples; returns the losses."""
        counts = counts.reshape(CONTEXTS * CONTEXTS, OUTPUTS)
        total = float(counts.sum())
        if not total:
            return []
        start = (counts.sum(0) + SMOOTH * total) / (total * (1 + SMOOTH * OUTPUTS))
        self.p["c"] = np.log(start).astype(np.float32)
        share = (counts / total).astype(np.float32)
        mass = share.sum(1, keepdims=True)
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses = []
        for t in range(1, steps + 1):
            e, h, logp = self.forward()
            losses.append(-float(np.vdot(share, logp)))
            dz = mass * np.exp(logp) - share
            dh = (dz @ self.p["v"].T) * (1 - h * h)
            de = dh @ self.p["w"].T
            g = {"v": h.T @ dz, "c": dz.sum(0), "w": e.T @ dh, "b": dh.sum(0), "left": np.zeros_like(self.p["left"]), "right": np.zeros_like(self.p["right"])}
            np.add.at(g["left"], self.l, de[:, :EMBED])
            np.add.at(g["right"], self.r, de[:, EMBED:])
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return losses

    def table(self) -> np.ndarray:
        """Log-probability of each output for each pair of contexts, one row after the other."""
        return self.forward()[2].astype(np.float32).reshape(-1)


def masked_lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, sum_logprob, mean_logprob of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = materialize(word_counts(rows), "words")
    words = [bytes(r["word"]) for r in vocabulary.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    shares = word_shares(vocabulary, words)
    bound = least_count(shares, HEAD)
    head = {bytes(r["word"]): r["share"] for r in shares.where(F.col("n") >= bound).select("word", "share").collect()}  # at most HEAD rows
    counted = materialize(triple_counts(rows, words), "triples").toPandas()  # at most one row a cell of a fixed table
    counts = np.zeros(CONTEXTS * CONTEXTS * OUTPUTS)
    counts[counted.cell.to_numpy(np.int64)] = counted.n.to_numpy(float)
    network = WindowNetwork()
    network.train(counts)
    sent = spark.sparkContext.broadcast((words, network.table(), head))

    def run(batches):
        words, table, head = sent.value
        vocabulary = Vocabulary(words)
        for batch in batches:
            n, total, tails = [], [], []
            for text in batch.column(1).to_pylist():
                own = words_of(text)
                outputs = np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own))
                in_buckets = [own[i] for i in np.flatnonzero(outputs >= WORDS).tolist()]
                found = list(map(head.get, in_buckets))
                n.append(len(own))
                total.append(float(table[cells(outputs)].sum(dtype=np.float64)) + sum(s for s in found if s is not None))
                tails.append([w for w, s in zip(in_buckets, found, strict=True) if s is None])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(tails, pa.list_(pa.binary()))], ["doc_id", "n_tokens", "sum_logprob", "tail"])

    scored = rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, sum_logprob double, tail array<binary>")
    if bound > 1:
        scored = materialize(scored.withColumn("locator", F.monotonically_increasing_id()), "scored")
        tail = scored.select("locator", F.explode("tail").alias("word")).join(shares.where(F.col("n") < bound), "word")
        tail = tail.groupBy("locator").agg(F.sum("share").alias("more"))
        scored = scored.join(tail, "locator", "left").withColumn("sum_logprob", F.col("sum_logprob") + F.coalesce("more", F.lit(0.0)))
    scored = scored.select("doc_id", "n_tokens", "sum_logprob")
    return scored.withColumn("mean_logprob", F.when(F.col("n_tokens") > 0, F.col("sum_logprob") / F.col("n_tokens")))
