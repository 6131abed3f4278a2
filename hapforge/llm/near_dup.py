"""Near-duplicates by circulant MinHash.

Two permutations of the 32-bit universe make all coordinates of a signature: the first scatters a
shingle, the second is applied after a circular shift by the coordinate's number. The signature is
cut into bands; documents that agree in a band share a bucket. The number of bands follows from the
rows of a band and the threshold, so that a pair right at the threshold is missed by all bands with
a probability under ``MISS``.

Equal shingle sets are one *node*. No bucket is ever expanded into all its pairs:

1. in each bucket every node is compared with the bucket's least node, on the full sets;
2. the links found give components, and only buckets that hold several of them are looked at again.
   There shingles that no other node of such buckets has bound every intersection, which rules out
   whole nodes: of a large group around one text, those that drifted too far from all others;
3. in each such bucket the nodes left are compared with the one that has the fewest shingles of its
   own, the most central, and components are merged by the links found;
4. in buckets that still hold several components, the nodes outside the largest one meet the nodes
   of other components, less what can't be linked: by the sizes, by the triangle inequality of the
   Jaccard distance (through the least node), by the bounds of step 2, or by parity bitmaps.

A parity bitmap has one bit for each class of shingles, set where a node has an odd number of them.
Two nodes differ in at least as many shingles as their bitmaps do in bits, so bitmaps that are too
far apart rule a pair out without its sets, and nearly all pairs that are left are links. A join of
step 3 or 4 thus puts out links and few other pairs, however large a group around one text is.

After that every pair of the same bucket is in one component, compared, or provably too different,
so no link between components is lost. Every comparison counts the intersection of whole sets.

``keep_representatives`` decides by row: rows are told apart by identifier and text.

Defined results: a null or blank text has an empty set and is linked with nothing. A text with fewer
words than a shingle is one shingle. Rows that repeat an identifier are the same document. Null
identifiers rank above all others; a component of such rows alone has a null component_id. An empty
table gives an empty result. Only the identifier and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapforge.llm.exact_dedup import sha256_text
from hapforge.shared import materialize, temporary

#: Words of a shingle and least similarity in per cent where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Rows of a band.
ROWS = 6
#: Largest probability that a pair at the threshold shares no band.
MISS = 1e-6
#: Most identifiers that are broadcast to pick candidate documents; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: 64-bit words of a parity bitmap.
PARITY = 16
#: Shingles worked on at a time, to stay in the cache.
SLAB = 1 << 16

SIGNED = "doc_id bigint, n_shingles bigint, node bigint, twin bigint, bands array<bigint>"
SETS = "node bigint, shingles array<bigint>, parity array<bigint>"


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permute32(x: np.ndarray, key: int) -> np.ndarray:
    """A bijection of the 32-bit numbers, in place."""
    x ^= np.uint32(key)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; cut at space and \\x09-\\x0D only."""
    return text.encode().lower().split()


def shingle_sets(texts: list[str], k: int, seed: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    from xxhash import xxh64_intdigest

    lists = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in lists], np.int64)
    flat = np.fromiter((xxh64_intdigest(w, seed) for ws in lists for w in ws), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    grams = flat.copy()
    for j in range(1, k):
        grams[: len(flat) - j] = grams[: len(flat) - j] * np.uint64(0x9E3779B97F4A7C15) + flat[j:]
    grams = _mix64(grams)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(grams[end - n : end - k + 1]))
        elif n:
            whole = np.uint64(n)
            for w in flat[end - n : end]:
                whole = _mix64(np.array([whole], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digests(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, independent of order."""
    a = np.add.reduceat(_mix64(flat + np.uint64(0xA0761D6478BD642F)), starts)
    b = np.add.reduceat(_mix64(flat ^ np.uint64(0xE7037ED1A0B428DB)), starts)
    return _mix64(a), _mix64(b)


def signatures(flat: np.ndarray, starts: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """coordinates x sets: least values of the circulant permutations."""
    scattered = _permute32((flat >> np.uint64(32)).astype(np.uint32), 0x9E3779B9 ^ seed)
    out = np.empty((coordinates, len(starts)), np.uint32)
    for c in range(coordinates):
        out[c] = np.minimum.reduceat(_permute32(scattered + np.uint32(c), 0x85EBCA6B), starts)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """bands x sets: one 64-bit key a band, salted by the band's number."""
    n = len(sig) // rows
    keys = np.empty((n, sig.shape[1]), np.uint64)
    for j in range(n):
        key = np.full(sig.shape[1], j + 1, np.uint64)
        for r in range(rows):
            key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[j * rows + r].astype(np.uint64))
        keys[j] = key
    return keys


def parity_bitmaps(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """sets x PARITY words: whether a set has an odd number of shingles of each class."""
    bits = 64 * PARITY
    of = np.repeat(np.arange(len(sizes)) * bits, sizes) + ((flat >> np.uint64(7)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(of, minlength=len(sizes) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sizes), bits), axis=1, bitorder="little").view(np.int64)


def _slabs(sets: list[np.ndarray]):
    at, size = 0, 0
    for i, s in enumerate(sets):
        size += len(s)
        if size >= SLAB or i + 1 == len(sets):
            yield at, i + 1
            at, size = i + 1, 0


def sign(docs: DataFrame, k: int, percent: int, rows: int = ROWS, seed: int = 0) -> DataFrame:
    """doc_id, set size, two digests of the set, its band keys, and what columns ``docs`` has after its text."""
    bands = bands_for(percent, rows)
    more = docs.columns[2:]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column(1).to_pylist(), k, seed)
                full = [i for i, s in enumerate(sets) if len(s)]
                node, twin = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                keys = np.zeros((len(sets), bands), np.int64)
                live = [sets[i] for i in full]
                for a, b in _slabs(live):
                    flat = np.concatenate(live[a:b])
                    sizes = np.array([len(s) for s in live[a:b]])
                    starts = np.cumsum(sizes) - sizes
                    at = full[a:b]
                    x, y = set_digests(flat, starts)
                    node[at], twin[at] = x.view(np.int64), y.view(np.int64)
                    keys[at] = band_keys(signatures(flat, starts, bands * rows, seed), rows).T.view(np.int64)
                lens = np.array([bands if len(s) else 0 for s in sets], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                empty = np.array([not len(s) for s in sets], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, mask=empty), pa.array(twin, mask=empty),
                        pa.ListArray.from_arrays(offsets, pa.array(keys[~empty].reshape(-1))), *part.columns[2:],
                    ], ["doc_id", "n_shingles", "node", "twin", "bands", *more],
                )

    return docs.mapInArrow(run, ", ".join([SIGNED, *[f"{c} {kind}" for c, kind in docs.dtypes[2:]]]))


def sets_of(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """node, sorted shingle hashes and parity bitmap of each text that has any shingle."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                sets = [s for s in shingle_sets(batch.slice(lo, 512).column(0).to_pylist(), k, seed) if len(s)]
                if sets:
                    sizes = np.array([len(s) for s in sets])
                    flat = np.concatenate(sets)
                    node, _ = set_digests(flat, np.cumsum(sizes) - sizes)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    words = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY)
                    parity = pa.ListArray.from_arrays(words, pa.array(parity_bitmaps(flat, sizes).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))), parity], ["node", "shingles", "parity"])

    return docs.mapInArrow(run, SETS)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): the least node reachable over ``edges`` (x, y), for nodes that have an edge.

    Each round points every node at the least of itself and its neighbours, follows the pointers
    twice more, and contracts the edges to what they point at. At least half of the nodes that still
    have edges go in a round, and so do all edges inside what has merged. Every round is written.
    """
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).where("x < y").distinct()
    edges = materialize(ordered(edges, "x", "y"), f"{name}-edges")
    labels = None
    while True:
        low = edges.union(edges.select("y", "x")).groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("up"))
        low = materialize(low, name)
        for _ in range(2):
            low = low.join(low.select(F.col("node").alias("at"), F.col("up").alias("top")), F.col("up") == F.col("at")).select("node", F.col("top").alias("up"))
        low = materialize(low, name)
        if labels is None:
            labels = low.withColumnRenamed("up", "comp")
        else:
            labels = materialize(labels.join(low.withColumnRenamed("node", "was"), F.col("comp") == F.col("was"), "left").select("node", F.coalesce("up", "comp").alias("comp")), name)
        x, y = low.select(F.col("node").alias("x"), F.col("up").alias("x_up")), low.select(F.col("node").alias("y"), F.col("up").alias("y_up"))
        edges = materialize(ordered(edges.join(x, "x").join(y, "y"), "x_up", "y_up"), f"{name}-edges")
        if edges.isEmpty():
            return labels


def merged(comps: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``comps`` (node, comp) with further links followed; only links between components are left to follow."""
    side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = links.join(side("x"), "x", "left").join(side("y"), "y", "left").select(F.coalesce("x_comp", "x").alias("x"), F.coalesce("y_comp", "y").alias("y"))
    tops = components(between, name)
    moved = comps.join(tops.select(F.col("node").alias("was"), F.col("comp").alias("top")), F.col("comp") == F.col("was"), "left")
    fresh = tops.join(comps.select("node"), "node", "left_anti")
    return materialize(moved.select("node", F.coalesce("top", "comp").alias("comp")).unionByName(fresh), name)


class _Judge:
    """Compares pairs of nodes on their full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int, seed: int):
        self.docs, self.classes, self.k, self.percent, self.seed = docs, classes, k, percent, seed

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the given nodes, from the text of each one's least document."""
        ids = materialize(self.classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("__rep")).distinct(), "candidates")
        n = ids.count()
        ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi").select("text")
        return materialize(sets_of(texts, self.k, self.seed).dropDuplicates(["node"]), "sets")

    def alone(self, sets: DataFrame) -> DataFrame:
        """(node, alone): how many of a node's shingles no other node in ``sets`` has."""
        held = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
        return held.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))

    def compare(self, pairs: DataFrame, name: str, sets: DataFrame | None = None) -> DataFrame:
        """(x, y, both, either) of each pair (x, y)."""
        if sets is None:
            sets = self.sets(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct())
        xs = sets.select(F.col("node").alias("x"), F.col("shingles").alias("xs"))
        ys = sets.select(F.col("node").alias("y"), F.col("shingles").alias("ys"))
        met = pairs.select("x", "y").join(xs, "x").join(ys, "y").withColumn("both", F.size(F.array_intersect("xs", "ys")).cast("long"))
        return materialize(met.select("x", "y", "both", (F.size("xs") + F.size("ys") - F.col("both")).alias("either")), name)

    def links(self, judged: DataFrame) -> DataFrame:
        return judged.where(F.col("both") * 100 >= F.col("either") * self.percent).select("x", "y")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, rows: int = ROWS, keyed: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    ``keyed`` tells rows apart by identifier and text instead: there is the digest of the text too,
    and of each component only the rows with its least (identifier, digest) are kept.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    key = ["digest"] if keyed else []
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *key)  # null identifiers rank above all others
    with temporary(docs.sparkSession) as scratch:
        for seed in range(4):
            signed = materialize(sign(docs.withColumn("digest", sha256_text(F.col("text"))) if keyed else docs, k, percent, rows, seed), "signed")
            classes = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(own).alias("first"), F.max("n_shingles").alias("n"), F.min("twin").alias("t0"), F.max("twin").alias("t1"))
            classes = materialize(classes, "classes")
            if classes.where("t0 <> t1").isEmpty():  # else two sets share a 64-bit digest: hash anew
                break
        else:
            raise RuntimeError("different shingle sets share a digest under every seed")
        judge = _Judge(docs, classes.select("node", "rep"), k, percent, seed)
        once = signed.where("n_shingles > 0").dropDuplicates(["node"])
        exploded = once.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
        least = exploded.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
        members = materialize(exploded.join(least, "key"), "members")

        sized = classes.select(F.col("node").alias("lead"), F.col("n").alias("lead_n"))
        stars = members.where("node <> lead").groupBy("node", "lead").agg(F.max("n").alias("n")).join(sized, "lead")
        stars = stars.where(F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent)
        stars = materialize(stars.select(F.col("node").alias("x"), F.col("lead").alias("y")), "stars")
        judged = judge.compare(stars, "judged")
        first = components(judge.links(judged), "first")

        far = judged.select(F.col("x").alias("node"), F.col("y").alias("lead"), (1 - F.col("both") / F.col("either")).alias("far"))
        placed = members.join(far, ["node", "lead"], "left").join(first, "node", "left")
        placed = placed.select("key", "node", "n", F.coalesce("comp", "node").alias("comp"), F.when(F.col("node") == F.col("lead"), 0.0).otherwise(F.col("far")).alias("far"))
        placed = materialize(placed, "placed")
        several = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("least_n")).where("c0 <> c1").select("key", "least_n")
        # Written first, so that the joins on a bucket are dealt anew and a large bucket can be split.
        mixed = materialize(placed.join(materialize(several, "several"), "key"), "mixed")
        sets = judge.sets(mixed.select("node").distinct())
        # ``shared`` bounds every intersection of a node; ``least_n`` is the smallest set of the bucket.
        mixed = mixed.join(judge.alone(sets), "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
        possible = F.col("shared") * 100 >= (F.col("n") + F.greatest("least_n", "shared") - F.col("shared")) * percent
        words = [f"p{i}_" for i in range(PARITY)]
        bitmaps = sets.select("node", *[F.col("parity")[i].alias(w) for i, w in enumerate(words)])
        mixed = materialize(mixed.where(possible).select("key", "node", "n", "comp", "far", "shared").join(bitmaps, "node"), "possible")
        most = F.least("shared", "shared2")
        differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}2"))) for w in words), F.lit(0))
        near = differ * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent)
        fitting = (F.col("comp") != F.col("comp2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (most * 100 >= (F.col("n") + F.col("n2") - most) * percent) & near
        in_order = (F.least("node", "node2").alias("x"), F.greatest("node", "node2").alias("y"))

        central = mixed.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("shared")).alias("alone"), "node", "n", "comp", "shared", *words)).alias("hub"))
        central = materialize(central.select("key", *[F.col(f"hub.{c}").alias(f"{c}2") for c in ("node", "n", "comp", "shared", *words)]), "central")
        known = judged.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        spokes = mixed.join(central, "key").where(fitting).select(*in_order).distinct()
        spokes = judge.compare(materialize(spokes.join(known, ["x", "y"], "left_anti"), "spokes"), "judged-spokes", sets)
        known = known.unionByName(spokes.select("x", "y"))
        comps = merged(first, judge.links(spokes), "second")

        mixed = mixed.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        held = mixed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        main = held.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("main"))
        mixed = materialize(mixed.join(materialize(main, "main"), "key"), "apart")
        outer = mixed.where("comp <> main").select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "comp", "far", "shared", *words)])
        room = F.lit(1 - percent / 100 + 1e-9)
        cross = mixed.join(outer, "key").where(
            fitting & ((F.col("comp") == F.col("main")) | (F.col("node") < F.col("node2"))) & F.coalesce(F.abs(F.col("far") - F.col("far2")) <= room, F.lit(True))
        )
        cross = materialize(cross.select(*in_order).distinct().join(known, ["x", "y"], "left_anti"), "cross")
        if not cross.isEmpty():
            comps = merged(comps, judge.links(judge.compare(cross, "judged-more", sets)), "third")
        scratch.keep(signed, classes, comps)

    named = classes.join(comps, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("first").alias("least"))
    final = named.join(lowest, "comp").select("node", "least")
    out = signed.select("doc_id", "n_shingles", "node", *key).join(final, "node", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    kept = kept & (alone | (F.col("digest") == F.col("least.digest"))) if keyed else kept
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *key)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, one document for each component. Rows go by identifier and text, so others that repeat the identifier stay."""
    with temporary(docs.sparkSession) as scratch:
        gone = near_duplicates(docs, id_col, text_col, k, percent, keyed=True).where("NOT kept")
        gone = materialize(gone.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__gone")).distinct(), "near-gone")
        scratch.keep(gone)
    sized = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS // 4 else gone  # digests are wider than identifiers
    tagged = docs.withColumn("__digest", sha256_text(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return tagged.join(sized, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__gone")), "left_anti").drop("__digest")
