"""Document fingerprints: a canonical exact digest.

A text is folded (compatibility composition NFKC, full case folding, runs of white space to one
space, ends trimmed) and hashed by several independently seeded 64-bit xxhash lanes. Documents whose
lanes agree form a bucket; inside a bucket the folded texts themselves are compared, and if a bucket
ever holds two of them, the fingerprints of all but the first (by byte order) carry a number. Where
edited texts are fingerprinted too, they fall into the same buckets and are compared there likewise.

The normaliser and the case folder are the ICU library that Spark ships, called through the SQL
function ``reflect``; no Python runs on the executors.

Defined results: a null text counts as empty, and the empty text has a fingerprint like any other.
Rows with null identifiers come first in the order of documents; rows that share an identifier are
ordered by a hash of their text, then by the text. One document is its own successor. An empty table gives an empty result.
Only the identifier and text columns are read, so names of other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hapforge.shared import materialize

#: 64-bit lanes of a fingerprint.
LANES = 4
#: Most buckets whose keys are broadcast when their texts are compared; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Most ranges of identifiers into which documents are dealt to find each one's successor.
MAX_RANGES = 1024


def fold(text: Column) -> Column:
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\x{1680}\x{2028}\x{2029}]+", " "))


def lanes_of(folded: Column, lanes: int = LANES) -> Column:
    """Hex of the lanes; each starts from the hash of its own number, so they are independent."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(i), folded)), 16, "0")) for i in range(lanes)])


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def keyed_texts(docs: DataFrame, text_col: str = "text", hashed=lanes_of) -> DataFrame:
    """(lanes, folded) of every row."""
    return docs.select(fold(_text(text_col)).alias("folded")).select(hashed(F.col("folded")).alias("lanes"), "folded")


def clashing_texts(keyed: DataFrame, lanes: DataFrame) -> DataFrame | None:
    """Compare the folded texts of every bucket with several rows.

    ``keyed`` holds (lanes, folded), ``lanes`` the lanes of the same rows from wherever they are cheapest
    to read. Returns (lanes, folded, number) of the buckets with more than one folded text, or None.
    """
    buckets = materialize(lanes.groupBy("lanes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lanes"), "buckets")
    n = buckets.count()
    if not n:
        return None
    keys = buckets.select(F.xxhash64("lanes").alias("__key")).distinct()
    keys = F.broadcast(keys) if n <= BROADCAST_ROWS else keys
    shared = keyed.withColumn("__key", F.xxhash64("lanes")).join(keys, "__key", "left_semi")
    texts = shared.groupBy("lanes", "folded").agg(F.count(F.lit(1)).alias("n"))
    several = materialize(texts.groupBy("lanes").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("lanes"), "clashes")
    if several.isEmpty():
        return None
    numbered = texts.join(several, "lanes", "left_semi").groupBy("lanes").agg(F.sort_array(F.collect_list("folded")).alias("all"))
    return materialize(numbered.select("lanes", F.posexplode("all").alias("number", "folded")), "numbered")


def _print(lanes: Column, number: Column | None) -> Column:
    return lanes if number is None else F.concat(lanes, F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(F.lit("")))


def _numbered(df: DataFrame, clashes: DataFrame | None, lanes: str, folded: str, out: str) -> DataFrame:
    if clashes is None:
        return df.withColumn(out, F.col(lanes)).drop(folded)
    c = clashes.select(F.col("lanes").alias("__l"), F.col("folded").alias("__f"), "number")
    joined = df.join(c, (F.col(lanes) == F.col("__l")) & (F.col(folded) == F.col("__f")), "left")
    return joined.withColumn(out, _print(F.col(lanes), F.coalesce("number", F.lit(0)))).drop("__l", "__f", "number", folded)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=lanes_of) -> DataFrame:
    """(doc_id, fingerprint): equal exactly where the folded texts are equal."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fold(_text(text_col)).alias("folded")).withColumn("lanes", hashed(F.col("folded")))
    keyed = keyed_texts(docs, text_col, hashed)
    return _numbered(rows, clashing_texts(keyed, keyed.select("lanes")), "lanes", "folded", "fingerprint").select("doc_id", "fingerprint")


def likeness(a: Column, b: Column) -> Column:
    """An exact digest knows only equal and different."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def with_successor(rows: DataFrame, carry: tuple[str, ...] = ("text",)) -> DataFrame:
    """``rows`` (doc_id, text, ...) with next_<c> of the next identifier for each carried column, of the first after the last.

    Identifiers are cut into ranges of about equal counts and each range is one window partition. The
    first row of a range is also dealt, as a guard, to the range before it, so no window spans ranges.
    """
    ids = rows.select("doc_id")
    parts = min(MAX_RANGES, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = sorted(set(cut or []))
    array = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.lit(None).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull() | array.isNull(), F.lit(0)).otherwise(F.size(F.filter(array, lambda b: b <= F.col("doc_id"))))
    firsts = {r[0]: r[1] for r in ids.withColumn("range", place).groupBy("range").agg(F.min(F.struct("doc_id")).alias("m")).select("range", "m.doc_id").collect()}
    names = rows.columns
    rows = rows.withColumn("range", place)
    if order := sorted(firsts):
        before = {p: order[i - 1] for i, p in enumerate(order)}
        head = F.get(F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(order[-1] + 1)]), F.col("range"))
        back = F.get(F.array(*[F.lit(before.get(p)).cast("int") for p in range(order[-1] + 1)]), F.col("range"))
        own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guard"))
        guard = F.struct(back.alias("range"), F.lit(True).alias("guard"))
        dealt = F.explode(F.when(head.eqNullSafe(F.col("doc_id")), F.array(own, guard)).otherwise(F.array(own)))
        rows = rows.select(*names, dealt.alias("at")).select(*names, "at.range", "at.guard")
    else:
        rows = rows.withColumn("guard", F.lit(False))
    w = Window.partitionBy("range").orderBy("guard", "doc_id", F.xxhash64("text"), "text")
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where("NOT guard").drop("range", "guard")


def half_edited(text: Column, next_text: Column) -> Column:
    """The last floor(n/2) code points replaced by as many first ones of the next text, or by all it has."""
    half = (F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def edited_texts(docs: DataFrame, clashes: DataFrame | None, id_col: str, text_col: str, hashed) -> DataFrame:
    """Per document its print and its successor's, and the digest, folded form and lanes of its half-edited text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(text_col).alias("text"))
    rows = rows.withColumn("folded", fold(F.col("text"))).withColumn("lanes", hashed(F.col("folded")))
    rows = with_successor(_numbered(rows, clashes, "lanes", "folded", "print").drop("lanes"), ("text", "print"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "print", "next_print", half_edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("folded", fold(F.col("edited"))).drop("edited")
    return rows.withColumn("lanes", hashed(F.col("folded")))


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=lanes_of) -> DataFrame:
    """Per document: its fingerprint, that of its half-edited text, and how alike they and the successor's are.

    The folded edited texts are written once, beside their lanes, so that buckets are counted on narrow
    columns and texts are read again only for shared buckets. Only if a bucket holds different texts are
    the documents numbered, and their successors found, a second time.
    """
    rows = materialize(edited_texts(docs, None, id_col, text_col, hashed), "edited")
    keyed = keyed_texts(docs, text_col, hashed).union(rows.select("lanes", "folded"))
    clashes = clashing_texts(keyed, rows.select(F.col("print").alias("lanes")).union(rows.select("lanes")))
    if clashes is not None:
        rows = edited_texts(docs, clashes, id_col, text_col, hashed)
    rows = _numbered(rows, clashes, "lanes", "folded", "edited_print")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
