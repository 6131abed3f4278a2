"""Exact deduplication by a streaming aggregation with keyed state on disk.

Every document becomes a narrow row (SHA-256 digest, identifier, locator). A structured stream over
those rows keeps one state entry per digest in RocksDB, without watermark, so it never expires: the
largest identifier with the locator of its row, and how many rows it has seen. Digests seen more
than once are *hits*; the full bytes of their rows are then compared by grouping on digest and text.
Equal texts meet in map-side partial aggregates first, so a text that a third of all rows share is
sent once per task. If one digest ever covers two texts, its rows are regrouped by the text itself.
Decisions come back to the rows by a join on the digest, in which the rows of the few digests that
hold a sizeable part of the table aren't shuffled: those digests are broadcast.

Everything on the path is DataFrame code that runs in the JVM.

Defined results: a null text counts as the empty text, which is a text like any other. Rows with a
null identifier take part and rank below all others. Rows that repeat both identifier and text are
copies of one another and exactly one of them is kept. An empty table gives an empty result. Only
the identifier and text columns are read, so names of other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hapforge.shared import materialize, scratch_path, temporary

#: Most rows of a key set that is broadcast (16 bytes a row as longs); larger sets are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A digest is hot if it has more than one in so many of all rows; fewer digests than this can be hot.
HOT_KEYS = 10_000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # what is idle goes soon
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space is taken ahead
}


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_text) -> DataFrame:
    """(doc_id, digest, locator): the locator numbers the rows of this table, which is written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), sha256_text(text).alias("text_sha256"))
    if digest is sha256_text:
        rows = rows.drop("text_sha256")
    return materialize(rows.withColumn("locator", F.monotonically_increasing_id()), "digests")


def stream_hits(digests: DataFrame, state_dir: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Run the digest rows through keyed state; returns (digest, keeper struct, group_size) of digests seen twice or more.

    ``state_dir`` names a lasting checkpoint: later calls with more files under the same table go on
    from the state they find. Each micro-batch appends what it updated; the last update of a digest
    is the one with the largest count.
    """
    spark = digests.sparkSession
    source = digests.inputFiles()[0].rpartition("/")[0] if not digests.isEmpty() else None
    work = state_dir or scratch_path(spark, "dedup-state")
    out = f"{work}/hits"
    schema = "digest string, keeper struct<doc_id: bigint, locator: bigint>, group_size bigint"
    if source is None:
        return spark.createDataFrame([], schema)
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(digests.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = (
            reader.parquet(source)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        )

        def append_hits(batch: DataFrame, epoch: int) -> None:
            batch.where("group_size > 1").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(append_hits)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.schema(schema).parquet(out)
    if files_per_batch or state_dir:
        last = updates.groupBy("digest").agg(F.max(F.struct("group_size", "keeper")).alias("u"))
        updates = last.select("digest", "u.keeper", "u.group_size")
    return updates


def _only_hits(docs: DataFrame, hits: DataFrame, n_hits: int) -> DataFrame:
    """Rows of ``docs`` (with a digest column) whose digest is among ``hits``."""
    keys = hits.select(F.xxhash64("digest").alias("__key")).distinct()
    keys = F.broadcast(keys) if n_hits <= BROADCAST_ROWS else keys
    return docs.withColumn("__key", F.xxhash64("digest")).join(keys, "__key", "left_semi").drop("__key")


def compare_bytes(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str, digest=sha256_text) -> DataFrame | None:
    """Compare whole texts under each hit digest; the digests that cover several texts, or None."""
    n_hits = hits.count()
    if not n_hits:
        return None
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).withColumn("digest", digest(F.col("text")))
    variants = _only_hits(rows, hits, n_hits).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    clashes = materialize(variants.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clashes")
    return None if clashes.isEmpty() else clashes


def _by_text(docs: DataFrame, clashes: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Decisions for the rows of digests that cover several texts: grouped by the text itself."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    rows = rows.join(clashes, "digest", "left_semi")
    # Rows that repeat identifier and text are numbered, so that one of them can stay.
    rows = rows.groupBy("text", "doc_id").agg(F.count(F.lit(1)).alias("n")).select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    groups = rows.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = rows.join(groups, "text")
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), sha256_text(F.col("text")).alias("text_sha256")
    )


def _with_hits(rows: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """``rows`` with the keeper and group size of their digest, null where it has one row."""
    is_hot = F.col("group_size") * HOT_KEYS > total
    hot = F.broadcast(hits.where(is_hot))  # group sizes add up to at most ``total``, so these are under HOT_KEYS rows
    cold = rows.join(hot, "digest", "left_anti").join(hits.where(~is_hot), "digest", "left")
    return rows.join(hot, "digest").unionByName(cold)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_text, files_per_batch: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The largest identifier of equal texts stays."""
    digests = digest_rows(docs, id_col, text_col, digest)
    hits = stream_hits(digests, files_per_batch=files_per_batch)
    clashes = compare_bytes(docs, hits, id_col, text_col, digest)
    sha = "digest" if digest is sha256_text else "text_sha256"
    rest, hits = (digests, hits) if clashes is None else (digests.join(clashes, "digest", "left_anti"), hits.join(clashes, "digest", "left_anti"))
    decided = _with_hits(rest, hits, digests.count()).select(
        "doc_id",
        F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("keeper").isNull() | (F.col("keeper.locator") == F.col("locator"))).alias("kept"),
        F.col(sha).alias("text_sha256"),
    )
    return decided if clashes is None else decided.unionByName(_by_text(docs, clashes, id_col, text_col, digest))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that exact deduplication keeps."""
    with temporary(docs.sparkSession) as scratch:
        keys = exact_dedup(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        keys = materialize(keys.where("NOT kept OR n > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("kept").alias("__kept")), "dedup-keys")
        scratch.keep(keys)
    tagged = docs.withColumn("__digest", sha256_text(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha"))
    total, repeated = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("__kept").cast("long")), F.lit(0))).first()
    sized = (lambda k: F.broadcast(k)) if total <= BROADCAST_ROWS // 8 else (lambda k: k)
    out = tagged.join(sized(keys), same, "left_anti")
    if repeated:
        once = tagged.join(keys.where("__kept"), same, "left_semi").dropDuplicates([id_col, "__digest"])
        out = out.unionByName(once)
    return out.drop("__digest")
