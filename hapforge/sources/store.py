"""The store: Parquet tables of variants, haplotypes, cells and graph edges, partitioned by block."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapforge.operators.matrix import GenotypeMatrix
from hapforge.operators.variants import blocks_of, ordered_blocks


def write_store(matrix: GenotypeMatrix, path: str, codec: str = "zstd") -> None:
    """Counts are stored with the variants, so later frequency filters reach the scan. Refuses to overwrite."""
    writer = lambda df: df.write.mode("errorifexists").option("compression", codec)
    writer(matrix.allele_counts().repartition("block").sortWithinPartitions("pos")).partitionBy("block").parquet(f"{path}/variants")
    cells = matrix.calls.join(matrix.variants.select("variant_idx", "block"), "variant_idx")
    # A block's cells are dealt by variant as well, so a large block is several files and tasks.
    writer(cells.repartition("block", F.pmod(F.xxhash64("variant_idx"), F.lit(16)))).partitionBy("block").parquet(f"{path}/calls")
    writer(matrix.haps).parquet(f"{path}/haps")


def read_store(spark: SparkSession, path: str, block: str | None = None) -> GenotypeMatrix:
    tables = {t: spark.read.parquet(f"{path}/{t}").withColumn("block", F.col("block").cast("string")) for t in ("variants", "calls")}
    if block is not None:
        tables = {t: df.where(F.col("block") == block) for t, df in tables.items()}
    names = ["variant_idx", "chrom", "pos", "id", "ref", "alt", "flip", "block"]
    return GenotypeMatrix(tables["calls"].select("variant_idx", "hap_idx"), tables["variants"].select(*names), spark.read.parquet(f"{path}/haps"))


def list_iids(spark: SparkSession, path: str) -> DataFrame:
    """(iid) of the individuals of a store, in the order of their haplotypes."""
    haps = spark.read.parquet(f"{path}/haps")
    return haps.groupBy("iid").agg(F.min("hap_idx").alias("at")).orderBy("at").select("iid")


def read_graph(spark: SparkSession, path: str, block: str | None = None) -> dict[str, DataFrame]:
    """reps, edges, sample_edges and individual_edges of a built store, as the products of ``operators.graph`` take them."""
    tables = {t: spark.read.parquet(f"{path}/{t}").withColumn("block", F.col("block").cast("string")) for t in ("reps", "edges", "sample_edges", "individual_edges")}
    return tables if block is None else {t: df.where(F.col("block") == block) for t, df in tables.items()}


def list_blocks(spark: SparkSession, path: str) -> DataFrame:
    m = read_store(spark, path)
    return ordered_blocks(blocks_of(m.variants, m.calls))


def threshold_histogram(counted: DataFrame, n: int) -> DataFrame:
    """(k, n_variants) above 10^-k, for k up to ceil(log10 n)."""
    ks = range(1, max(1, math.ceil(math.log10(max(n, 2)))) + 1)
    row = counted.agg(*[F.count_if(F.col("maf") > F.lit(10.0**-k)).alias(str(k)) for k in ks])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("n_variants")) for k in ks])).alias("s")).select("s.k", "s.n_variants")


def write_assoc(results: DataFrame, out: str) -> None:
    results.write.option("compression", "lz4").parquet(f"{out}.parquet")


def write_tsv(results: DataFrame, out: str, suffix: str = "tsv") -> None:
    results.write.option("sep", "\t").option("header", True).csv(f"{out}.{suffix}")


def write_ld(matrix: GenotypeMatrix, out: str) -> None:
    """<out>.snplist (POS, REF, ALT, SNP, MISSINGNESS, AF) and <out>.ld, the sparse triples."""
    v = matrix.allele_counts()
    write_tsv(v.select(F.col("pos").alias("POS"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.col("id").alias("SNP"), F.lit(0).alias("MISSINGNESS"), F.col("af").alias("AF")), out, "snplist")
    matrix.ld().write.parquet(f"{out}.ld")
