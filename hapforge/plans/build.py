"""Building the compressed store from VCF files, in restartable steps.

Each step writes Parquet below one folder and is skipped if its result is there, so a build goes on
where it stopped. Blocks are independent: every join in a step has the block in its key.

step 0  plan: regions of each chromosome     step 3  weights, haplotype edges, checks
step 1  cells and variants of each region    step 4  edges of individuals
step 2  containment, representatives, edges  step 5  one store of all blocks, if the checks hold
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hapforge.functions.columns import plain_chrom
from hapforge.operators import graph
from hapforge.operators.matrix import GenotypeMatrix
from hapforge.operators.variants import region_partitions
from hapforge.sources.files import read_sex, read_vcf, vcf_samples


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _once(spark: SparkSession, path: str, make) -> DataFrame:
    if not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def step0(spark: SparkSession, vcfs: list[tuple[str, str]], out: str, size: int = 20_000_000, small: int = 20, **params) -> DataFrame:
    """(large_job_id, small_job_id, block, chrom, large_start, large_end, region_start, region_end, vcf_path); parameters are kept beside it.

    A large region is a block and has up to ``small`` small regions. ``vcfs`` gives a chromosome and a
    file; only that chromosome of the file is planned, or each that it has for ``all``.
    """

    def make() -> DataFrame:
        jobs = None
        for chrom, path in vcfs:
            f = F.split("value", "\t", 3)
            rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"))
            rows = rows if chrom == "all" else rows.where(plain_chrom(F.col("chrom")) == chrom.lower().removeprefix("chr"))
            extent = rows.groupBy("chrom").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).where("start IS NOT NULL")
            part = region_partitions(extent, size).withColumn("vcf_path", F.lit(path))
            jobs = part if jobs is None else jobs.unionByName(part)
        name = F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
        large = jobs.select(name.alias("block"), "chrom", F.col("start").alias("large_start"), F.col("end").alias("large_end"), "vcf_path")
        large = large.withColumn("large_job_id", F.row_number().over(Window.orderBy("chrom", "large_start", "vcf_path")) - 1)  # a row a region
        span = F.col("large_end") - F.col("large_start") + 1
        cut = lambda i: F.col("large_start") + F.floor(span * i / F.col("parts")).cast("long")
        rows = large.withColumn("parts", F.least(F.lit(small).cast("long"), span)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        rows = rows.withColumn("region_start", cut(F.col("part"))).withColumn("region_end", cut(F.col("part") + 1) - 1)
        return rows.withColumn("small_job_id", F.row_number().over(Window.orderBy("large_job_id", "part")) - 1).drop("parts", "part")

    plan = _once(spark, f"{out}/jobs", make)
    kept = json.dumps({k: v for k, v in params.items() if v is not None} | {"size": size, "small": small})
    _once(spark, f"{out}/params", lambda: spark.createDataFrame([(kept,)], "params string"))
    return plan


def _params(spark: SparkSession, out: str) -> dict:
    return json.loads(spark.read.parquet(f"{out}/params").first()["params"])


def step1(spark: SparkSession, out: str) -> GenotypeMatrix:
    """Cells, variants and haplotypes; a region without variants leaves nothing."""
    p = _params(spark, out)
    jobs = spark.read.parquet(f"{out}/jobs")
    if not all(_exists(spark, f"{out}/{t}") for t in ("cells", "variants", "haps")):
        paths = sorted(r["vcf_path"] for r in jobs.select("vcf_path").distinct().collect())  # one a file
        order = vcf_samples(spark, paths[0])
        for path in paths[1:]:
            if sorted(own := vcf_samples(spark, path)) != sorted(order):
                raise ValueError(f"{path} doesn't have the samples of {paths[0]}: {', '.join(sorted(set(own) ^ set(order))[:5]) or 'some are repeated'}")
        sex = read_sex(spark, p["sex"]) if p.get("sex") else None
        how = {"samples": p.get("samples"), "maf": p.get("maf"), "phased": p.get("phased", True), "remove_indels": bool(p.get("remove_indels")), "remove_multiallelics": bool(p.get("remove_multiallelics"))}
        spans = jobs.select(F.col("chrom").alias("job_chrom"), "large_start", "large_end", F.col("block").alias("job_block"), "vcf_path").distinct()
        variants = cells = haps = None
        for path in paths:
            m = read_vcf(spark, path, order=order, sex=sex, **how)
            m = m.flip_minor() if str(p.get("flip_minor_alleles", False)).lower() in ("true", "1") else m
            own = m.variants.join(spans.where(F.col("vcf_path") == path), (F.col("chrom") == F.col("job_chrom")) & F.col("pos").between(F.col("large_start"), F.col("large_end")))
            own = own.withColumn("block", F.col("job_block")).select(*m.variants.columns)
            variants = own if variants is None else variants.unionByName(own)
            cells = m.calls.select("variant_idx", "hap_idx") if cells is None else cells.unionByName(m.calls.select("variant_idx", "hap_idx"))
            haps = haps or m.haps
        # A variant that several files list is one variant, in one block, with the carriers of all.
        first = variants.groupBy("variant_idx").agg(F.min(F.struct("block", *[c for c in variants.columns if c not in ("variant_idx", "block")])).alias("v")).select("variant_idx", "v.*")
        _once(spark, f"{out}/variants", lambda: first.select(*variants.columns))
        known = spark.read.parquet(f"{out}/variants").select("variant_idx", "block")
        _once(spark, f"{out}/cells", lambda: cells.distinct().join(known, "variant_idx"))
        _once(spark, f"{out}/haps", lambda: haps)
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    return GenotypeMatrix(read("cells").select("variant_idx", "hap_idx"), read("variants"), read("haps"))


def _nested_cells(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/cells").select("block", F.lpad(F.hex("variant_idx"), 16, "0").alias("v"), "hap_idx")


def step2(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    cells = _nested_cells(spark, out)
    contained = _once(spark, f"{out}/contained", lambda: graph.containment(cells))
    reps = _once(spark, f"{out}/reps", lambda: graph.representatives(cells, contained))
    return reps, _once(spark, f"{out}/closed", lambda: graph.closure(contained, reps))


def step3(spark: SparkSession, out: str) -> DataFrame:
    """Weights and haplotype edges; returns the statistics of each block, with whether the graph gives the matrix's counts."""
    reps, closed = step2(spark, out)
    cells = _nested_cells(spark, out)
    weighted = _once(spark, f"{out}/edges", lambda: graph.linearize(closed))
    samples = _once(spark, f"{out}/sample_edges", lambda: graph.sample_edges(cells, reps, weighted))

    def stats() -> DataFrame:
        ones = spark.read.parquet(f"{out}/haps").select("hap_idx", F.lit(1).cast("long").alias("y"))
        got = graph.graph_rmatvec(weighted, samples, reps, ones).select("block", "v", F.col("x").alias("graph"))
        want = graph.carrier_counts(cells)
        check = want.join(got, ["block", "v"], "full").groupBy("block").agg(F.max(~F.col("n").eqNullSafe(F.col("graph"))).alias("wrong"))
        c = graph.compression(cells, reps, weighted, samples).join(check, "block")
        return c.select("block", "n_variants", "nnz_matrix", "nnz_graph", (F.col("nnz_graph") / F.col("nnz_matrix")).alias("nnz_ratio"), (~F.col("wrong")).alias("correct_allele_counts"))

    return _once(spark, f"{out}/stats", stats)


def step4(spark: SparkSession, out: str) -> DataFrame:
    samples = spark.read.parquet(f"{out}/sample_edges")
    return _once(spark, f"{out}/individual_edges", lambda: graph.with_individuals(samples, spark.read.parquet(f"{out}/haps")))


def step5(spark: SparkSession, out: str, store: str) -> None:
    """Refuses if any block's counts are wrong."""
    from hapforge.sources.store import write_store

    bad = [r["block"] for r in step3(spark, out).where("NOT correct_allele_counts").limit(20).collect()]
    if bad:
        raise ValueError(f"the graph doesn't give the matrix's counts in {', '.join(bad)}")
    write_store(step1(spark, out), store)
    for t in ("reps", "edges", "sample_edges", "individual_edges"):
        spark.read.parquet(f"{out}/{t}").repartition("block").write.mode("errorifexists").partitionBy("block").parquet(f"{store}/{t}")


def compress(spark: SparkSession, vcf: str, store: str, work: str, chrom: str = "all", **params) -> None:
    """All steps over one VCF."""
    step0(spark, [(chrom, vcf)], work, **params)
    step1(spark, work)
    step2(spark, work)
    step3(spark, work)
    step4(spark, work)
    step5(spark, work, store)
