"""Text sources: VCF, BED, phenotype tables, sample lists, sex files and matrix-market trios.

All are read by ``spark.read.text`` or CSV, so they split, decompress and prune as Spark does, and a
path may be anything that Spark opens.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapforge.functions.columns import is_biallelic, is_snv, null_tokens
from hapforge.operators.matrix import GenotypeMatrix


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, chromStart, chromEnd); blank lines, comments, browser and track lines are skipped. Too few fields or ends that aren't numbers raise when the rows are used."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike("^(#|browser|track)"))
    f = F.split("line", r"\s+")
    bad = F.raise_error(F.concat(F.lit("not a BED line: "), F.col("line")))
    number = lambda i: F.when(F.size(f) < 3, bad).when(F.get(f, F.lit(i)).rlike("^[0-9]+$"), F.get(f, F.lit(i)).cast("long")).otherwise(bad)
    return lines.select(F.get(f, F.lit(0)).alias("chrom"), number(1).alias("chromStart"), number(2).alias("chromEnd"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, numbers: list[int] | None = None) -> DataFrame:
    """A tab-separated phenotype or covariate table: ``iid`` first, family ids dropped, missing tokens null, true/false 1/0.

    ``columns`` by name or ``numbers`` from 0, not both; the identifier always comes along.
    """
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    ids = [c for c in raw.columns if re.fullmatch(r"#?iid", c, re.IGNORECASE)]
    if len(ids) != 1:
        raise ValueError(f"exactly one column must be iid; found {ids or 'none'} in {raw.columns}")
    if columns and numbers:
        raise ValueError("choose columns by name or by number, not both")
    data = [c for c in raw.columns if c not in ids and not re.fullmatch(r"#?fid", c, re.IGNORECASE)]
    if numbers is not None:
        out = [i for i in numbers if not 0 <= i < len(raw.columns)]
        if out:
            raise ValueError(f"column numbers {out} are outside 0 to {len(raw.columns) - 1}")
        data = [raw.columns[i] for i in numbers if raw.columns[i] in data]
    elif columns is not None:
        import difflib

        for c in columns:
            if c not in raw.columns:
                close = difflib.get_close_matches(c, raw.columns, 3, 0.75)
                raise ValueError(f"no column {c!r}; available: {', '.join(raw.columns)}" + (f". Did you mean {', '.join(close)}?" if close else ""))
        data = [c for c in columns if c in data]

    def value(c: str):
        text = null_tokens(F.col(f"`{c}`"))
        return F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0).otherwise(text.try_cast("double"))

    return raw.select(F.col(f"`{ids[0]}`").alias("iid"), *[value(c).alias(c) for c in data])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(iid): one a line, or a white-space table whose header has IID or #IID; gz is fine."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    first = lines.first()
    fields = re.split(r"\s+", first["line"]) if first else []
    at = [i for i, f in enumerate(fields) if f.upper().lstrip("#") == "IID"]
    if not at:
        return lines.select(F.get(F.split("line", r"\s+"), F.lit(0)).alias("iid"))
    return lines.where(F.col("line") != first["line"]).select(F.get(F.split("line", r"\s+"), F.lit(at[0])).alias("iid"))


def read_sex(spark: SparkSession, path: str) -> DataFrame:
    """(row, sex): one whole number a line in the order of individuals, 1 male and 0 female. One small file, read whole to keep its order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("row", "sex")).select("row", F.col("sex").cast("int").alias("sex"))


def _header(spark: SparkSession, path: str) -> list[str]:
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError("the VCF has no #CHROM line")
    return header["value"].split("\t")


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """The samples of a VCF in its own order."""
    return _header(spark, path)[9:]


def read_vcf(
    spark: SparkSession, path: str, *, order: list[str] | None = None, phased: bool = True, region: str | None = None, flip_minor_alleles: bool = False, samples: list[str] | None = None, maf: float | None = None,
    remove_indels: bool = False, remove_multiallelics: bool = False, sex: DataFrame | None = None, block: str | None = None,
) -> GenotypeMatrix:
    """Haplotypes of a VCF text as relations. A carrier has an allele above 0; a missing allele is no carrier.

    ``region`` is ``chrom:start-end`` with both ends inside. Unphased genotypes give one row a sample
    whose cell counts once if any allele is above 0. Haplotypes are numbered by the place of their
    sample in ``order``, which is that of the file if not given; rows of ``sex`` go by it as well.
    """
    lines = spark.read.text(path).where("value <> ''")
    names = vcf_samples(spark, path)
    number = {n: i for i, n in enumerate(names if order is None else order)}
    if missing := [n for n in names if n not in number]:
        raise ValueError(f"samples {', '.join(missing[:5])} of {path} aren't in the given order")
    chosen = [n for n in names if samples is None or n in set(samples)]
    if not chosen:
        raise ValueError("none of the samples is in the VCF")
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("int").alias("pos"), F.get(f, F.lit(2)).alias("id"), F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"), F.array_position(F.split(F.get(f, F.lit(8)), ":"), F.lit("GT")).alias("gt"), F.slice(f, 10, len(names)).alias("calls")
    )
    if region:
        m = re.fullmatch(r"(?:(.*):)?(\d+)-(\d+)", region)
        if not m:
            raise ValueError(f"not a region: {region!r}")
        rows = rows.where(F.col("pos").between(int(m[2]), int(m[3])) & (F.lit(True) if m[1] is None else F.col("chrom") == m[1]))
    if remove_indels:
        rows = rows.where(is_snv(F.col("ref"), F.col("alt")))
    if remove_multiallelics:
        rows = rows.where(is_biallelic(F.col("alt")))
    key = F.xxhash64("chrom", "pos", "id", "ref", "alt")
    rows = rows.withColumn("variant_idx", key)
    picked = set(chosen)
    people = spark.createDataFrame([(i, number[n], n) for i, n in enumerate(names) if n in picked], "person long, number long, iid string")
    if sex is not None:
        people = people.join(sex.select(F.col("row").cast("long").alias("number"), "sex"), "number", "left").na.fill(0, ["sex"])
    else:
        people = people.withColumn("sex", F.lit(0))
    haps = people.withColumn("hap", F.explode(F.array(F.lit(0), F.lit(1)) if phased else F.array(F.lit(0))))
    haps = haps.select((F.col("number") * (2 if phased else 1) + F.col("hap")).alias("hap_idx"), "iid", "hap", "sex")
    cells = rows.select("variant_idx", F.col("gt").cast("int").alias("gt"), F.posexplode("calls").alias("person", "call"))
    cells = cells.select("variant_idx", "person", F.split(F.get(F.split("call", ":"), F.col("gt") - 1), r"[|/]").alias("alleles"))
    allele = F.posexplode("alleles").alias("hap", "allele")
    cells = cells.select("variant_idx", "person", allele).where(F.coalesce(F.col("allele").try_cast("int"), F.lit(0)) > 0).where("hap < 2")
    hap_idx = (F.col("number") * 2 + F.col("hap")) if phased else F.col("number")
    cells = cells.join(people.select("person", "number"), "person").select("variant_idx", hap_idx.cast("long").alias("hap_idx")).distinct()
    variants = rows.select("variant_idx", "chrom", "pos", "id", "ref", "alt", F.lit(False).alias("flip"), (F.lit(block) if block else F.col("chrom")).alias("block")).dropDuplicates(["variant_idx"])
    matrix = GenotypeMatrix(cells, variants, haps)
    if sex is not None:
        matrix = matrix.drop_second_of_males()
    if maf is not None:
        kept = matrix.allele_counts().where((F.col("af") >= maf) & (1 - F.col("af") >= maf))
        matrix = matrix.with_variants(kept)
    return matrix.flip_minor() if flip_minor_alleles else matrix


def write_trio(entries: DataFrame, samples: DataFrame, variants: DataFrame, shape: tuple[int, int], prefix: str) -> None:
    """<prefix>.mtx, .psam and .pvar as ``read_trio`` takes them; each is a folder of text files whose first file starts with the head."""
    spark = entries.sparkSession
    body = entries.select(F.format_string("%d %d %s", F.col("row") + 1, F.col("col") + 1, F.col("value").cast("string")).alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{shape[0]} {shape[1]} {entries.count()}",)], "value string").coalesce(1)
    head.unionByName(body).write.text(f"{prefix}.mtx")
    table = lambda df, ext: df.write.option("sep", "\t").option("header", True).csv(f"{prefix}.{ext}")
    table(samples, "psam")
    info = F.concat(F.lit("IDX="), F.col("idx").cast("string"), F.lit(";FLIP="), F.col("flip").cast("int").cast("string"))
    table(variants.select(F.col("chrom").alias("#CHROM"), F.col("pos").alias("POS"), F.col("id").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), info.alias("INFO")), "pvar")


def read_trio(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries (row, col, value) from 0, samples, variants with idx and flip) of <prefix>.mtx, .psam and .pvar."""
    body = spark.read.text(f"{prefix}.mtx").where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.first()["value"]
    f = F.split(F.trim("value"), r"\s+")
    entries = body.where(F.col("value") != size).select((F.get(f, F.lit(0)).try_cast("long") - 1).alias("row"), (F.get(f, F.lit(1)).try_cast("long") - 1).alias("col"), F.coalesce(F.get(f, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("value"))
    table = lambda ext: spark.read.option("sep", "\t").option("header", True).csv(f"{prefix}.{ext}")
    variants = table("pvar")
    variants = variants.toDF(*[c.lstrip("#") for c in variants.columns])
    idx = F.regexp_extract("INFO", r"IDX=(-?\d+)", 1).try_cast("long")
    return entries, table("psam"), variants.withColumn("idx", idx).withColumn("flip", F.regexp_extract("INFO", r"FLIP=(\d)", 1) == "1")
