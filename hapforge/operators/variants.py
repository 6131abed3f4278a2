"""Filters and listings over variants, blocks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hapforge.functions.columns import chrom_order, is_biallelic, is_snv, minor, plain_chrom


def maf_above(variants: DataFrame, threshold: float) -> DataFrame:
    """Later filters are strict."""
    return variants.where(minor(F.col("af")) > threshold)


def maf_at_least(variants: DataFrame, threshold: float) -> DataFrame:
    """The filter while reading keeps equality."""
    return variants.where((F.col("af") >= threshold) & (1 - F.col("af") >= threshold))


def in_region(variants: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Both ends belong to a region."""
    return variants.where((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def snvs(variants: DataFrame, remove_indels: bool = True, remove_multiallelics: bool = True) -> DataFrame:
    kept = variants.where(is_snv(F.col("ref"), F.col("alt"))) if remove_indels else variants
    return kept.where(is_biallelic(F.col("alt"))) if remove_multiallelics else kept


#: Positions of a bin are 2^BIN.
BIN = 14


def in_bed(variants: DataFrame, bed: DataFrame) -> DataFrame:
    """Chromosome names equal as they are, start <= pos < end in any of the regions.

    Regions are listed once for each bin of positions they touch, so variants meet those of their own
    bin only, and a chromosome is spread over its bins.
    """
    bins = F.sequence(F.shiftright("chromStart", BIN), F.shiftright(F.col("chromEnd") - 1, BIN))
    spread = bed.where("chromEnd > chromStart").select(F.col("chrom").alias("bed_chrom"), F.col("chromStart").alias("bed_start"), F.col("chromEnd").alias("bed_end"), F.explode(bins).alias("bed_bin"))
    covers = (F.col("chrom") == F.col("bed_chrom")) & (F.shiftright(F.col("pos").cast("long"), BIN) == F.col("bed_bin")) & (F.col("pos") >= F.col("bed_start")) & (F.col("pos") < F.col("bed_end"))
    return variants.join(spread, covers, "left_semi")


def dual_threshold(variants: DataFrame, bed: DataFrame | None, maf: float = 0.0, bed_maf: float = 0.0, bed_only: bool = False) -> DataFrame:
    """Variants of the BED regions above one frequency, others above another; without BED only the first counts."""
    if bed is None:
        return maf_above(variants, maf)
    if bed_only:
        return in_bed(variants, bed).where(minor(F.col("af")) > bed_maf)
    inside = in_bed(variants.select("chrom", "pos").distinct(), bed).select(F.col("chrom").alias("in_chrom"), F.col("pos").alias("in_pos"))
    flagged = variants.join(inside, (F.col("chrom") == F.col("in_chrom")) & (F.col("pos") == F.col("in_pos")), "left")
    least = F.when(F.col("in_pos").isNotNull(), F.lit(bed_maf)).otherwise(F.lit(maf))
    return flagged.where(minor(F.col("af")) > least).drop("in_chrom", "in_pos")


def counts_by_block(variants: DataFrame, maf: float, bed: DataFrame | None = None, bed_maf: float = 0.0) -> DataFrame:
    """(block, n_variants) left by the filter; blocks that keep none have 0."""
    kept = dual_threshold(variants, bed, maf, bed_maf).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return variants.select("block").distinct().join(kept, "block", "left").select("block", F.coalesce("n", F.lit(0).cast("long")).alias("n_variants"))


def blocks_of(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """(block, chrom, start, end, n_variants, n_entries)."""
    spans = variants.groupBy("block", "chrom").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n_variants"))
    cells = calls.join(variants.select("variant_idx", "block", "chrom"), "variant_idx").groupBy("block", "chrom").agg(F.count(F.lit(1)).alias("n_entries"))
    return spans.join(cells, ["block", "chrom"], "left").na.fill(0, ["n_entries"])


def ordered_blocks(blocks: DataFrame) -> DataFrame:
    """With block_idx: numeric chromosomes by number, then others by name, then by start. A block is a row, so one task orders them."""
    order = Window.orderBy(*chrom_order(F.col("chrom")), "start")
    return blocks.withColumn("block_idx", F.row_number().over(order) - 1)


def pick_blocks(blocks: DataFrame, chroms: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Blocks by chromosome or by name, not both; ValueError for what isn't there, with what is close to it."""
    import difflib

    if chroms and names:
        raise ValueError("choose blocks by chromosome or by name, not both")
    if not chroms and not names:
        return blocks
    column = plain_chrom(F.col("chrom")) if chroms else F.col("block").cast("string")
    wanted = [c.lower().removeprefix("chr") for c in chroms] if chroms else list(names or ())
    there = sorted(r[0] for r in blocks.select(column.alias("k")).distinct().collect())
    for w in wanted:
        if w not in there:
            close = difflib.get_close_matches(w, there, 3, 0.75)
            raise ValueError(f"{w!r} isn't there; available: {', '.join(there)}" + (f". Did you mean {', '.join(close)}?" if close else ""))
    return blocks.where(column.isin(wanted))


def region_partitions(extents: DataFrame, size: int) -> DataFrame:
    """(chrom, part, start, end): int(span / size), at least one, closed sub-intervals of about equal length."""
    parts = F.greatest(F.lit(1), F.floor((F.col("end") - F.col("start")) / size).cast("int"))
    rows = extents.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    edge = lambda i: F.col("start") + F.floor((F.col("end") - F.col("start")) * i / F.col("parts")).cast("long")
    return rows.select("chrom", "part", (edge(F.col("part")) + F.when(F.col("part") > 0, 1).otherwise(0)).alias("start"), edge(F.col("part") + 1).alias("end"))


def balance_blocks(blocks: DataFrame, workers: int) -> DataFrame:
    """Contiguous ranges of ordered blocks with about equal numbers of entries."""
    w = Window.orderBy("block_idx")
    before = F.coalesce(F.sum("n_entries").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_entries").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.least(F.floor(before * workers / F.greatest(total, F.lit(1))), F.lit(workers - 1))
    return blocks.withColumn("worker", share.cast("int"))


def variant_info(variants: DataFrame, columns: str = "all", threshold: float | None = None) -> DataFrame:
    """id_only, no_id or all of the description, optionally of variants above a minor allele frequency."""
    kept = variants if threshold is None else maf_above(variants, threshold)
    names = {"id_only": ["id"], "no_id": ["chrom", "pos", "ref", "alt"], "all": ["chrom", "pos", "id", "ref", "alt"]}
    if columns not in names:
        raise ValueError(f"columns must be one of {', '.join(names)}, not {columns!r}")
    return kept.select("variant_idx", *names[columns])


def merge_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(left_row, right_row) of equal keys; repeated keys multiply. Both sides number their rows themselves (column ``row``)."""
    if dict(left.dtypes)[key] != dict(right.dtypes)[key]:
        raise TypeError(f"{key} is {dict(left.dtypes)[key]} on one side and {dict(right.dtypes)[key]} on the other")
    return left.select(key, F.col("row").alias("left_row")).join(right.select(key, F.col("row").alias("right_row")), key).select("left_row", "right_row")


def merge_chain(tables: list[DataFrame], key: str) -> DataFrame:
    """(left_row, right_row) of the first and the last table, by way of those between: the composed merge of several tables."""
    if len(tables) < 2:
        raise ValueError("a chain needs two tables or more")
    first, *between, last = tables
    for table in between:
        if dict(table.dtypes)[key] != dict(first.dtypes)[key]:
            raise TypeError(f"{key} is {dict(first.dtypes)[key]} in one table and {dict(table.dtypes)[key]} in another")
        first = first.join(table.select(key), key)
    return merge_rows(first, last, key)


def rows_with_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left``, once each, whose key occurs in ``right``."""
    return left.join(right.select(key), key, "left_semi")


def attach_info(results: DataFrame, info: DataFrame) -> DataFrame:
    """Join by variant_idx; ValueError unless both have the same number of variants."""
    a, b = results.count(), info.count()
    if a != b:
        raise ValueError(f"{a} result rows but {b} variants")
    return info.join(results, "variant_idx")


def impute_means(table: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the mean of the others in their column."""
    clean = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in columns}
    means = table.agg(*[F.avg(clean[c]).alias(f"{c}__mean") for c in columns])
    joined = table.crossJoin(F.broadcast(means))  # one row
    return joined.select(*[F.coalesce(clean[c], F.col(f"{c}__mean")).alias(c) if c in columns else F.col(c) for c in table.columns])


def some_phenotype(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.where(F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull())
