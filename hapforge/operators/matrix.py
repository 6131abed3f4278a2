"""The genotype matrix as relations, and what is computed from it.

``calls`` lists the non-zero cells (variant_idx, hap_idx) of a 0/1 haplotype-by-variant matrix, once
each; ``variants`` has a row for each column (variant_idx, chrom, pos, id, ref, alt, flip, block) and
``haps`` one for each row (hap_idx, iid, hap, sex). A flipped variant stores ``1 - x``: every product
corrects for it by adding a constant, so nothing is ever made dense. Columns and rows without cells
survive, because results are joined to the two dimension tables from the left.

A product joins the cells with a vector and sums by the other index: one shuffle, with partial sums
before it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapforge.functions.columns import minor, sign
from hapforge.shared import materialize

#: Parts into which haplotypes are dealt when the complement of a column is listed.
PARTS = 64


@dataclass(frozen=True)
class GenotypeMatrix:
    calls: DataFrame
    variants: DataFrame
    haps: DataFrame
    ploidy: int = 1
    #: variants with their counts, if they have been stored.
    counted: DataFrame | None = None

    def _with(self, **parts) -> GenotypeMatrix:
        return replace(self, counted=None, **parts)

    def stored(self) -> GenotypeMatrix:
        """The same matrix, written to the shared folder with its counts, for what takes more than one pass over it."""
        if self.counted is not None:
            return self
        m = replace(self, calls=materialize(self.calls, "calls"), variants=materialize(self.variants, "variants"), haps=materialize(self.haps, "haps"))
        return replace(m, counted=materialize(m.allele_counts(), "counted"))

    def iids(self) -> DataFrame:
        """(iid) of the individuals, once each."""
        return self.haps.select("iid").distinct()

    @cached_property
    def n(self) -> int:
        return self.haps.count()

    @cached_property
    def shape(self) -> tuple[int, int]:
        return self.n, self.variants.count()

    @cached_property
    def nnz(self) -> int:
        return self.calls.count()

    # --- selections -------------------------------------------------------------------------

    def with_variants(self, kept: DataFrame) -> GenotypeMatrix:
        """The columns named by ``kept`` (variant_idx)."""
        ids = kept.select("variant_idx").distinct()
        return self._with(variants=self.variants.join(ids, "variant_idx", "left_semi"), calls=self.calls.join(ids, "variant_idx", "left_semi"))

    def keep_samples(self, iids: DataFrame) -> GenotypeMatrix:
        """The rows of the individuals in ``iids`` (iid), both haplotypes of each."""
        haps = self.haps.join(iids.select("iid").distinct(), "iid", "left_semi")
        return self._with(haps=haps, calls=self.calls.join(haps.select("hap_idx"), "hap_idx", "left_semi"))

    def remove_samples(self, iids: DataFrame) -> GenotypeMatrix:
        haps = self.haps.join(iids.select("iid").distinct(), "iid", "left_anti")
        return self._with(haps=haps, calls=self.calls.join(haps.select("hap_idx"), "hap_idx", "left_semi"))

    def drop_second_of_males(self) -> GenotypeMatrix:
        """Males (sex 1) are haploid: their second haplotype goes."""
        haps = self.haps.where(~((F.col("sex") == 1) & (F.col("hap") == 1)))
        return self._with(haps=haps, calls=self.calls.join(haps.select("hap_idx"), "hap_idx", "left_semi"))

    # --- counts -----------------------------------------------------------------------------

    def stored_counts(self) -> DataFrame:
        """variants with ``stored``: how many cells each column has."""
        held = self.calls.groupBy("variant_idx").agg(F.count(F.lit(1)).alias("stored"))
        return self.variants.join(held, "variant_idx", "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))

    def allele_counts(self) -> DataFrame:
        """variants with ``ac`` (flips corrected), ``af`` and ``maf``."""
        if self.counted is not None:
            return self.counted
        ac = F.when(F.col("flip"), F.lit(self.n) - F.col("stored")).otherwise(F.col("stored"))
        counted = self.stored_counts().withColumn("ac", ac.cast("long"))
        af = F.col("ac") / F.lit(float(max(self.n, 1) * self.ploidy))
        return counted.withColumn("af", af).withColumn("maf", minor(F.col("af"))).drop("stored")

    def doses(self, within: DataFrame | None = None) -> DataFrame:
        """(variant_idx, iid, dose) of individuals with a stored allele; ``within`` (iid) restricts them."""
        rows = self.haps.select("hap_idx", "iid")
        rows = rows if within is None else rows.join(within.select("iid").distinct(), "iid", "left_semi")
        return self.calls.join(rows, "hap_idx").groupBy("variant_idx", "iid").agg(F.count(F.lit(1)).alias("dose"))

    def carrier_counts(self, within: DataFrame | None = None) -> DataFrame:
        """(variant_idx, carriers, heterozygotes, homozygotes) over individuals; a flipped variant's carriers are those without two stored alleles."""
        rows = self.haps if within is None else self.haps.join(within.select("iid").distinct(), "iid", "left_semi")
        people = rows.select("iid").distinct().count()
        seen = self.doses(within).groupBy("variant_idx").agg(
            F.count(F.lit(1)).alias("some"), F.count_if(F.col("dose") == 1).alias("one"), F.count_if(F.col("dose") >= 2).alias("two")
        )
        all_v = self.variants.select("variant_idx", "flip").join(seen, "variant_idx", "left").na.fill(0, ["some", "one", "two"])
        return all_v.select(
            "variant_idx",
            F.when(F.col("flip"), F.lit(people) - F.col("two")).otherwise(F.col("some")).cast("long").alias("carriers"),
            F.col("one").alias("heterozygotes"),
            F.when(F.col("flip"), F.lit(people) - F.col("some")).otherwise(F.col("two")).cast("long").alias("homozygotes"),
        )

    def flip_minor(self) -> GenotypeMatrix:
        """Columns with a frequency above one half become their complement, and are marked as flipped."""
        counted = self.stored_counts().withColumn("turn", F.col("stored") > F.lit(self.n / 2))
        turned = counted.where("turn").select("variant_idx")
        rest = self.calls.join(turned, "variant_idx", "left_anti").select("variant_idx", "hap_idx")
        # Only turned columns meet all rows, part by part; there is at most one new cell for each old one.
        rows = self.haps.select("hap_idx", F.pmod(F.xxhash64("hap_idx"), F.lit(PARTS)).alias("part"))
        dealt = turned.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        cells = dealt.join(rows, "part").join(self.calls, ["variant_idx", "hap_idx"], "left_anti")
        names = self.variants.columns
        variants = counted.withColumn("flip", F.col("flip") != F.col("turn")).select(*names)
        return self._with(calls=rest.unionByName(cells.select("variant_idx", "hap_idx")), variants=variants)

    # --- products ---------------------------------------------------------------------------

    def matmat(self, right: DataFrame, values: list[str]) -> DataFrame:
        """X B for B (variant_idx, values...): one row a haplotype."""
        b = self.variants.select("variant_idx", "flip").join(right, "variant_idx")
        signed = b.select("variant_idx", *[(sign(F.col("flip")) * F.col(v)).alias(v) for v in values])
        sums = self.calls.join(signed, "variant_idx").groupBy("hap_idx").agg(*[F.sum(v).alias(v) for v in values])
        shift = b.where("flip").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"{v}__shift") for v in values])
        out = self.haps.select("hap_idx").join(sums, "hap_idx", "left").crossJoin(F.broadcast(shift))  # one row
        return out.select("hap_idx", *[(F.coalesce(v, F.lit(0)) + F.col(f"{v}__shift")).alias(v) for v in values])

    def rmatmat(self, left: DataFrame, values: list[str]) -> DataFrame:
        """X' Y for Y (hap_idx, values...): one row a variant."""
        y = self.haps.select("hap_idx").join(left, "hap_idx")
        sums = self.calls.join(y, "hap_idx").groupBy("variant_idx").agg(*[F.sum(v).alias(v) for v in values])
        total = y.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"{v}__all") for v in values])
        out = self.variants.select("variant_idx", "flip").join(sums, "variant_idx", "left").crossJoin(F.broadcast(total))  # one row
        pick = lambda v: F.when(F.col("flip"), F.col(f"{v}__all") - F.coalesce(v, F.lit(0))).otherwise(F.coalesce(v, F.lit(0)))
        return out.select("variant_idx", *[pick(v).alias(v) for v in values])

    def centered_matmat(self, right: DataFrame, values: list[str]) -> DataFrame:
        """(X - 1 f') B by a rank-one correction."""
        raw = self.matmat(right, values)
        f = self.allele_counts().select("variant_idx", "af").join(right, "variant_idx")
        shift = f.agg(*[F.coalesce(F.sum(F.col("af") * F.col(v)), F.lit(0.0)).alias(f"{v}__mean") for v in values])
        return raw.crossJoin(F.broadcast(shift)).select("hap_idx", *[(F.col(v) - F.col(f"{v}__mean")).alias(v) for v in values])

    def centered_rmatmat(self, left: DataFrame, values: list[str]) -> DataFrame:
        raw = self.rmatmat(left, values).join(self.allele_counts().select("variant_idx", "af"), "variant_idx")
        total = self.haps.select("hap_idx").join(left, "hap_idx").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"{v}__all") for v in values])
        return raw.crossJoin(F.broadcast(total)).select("variant_idx", "af", *[(F.col(v) - F.col("af") * F.col(f"{v}__all")).alias(v) for v in values])

    def scale(self) -> Column:
        """1 / sqrt(f (1 - f)) of a column with ``af``; 1 where the variant doesn't vary."""
        pq = F.col("af") * (1 - F.col("af"))
        return F.when(pq > 0, 1 / F.sqrt(pq)).otherwise(F.lit(1.0))

    def normalized_rmatmat(self, left: DataFrame, values: list[str]) -> DataFrame:
        return self.centered_rmatmat(left, values).select("variant_idx", *[(F.col(v) * self.scale()).alias(v) for v in values])

    def normalized_matmat(self, right: DataFrame, values: list[str]) -> DataFrame:
        scaled = self.allele_counts().select("variant_idx", "af").join(right, "variant_idx").select("variant_idx", *[(F.col(v) * self.scale()).alias(v) for v in values])
        return self.centered_matmat(scaled, values)

    def grm_matmat(self, left: DataFrame, values: list[str], alpha: float = -1.0) -> DataFrame:
        """Z diag((pq)^(1+alpha)) Z' Y with Z the normalized matrix; not divided by the number of variants."""
        w = self.centered_rmatmat(left, values)
        pq = F.col("af") * (1 - F.col("af"))
        weight = F.when(pq > 0, F.pow(pq, F.lit(float(alpha)))).otherwise(F.lit(0.0))
        # Written once: the product reads it for the cells, for the flips and for the mean.
        weighted = materialize(w.select("variant_idx", *[(F.col(v) * weight).alias(v) for v in values]), "weighted")
        return self.centered_matmat(weighted, values)

    def diploid(self, rows: DataFrame, values: list[str]) -> DataFrame:
        """Sum haplotype rows (hap_idx, values...) by individual."""
        return self.haps.select("hap_idx", "iid").join(rows, "hap_idx").groupBy("iid").agg(*[F.sum(v).alias(v) for v in values])

    def co_occurrence(self) -> DataFrame:
        """(v1, v2, k): haplotypes that carry both stored alleles, v1 <= v2, in the same block.

        Cells meet by haplotype and block, so a task holds pairs of one block only; LD across blocks
        isn't formed.
        """
        cells = self.calls.join(self.variants.select("variant_idx", "block"), "variant_idx")
        a = cells.select("hap_idx", "block", F.col("variant_idx").alias("v1"))
        b = cells.select("hap_idx", "block", F.col("variant_idx").alias("v2"))
        met = a.join(b, ["hap_idx", "block"]).where("v1 <= v2")
        return met.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("k"))

    def ld(self) -> DataFrame:
        """Uncentered X'X / n of stored alleles, in both triangles."""
        half = self.co_occurrence().select("v1", "v2", (F.col("k") / F.lit(float(self.n))).alias("r"))
        return half.unionByName(half.where("v1 < v2").select(F.col("v2").alias("v1"), F.col("v1").alias("v2"), "r"))

    def carriers_of(self, variant_ids: DataFrame, unphased: bool = False) -> DataFrame:
        """Stored carriers of some variants, by haplotype, or by individual with a dose."""
        cells = self.calls.join(variant_ids.select("variant_idx").distinct(), "variant_idx", "left_semi")
        if not unphased:
            return cells.select("variant_idx", "hap_idx")
        return cells.join(self.haps.select("hap_idx", "iid"), "hap_idx").groupBy("variant_idx", "iid").agg(F.count(F.lit(1)).alias("dose"))

    def genotype_variances(self, within: DataFrame | None = None) -> DataFrame:
        """(variant_idx, variance, carriers): the sum of squared doses, 3 alleles - 2 carriers, over the individuals in ``within`` (iid)."""
        people = self.carrier_counts(within)
        return people.select("variant_idx", (F.col("heterozygotes") + 4 * F.col("homozygotes")).alias("variance"), "carriers")

    def column_variances(self, sample: DataFrame | None = None) -> DataFrame:
        """Population variance of each column over all rows or over ``sample`` (hap_idx)."""
        m = self if sample is None else self._with(haps=self.haps.join(sample.select("hap_idx").distinct(), "hap_idx", "left_semi"), calls=self.calls.join(sample.select("hap_idx").distinct(), "hap_idx", "left_semi"))
        return m.allele_counts().select("variant_idx", (F.col("af") * (1 - F.col("af"))).alias("variance"))


def binarize(dosages: DataFrame, least_r: float) -> DataFrame:
    """(variant_idx, hap_idx, call) of dosages rounded half to even, for variants whose dosage and call correlate at least so much."""
    rounded = dosages.withColumn("call", F.rint("dosage").cast("int"))
    kept = rounded.groupBy("variant_idx").agg(F.corr("dosage", "call").alias("r")).where(F.col("r") >= least_r)
    return rounded.join(kept.select("variant_idx"), "variant_idx", "left_semi").select("variant_idx", "hap_idx", "call")
