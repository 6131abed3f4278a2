"""Column expressions shared by the genotype operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minor(frequency: Column) -> Column:
    return F.least(frequency, 1 - frequency)


def plain_chrom(chrom: Column) -> Column:
    """Chromosome names compare without case and without a leading ``chr``."""
    return F.regexp_replace(F.lower(chrom.cast("string")), "^chr", "")


def chrom_order(chrom: Column) -> list[Column]:
    """Numeric chromosomes by number, then the others by name."""
    name = plain_chrom(chrom)
    number = F.when(name.rlike("^[0-9]+$"), name.cast("long"))
    return [number.isNull(), number, name]


def alternates(alt: Column) -> Column:
    return F.split(alt, ",")


def is_snv(ref: Column, alt: Column) -> Column:
    """Reference and every alternate are one base long."""
    return (F.length(ref) == 1) & F.forall(alternates(alt), lambda a: F.length(a) == 1)


def is_biallelic(alt: Column) -> Column:
    return F.size(alternates(alt)) == 1


def sign(flip: Column) -> Column:
    return F.when(flip, -1).otherwise(1)


def null_tokens(value: Column) -> Column:
    """NA, NULL, NaN and the empty string mean missing."""
    return F.when(F.upper(F.trim(value)).isin("NA", "", "NULL", "NAN"), None).otherwise(F.trim(value))
