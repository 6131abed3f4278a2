"""Command line: compress, multi-step-compress, assoc, rhe, score.

Exit codes: 0 done, 1 failed while running, 2 wrong arguments. Errors go to stderr as
``error: <command>: <message>``; the command line and times go to ``<out>.log``.
"""

from __future__ import annotations

import argparse
import re
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapforge.operators import association as assoc
from hapforge.operators.matrix import GenotypeMatrix
from hapforge.operators.variants import attach_info, blocks_of, dual_threshold, pick_blocks, some_phenotype, variant_info
from hapforge.sources.files import read_bed, read_samples, read_table
from hapforge.sources.store import read_store, write_assoc, write_tsv


def listed(text: str | None) -> list[str] | None:
    """Values between commas or white space, once each."""
    return None if text is None else list(dict.fromkeys(x for x in re.split(r"[,\s]+", text.strip()) if x))


def numbered(text: str | None) -> list[int] | None:
    if text is None:
        return None
    out = [int(x) for x in listed(text)]
    if any(x < 0 for x in out):
        raise ValueError(f"column numbers start at 0: {text!r}")
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hapforge", description="Analytics over phased genotype matrices.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, store: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        if store:
            p.add_argument("store", help="folder of a compressed store")
        p.add_argument("--out", required=True, help="prefix of the results")
        return p

    def choice(p: argparse.ArgumentParser) -> None:
        g = p.add_mutually_exclusive_group()
        g.add_argument("--chrom", help="chromosomes, as a list")
        g.add_argument("--block-names", help="blocks, as a list")

    def tables(p: argparse.ArgumentParser) -> None:
        p.add_argument("pheno")
        g = p.add_mutually_exclusive_group()
        g.add_argument("--pheno-name")
        g.add_argument("--pheno-col-nums")
        p.add_argument("--covar")
        g = p.add_mutually_exclusive_group()
        g.add_argument("--covar-name")
        g.add_argument("--covar-col-nums")
        choice(p)

    def source(p: argparse.ArgumentParser) -> None:
        for flag in ("flip-minor-alleles", "remove-indels", "remove-multiallelics", "unphased"):
            p.add_argument(f"--{flag}", action="store_true")
        p.add_argument("--maf", type=float)
        p.add_argument("--keep", help="file of samples")
        p.add_argument("--sex-path", help="file of one number an individual, 1 male and 0 female")
        p.add_argument("--partition-size", type=int, default=20_000_000)
        p.add_argument("--num-small-blocks", type=int, default=20)

    def filters(p: argparse.ArgumentParser) -> None:
        p.add_argument("--maf-log10-threshold", type=int)
        p.add_argument("--bed")
        p.add_argument("--bed-maf-log10-threshold", type=int)

    p = command("compress", "VCF to store", store=False)
    p.add_argument("vcf")
    source(p)

    p = command("multi-step-compress", "one step of a build", store=False)
    p.add_argument("step", choices=[f"step{i}" for i in range(6)])
    p.add_argument("--vcf-metadata", help="lines of chromosome and VCF path")
    p.add_argument("--store", help="where step5 writes")
    source(p)

    p = command("assoc", "association scan")
    tables(p)
    for flag in ("no-hwe", "repeat-covar", "recompute-ac"):
        p.add_argument(f"--{flag}", action="store_true")
    g = p.add_mutually_exclusive_group()
    g.add_argument("--no-variant-info", action="store_true")
    g.add_argument("--all-variant-info", action="store_true")
    filters(p)

    p = command("rhe", "heritability by randomized Haseman-Elston")
    tables(p)
    p.add_argument("--num-matvecs", type=int, default=100)
    p.add_argument("--estimator", choices=["hutchinson", "hutch++", "xnystrace"], default="xnystrace")
    p.add_argument("--sampler", choices=sorted(assoc.SAMPLERS), default="normal")
    p.add_argument("--seed", type=int, default=1)
    filters(p)

    p = command("score", "polygenic scores")
    p.add_argument("--beta-path", required=True)
    p.add_argument("--score-cols", required=True)
    choice(p)
    return top


def _matrix(spark: SparkSession, a: argparse.Namespace) -> GenotypeMatrix:
    m = read_store(spark, a.store)
    if m.variants.isEmpty():
        raise ValueError(f"{a.store} has no blocks")
    if a.chrom or a.block_names:
        blocks = pick_blocks(blocks_of(m.variants, m.calls), listed(a.chrom), listed(a.block_names))
        m = m.with_variants(m.variants.join(blocks.select("block"), "block", "left_semi"))
    if getattr(a, "maf_log10_threshold", None) is not None or getattr(a, "bed", None):
        kept = dual_threshold(m.allele_counts(), read_bed(spark, a.bed) if a.bed else None, _power(a.maf_log10_threshold), _power(a.bed_maf_log10_threshold))
        m = m.with_variants(kept)
    return m


def _people(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, list[str], list[str]]:
    pheno = read_table(spark, a.pheno, listed(a.pheno_name), numbered(a.pheno_col_nums))
    traits, covars = pheno.columns[1:], []
    pheno = some_phenotype(pheno, traits)
    if a.covar:
        covar = read_table(spark, a.covar, listed(a.covar_name), numbered(a.covar_col_nums))
        covars = covar.columns[1:]
        pheno = pheno.join(covar, "iid")
    return assoc.with_intercept(pheno), traits, ["i0", *covars]


def _power(log10: int | None) -> float:
    return 0.0 if log10 is None else 10.0**log10


def run_assoc(spark: SparkSession, a: argparse.Namespace) -> None:
    m = _matrix(spark, a)
    table, traits, covars = _people(spark, a)
    how = {"assume_hwe": not a.no_hwe, "recompute_ac": a.recompute_ac}
    out = assoc.gwas_each(m, table, traits, covars, **how) if a.repeat_covar else assoc.gwas(m, table, traits, covars, **how)
    names = {"a1freq": "A1FREQ", "a1_carrier_freq": "A1_CARRIER_FREQ"} | {f"{t}_{x}": f"{t}_{x.upper()}" for t in traits for x in ("beta", "se")}
    if not a.no_variant_info:
        info = variant_info(m.variants, "all" if a.all_variant_info else "id_only")
        out = attach_info(out, info)
    cols = [F.col(c).cast("float").alias(names[c]) if c in names else F.col(c).alias(c.upper()) for c in out.columns if c != "variant_idx"]
    write_assoc(out.select(*cols), a.out)


def run_rhe(spark: SparkSession, a: argparse.Namespace) -> None:
    table, traits, covars = _people(spark, a)
    out = assoc.haseman_elston(_matrix(spark, a), table, traits, covars, num_matvecs=a.num_matvecs, estimator=a.estimator, sampler=a.sampler, seed=a.seed)
    write_tsv(out.toDF(*[c.replace("_se", ".se") for c in out.columns]), a.out, "h2g.tsv")


def run_score(spark: SparkSession, a: argparse.Namespace) -> None:
    effects = spark.read.parquet(a.beta_path)
    columns = listed(a.score_cols)
    effects = effects.withColumnRenamed("ID", "id").select("id", *columns)
    write_tsv(assoc.polygenic_scores(_matrix(spark, a), effects, columns), a.out)


def _source(spark: SparkSession, a: argparse.Namespace) -> dict:
    samples = [r["iid"] for r in read_samples(spark, a.keep).collect()] if a.keep else None
    return {
        "size": a.partition_size, "small": a.num_small_blocks, "samples": samples, "maf": a.maf, "sex": a.sex_path, "phased": not a.unphased,
        "flip_minor_alleles": a.flip_minor_alleles, "remove_indels": a.remove_indels, "remove_multiallelics": a.remove_multiallelics,
    }


def run_compress(spark: SparkSession, a: argparse.Namespace) -> None:
    from hapforge.plans import build

    build.compress(spark, a.vcf, a.out, f"{a.out}.work", **_source(spark, a))


def run_step(spark: SparkSession, a: argparse.Namespace) -> None:
    from hapforge.plans import build

    if a.step == "step0":
        if not a.vcf_metadata:
            raise ValueError("step0 needs --vcf-metadata")
        vcfs = [tuple(r["value"].split()[:2]) for r in spark.read.text(a.vcf_metadata).where("trim(value) <> ''").collect()]
        build.step0(spark, vcfs, a.out, **_source(spark, a))
    elif a.step == "step5":
        build.step5(spark, a.out, a.store or f"{a.out}/store")
    else:
        getattr(build, a.step)(spark, a.out)


RUN = {"compress": run_compress, "multi-step-compress": run_step, "assoc": run_assoc, "rhe": run_rhe, "score": run_score}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    began = time.time()
    try:
        RUN[a.command](spark or SparkSession.builder.getOrCreate(), a)
        said, code = f"done in {time.time() - began:.1f} s", 0
    except Exception as e:  # noqa: BLE001  the exit code is the interface
        said, code = f"error: {a.command}: {e}", 1
        print(said, file=sys.stderr)
    if "://" not in a.out:
        with open(f"{a.out}.log", "a") as log:
            print(f"hapforge {' '.join(argv if argv is not None else sys.argv[1:])}\n{said}", file=log)
    return code


if __name__ == "__main__":
    sys.exit(main())
