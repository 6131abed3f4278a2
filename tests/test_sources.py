import gzip

import pytest
from pyspark.sql import functions as F

from hapforge import cli
from hapforge.operators import graph
from hapforge.operators.variants import blocks_of
from hapforge.plans import build
from hapforge.sources import files, store

VCF = """##fileformat=VCFv4.2
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s1	s2	s3
1	100	a	A	T	.	.	.	GT	0|1	1|1	0|0
1	150	b	A	AC	.	.	.	GT	1|0	0|0	0|0
1	200	c	G	A,T	.	.	.	GT:DP	2|0:3	0|1:4	.|1:5
1	300	d	C	G	.	.	.	GT	1|1	1|1	1|0
1	400	e	C	G	.	.	.	GT	0|0	0|0	0|0
"""


@pytest.fixture
def vcf(tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    return str(tmp_path / "x.vcf")


def counts(m):
    return {r.id: r.ac for r in m.allele_counts().collect()}


def test_vcf(spark, vcf):
    assert counts(files.read_vcf(spark, vcf)) == {"a": 3, "b": 1, "c": 3, "d": 5, "e": 0}
    assert counts(files.read_vcf(spark, vcf, region="1:150-300", remove_indels=True)) == {"c": 3, "d": 5}
    assert counts(files.read_vcf(spark, vcf, remove_indels=True, remove_multiallelics=True)) == {"a": 3, "d": 5, "e": 0}
    assert counts(files.read_vcf(spark, vcf, samples=["s1"])) == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 0}
    assert counts(files.read_vcf(spark, vcf, maf=0.5)) == {"a": 3, "c": 3}
    flipped = files.read_vcf(spark, vcf, flip_minor_alleles=True)
    assert counts(flipped) == counts(files.read_vcf(spark, vcf)) and flipped.variants.where("flip").count() == 1
    with pytest.raises(ValueError):
        files.read_vcf(spark, vcf, samples=["nobody"])


def test_tables(spark, tmp_path):
    (tmp_path / "b.bed").write_text("# c\ntrack x\nbrowser y\n\n1\t5\t9\textra\n2 1 3\n")
    assert [tuple(r) for r in files.read_bed(spark, str(tmp_path / "b.bed")).orderBy("chrom").collect()] == [("1", 5, 9), ("2", 1, 3)]
    (tmp_path / "bad.bed").write_text("1\t5\n")
    with pytest.raises(Exception, match="not a BED line"):
        files.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "p.tsv").write_text("#FID\t#IID\theight\tT2D\nf\ta\t1.5\ttrue\nf\tb\tNA\tfalse\nf\tc\tNaN\t\n")
    got = [tuple(r) for r in files.read_table(spark, str(tmp_path / "p.tsv")).orderBy("iid").collect()]
    assert got == [("a", 1.5, 1.0), ("b", None, 0.0), ("c", None, None)]
    with pytest.raises(ValueError, match="Did you mean"):
        files.read_table(spark, str(tmp_path / "p.tsv"), ["heigth"])
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "p.tsv"), numbers=[9])
    with gzip.open(tmp_path / "k.txt.gz", "wt") as f:
        f.write("#IID x\na 1\nb 2\n")
    assert {r.iid for r in files.read_samples(spark, str(tmp_path / "k.txt.gz")).collect()} == {"a", "b"}
    (tmp_path / "sex").write_text("1\n0\n1\n")
    assert [tuple(r) for r in files.read_sex(spark, str(tmp_path / "sex")).collect()] == [(0, 1), (1, 0), (2, 1)]


def test_files_in_another_order_and_several_chromosomes(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    line = lambda c, p, i, *g: f"{c}\t{p}\t{i}\tA\tT\t.\t.\t.\tGT\t" + "\t".join(g) + "\n"
    (tmp_path / "a.vcf").write_text(head + "s1\ts2\n" + line("1", 100, "a", "1|0", "0|0") + line("2", 100, "c", "0|0", "1|1"))
    (tmp_path / "b.vcf").write_text(head + "s2\ts1\n" + line("1", 100, "a", "0|0", "1|0") + line("1", 120, "b", "1|1", "0|0"))
    out = str(tmp_path / "w")
    jobs = build.step0(spark, [("all", str(tmp_path / "a.vcf")), ("chr1", str(tmp_path / "b.vcf"))], out, size=1000, small=4)
    assert {(r.chrom, r.large_job_id) for r in jobs.collect()} == {("1", 0), ("1", 1), ("2", 2)} and jobs.select("small_job_id").distinct().count() == jobs.count()
    m = build.step1(spark, out)
    dose = {(r.id, r.iid): r.dose for r in m.doses().join(m.variants, "variant_idx").collect()}
    assert dose == {("a", "s1"): 1, ("b", "s2"): 2, ("c", "s2"): 2}
    blocks = {(r.chrom, r.n_entries) for r in blocks_of(m.variants, m.calls).collect()}
    assert {c for c, _ in blocks} == {"1", "2"} and sum(n for _, n in blocks) == 5
    (tmp_path / "c.vcf").write_text(head + "s1\ts9\n" + line("1", 100, "a", "1|0", "0|0"))
    build.step0(spark, [("1", str(tmp_path / "a.vcf")), ("1", str(tmp_path / "c.vcf"))], f"{out}2")
    with pytest.raises(ValueError, match="doesn't have the samples"):
        build.step1(spark, f"{out}2")


def test_build_and_commands(spark, vcf, tmp_path):
    out = str(tmp_path / "s")
    assert cli.main(["compress", vcf, "--out", out, "--partition-size", "150"], spark) == 0
    stats = build.step3(spark, f"{out}.work").collect()
    assert len(stats) == 2 and all(r.correct_allele_counts for r in stats)
    assert counts(store.read_store(spark, out)) == {"a": 3, "b": 1, "c": 3, "d": 5, "e": 0}
    assert store.list_blocks(spark, out).count() == 2
    assert [r.iid for r in store.list_iids(spark, out).collect()] == ["s1", "s2", "s3"]
    g, m = store.read_graph(spark, out), store.read_store(spark, out)
    b = g["reps"].select("block", "v", F.lit(1).cast("long").alias("x"))
    got = {r.hap_idx: r.y for r in graph.graph_matvec(g["edges"], g["sample_edges"], g["reps"], b).where("y <> 0").collect()}
    assert got == {r.hap_idx: r.n for r in m.calls.groupBy("hap_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    (tmp_path / "p.tsv").write_text("iid\ty\ns1\t1\ns2\t2\ns3\t4\n")
    assert cli.main(["assoc", out, str(tmp_path / "p.tsv"), "--out", str(tmp_path / "r")], spark) == 0
    got = spark.read.parquet(str(tmp_path / "r.parquet"))
    assert got.columns == ["ID", "A1FREQ", "y_BETA", "y_SE"] and got.count() == 5
    spark.createDataFrame([("a", 2.0), ("zzz", 1.0)], "ID string, s double").write.parquet(str(tmp_path / "beta"))
    assert cli.main(["score", out, "--beta-path", str(tmp_path / "beta"), "--score-cols", "s", "--out", str(tmp_path / "q")], spark) == 0
    scores = {r.iid: float(r.s) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "q.tsv")).collect()}
    assert scores == {"s1": 2.0, "s2": 4.0, "s3": 0.0}
    assert cli.main(["assoc", out, str(tmp_path / "p.tsv"), "--chrom", "7", "--out", str(tmp_path / "z")], spark) == 1
    assert cli.main(["assoc"], spark) == 2
