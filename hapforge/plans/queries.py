"""The registry of genotype queries: name -> (Spark function, DuckDB statement or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapforge.operators import association as assoc
from hapforge.operators import graph, structure
from hapforge.operators import variants as var
from hapforge.operators.matrix import GenotypeMatrix, binarize
from hapforge.plans import derive
from hapforge.shared import materialize
from hapforge.sources.store import threshold_histogram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Least correlation of dosage and call: some variants of the query below have more, others less.
_LEAST_R = 0.92

# --- statements that several oracles start from ------------------------------------------------

_LINES = """x AS (SELECT CAST(o_custkey * 2 + (l_linenumber % 2) AS BIGINT) AS hap_idx, p_brand, p_type, p_size, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
haps AS (SELECT CAST(c_custkey * 2 + h AS BIGINT) AS hap_idx, CAST(c_custkey AS VARCHAR) AS iid, h AS hap, CAST(c_custkey % 2 AS INT) AS sex
  FROM customer CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1) hh),
nh AS (SELECT COUNT(*) AS n FROM haps)"""
_FINE = f"""{_LINES},
cells AS (SELECT DISTINCT hap_idx, CAST(substr(p_brand, 7) AS INT) AS chrom, p_size AS pos FROM x),
calls AS (SELECT hap_idx, chrom * 100 + pos AS variant_idx FROM cells),
variants AS (SELECT DISTINCT chrom * 100 + pos AS variant_idx, CAST(chrom AS VARCHAR) AS chrom, pos, 'chr' || chrom || ':' || pos AS id, 'A' AS ref,
  CASE WHEN pos % 5 = 0 THEN 'AT' WHEN pos % 5 = 1 THEN 'T,G' ELSE 'T' END AS alt, CAST(chrom AS VARCHAR) AS block FROM cells),
ac AS (SELECT v.*, COUNT(c.hap_idx) AS ac, COUNT(c.hap_idx) / CAST((SELECT n FROM nh) AS DOUBLE) AS af FROM variants v LEFT JOIN calls c USING (variant_idx) GROUP BY ALL)"""
_COARSE = f"""{_LINES},
calls AS (SELECT DISTINCT hap_idx, CAST(substr(p_brand, 7) AS INT) AS variant_idx FROM x),
variants AS (SELECT DISTINCT variant_idx, variant_idx % 2 = 1 AS flip FROM calls),
stored AS (SELECT variant_idx, COUNT(*) AS k FROM calls GROUP BY variant_idx)"""
_PHENO = """pheno AS (SELECT CAST(c_custkey AS VARCHAR) AS iid, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS bal, c_acctbal AS acctbal,
  CAST(c_nationkey AS DOUBLE) AS nation, spend FROM customer LEFT JOIN (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
_NESTED = f"""{_LINES},
cells AS (SELECT DISTINCT p_brand AS block, hap_idx, p_brand || ':any' AS v FROM x
  UNION SELECT DISTINCT p_brand, hap_idx, p_brand || ':q' || t FROM x JOIN (VALUES (1), (10), (20), (30), (40)) q(t) ON l_quantity >= t
  UNION SELECT DISTINCT p_brand, hap_idx, p_brand || ':' || p_type FROM x),
cn AS (SELECT block, v, COUNT(*) AS n FROM cells GROUP BY block, v),
contained AS (SELECT a.block, a.v AS child, b.v AS parent, ca.n AS n_child, cb.n AS n_parent FROM cells a JOIN cells b ON a.block = b.block AND a.hap_idx = b.hap_idx AND a.v <> b.v
  JOIN cn ca ON ca.block = a.block AND ca.v = a.v JOIN cn cb ON cb.block = b.block AND cb.v = b.v GROUP BY ALL HAVING COUNT(*) = ca.n),
reps AS (SELECT cn.block, cn.v, least(cn.v, coalesce(MIN(c.parent), cn.v)) AS rep FROM cn LEFT JOIN contained c ON c.block = cn.block AND c.child = cn.v AND c.n_child = c.n_parent GROUP BY cn.block, cn.v),
closed AS (SELECT c.block, c.child, c.parent FROM contained c WHERE n_child < n_parent
  AND (c.block, c.child) IN (SELECT (block, v) FROM reps WHERE v = rep) AND (c.block, c.parent) IN (SELECT (block, v) FROM reps WHERE v = rep)),
edges AS (SELECT * FROM closed e WHERE NOT EXISTS (SELECT 1 FROM closed a JOIN closed b ON a.block = b.block AND a.parent = b.child WHERE a.block = e.block AND a.child = e.child AND b.parent = e.parent)),
linear AS (WITH RECURSIVE chains AS (SELECT block, child, parent, 1 AS len FROM closed UNION ALL
    SELECT c.block, c.child, s.parent, c.len + 1 FROM chains c JOIN closed s ON s.block = c.block AND s.child = c.parent)
  SELECT block, child, parent, CAST(SUM(CASE WHEN len % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM chains GROUP BY block, child, parent HAVING SUM(CASE WHEN len % 2 = 1 THEN 1 ELSE -1 END) <> 0),
xrep AS (SELECT c.block, c.hap_idx, c.v FROM cells c JOIN reps r ON r.block = c.block AND r.v = c.v AND r.v = r.rep),
samples AS (SELECT block, hap_idx, v, CAST(SUM(w) AS BIGINT) AS weight FROM (SELECT block, hap_idx, v, 1 AS w FROM xrep UNION ALL
  SELECT s.block, s.hap_idx, l.parent, -l.weight FROM xrep s JOIN linear l ON l.block = s.block AND l.child = s.v) GROUP BY block, hap_idx, v HAVING SUM(w) <> 0)"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _r(column: str, places: int = 6):
    return F.round(F.col(column), places).alias(column)


_BED = [("1", 5, 15), ("2", 1, 30), ("2", 20, 40), ("7", 10, 11)]
_BED_SQL = "bed AS (SELECT * FROM (VALUES ('1', 5, 15), ('2', 1, 30), ('2', 20, 40), ('7', 10, 11)) b(chrom, chromStart, chromEnd)),\ninbed AS (SELECT a.*, EXISTS (SELECT 1 FROM bed WHERE bed.chrom = a.chrom AND a.pos >= chromStart AND a.pos < chromEnd) AS inside FROM ac a)"


def _bed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BED, "chrom string, chromStart bigint, chromEnd bigint")


def _b(matrix: GenotypeMatrix) -> DataFrame:
    """Effects of variants: small whole numbers, so sums are exact."""
    v = F.col("variant_idx")
    return matrix.variants.select("variant_idx", (v % 7 - 3).cast("double").alias("b0"), (v % 5 - 2).cast("double").alias("b1"))


def _y(matrix: GenotypeMatrix) -> DataFrame:
    h = F.col("hap_idx")
    return matrix.haps.select("hap_idx", (h % 5 - 2).cast("double").alias("y0"), (h % 3 - 1).cast("double").alias("y1"))


_B_SQL = "b AS (SELECT variant_idx, CAST(variant_idx % 7 - 3 AS DOUBLE) AS b0, CAST(variant_idx % 5 - 2 AS DOUBLE) AS b1 FROM variants)"
_Y_SQL = "y AS (SELECT hap_idx, CAST(hap_idx % 5 - 2 AS DOUBLE) AS y0, CAST(hap_idx % 3 - 1 AS DOUBLE) AS y1 FROM haps)"

# --- counts and frequencies -------------------------------------------------------------------


@_query("allele_counts", f"WITH {_FINE} SELECT variant_idx, ac FROM ac")
def allele_counts(spark, sf):
    return derive.fine(spark, sf).allele_counts().select("variant_idx", "ac")


@_query("allele_freq", f"WITH {_FINE} SELECT variant_idx, id, ac, ROUND(af, 9) AS af FROM ac")
def allele_freq(spark, sf):
    return derive.fine(spark, sf).allele_counts().select("variant_idx", "id", "ac", _r("af", 9))


@_query("maf_filter_strict", f"WITH {_FINE} SELECT variant_idx, ac FROM ac WHERE least(af, 1 - af) > 0.02")
def maf_filter_strict(spark, sf):
    return var.maf_above(derive.fine(spark, sf).allele_counts(), 0.02).select("variant_idx", "ac")


@_query("maf_filter_read", f"WITH {_FINE} SELECT variant_idx, ac FROM ac WHERE af >= 0.02 AND 1 - af >= 0.02")
def maf_filter_read(spark, sf):
    return var.maf_at_least(derive.fine(spark, sf).allele_counts(), 0.02).select("variant_idx", "ac")


@_query(
    "flip_alleles",
    f"WITH {_COARSE} SELECT variant_idx, k > (SELECT n FROM nh) / 2.0 AS flip, CAST(CASE WHEN k > (SELECT n FROM nh) / 2.0 THEN (SELECT n FROM nh) - k ELSE k END AS BIGINT) AS stored, k AS ac FROM stored",
)
def flip_alleles(spark, sf):
    m = derive.coarse(spark, sf).flip_minor()
    return m.stored_counts().select("variant_idx", "flip", "stored").join(m.allele_counts().select("variant_idx", "ac"), "variant_idx")


@_query(
    "carriers",
    f"""WITH {_COARSE}, d AS (SELECT variant_idx, iid, COUNT(*) AS dose FROM calls JOIN haps USING (hap_idx) GROUP BY 1, 2),
s AS (SELECT variant_idx, COUNT(*) AS held, SUM(CASE WHEN dose = 1 THEN 1 ELSE 0 END) AS one, SUM(CASE WHEN dose = 2 THEN 1 ELSE 0 END) AS two FROM d GROUP BY 1)
SELECT variant_idx, CAST(CASE WHEN flip THEN (SELECT COUNT(*) FROM customer) - two ELSE held END AS BIGINT) AS carriers, CAST(one AS BIGINT) AS heterozygotes,
  CAST(CASE WHEN flip THEN (SELECT COUNT(*) FROM customer) - held ELSE two END AS BIGINT) AS homozygotes FROM s JOIN variants USING (variant_idx)""",
)
def carriers(spark, sf):
    return derive.coarse(spark, sf, flipped=True).carrier_counts()


@_query(
    "heterozygotes",
    f"""WITH {_FINE}, d AS (SELECT variant_idx, iid, COUNT(*) AS dose FROM calls JOIN haps USING (hap_idx) WHERE CAST(iid AS INT) % 3 <> 0 GROUP BY 1, 2)
SELECT v.variant_idx, COUNT(CASE WHEN dose = 1 THEN 1 END) AS heterozygotes FROM variants v LEFT JOIN d USING (variant_idx) GROUP BY 1""",
)
def heterozygotes(spark, sf):
    m = derive.fine(spark, sf)
    return m.carrier_counts(m.haps.where(F.col("iid").cast("int") % 3 != 0)).select("variant_idx", "heterozygotes")


@_query("threshold_histogram", f"WITH {_FINE} SELECT k, COUNT(CASE WHEN least(af, 1 - af) > pow(10.0, -k) THEN 1 END) AS n_variants FROM ac CROSS JOIN (SELECT CAST(unnest(range(1, CAST(greatest(1, ceil(log10(greatest((SELECT n FROM nh), 2)))) AS BIGINT) + 1)) AS INT) AS k) t GROUP BY k")
def histogram(spark, sf):
    m = derive.fine(spark, sf)
    return threshold_histogram(m.allele_counts(), m.n)


@_query(
    "sex_aware_carriers",
    f"""WITH {_FINE}, kept AS (SELECT * FROM haps WHERE NOT (sex = 1 AND hap = 1)), d AS (SELECT variant_idx, iid, COUNT(*) AS dose FROM calls JOIN kept USING (hap_idx) GROUP BY 1, 2)
SELECT v.variant_idx, COUNT(dose) AS carriers, COUNT(CASE WHEN dose = 1 THEN 1 END) AS heterozygotes, COUNT(CASE WHEN dose = 2 THEN 1 END) AS homozygotes FROM variants v LEFT JOIN d USING (variant_idx) GROUP BY 1""",
)
def sex_aware_carriers(spark, sf):
    return derive.fine(spark, sf).drop_second_of_males().carrier_counts()


@_query(
    "compression_stats",
    f"WITH {_FINE} SELECT block, COUNT(*) AS n_variants, CAST(SUM(ac) AS BIGINT) AS n_entries, CAST(SUM(least(ac, (SELECT n FROM nh) - ac)) AS BIGINT) AS minor_alleles FROM ac GROUP BY block",
)
def compression_stats(spark, sf):
    m = derive.fine(spark, sf)
    v = m.allele_counts()
    return v.groupBy("block").agg(F.count(F.lit(1)).alias("n_variants"), F.sum("ac").alias("n_entries"), F.sum(F.least("ac", F.lit(m.n) - F.col("ac"))).alias("minor_alleles"))


@_query("column_variance", f"WITH {_FINE} SELECT variant_idx, ROUND(af * (1 - af), 9) AS variance FROM ac")
def column_variance(spark, sf):
    return derive.fine(spark, sf).column_variances().select("variant_idx", _r("variance", 9))


@_query(
    "binarize",
    f"""WITH d AS (SELECT CAST(l_partkey % 50 AS INT) AS variant_idx, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS hap_idx, l_discount * 20 AS dosage FROM lineitem),
r AS (SELECT *, CAST(round_even(dosage, 0) AS INT) AS call FROM d),
k AS (SELECT variant_idx FROM r GROUP BY 1 HAVING corr(dosage, call) >= {_LEAST_R})
SELECT variant_idx, COUNT(*) AS n, CAST(SUM(call) AS BIGINT) AS calls FROM r JOIN k USING (variant_idx) GROUP BY 1""",
)
def binarized(spark, sf):
    li = derive.table(spark, sf, "lineitem")
    d = li.select((F.col("l_partkey") % 50).cast("int").alias("variant_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("hap_idx"), (F.col("l_discount") * 20).alias("dosage"))
    return binarize(d, _LEAST_R).groupBy("variant_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("call").alias("calls"))


# --- filters, listings and joins --------------------------------------------------------------


@_query("region_scan", f"WITH {_FINE} SELECT variant_idx, pos FROM variants WHERE chrom = '3' AND pos BETWEEN 10 AND 20")
def region_scan(spark, sf):
    return var.in_region(derive.fine(spark, sf).variants, "3", 10, 20).select("variant_idx", "pos")


@_query("bed_filter", f"WITH {_FINE}, {_BED_SQL} SELECT variant_idx, ac FROM inbed WHERE inside AND least(af, 1 - af) > 0.01")
def bed_filter(spark, sf):
    return var.dual_threshold(derive.fine(spark, sf).allele_counts(), _bed(spark), bed_maf=0.01, bed_only=True).select("variant_idx", "ac")


@_query("bed_dual_threshold", f"WITH {_FINE}, {_BED_SQL} SELECT variant_idx, ac FROM inbed WHERE least(af, 1 - af) > CASE WHEN inside THEN 0.005 ELSE 0.02 END")
def bed_dual_threshold(spark, sf):
    return var.dual_threshold(derive.fine(spark, sf).allele_counts(), _bed(spark), 0.02, 0.005).select("variant_idx", "ac")


@_query("filtered_counts_by_block", f"WITH {_FINE} SELECT block, COUNT(CASE WHEN least(af, 1 - af) > 0.02 THEN 1 END) AS n_variants FROM ac GROUP BY block")
def filtered_counts_by_block(spark, sf):
    return var.counts_by_block(derive.fine(spark, sf).allele_counts(), 0.02)


_BLOCKS = "blocks AS (SELECT block, chrom, MIN(pos) AS start, MAX(pos) AS \"end\", COUNT(*) AS n_variants, CAST(SUM(ac) AS BIGINT) AS n_entries FROM ac GROUP BY block, chrom), ordered AS (SELECT *, CAST(row_number() OVER (ORDER BY CAST(chrom AS INT), start) - 1 AS INT) AS block_idx FROM blocks)"


@_query("block_listing_sorted", f"WITH {_FINE}, {_BLOCKS} SELECT * FROM ordered")
def block_listing_sorted(spark, sf):
    m = derive.fine(spark, sf)
    return var.ordered_blocks(var.blocks_of(m.variants, m.calls))


@_query("load_balance_split", f"WITH {_FINE}, {_BLOCKS} SELECT block, block_idx, CAST(least(3, floor(coalesce(SUM(n_entries) OVER (ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 / SUM(n_entries) OVER ())) AS INT) AS worker FROM ordered")
def load_balance_split(spark, sf):
    m = derive.fine(spark, sf)
    return var.balance_blocks(var.ordered_blocks(var.blocks_of(m.variants, m.calls)), 4).select("block", "block_idx", "worker")


@_query(
    "region_partitions",
    f"""WITH {_FINE}, e AS (SELECT chrom, CAST(MIN(pos) AS BIGINT) * 1000 AS s, CAST(MAX(pos) AS BIGINT) * 1000 AS t FROM variants GROUP BY chrom),
p AS (SELECT *, greatest(1, CAST(floor((t - s) / 9000.0) AS INT)) AS parts FROM e), q AS (SELECT *, CAST(unnest(range(parts)) AS INT) AS part FROM p)
SELECT chrom, part, CAST(s + floor((t - s) * part / CAST(parts AS DOUBLE)) + CASE WHEN part > 0 THEN 1 ELSE 0 END AS BIGINT) AS start, CAST(s + floor((t - s) * (part + 1) / CAST(parts AS DOUBLE)) AS BIGINT) AS "end" FROM q""",
)
def region_partitions(spark, sf):
    e = derive.fine(spark, sf).variants.groupBy("chrom").agg((F.min("pos").cast("long") * 1000).alias("start"), (F.max("pos").cast("long") * 1000).alias("end"))
    return var.region_partitions(e, 9000)


@_query("pick_blocks", f"WITH {_FINE}, {_BLOCKS} SELECT block, n_variants FROM blocks WHERE chrom IN ('2', '10')")
def pick_blocks(spark, sf):
    m = derive.fine(spark, sf)
    return var.pick_blocks(var.blocks_of(m.variants, m.calls), chroms=["chr2", "CHR10"]).select("block", "n_variants")


@_query("indel_multiallelic_filter", f"WITH {_FINE} SELECT variant_idx, alt FROM variants WHERE pos % 5 NOT IN (0, 1)")
def indel_multiallelic_filter(spark, sf):
    return var.snvs(derive.fine(spark, sf).variants).select("variant_idx", "alt")


@_query("variant_info", f"WITH {_FINE} SELECT variant_idx, chrom, pos, ref, alt FROM ac WHERE least(af, 1 - af) > 0.015")
def variant_info(spark, sf):
    return var.variant_info(derive.fine(spark, sf).allele_counts(), "no_id", 0.015)


@_query("merge_inner", "SELECT CAST(c_custkey AS BIGINT) AS left_row, o_orderkey AS right_row FROM customer JOIN orders ON c_custkey = o_custkey")
def merge_inner(spark, sf):
    left = derive.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("row"))
    return var.merge_rows(left, derive.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("row")), "k")


@_query("row_filter", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def row_filter(spark, sf):
    o = derive.table(spark, sf, "orders")
    c = derive.table(spark, sf, "customer")
    return var.rows_with_match(c.withColumn("k", F.col("c_custkey")), o.withColumn("k", F.col("o_custkey")), "k").select("c_custkey")


@_query("merge_chain", "SELECT CAST(c_custkey AS BIGINT) AS left_row, l_orderkey * 8 + l_linenumber AS right_row FROM customer JOIN orders ON c_custkey = o_custkey JOIN (SELECT o_custkey AS k, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1) t ON t.k = c_custkey")
def merge_chain(spark, sf):
    c, o, li = (derive.table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    left = c.select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("row"))
    first = li.where("l_linenumber = 1").join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("k"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    return var.merge_chain([left, o.select(F.col("o_custkey").alias("k")), first], "k")


@_query("remove_samples", f"WITH {_FINE}, kept AS (SELECT * FROM haps WHERE CAST(iid AS INT) % 4 <> 0) SELECT v.variant_idx, COUNT(k.hap_idx) AS ac FROM variants v LEFT JOIN calls c USING (variant_idx) LEFT JOIN kept k USING (hap_idx) GROUP BY 1")
def remove_samples(spark, sf):
    m = derive.fine(spark, sf)
    return m.remove_samples(m.haps.where(F.col("iid").cast("int") % 4 == 0)).allele_counts().select("variant_idx", "ac")


@_query("sample_keep", f"WITH {_FINE}, kept AS (SELECT * FROM haps WHERE CAST(iid AS INT) % 4 = 1) SELECT v.variant_idx, COUNT(k.hap_idx) AS ac, ROUND(COUNT(k.hap_idx) / CAST((SELECT COUNT(*) FROM kept) AS DOUBLE), 9) AS af FROM variants v LEFT JOIN calls c USING (variant_idx) LEFT JOIN kept k USING (hap_idx) GROUP BY 1")
def sample_keep(spark, sf):
    m = derive.fine(spark, sf)
    return m.keep_samples(m.haps.where(F.col("iid").cast("int") % 4 == 1)).allele_counts().select("variant_idx", "ac", _r("af", 9))


@_query("pheno_covar_join", f"WITH {_PHENO} SELECT iid, bal, spend, nation, CAST(1 AS DOUBLE) AS i0 FROM pheno WHERE coalesce(bal, spend) IS NOT NULL")
def pheno_covar_join(spark, sf):
    return assoc.with_intercept(var.some_phenotype(derive.phenotypes(spark, sf), ["bal", "spend"])).select("iid", "bal", "spend", "nation", "i0")


@_query("impute_mean", f"WITH {_PHENO} SELECT iid, ROUND(coalesce(bal, (SELECT AVG(bal) FROM pheno)), 4) AS bal, ROUND(coalesce(spend, (SELECT AVG(spend) FROM pheno)), 2) AS spend FROM pheno")
def impute_mean(spark, sf):
    return var.impute_means(derive.phenotypes(spark, sf).select("iid", "bal", "spend"), ["bal", "spend"]).select("iid", _r("bal", 4), _r("spend", 2))


# --- products ---------------------------------------------------------------------------------


@_query("matvec", f"WITH {_FINE}, {_B_SQL} SELECT h.hap_idx, coalesce(SUM(b0), 0) AS b0 FROM haps h LEFT JOIN (calls JOIN b USING (variant_idx)) c ON c.hap_idx = h.hap_idx GROUP BY 1")
def matvec(spark, sf):
    m = derive.fine(spark, sf)
    return m.matmat(_b(m), ["b0"])


@_query("rmatvec", f"WITH {_FINE}, {_Y_SQL} SELECT v.variant_idx, coalesce(SUM(y0), 0) AS y0 FROM variants v LEFT JOIN (calls JOIN y USING (hap_idx)) c ON c.variant_idx = v.variant_idx GROUP BY 1")
def rmatvec(spark, sf):
    m = derive.fine(spark, sf)
    return m.rmatmat(_y(m), ["y0"])


@_query("matmat", f"WITH {_FINE}, {_B_SQL} SELECT h.hap_idx, coalesce(SUM(b0), 0) AS b0, coalesce(SUM(b1), 0) AS b1 FROM haps h LEFT JOIN (calls JOIN b USING (variant_idx)) c ON c.hap_idx = h.hap_idx GROUP BY 1")
def matmat(spark, sf):
    m = derive.fine(spark, sf)
    return m.matmat(_b(m), ["b0", "b1"])


@_query("rmatmat", f"WITH {_FINE}, {_Y_SQL} SELECT v.variant_idx, coalesce(SUM(y0), 0) AS y0, coalesce(SUM(y1), 0) AS y1 FROM variants v LEFT JOIN (calls JOIN y USING (hap_idx)) c ON c.variant_idx = v.variant_idx GROUP BY 1")
def rmatmat(spark, sf):
    m = derive.fine(spark, sf)
    return m.rmatmat(_y(m), ["y0", "y1"])


@_query(
    "matvec_flipped",
    f"WITH {_COARSE}, {_B_SQL} SELECT h.hap_idx, SUM(CASE WHEN v.flip THEN (CASE WHEN c.hap_idx IS NULL THEN b0 ELSE 0 END) ELSE (CASE WHEN c.hap_idx IS NULL THEN 0 ELSE b0 END) END) AS b0 FROM haps h CROSS JOIN variants v JOIN b ON b.variant_idx = v.variant_idx LEFT JOIN calls c ON c.hap_idx = h.hap_idx AND c.variant_idx = v.variant_idx GROUP BY 1",
)
def matvec_flipped(spark, sf):
    m = derive.coarse(spark, sf, flipped=True)
    return m.matmat(_b(m), ["b0"])


@_query(
    "rmatvec_flipped",
    f"WITH {_COARSE}, {_Y_SQL} SELECT v.variant_idx, SUM(CASE WHEN v.flip THEN (CASE WHEN c.hap_idx IS NULL THEN y0 ELSE 0 END) ELSE (CASE WHEN c.hap_idx IS NULL THEN 0 ELSE y0 END) END) AS y0 FROM variants v CROSS JOIN y LEFT JOIN calls c ON c.hap_idx = y.hap_idx AND c.variant_idx = v.variant_idx GROUP BY 1",
)
def rmatvec_flipped(spark, sf):
    m = derive.coarse(spark, sf, flipped=True)
    return m.rmatmat(_y(m), ["y0"])


@_query("mean_centered_matvec", f"WITH {_FINE}, {_B_SQL}, s AS (SELECT SUM(af * b0) AS m FROM ac JOIN b USING (variant_idx)) SELECT h.hap_idx, ROUND(coalesce(SUM(b0), 0) - (SELECT m FROM s), 6) AS b0 FROM haps h LEFT JOIN (calls JOIN b USING (variant_idx)) c ON c.hap_idx = h.hap_idx GROUP BY 1")
def mean_centered_matvec(spark, sf):
    m = derive.fine(spark, sf)
    return m.centered_matmat(_b(m), ["b0"]).select("hap_idx", _r("b0"))


_W_SQL = "w AS (SELECT a.variant_idx, a.af, coalesce(SUM(c.y0), 0) - a.af * (SELECT SUM(y0) FROM y) AS w FROM ac a LEFT JOIN (calls JOIN y USING (hap_idx)) c ON c.variant_idx = a.variant_idx GROUP BY a.variant_idx, a.af)"


@_query("normalized_rmatvec", f"WITH {_FINE}, {_Y_SQL}, {_W_SQL} SELECT variant_idx, ROUND(w / CASE WHEN af * (1 - af) > 0 THEN sqrt(af * (1 - af)) ELSE 1 END, 5) AS y0 FROM w")
def normalized_rmatvec(spark, sf):
    m = derive.fine(spark, sf)
    return m.normalized_rmatmat(_y(m), ["y0"]).select("variant_idx", _r("y0", 5))


@_query(
    "normalized_matvec",
    f"WITH {_FINE}, {_B_SQL}, z AS (SELECT variant_idx, af, b0 / sqrt(af * (1 - af)) AS s FROM ac JOIN b USING (variant_idx)) SELECT h.hap_idx, ROUND(coalesce(SUM(s), 0) - (SELECT SUM(af * s) FROM z), 5) AS b0 FROM haps h LEFT JOIN (calls JOIN z USING (variant_idx)) c ON c.hap_idx = h.hap_idx GROUP BY 1",
)
def normalized_matvec(spark, sf):
    m = derive.fine(spark, sf)
    return m.normalized_matmat(_b(m), ["b0"]).select("hap_idx", _r("b0", 5))


for _name, _alpha in (("grm_matvec", -1.0), ("grm_alpha", -0.5)):
    _sql = f"WITH {_FINE}, {_Y_SQL}, {_W_SQL}, q AS (SELECT variant_idx, af, w * pow(af * (1 - af), {_alpha}) AS s FROM w) SELECT h.hap_idx, ROUND(coalesce(SUM(s), 0) - (SELECT SUM(af * s) FROM q), 3) AS y0 FROM haps h LEFT JOIN (calls JOIN q USING (variant_idx)) c ON c.hap_idx = h.hap_idx GROUP BY 1"

    @_query(_name, _sql)
    def _grm(spark, sf, alpha=_alpha):
        m = derive.fine(spark, sf)
        return m.grm_matmat(_y(m), ["y0"], alpha).select("hap_idx", _r("y0", 3))


@_query("diploid_sum", f"WITH {_LINES} SELECT iid, CAST(SUM(hap_idx % 5 - 2) AS DOUBLE) AS y0 FROM haps GROUP BY iid")
def diploid_sum(spark, sf):
    m = derive.fine(spark, sf)
    return m.diploid(_y(m), ["y0"])


_EFFECTS_SQL = "eff AS (SELECT id, CAST(pos % 9 - 4 AS DOUBLE) AS s0, CAST(pos % 4 AS DOUBLE) AS s1 FROM variants WHERE pos % 2 = 0 UNION ALL SELECT 'EXTRA_1', 5.0, 5.0)"


def _effects(m: GenotypeMatrix) -> DataFrame:
    known = m.variants.where("pos % 2 = 0").select("id", (F.col("pos") % 9 - 4).cast("double").alias("s0"), (F.col("pos") % 4).cast("double").alias("s1"))
    return known.unionByName(m.variants.sparkSession.createDataFrame([("EXTRA_1", 5.0, 5.0)], known.schema))


@_query("prs_score", f"WITH {_FINE}, {_EFFECTS_SQL} SELECT h.iid, coalesce(SUM(s0), 0) AS s0, coalesce(SUM(s1), 0) AS s1 FROM haps h LEFT JOIN (calls JOIN variants USING (variant_idx) JOIN eff USING (id)) c ON c.hap_idx = h.hap_idx GROUP BY 1")
def prs_score(spark, sf):
    m = derive.fine(spark, sf)
    return assoc.polygenic_scores(m, _effects(m), ["s0", "s1"])


@_query("ld_matrix", f"WITH {_FINE} SELECT a.variant_idx AS v1, b.variant_idx AS v2, ROUND(COUNT(*) / CAST((SELECT n FROM nh) AS DOUBLE), 9) AS r FROM calls a JOIN calls b ON a.hap_idx = b.hap_idx AND a.variant_idx // 100 = b.variant_idx // 100 GROUP BY 1, 2")
def ld_matrix(spark, sf):
    return derive.fine(spark, sf).ld().select("v1", "v2", _r("r", 9))


@_query("ld_snplist", f'WITH {_FINE} SELECT pos AS "POS", ref AS "REF", alt AS "ALT", id AS "SNP", 0 AS "MISSINGNESS", ROUND(af, 9) AS "AF" FROM ac')
def ld_snplist(spark, sf):
    v = derive.fine(spark, sf).allele_counts()
    return v.select(F.col("pos").alias("POS"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.col("id").alias("SNP"), F.lit(0).alias("MISSINGNESS"), F.round("af", 9).alias("AF"))


@_query("carriers_subset", f"WITH {_FINE} SELECT variant_idx, iid, COUNT(*) AS dose FROM calls JOIN haps USING (hap_idx) WHERE variant_idx IN (101, 205, 310) GROUP BY 1, 2")
def carriers_subset(spark, sf):
    m = derive.fine(spark, sf)
    return m.carriers_of(m.variants.where(F.col("variant_idx").isin(101, 205, 310)), unphased=True)


# --- association ------------------------------------------------------------------------------

_ONE = "ph AS (SELECT hap_idx, iid, {y} AS y FROM haps JOIN pheno USING (iid) WHERE {y} IS NOT NULL), s AS (SELECT COUNT(*) AS n, SUM(y) AS sy, SUM(y * y) AS syy FROM ph)"
_ONE_V = "v AS (SELECT a.variant_idx, a.af, COUNT(p.hap_idx) AS k, coalesce(SUM(p.y), 0) AS xy FROM ac a LEFT JOIN calls c USING (variant_idx) LEFT JOIN ph p ON p.hap_idx = c.hap_idx GROUP BY 1, 2), d AS (SELECT *, k - k * CAST(k AS DOUBLE) / n AS den FROM v CROSS JOIN s)"


@_query(
    "gwas_hwe",
    f"WITH {_FINE}, {_PHENO}, {_ONE.format(y='acctbal')}, {_ONE_V} SELECT variant_idx, ROUND(af, 9) AS a1freq, ROUND((xy - k * sy / n) / den, 6) AS acctbal_beta, ROUND(sqrt((syy - sy * sy / n) / (n - 2) / den), 6) AS acctbal_se FROM d WHERE den >= 1e-4",
)
def gwas_hwe(spark, sf):
    out = assoc.gwas(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["acctbal"], ["i0"])
    return out.where("acctbal_beta IS NOT NULL").select("variant_idx", _r("a1freq", 9), _r("acctbal_beta", 6), _r("acctbal_se", 6))


@_query(
    "gwas_no_hwe",
    f"""WITH {_FINE}, {_PHENO}, {_ONE.format(y='acctbal')}, {_ONE_V},
g AS (SELECT variant_idx, iid, COUNT(*) AS dose FROM calls JOIN haps USING (hap_idx) GROUP BY 1, 2), t AS (SELECT variant_idx, SUM(CASE WHEN dose = 1 THEN 1 ELSE 0 END) AS het FROM g GROUP BY 1),
e AS (SELECT d.*, het, k + (k - het) - 2.0 * k * k / n AS den2 FROM d JOIN t USING (variant_idx))
SELECT variant_idx, ROUND(2.0 * het / (SELECT n FROM nh), 9) AS a1_carrier_freq, ROUND((xy - k * sy / n) / den2, 6) AS acctbal_beta, ROUND(sqrt((syy - sy * sy / n) / (n - 2) / den2), 6) AS acctbal_se FROM e WHERE den2 >= 1e-4""",
)
def gwas_no_hwe(spark, sf):
    out = assoc.gwas(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["acctbal"], ["i0"], assume_hwe=False)
    return out.where("acctbal_beta IS NOT NULL").select("variant_idx", _r("a1_carrier_freq", 9), _r("acctbal_beta", 6), _r("acctbal_se", 6))


@_query(
    "gwas_recompute_ac",
    f"WITH {_FINE}, {_PHENO}, {_ONE.format(y='bal')}, {_ONE_V} SELECT variant_idx, ROUND((xy - k * sy / n) / den, 6) AS bal_beta, ROUND(sqrt((syy - sy * sy / n) / (n - 2) / den), 6) AS bal_se FROM d WHERE den >= 1e-4",
)
def gwas_recompute_ac(spark, sf):
    out = assoc.gwas(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["bal"], ["i0"], recompute_ac=True)
    return out.where("bal_beta IS NOT NULL").select("variant_idx", _r("bal_beta", 6), _r("bal_se", 6))


@_query(
    "gwas_repeat_covar",
    f"WITH {_FINE}, {_PHENO}, {_ONE.format(y='bal')}, {_ONE_V} SELECT variant_idx, CASE WHEN den >= 1e-4 THEN ROUND((xy - k * sy / n) / den, 6) END AS bal_beta, CASE WHEN den >= 1e-4 THEN ROUND(sqrt((syy - sy * sy / n) / (n - 2) / den), 6) END AS bal_se FROM d",
)
def gwas_repeat_covar(spark, sf):
    out = assoc.gwas_each(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["bal"], ["i0"])
    return out.select("variant_idx", _r("bal_beta", 6), _r("bal_se", 6))


@_query(
    "gwas_covariate",
    f"""WITH {_FINE}, {_PHENO}, ph AS (SELECT hap_idx, acctbal AS y, nation AS c FROM haps JOIN pheno USING (iid)),
s AS (SELECT COUNT(*) AS n, SUM(y) AS sy, SUM(c) AS sc, SUM(c * c) AS scc, SUM(c * y) AS scy, SUM(y * y) AS syy FROM ph),
m AS (SELECT *, n * scc - sc * sc AS det, (scc * sy - sc * scy) / (n * scc - sc * sc) AS b0, (n * scy - sc * sy) / (n * scc - sc * sc) AS b1 FROM s),
v AS (SELECT variant_idx, COUNT(*) AS k, SUM(y) AS xy, SUM(c) AS xc FROM calls JOIN ph USING (hap_idx) GROUP BY 1),
d AS (SELECT *, k - (scc * k * k - 2 * sc * k * xc + n * xc * xc) / det AS den FROM v CROSS JOIN m)
SELECT variant_idx, ROUND((xy - b0 * k - b1 * xc) / den, 6) AS acctbal_beta, ROUND(sqrt((syy - b0 * sy - b1 * scy) / (n - 4) / den), 6) AS acctbal_se FROM d WHERE den >= 1e-4""",
)
def gwas_covariate(spark, sf):
    out = assoc.gwas(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["acctbal"], ["i0", "nation"])
    return out.where("acctbal_beta IS NOT NULL").select("variant_idx", _r("acctbal_beta", 6), _r("acctbal_se", 6))


@_query(
    "gwas_flipped",
    f"""WITH {_COARSE}, {_PHENO}, ph AS (SELECT hap_idx, acctbal AS y FROM haps JOIN pheno USING (iid)), s AS (SELECT COUNT(*) AS n, SUM(y) AS sy, SUM(y * y) AS syy FROM ph),
v AS (SELECT variant_idx, COUNT(*) AS k, SUM(y) AS xy FROM calls JOIN ph USING (hap_idx) GROUP BY 1), d AS (SELECT *, k - k * CAST(k AS DOUBLE) / n AS den, (xy - k * sy / n) AS num FROM v CROSS JOIN s JOIN variants USING (variant_idx))
SELECT variant_idx, ROUND(CASE WHEN flip THEN -num ELSE num END / den, 6) AS acctbal_beta, ROUND(sqrt((syy - sy * sy / n) / (n - 2) / den), 6) AS acctbal_se FROM d""",
)
def gwas_flipped(spark, sf):
    out = assoc.gwas(derive.coarse(spark, sf, flipped=True), assoc.with_intercept(derive.phenotypes(spark, sf)), ["acctbal"], ["i0"])
    return out.select("variant_idx", _r("acctbal_beta", 6), _r("acctbal_se", 6))


_TRAITS = ("bal", "spend", "acctbal")


@_query(
    "gwas_multi_trait",
    f"""WITH {_FINE}, {_PHENO}, w AS (SELECT AVG(nation) AS mean FROM pheno), ph AS (SELECT hap_idx, coalesce(nation, mean) AS c, bal, spend, acctbal FROM haps JOIN pheno USING (iid) CROSS JOIN w),
a AS (SELECT COUNT(*) AS n, SUM(c) AS sc, SUM(c * c) AS scc FROM ph),
"""
    + ", ".join(
        f"""s_{t} AS (SELECT COUNT({t}) AS n, SUM({t}) AS sy, SUM(CASE WHEN {t} IS NOT NULL THEN c END) AS sc, SUM(CASE WHEN {t} IS NOT NULL THEN c * c END) AS scc, SUM(c * {t}) AS scy, SUM({t} * {t}) AS syy FROM ph),
m_{t} AS (SELECT *, (scc * sy - sc * scy) / (n * scc - sc * sc) AS b0, (n * scy - sc * sy) / (n * scc - sc * sc) AS b1 FROM s_{t}),
r_{t} AS (SELECT hap_idx, {t} - b0 - b1 * c AS r FROM ph CROSS JOIN m_{t} WHERE {t} IS NOT NULL)"""
        for t in _TRAITS
    )
    + """,
v AS (SELECT x.variant_idx, x.af, COUNT(p.hap_idx) AS k, coalesce(SUM(p.c), 0) AS xc, """
    + ", ".join(f"coalesce(SUM(r_{t}.r), 0) AS x_{t}" for t in _TRAITS)
    + " FROM ac x LEFT JOIN calls c USING (variant_idx) LEFT JOIN ph p ON p.hap_idx = c.hap_idx "
    + " ".join(f"LEFT JOIN r_{t} ON r_{t}.hap_idx = c.hap_idx" for t in _TRAITS)
    + """ GROUP BY 1, 2),
d AS (SELECT *, k - (scc * k * k - 2 * sc * k * xc + n * xc * xc) / (n * scc - sc * sc) AS den FROM v CROSS JOIN a)
SELECT variant_idx, ROUND(af, 3) AS a1freq, """
    + ", ".join(f"CASE WHEN den >= 1e-4 THEN ROUND(x_{t} / den, 3) END AS {t}_beta, CASE WHEN den >= 1e-4 THEN ROUND(sqrt((SELECT (syy - b0 * sy - b1 * scy) / (n - 4) FROM m_{t}) / den), 3) END AS {t}_se" for t in _TRAITS)
    + " FROM d",
)
def gwas_multi_trait(spark, sf):
    out = assoc.gwas(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), list(_TRAITS), ["i0", "nation"])
    return out.select("variant_idx", *[_r(c, 3) for c in out.columns[1:]])


_SIMPLE_SQL = "t AS (SELECT *, CASE WHEN flip THEN n - k ELSE k END AS a, CASE WHEN flip THEN sy - xy ELSE xy END AS axy FROM v CROSS JOIN s), d AS (SELECT *, a - a * CAST(a AS DOUBLE) / n AS var, (axy - a * sy / n) / (a - a * CAST(a AS DOUBLE) / n) AS beta FROM t) SELECT variant_idx, ROUND(beta, 6) AS beta, ROUND(sqrt(((syy - sy * sy / n) - beta * beta * var) / (n - 2) / var), 6) AS se FROM d"


@_query("simple_gwas", f"WITH {_FINE}, {_PHENO}, {_ONE.format(y='acctbal')}, v AS (SELECT a.variant_idx, FALSE AS flip, COUNT(p.hap_idx) AS k, coalesce(SUM(p.y), 0) AS xy FROM ac a LEFT JOIN calls c USING (variant_idx) LEFT JOIN ph p ON p.hap_idx = c.hap_idx GROUP BY 1), {_SIMPLE_SQL}")
def simple_gwas(spark, sf):
    return assoc.simple_gwas(derive.fine(spark, sf), derive.phenotypes(spark, sf), "acctbal").select("variant_idx", _r("beta", 6), _r("se", 6))


@_query("simple_gwas_flipped", f"WITH {_COARSE}, {_PHENO}, {_ONE.format(y='acctbal')}, v AS (SELECT v.variant_idx, ANY_VALUE(v.flip) AS flip, COUNT(p.hap_idx) AS k, coalesce(SUM(p.y), 0) AS xy FROM variants v LEFT JOIN calls c USING (variant_idx) LEFT JOIN ph p ON p.hap_idx = c.hap_idx GROUP BY 1), {_SIMPLE_SQL}")
def simple_gwas_flipped(spark, sf):
    return assoc.simple_gwas(derive.coarse(spark, sf, flipped=True), derive.phenotypes(spark, sf), "acctbal").select("variant_idx", _r("beta", 6), _r("se", 6))


@_query(
    "residualize",
    f"""WITH {_LINES}, {_PHENO}, p AS (SELECT hap_idx, bal AS y, nation AS c FROM haps JOIN pheno USING (iid)), s AS (SELECT regr_slope(y, c) AS b1, regr_intercept(y, c) AS b0 FROM p WHERE y IS NOT NULL)
SELECT hap_idx, ROUND(CASE WHEN y IS NULL THEN 0 ELSE y - b0 - b1 * c END, 5) AS r_0 FROM p CROSS JOIN s""",
)
def residualized(spark, sf):
    rows = assoc.aligned(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["bal"], ["i0", "nation"])
    return assoc.residualize(rows, 1, 2)[0].select("hap_idx", _r("r_0", 5))


@_query(
    "he_exact_traces",
    f"""WITH {_COARSE}, af AS (SELECT variant_idx, k / CAST((SELECT n FROM nh) AS DOUBLE) AS f FROM stored),
g AS (SELECT h.iid, a.variant_idx, (COUNT(c.hap_idx) - 2 * a.f) / sqrt(a.f * (1 - a.f)) AS z FROM haps h CROSS JOIN af a LEFT JOIN calls c ON c.hap_idx = h.hap_idx AND c.variant_idx = a.variant_idx GROUP BY h.iid, a.variant_idx, a.f),
p AS (SELECT a.variant_idx AS u, b.variant_idx AS v, SUM(a.z * b.z) AS dot FROM g a JOIN g b ON a.iid = b.iid GROUP BY 1, 2)
SELECT ROUND(SUM(CASE WHEN u = v THEN dot END) / 2, 2) AS tr_k, ROUND(SUM(dot * dot) / 4, 0) AS tr_k2 FROM p""",
)
def he_exact_traces(spark, sf):
    t1, t2 = assoc.exact_traces(derive.coarse(spark, sf))
    return spark.createDataFrame([(round(t1, 2), float(round(t2, 0)))], "tr_k double, tr_k2 double")


def _unit(key: str, seed: str) -> str:
    """A statement's form of ``hashed_uniform``."""
    return f"((('0x' || substr(md5({seed} || '|' || {key}), 1, 13))::BIGINT + 0.5) / {float(1 << 52)})"


def _normal(key: str, seed: str) -> str:
    return f"(sqrt(-2 * ln({_unit(key, f'(({seed}) * 2 + 1000003)')})) * cos(2 * pi() * {_unit(key, f'(({seed}) * 2 + 1000004)')}))"


_PRODUCTS = 20
#: K x for x (iid, i, x) in ``{x}``: centred and weighted products over all variants, halved, less the mean.
_KX = """{out}_w AS (SELECT a.variant_idx, al.i, a.af, (coalesce(t.x, 0) - a.af * al.s) / (a.af * (1 - a.af)) AS w FROM (SELECT i, SUM(2 * x) AS s FROM {x} GROUP BY i) al CROSS JOIN ac a
  LEFT JOIN (SELECT c.variant_idx, q.i AS j, SUM(q.x) AS x FROM calls c JOIN haps USING (hap_idx) JOIN {x} q USING (iid) GROUP BY 1, 2) t ON t.variant_idx = a.variant_idx AND t.j = al.i WHERE a.af > 0 AND a.af < 1),
{out}_m AS (SELECT i, SUM(af * w) AS m FROM {out}_w GROUP BY i),
{out}_r AS (SELECT p.iid, m.i, coalesce(t.x, 0) / 2 - m.m AS x FROM (SELECT DISTINCT iid FROM pheno) p CROSS JOIN {out}_m m LEFT JOIN (SELECT iid, i, SUM(w) AS x FROM calls JOIN haps USING (hap_idx) JOIN {out}_w USING (variant_idx) GROUP BY 1, 2) t ON t.iid = p.iid AND t.i = m.i),
{out} AS (SELECT iid, i, x - AVG(x) OVER (PARTITION BY i) AS x FROM {out}_r)"""


@_query(
    "rhe_hutchinson",
    f"""WITH {_FINE}, {_PHENO},
z AS (SELECT iid, i, {_normal('iid', '1 + 7919 * i')} AS x FROM pheno CROSS JOIN (SELECT unnest(range({_PRODUCTS})) AS i) r),
p AS (SELECT iid, i, x - AVG(x) OVER (PARTITION BY i) AS x FROM z),
{_KX.format(x='p', out='kp')},
t AS (SELECT (SELECT SUM(p.x * kp.x) FROM p JOIN kp USING (iid, i)) / {_PRODUCTS} AS t1, (SELECT SUM(x * x) FROM kp) / {_PRODUCTS} AS t2, (SELECT COUNT(*) FROM pheno) AS n),
raw AS (SELECT iid, 0 AS i, acctbal AS x FROM pheno UNION ALL SELECT iid, 1, coalesce(spend, 0) FROM pheno),
cen AS (SELECT iid, i, x - AVG(x) OVER (PARTITION BY i) AS x FROM raw),
y AS (SELECT iid, i, x * sqrt((CASE WHEN i = 0 THEN (SELECT COUNT(acctbal) FROM pheno) ELSE (SELECT COUNT(spend) FROM pheno) END) / SUM(x * x) OVER (PARTITION BY i)) AS x FROM cen),
{_KX.format(x='y', out='ky')},
q AS (SELECT i, SUM(y.x * y.x) AS q0, SUM(y.x * ky.x) AS q1 FROM y JOIN ky USING (iid, i) GROUP BY i),
sol AS (SELECT i, t1 * (n * q1 - t1 * q0) / (n * t2 - t1 * t1) AS s2g, q0 * (t2 * q0 - t1 * q1) / (n * t2 - t1 * t1) AS s2e FROM q CROSS JOIN t)
SELECT CASE WHEN i = 0 THEN 'acctbal' ELSE 'spend' END AS phenotype, ROUND(s2g, 3) AS s2g, ROUND(s2e, 3) AS s2e, ROUND(s2g / (s2g + s2e), 5) AS h2g FROM sol""",
)
def rhe_hutchinson(spark, sf):
    out = assoc.haseman_elston(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["acctbal", "spend"], ["i0"], num_matvecs=_PRODUCTS, estimator="hutchinson")
    return out.select("phenotype", _r("s2g", 3), _r("s2e", 3), _r("h2g", 5))


for _est in ("hutch++", "xnystrace"):  # an eigenvalue problem each: held against dense matrices in the tests

    @_query(f"rhe_{_est.replace('++', 'pp')}")
    def _rhe(spark, sf, est=_est):
        return assoc.haseman_elston(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["acctbal", "spend"], ["i0"], num_matvecs=_PRODUCTS, estimator=est)


@_query(
    "rhe_exact",
    f"""WITH {_FINE}, {_PHENO}, cen AS (SELECT iid, 0 AS i, acctbal - AVG(acctbal) OVER () AS x FROM pheno), y AS (SELECT iid, i, x * sqrt(COUNT(*) OVER () / SUM(x * x) OVER ()) AS x FROM cen),
{_KX.format(x='y', out='ky')},
q AS (SELECT SUM(y.x * y.x) AS q0, SUM(y.x * ky.x) AS q1, COUNT(*) AS n FROM y JOIN ky USING (iid, i)),
sol AS (SELECT 1000.0 * (n * q1 - 1000.0 * q0) / (n * 5000000.0 - 1e6) AS s2g, q0 * (5000000.0 * q0 - 1000.0 * q1) / (n * 5000000.0 - 1e6) AS s2e FROM q)
SELECT 'acctbal' AS phenotype, ROUND(s2g, 4) AS s2g, ROUND(s2e, 3) AS s2e FROM sol""",
)
def rhe_exact(spark, sf):
    """The moment equations alone, with both traces given."""
    out = assoc.haseman_elston(derive.fine(spark, sf), assoc.with_intercept(derive.phenotypes(spark, sf)), ["acctbal"], ["i0"], exact=(1000.0, 5e6))
    return out.select("phenotype", _r("s2g", 4), _r("s2e", 3))


@_query("blup")  # a linear system in K: held against a dense solution in the tests
def blup(spark, sf):
    return assoc.blup(derive.fine(spark, sf), derive.phenotypes(spark, sf), "acctbal", 0.5)


@_query(
    "simulate_phenotype",
    f"""WITH {_FINE}, b AS (SELECT variant_idx, {_normal('variant_idx', '1')} * CASE WHEN {_unit('variant_idx', '2')} < 0.5 THEN 1.0 ELSE 0.0 END AS b FROM variants),
g AS (SELECT iid, coalesce(SUM(b), 0) AS g FROM haps LEFT JOIN (calls JOIN b USING (variant_idx)) USING (hap_idx) GROUP BY iid),
s AS (SELECT iid, (g - AVG(g) OVER ()) * sqrt(0.4) / stddev_pop(g) OVER () AS genetic FROM g)
SELECT iid, ROUND(genetic, 6) AS genetic, ROUND(genetic + {_normal('iid', '3')} * sqrt(1 - 0.4), 6) AS y FROM s""",
)
def simulate_phenotype(spark, sf):
    return assoc.simulate_phenotype(derive.fine(spark, sf), 0.4, 0.5).select("iid", _r("genetic", 6), _r("y", 6))


@_query("pca")  # eigenvalue problems, both: held against dense matrices in the tests
def pca(spark, sf):
    values, _ = structure.pca(derive.fine(spark, sf), 3)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component int, eigenvalue double")


@_query("svd")
def svd(spark, sf):
    return structure.svd(derive.fine(spark, sf), 3)[2]


@_query("genotype_variances", f"WITH {_FINE}, d AS (SELECT variant_idx, iid, COUNT(*) AS dose FROM calls JOIN haps USING (hap_idx) GROUP BY 1, 2) SELECT v.variant_idx, CAST(coalesce(SUM(dose * dose), 0) AS BIGINT) AS variance, COUNT(dose) AS carriers FROM variants v LEFT JOIN d USING (variant_idx) GROUP BY 1")
def genotype_variances(spark, sf):
    return derive.fine(spark, sf).genotype_variances()


# --- graphs -----------------------------------------------------------------------------------


def _graph(spark, sf):
    cells = materialize(derive.nested(spark, sf), "nested")
    contained = materialize(graph.containment(cells), "contained")
    reps = materialize(graph.representatives(cells, contained), "reps")
    return cells, contained, reps, materialize(graph.closure(contained, reps), "closed")


@_query("containment_pairs", f"WITH {_NESTED} SELECT * FROM contained")
def containment_pairs(spark, sf):
    return graph.containment(materialize(derive.nested(spark, sf), "nested"))


@_query("identical_variants", f"WITH {_NESTED} SELECT * FROM reps")
def identical_variants(spark, sf):
    return _graph(spark, sf)[2]


@_query("closure", f"WITH {_NESTED} SELECT * FROM closed")
def closure(spark, sf):
    return graph.transitive_closure(graph.reduction(_graph(spark, sf)[3]))


@_query("transitive_reduction", f"WITH {_NESTED} SELECT * FROM edges")
def transitive_reduction(spark, sf):
    return graph.reduction(_graph(spark, sf)[3])


@_query("reduction_union", f"WITH {_NESTED} SELECT * FROM edges")
def reduction_union(spark, sf):
    edges = graph.reduction(_graph(spark, sf)[3])
    return graph.reduction_union(edges.where("child < parent"), edges.where("child >= parent"))


@_query("topo_levels", f"WITH {_NESTED}, lv AS (WITH RECURSIVE walk AS (SELECT block, rep AS v, 0 AS level FROM reps WHERE v = rep UNION SELECT e.block, e.child, w.level + 1 FROM walk w JOIN edges e ON e.block = w.block AND e.parent = w.v) SELECT block, v, MAX(level) AS level FROM walk GROUP BY 1, 2) SELECT block, v, level FROM lv")
def topo_levels(spark, sf):
    _, _, reps, closed = _graph(spark, sf)
    return graph.levels(reps.where("v = rep"), graph.reduction(closed))


@_query("linearized_edges", f"WITH {_NESTED} SELECT * FROM linear")
def linearized_edges(spark, sf):
    return graph.linearize(_graph(spark, sf)[3])


@_query("path_sums", f"WITH {_NESTED} SELECT block, child, parent, CAST(1 AS BIGINT) AS total FROM closed")
def path_sums(spark, sf):
    return graph.path_sums(graph.linearize(_graph(spark, sf)[3]))


@_query("sample_edges", f"WITH {_NESTED} SELECT * FROM samples")
def sample_edges(spark, sf):
    cells, _, reps, closed = _graph(spark, sf)
    return graph.sample_edges(cells, reps, graph.linearize(closed))


@_query("graph_compression", f"WITH {_NESTED}, e AS (SELECT block, COUNT(*) AS k FROM (SELECT block FROM linear UNION ALL SELECT block FROM samples) GROUP BY 1) SELECT c.block, COUNT(DISTINCT v) AS n_variants, COUNT(*) AS nnz_matrix, ANY_VALUE(e.k) AS nnz_graph FROM cells c JOIN e USING (block) GROUP BY 1")
def graph_compression(spark, sf):
    cells, _, reps, closed = _graph(spark, sf)
    linear = graph.linearize(closed)
    return graph.compression(cells, reps, linear, graph.sample_edges(cells, reps, linear))


@_query("graph_matvec", f"WITH {_NESTED} SELECT hap_idx, CAST(SUM(length(v)) AS BIGINT) AS y FROM cells GROUP BY 1")
def graph_matvec(spark, sf):
    cells, _, reps, closed = _graph(spark, sf)
    linear = graph.linearize(closed)
    b = reps.select("block", "v", F.length("v").cast("long").alias("x"))
    return graph.graph_matvec(linear, graph.sample_edges(cells, reps, linear), reps, b)


@_query("graph_rmatvec", f"WITH {_NESTED} SELECT block, v, CAST(SUM(hap_idx % 11) AS BIGINT) AS x FROM cells GROUP BY 1, 2")
def graph_rmatvec(spark, sf):
    cells, _, reps, closed = _graph(spark, sf)
    linear = graph.linearize(closed)
    y = derive.haplotypes(spark, sf).select("hap_idx", (F.col("hap_idx") % 11).alias("y"))
    return graph.graph_rmatvec(linear, graph.sample_edges(cells, reps, linear), reps, y)


@_query("individual_nodes", f"WITH {_NESTED} SELECT block, iid, v, CAST(SUM(weight) AS BIGINT) AS weight FROM samples JOIN haps USING (hap_idx) GROUP BY 1, 2, 3 HAVING SUM(weight) <> 0")
def individual_nodes(spark, sf):
    cells, _, reps, closed = _graph(spark, sf)
    return graph.with_individuals(graph.sample_edges(cells, reps, graph.linearize(closed)), derive.haplotypes(spark, sf))


@_query("degree_counts", f"WITH {_NESTED} SELECT block, v, CAST(SUM(o) AS BIGINT) AS outdegree, CAST(SUM(i) AS BIGINT) AS indegree FROM (SELECT block, parent AS v, 1 AS o, 0 AS i FROM edges UNION ALL SELECT block, child, 0, 1 FROM edges) GROUP BY 1, 2")
def degree_counts(spark, sf):
    return graph.degrees(graph.reduction(_graph(spark, sf)[3]))


@_query("remove_degree_zero", f"WITH {_NESTED}, u AS (SELECT DISTINCT block, v FROM (SELECT block, parent AS v FROM edges UNION ALL SELECT block, child FROM edges)) SELECT block, v, CAST(row_number() OVER (PARTITION BY block ORDER BY v) - 1 AS INT) AS node FROM u")
def remove_degree_zero(spark, sf):
    _, _, reps, closed = _graph(spark, sf)
    return graph.without_isolated(reps.where("v = rep"), graph.reduction(closed))


@_query(
    "trio_cliques",
    f'WITH {_NESTED}, t AS (SELECT block, child, parent AS "left", lead(parent) OVER (PARTITION BY block, child ORDER BY parent) AS "right" FROM (SELECT block, CAST(hap_idx AS VARCHAR) AS child, v AS parent FROM cells)) SELECT block, "left", "right", COUNT(*) AS size FROM t WHERE "right" IS NOT NULL GROUP BY 1, 2, 3',
)
def trio_cliques(spark, sf):
    cells = derive.nested(spark, sf)
    return graph.trio_cliques(cells.select("block", F.col("hap_idx").cast("string").alias("child"), F.col("v").alias("parent")))


@_query("recombination", f"WITH {_NESTED} SELECT block, CAST(hap_idx AS VARCHAR) AS child, v AS parent, CAST(1 AS BIGINT) AS shared FROM cells")
def recombination(spark, sf):
    """Factored and expanded again: what every haplotype reaches must be what it carries, and no pair of neighbouring parents may be shared any more."""
    lists, variants = derive.nested_lists(spark, sf)
    lists = materialize(lists, "lists")
    factored = materialize(graph.factor_lists(lists.groupBy("block", "list").agg(F.count(F.lit(1)).alias("n"))), "factored")
    shared = graph.shared_pairs(factored).withColumnRenamed("size", "shared")
    reached = graph.expand_lists(factored, variants).join(F.broadcast(shared), "block", "left")
    rows = graph.by_list(lists, reached)
    return rows.select("block", F.col("hap_idx").cast("string").alias("child"), F.explode("parents").alias("parent"), F.coalesce("shared", F.lit(1).cast("long")).alias("shared"))
