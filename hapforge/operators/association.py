"""Association scans, scores, heritability and prediction.

Covariate algebra is p x p and solved on the driver; everything that has a row for each haplotype or
variant stays distributed. A scan is one join of the cells with the residual phenotypes and one
aggregation by variant with a sum for each trait, covariate and missingness pattern.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapforge.operators.dense import gram, orthonormal, times
from hapforge.operators.matrix import GenotypeMatrix
from hapforge.operators.variants import impute_means
from hapforge.shared import materialize

#: A denominator below this is a variant that doesn't vary within the sample.
FLAT = 1e-4
#: Relative cut-off of singular values in pseudo-inverses.
RCOND = 1e-5


def _number(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def with_intercept(table: DataFrame, name: str = "i0") -> DataFrame:
    return table.withColumn(name, F.lit(1.0))


def aligned(matrix: GenotypeMatrix, table: DataFrame, traits: list[str], covars: list[str]) -> DataFrame:
    """(hap_idx, iid, y_t, d_t, c_j) of haplotypes whose individual has a row; repeated rows multiply."""
    t = impute_means(table, covars).select(
        "iid", *[F.coalesce(_number(y), F.lit(0.0)).alias(f"y_{i}") for i, y in enumerate(traits)], *[_number(y).isNotNull().cast("double").alias(f"d_{i}") for i, y in enumerate(traits)],
        *[F.col(c).cast("double").alias(f"c_{j}") for j, c in enumerate(covars)],
    )
    return matrix.haps.select("hap_idx", "iid").join(t, "iid")


def residualize(rows: DataFrame, n_traits: int, n_covars: int) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """Adds r_t, the residual of y_t on the covariates over rows where it is known (0 elsewhere).

    Returns also (C'C) over all rows and, a trait, its number of known rows and its residual square sum.
    """
    p, ts, cs = n_covars, range(n_traits), range(n_covars)
    pairs = [(i, j) for i in cs for j in cs if i <= j]
    c = [F.col(f"c_{j}") for j in cs]
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(c[i] * c[j]).alias(f"a_{i}_{j}") for i, j in pairs]
    for t in ts:
        d, y = F.col(f"d_{t}"), F.col(f"y_{t}")
        sums += [F.sum(d).alias(f"n_{t}"), F.sum(d * y * y).alias(f"yy_{t}")]
        sums += [F.sum(d * c[i] * c[j]).alias(f"a{t}_{i}_{j}") for i, j in pairs] + [F.sum(d * c[i] * y).alias(f"b{t}_{i}") for i in cs]
    got = rows.agg(*sums).first()
    if not got["n"]:
        raise ValueError("no haplotype has a phenotype row")

    def gram(tag: str) -> np.ndarray:
        a = np.zeros((p, p))
        for i, j in pairs:
            a[i, j] = a[j, i] = got[f"{tag}_{i}_{j}"]
        return a

    out, facts = rows, []
    for t in ts:
        b = np.array([got[f"b{t}_{i}"] for i in cs])
        beta = np.linalg.pinv(gram(f"a{t}"), rcond=RCOND) @ b
        fitted = sum((F.lit(float(beta[i])) * c[i] for i in cs), F.lit(0.0))
        out = out.withColumn(f"r_{t}", F.col(f"d_{t}") * (F.col(f"y_{t}") - fitted))
        facts.append({"n": got[f"n_{t}"], "rss": max(0.0, got[f"yy_{t}"] - float(b @ beta))})
    return out, gram("a"), facts


def gwas(
    matrix: GenotypeMatrix, table: DataFrame, traits: list[str], covars: list[str], *, assume_hwe: bool = True, recompute_ac: bool = False, check_intercept: bool = True
) -> DataFrame:
    """variant_idx, a1freq[, a1_carrier_freq] and <trait>_beta, <trait>_se of every variant. The first covariate is the intercept."""
    if not assume_hwe:
        check_individuals(matrix)
    matrix = matrix.stored()
    rows = materialize(aligned(matrix, table, traits, covars), "aligned")
    if check_intercept:
        low, high = table.agg(F.min(F.col(covars[0]).cast("double")), F.max(F.col(covars[0]).cast("double"))).first()
        if low is None or abs(low - 1) > 1e-6 or abs(high - 1) > 1e-6:
            raise ValueError("the first covariate must be an intercept of ones")
    rows, ctc, facts = residualize(rows, len(traits), len(covars))
    inverse = np.linalg.pinv(ctc, rcond=RCOND)
    ts, cs = range(len(traits)), range(len(covars))
    values = [f"r_{t}" for t in ts] + [f"c_{j}" for j in cs] + ([f"d_{t}" for t in ts] if recompute_ac else [])
    summed = matrix.calls.join(rows, "hap_idx").groupBy("variant_idx").agg(F.count(F.lit(1)).cast("double").alias("k"), *[F.sum(v).alias(v) for v in values])
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values]).first()
    n_rows = totals["n"]
    # A flipped column is 1 - x: its sums are the totals less the stored sums.
    v = matrix.variants.select("variant_idx", "flip").join(summed, "variant_idx", "left").na.fill(0.0, ["k", *values])
    turn = lambda c, all_: F.when(F.col("flip"), F.lit(float(all_)) - F.col(c)).otherwise(F.col(c))
    v = v.select("variant_idx", turn("k", n_rows).alias("ac"), *[turn(x, totals[x] or 0.0).alias(x) for x in values])
    tve = sum((F.lit(float(inverse[i, j])) * F.col(f"c_{i}") * F.col(f"c_{j}") for i in cs for j in cs), F.lit(0.0))
    v = v.withColumn("tve", tve)
    freq = matrix.allele_counts().select("variant_idx", F.col("af").alias("a1freq"))
    v = v.join(freq, "variant_idx")
    if not assume_hwe:
        het = matrix.carrier_counts(table.select("iid")).select("variant_idx", "heterozygotes")
        v = v.join(het, "variant_idx").withColumn("hom", (F.col("ac") - F.col("heterozygotes")) / 2)
        v = v.withColumn("a1_carrier_freq", 2 * F.col("heterozygotes") / F.lit(float(matrix.n)))

    def denominator(t: int) -> Column:
        ac, q, extra = F.col("ac"), F.col("tve"), F.lit(0.0)
        if recompute_ac:
            # The rarer form keeps the ratio of counts away from rounding.
            common = F.col("ac") > n_rows / 2
            mine, known = F.col(f"d_{t}"), facts[t]["n"]
            whole = F.when(common, n_rows - F.col("ac")).otherwise(F.col("ac"))
            part = F.when(common, F.lit(float(known)) - mine).otherwise(mine)
            rare_q = F.when(common, F.lit(float(n_rows)) - 2 * F.col("ac") + F.col("tve")).otherwise(F.col("tve"))
            ac, q = part, rare_q * F.pow(part / F.when(whole > 0, whole), F.lit(2.0)) * (n_rows / known)
        if not assume_hwe:
            scale = ac / F.when(F.col("ac") > 0, F.col("ac")) if recompute_ac else F.lit(1.0)
            extra = 2 * F.col("hom") * scale - q
        return ac - q + extra

    out = [F.col("variant_idx"), F.col("a1freq")] + ([] if assume_hwe else [F.col("a1_carrier_freq")])
    for t, name in enumerate(traits):
        den = denominator(t)
        den = F.when(den >= FLAT, den)
        free = facts[t]["n"] - 2 * len(covars)
        out += [(F.col(f"r_{t}") / den).alias(f"{name}_beta"), F.sqrt(F.lit(facts[t]["rss"] / free if free > 0 else math.nan) / den).alias(f"{name}_se")]
    return v.select(*out)


def check_individuals(matrix: GenotypeMatrix) -> None:
    """Without Hardy-Weinberg, heterozygotes are counted: haplotypes must belong to individuals, two at most to each."""
    if "iid" not in matrix.haps.columns or matrix.ploidy != 1:
        raise ValueError("without assume_hwe the matrix must have haplotypes with individuals (iid), to count heterozygotes")
    odd = matrix.haps.groupBy("iid").agg(F.count(F.lit(1)).alias("n")).where("iid IS NULL OR n > 2").limit(1).collect()
    if odd:
        raise ValueError(f"without assume_hwe every individual has two haplotypes at most; {odd[0]['iid']!r} has {odd[0]['n']}")


def gwas_each(matrix: GenotypeMatrix, table: DataFrame, traits: list[str], covars: list[str], **how) -> DataFrame:
    """Each trait alone, over the individuals that have it; only its beta and se are kept."""
    out = matrix.variants.select("variant_idx")
    for t in traits:
        own = table.where(_number(t).isNotNull())
        out = out.join(gwas(matrix, own, [t], covars, **how).select("variant_idx", f"{t}_beta", f"{t}_se"), "variant_idx", "left")
    return out


def simple_gwas(matrix: GenotypeMatrix, table: DataFrame, trait: str) -> DataFrame:
    """(variant_idx, beta, se): least squares of a trait on each column with an intercept only; null where a column doesn't vary."""
    rows = matrix.haps.select("hap_idx", "iid").join(table.select("iid", _number(trait).alias("y")).where("y IS NOT NULL"), "iid")
    n, sy, syy = rows.agg(F.count(F.lit(1)), F.sum("y"), F.sum(F.col("y") * F.col("y"))).first()
    none = F.lit(None).cast("double")
    if n < matrix.ploidy + 2:
        return matrix.variants.select("variant_idx", none.alias("beta"), none.alias("se"))
    held = matrix.calls.join(rows, "hap_idx").groupBy("variant_idx").agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("y").alias("ky"))
    v = matrix.variants.select("variant_idx", "flip").join(held, "variant_idx", "left").na.fill(0.0, ["k", "ky"])
    # A flipped column is 1 - x: its sums are the totals less the stored sums.
    v = v.select("variant_idx", F.when(F.col("flip"), n - F.col("k")).otherwise(F.col("k")).alias("ac"), F.when(F.col("flip"), sy - F.col("ky")).otherwise(F.col("ky")).alias("xy"))
    var = F.col("ac") - F.col("ac") * F.col("ac") / n
    varies = F.when(var > 1e-6, var)
    beta = (F.col("xy") - F.col("ac") * (sy / n)) / varies
    rss = F.greatest(F.lit(syy - sy * sy / n) - beta * beta * var, F.lit(0.0))
    return v.select("variant_idx", beta.alias("beta"), F.sqrt(rss / (n - matrix.ploidy - 1) / varies).alias("se"))


# --- scores -----------------------------------------------------------------------------------


def polygenic_scores(matrix: GenotypeMatrix, effects: DataFrame, columns: list[str]) -> DataFrame:
    """(iid, columns): effects (id, columns) of known variants, summed over both haplotypes; unknown ids are ignored and missing ones count as 0."""
    beta = matrix.variants.select("variant_idx", "id").join(effects, "id", "left").select("variant_idx", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return matrix.diploid(matrix.matmat(beta, columns), columns)


def simulate_phenotype(matrix: GenotypeMatrix, heritability: float, fraction_causal: float = 1.0, seed: int = 1) -> DataFrame:
    """(iid, genetic, y): normal effects on a random part of the variants, and noise, scaled to the heritability.

    Effects and noise come from hashes of the identifiers, so a lost task draws the same again.
    """
    beta = matrix.variants.select("variant_idx", (hashed_normal(F.col("variant_idx").cast("string"), seed) * (hashed_uniform(F.col("variant_idx").cast("string"), seed + 1) < fraction_causal).cast("double")).alias("g"))
    g = matrix.diploid(matrix.matmat(beta, ["g"]), ["g"])
    mean, sd = g.agg(F.avg("g"), F.stddev_pop("g")).first()
    if not sd:
        raise ValueError("the genetic values don't vary")
    genetic = (F.col("g") - F.lit(mean)) * F.lit(math.sqrt(heritability) / sd)
    return g.select("iid", genetic.alias("genetic"), (genetic + hashed_normal(F.col("iid"), seed + 2) * F.lit(math.sqrt(1 - heritability))).alias("y"))


def hashed_uniform(key: Column, seed: int) -> Column:
    """In (0, 1), the same for the same key and seed: 52 bits of an md5, so any engine can draw the same."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def hashed_normal(key: Column, seed: int) -> Column:
    """Box-Muller over two hashed uniforms."""
    return F.sqrt(-2 * F.log(hashed_uniform(key, seed * 2 + 1_000_003))) * F.cos(2 * math.pi * hashed_uniform(key, seed * 2 + 1_000_004))


# --- heritability -----------------------------------------------------------------------------

SAMPLERS = {"normal": "normal", "gaussian": "normal", "sphere": "sphere", "standardized": "sphere", "rademacher": "rademacher", "signed": "rademacher"}


def probes(rows: DataFrame, k: int, sampler: str = "normal", seed: int = 1) -> DataFrame:
    """(iid, x_0 ... x_k-1): random probes, one value a row, drawn by hashing the identifier."""
    kind = SAMPLERS.get(sampler)
    if kind is None:
        raise ValueError(f"unknown sampler {sampler!r}; known: {', '.join(SAMPLERS)}")
    draw = (lambda i: F.when(hashed_uniform(F.col("iid"), seed + 7919 * i) < 0.5, -1.0).otherwise(1.0)) if kind == "rademacher" else (lambda i: hashed_normal(F.col("iid"), seed + 7919 * i))
    out = rows.select("iid", *[draw(i).alias(f"x_{i}") for i in range(k)])
    if kind != "sphere":
        return out
    norms = out.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"x_{i}") * F.col(f"x_{i}")).alias(f"s_{i}") for i in range(k)]).first()
    return out.select("iid", *[(F.col(f"x_{i}") * F.lit(math.sqrt(norms["n"] / norms[f"s_{i}"]))).alias(f"x_{i}") for i in range(k)])


class Kinship:
    """K = 1/2 L Z Z' L' over individuals, without the covariates: K acts on (iid, values...)."""

    def __init__(self, matrix: GenotypeMatrix, table: DataFrame, covars: list[str], alpha: float = -1.0):
        self.matrix, self.alpha, self.covars = matrix.stored(), alpha, covars
        t = impute_means(table, covars).select("iid", *[F.col(c).cast("double").alias(f"c_{j}") for j, c in enumerate(covars)])
        self.people = materialize(t, "people")
        n, known = self.people.count(), self.matrix.haps.groupBy("iid").agg(F.count(F.lit(1)).alias("h"))
        bad = self.people.groupBy("iid").agg(F.count(F.lit(1)).alias("n")).join(known, "iid", "left").where("n > 1 OR coalesce(h, 0) NOT IN (0, 2)")
        if not bad.isEmpty():
            raise ValueError("every row must match no or two haplotypes, and every haplotype one row at most")
        self.n = n
        p = range(len(covars))
        sums = self.people.agg(*[F.sum(F.col(f"c_{i}") * F.col(f"c_{j}")).alias(f"a_{i}_{j}") for i in p for j in p]).first()
        self.inverse = np.linalg.pinv(np.array([[sums[f"a_{i}_{j}"] for j in p] for i in p]), rcond=RCOND)

    def project(self, x: DataFrame, values: list[str]) -> DataFrame:
        """Remove what the covariates explain."""
        p = range(len(self.covars))
        rows = self.people.join(x, "iid")
        sums = rows.agg(*[F.sum(F.col(f"c_{j}") * F.col(v)).alias(f"{v}__{j}") for v in values for j in p]).first()
        coef = {v: self.inverse @ np.array([sums[f"{v}__{j}"] or 0.0 for j in p]) for v in values}
        return rows.select("iid", *[(F.col(v) - sum((F.lit(float(coef[v][j])) * F.col(f"c_{j}") for j in p), F.lit(0.0))).alias(v) for v in values])

    def apply(self, x: DataFrame, values: list[str], name: str = "kinship") -> DataFrame:
        """K x; the product is written to the shared folder before the covariates are taken out of it."""
        haps = self.matrix.haps.select("hap_idx", "iid").join(x, "iid").select("hap_idx", *values)
        moved = self.matrix.diploid(self.matrix.grm_matmat(haps, values, self.alpha), values)
        half = moved.select("iid", *[(F.col(v) / 2).alias(v) for v in values])
        filled = self.people.select("iid").join(half, "iid", "left").na.fill(0.0, values)
        return self.project(materialize(filled, name), values)

    def dots(self, a: DataFrame, b: DataFrame, values: list[str]) -> np.ndarray:
        """Sum over individuals of a_v b_v, a value."""
        joined = a.select("iid", *[F.col(v).alias(f"{v}__a") for v in values]).join(b, "iid")
        got = joined.agg(*[F.sum(F.col(f"{v}__a") * F.col(v)).alias(v) for v in values]).first()
        return np.array([got[v] or 0.0 for v in values])

    def without(self, x: DataFrame, values: list[str], basis: DataFrame, q: list[str]) -> DataFrame:
        """x less its part in the span of an orthonormal basis."""
        joined = materialize(x.join(basis, "iid"), "joined")
        return times(joined, "iid", [*values, *q], np.vstack([np.eye(len(values)), -gram(joined, q, values)]), values)


def check_matvecs(k: int, n: int, estimator: str) -> None:
    least = {"hutch++": 3, "xnystrace": 2}.get(estimator, 1)
    if not isinstance(k, int) or isinstance(k, bool) or not least <= k <= n:
        raise ValueError(f"{estimator} needs a whole number of products from {least} to {n}, not {k!r}")


def traces(kin: Kinship, k: int, estimator: str = "hutchinson", sampler: str = "normal", seed: int = 1) -> tuple[float, float]:
    """Estimates of tr K and tr K^2 from k products with K. Only matrices of probes by probes reach the driver."""
    check_matvecs(k, kin.n, estimator)

    def drawn(n: int, seed: int) -> tuple[list[str], DataFrame]:
        names = [f"x_{i}" for i in range(n)]
        return names, materialize(kin.project(probes(kin.people.select("iid"), n, sampler, seed), names), "probes")

    if estimator == "hutchinson":
        names, x = drawn(k, seed)
        kx = materialize(kin.apply(x, names), "products")
        return float(kin.dots(x, kx, names).sum() / k), float(kin.dots(kx, kx, names).sum() / k)
    if estimator == "hutch++":
        # The span of a third of the products is traced exactly, what is left of K by the rest.
        m = k // 3
        names, s = drawn(m, seed)
        basis, q, _ = orthonormal(materialize(kin.apply(s, names), "products"), "iid", names)
        basis = materialize(basis, "basis")
        kq = materialize(kin.apply(basis, q), "products")
        names, g = drawn(m, seed + 104_729)
        g = materialize(kin.without(g, names, basis, q), "probes")
        kg = materialize(kin.apply(g, names), "products")
        t1 = kin.dots(basis, kq, q).sum() + kin.dots(g, kg, names).sum() / m
        return float(t1), float(kin.dots(kq, kq, q).sum() + kin.dots(kg, kg, names).sum() / m)
    if estimator == "xnystrace":
        names, om = drawn(k, seed)
        y = kin.apply(om, names).select("iid", *[F.col(v).alias(f"k{v}") for v in names])
        both = materialize(om.join(y, "iid"), "products")
        ys = [f"k{v}" for v in names]
        got = gram(both, [*names, *ys], ys)
        return nystrom_traces(got[:k], got[k:])
    raise ValueError(f"unknown estimator {estimator!r}; known: hutchinson, hutch++, xnystrace")


def nystrom_traces(h: np.ndarray, g: np.ndarray, cut: float = 1e-10) -> tuple[float, float]:
    """tr K and tr K^2 from H = O'KO and G = (KO)'KO for probes O: each probe weighs what the others leave out.

    With S = KO H^-1 and c_i = (H^-1)_ii, the Nystroem approximation from all probes but the i-th is
    N - s_i s_i' / c_i, where N = KO H^-1 (KO)'. As N O = KO, the i-th probe sees K o_i = y_i and the
    approximation y_i - s_i / c_i, so every term comes from H and G. If K has fewer directions than
    there are probes, N is K.
    """
    h = (h + h.T) / 2
    w, v = np.linalg.eigh(h)
    if w[-1] <= 0:
        return 0.0, 0.0
    kept = w > cut * w[-1]
    inverse = (v[:, kept] / w[kept]) @ v[:, kept].T
    p = inverse @ g
    whole, square = float(np.trace(p)), float(np.sum(p * p.T))
    if not kept.all():
        return whole, square
    s = p @ inverse
    c, ss, ys, sns = np.diag(inverse), np.diag(s), np.diag(p), np.diag(p @ s)
    t1 = whole + np.mean((1 - ss) / c)
    t2 = square + np.mean((ss**2 / c - 2 * sns) / c + (2 * ys - ss / c) / c)
    return float(t1), float(t2)


def haseman_elston(
    matrix: GenotypeMatrix, table: DataFrame, traits: list[str], covars: list[str], *, num_matvecs: int = 20, estimator: str = "hutchinson", sampler: str = "normal", seed: int = 1,
    alpha: float = -1.0, exact: tuple[float, float] | None = None,
) -> DataFrame:
    """phenotype, s2g, s2g_se, s2e, s2e_se, h2g, h2g_se from the two moment equations of K and the identity."""
    kin = Kinship(matrix, table, covars, alpha)
    t1, t2 = exact or traces(kin, num_matvecs, estimator, sampler, seed)
    n = kin.n
    ys = [f"y_{i}" for i in range(len(traits))]
    y = table.select("iid", *[F.coalesce(_number(t), F.lit(0.0)).alias(v) for v, t in zip(ys, traits, strict=True)])
    known = table.agg(*[F.count(_number(t)).alias(v) for v, t in zip(ys, traits, strict=True)]).first()
    y = kin.project(y, ys)
    norm = kin.dots(y, y, ys)
    y = materialize(y.select("iid", *[(F.col(v) * F.lit(math.sqrt(known[v] / s) if s > 0 else 0.0)).alias(v) for v, s in zip(ys, norm, strict=True)]), "traits")
    ky = materialize(kin.apply(y, ys), "products")
    # Powers of K between the traits: y'y, y'Ky, y'KKy, y'KKKy.
    kky = kin.apply(ky, ys)
    forms = zip(kin.dots(y, y, ys), kin.dots(y, ky, ys), kin.dots(ky, ky, ys), kin.dots(ky, kky, ys), strict=True)
    det = n * t2 - t1 * t1
    rows = []
    for t, (q0, q1, q2, q3) in zip(traits, forms, strict=True):
        a, b = (n * q1 - t1 * q0) / det, (t2 * q0 - t1 * q1) / det
        # U = y'(nK - tr K)y and W = y'y under V = aK + bI: their variances and covariance give those of a and b.
        u = 2 * (a * (n * n * q3 - 2 * n * t1 * q2 + t1 * t1 * q1) + b * (n * n * q2 - 2 * n * t1 * q1 + t1 * t1 * q0))
        uw = 2 * (n * (a * q2 + b * q1) - t1 * (a * q1 + b * q0))
        w = 2 * (a * a * t2 + 2 * a * b * t1 + b * b * n)
        va = (u + a * a * t2 / num_matvecs) / det**2
        vb = t1 * t1 * u / (n * det) ** 2 + w / n**2 - 2 * t1 * uw / (n * n * det)
        cab = uw / (det * n) - t1 * u / (n * det**2)
        s2g, s2e = a * t1, b * q0
        vg, ve, cge = t1 * t1 * va, q0 * q0 * vb, t1 * q0 * cab
        total = s2g + s2e
        vh = (s2e**2 * vg + s2g**2 * ve - 2 * s2g * s2e * cge) / total**4 if total else math.nan
        root = lambda x: float(math.sqrt(x)) if x >= 0 else math.nan
        rows.append((t, float(s2g), root(vg), float(s2e), root(ve), float(s2g / total) if total else math.nan, root(vh)))
    return matrix.calls.sparkSession.createDataFrame(rows, "phenotype string, s2g double, s2g_se double, s2e double, s2e_se double, h2g double, h2g_se double")


def blup(matrix: GenotypeMatrix, table: DataFrame, trait: str, heritability: float, *, steps: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """(iid, prediction): K (K + s I)^-1 y by conjugate gradients; one product with K a step, K scaled to a mean diagonal of one.

    It ends when the squared residual has fallen by ``tolerance``; RuntimeError if that takes more than ``steps``.
    """
    kin = Kinship(matrix, with_intercept(table.select("iid", trait)), ["i0"])
    t1 = trace_of_kinship(kin.matrix)
    ratio = (1 - heritability) / max(heritability, 1e-12)
    y = materialize(kin.project(table.select("iid", F.coalesce(_number(trait), F.lit(0.0)).alias("v")), ["v"]), "blup-y")
    scale = kin.n / t1 if t1 else 1.0
    zero = F.lit(0.0)
    # x solves the system, kx is K x scaled, r the residual, p the direction.
    state = y.select("iid", zero.alias("x"), zero.alias("kx"), F.col("v").alias("r"), F.col("v").alias("p"))
    rr = first = float(kin.dots(y, y, ["v"])[0])
    for _ in range(steps):
        if rr <= tolerance * first:
            break
        kp = kin.apply(state.select("iid", F.col("p").alias("v")), ["v"], "blup").select("iid", (F.lit(scale) * F.col("v")).alias("kp"))
        ap = materialize(state.join(kp, "iid").withColumn("ap", F.col("kp") + F.lit(ratio) * F.col("p")), "blup-state")
        pap, rap, aap = ap.agg(F.sum(F.col("p") * F.col("ap")), F.sum(F.col("r") * F.col("ap")), F.sum(F.col("ap") * F.col("ap"))).first()
        step = rr / pap
        new = max(rr - 2 * step * rap + step * step * aap, 0.0)
        r = F.col("r") - F.lit(step) * F.col("ap")
        state = ap.select("iid", (F.col("x") + F.lit(step) * F.col("p")).alias("x"), (F.col("kx") + F.lit(step) * F.col("kp")).alias("kx"), r.alias("r"), (r + F.lit(new / rr) * F.col("p")).alias("p"))
        rr = new
    if rr > tolerance * first:
        raise RuntimeError(f"conjugate gradients left {rr / first:.1e} of the squared residual after {steps} steps")
    return state.select("iid", F.col("kx").alias("prediction"))


def _varying(matrix: GenotypeMatrix) -> DataFrame:
    """(variant_idx, f) of variants that vary: the frequency of what is stored, which a flip turns round."""
    f = F.when(F.col("flip"), 1 - F.col("af")).otherwise(F.col("af"))
    return matrix.allele_counts().where("af > 0 AND af < 1").select("variant_idx", f.alias("f"))


def trace_of_kinship(matrix: GenotypeMatrix) -> float:
    """tr K of 1/2 L Z Z' L' over individuals with two haplotypes: one sum over the doses, no pairs."""
    people = matrix.iids().count()
    sums = matrix.doses().groupBy("variant_idx").agg(F.sum(F.col("dose") * F.col("dose")).alias("square"), F.sum("dose").alias("one"))
    f = F.col("f")
    part = (F.coalesce("square", F.lit(0)) - 4 * f * F.coalesce("one", F.lit(0)) + 4 * people * f * f) / (f * (1 - f))
    return (_varying(matrix).join(sums, "variant_idx", "left").agg(F.sum(part)).first()[0] or 0.0) / 2


def exact_traces(matrix: GenotypeMatrix) -> tuple[float, float]:
    """tr K and tr K^2 of 1/2 L Z Z' L' over individuals, from pair sums of variants (K isn't formed).

    With individual sums s_u of column u: tr K = 1/2 sum_u |s_u|^2 and tr K^2 = 1/4 sum_uv (s_u's_v)^2.
    Pairs that no individual shares have a closed form, so only co-occurring pairs are joined. That
    is as much as LD takes; ``traces`` estimates both without pairs.
    """
    matrix = matrix.stored()
    f = _varying(matrix)
    people = matrix.iids().count()
    g = matrix.doses().join(f.select("variant_idx"), "variant_idx", "left_semi")
    a, b = g.select("iid", F.col("variant_idx").alias("u"), F.col("dose").alias("gu")), g.select("iid", F.col("variant_idx").alias("v"), F.col("dose").alias("gv"))
    met = a.join(b, "iid").groupBy("u", "v").agg(F.sum(F.col("gu") * F.col("gv")).alias("dot"))
    fu, fv = f.toDF("u", "fu"), f.toDF("v", "fv")
    mean = 4.0 * people * F.col("fu") * F.col("fv")
    spread = F.col("fu") * (1 - F.col("fu")) * F.col("fv") * (1 - F.col("fv"))
    met = met.join(fu, "u").join(fv, "v").select("u", "v", ((F.col("dot") - mean) / F.sqrt(spread)).alias("w"), (mean / F.sqrt(spread)).alias("m"))
    square = met.agg(F.sum(F.col("w") * F.col("w") - F.col("m") * F.col("m"))).first()[0] or 0.0
    # Over all pairs, the sum of m^2 factorises: m = 4 N sqrt(fu/(1-fu)) sqrt(fv/(1-fv)).
    s = f.agg(F.sum(F.col("f") / (1 - F.col("f")))).first()[0] or 0.0
    return trace_of_kinship(matrix), (square + (4.0 * people * s) ** 2) / 4
