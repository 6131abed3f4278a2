"""Mixing sources to target weights by temperature.

A source with share p of all tokens gets the weight p^t / sum(p^t). The exponent t in [0, 1] is
bisected: it is the largest for which the weights still reach a wanted entropy (in nats), or the
smallest for which no source is repeated more often than a limit. The weights become token budgets,
and the budgets become block permutations: a source's documents are hashed into blocks, every epoch
permutes the blocks and the documents in each block by keyed digests, whole epochs draw everything
and the last epoch draws blocks, then documents of the block at the edge, while the budget lasts.

A source's blocks are ordered in 256 cells by the first byte of their keys, so no task holds all
blocks of a source, however large; no task orders more documents than a block has.

Only DataFrame functions are used. The sources are never collected: each job of the bisection
returns the sums of fifteen exponents, which is four halvings.

Defined results: a null text has no tokens; documents without tokens are drawn whenever their place
comes up. A null source is a source of its own. Rows that share identifier and source are drawn
together. If no source has tokens, every document is drawn once. Columns other than those named are
not read by ``draw``, and ``mix`` returns the columns it was given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hapforge.shared import materialize, temporary

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a block, on average.
BLOCK_ROWS = 512
#: Halvings of the exponent's interval.
HALVINGS = 24
SEED = "mix-1"


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_shares(units: DataFrame) -> DataFrame:
    """(src, tokens, docs) of each source."""
    return units.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def bisect_exponent(shares: DataFrame, target_entropy: float | None, repeat_limit: float | None, budget: int | None) -> tuple[float, float, float]:
    """(exponent, sum of p^t at it, largest share). ``budget`` None: as many tokens as give the largest source one epoch."""
    live = shares.where("tokens > 0")
    total, least, most = live.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total:
        return 1.0, 1.0, 1.0
    share = F.col("tokens") / F.lit(float(total))

    def sums(ts: list[float]) -> list[tuple[float, float]]:
        cols = [c for t in ts for c in (F.sum(F.pow(share, F.lit(t))), F.sum(F.pow(share, F.lit(t)) * F.log(share)))]
        row = live.agg(*cols).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(ts))]

    def flat_enough(t: float, z: float, zl: float) -> bool:
        """True where t may grow: the entropy is still reached, or the limit is still broken."""
        if target_entropy is not None:
            return math.log(z) - t * zl / z >= target_entropy
        factor = budget / total / z if budget is not None else (most / total) ** (1.0 - t)
        return factor * (least / total) ** (t - 1.0) > (repeat_limit or math.inf)

    lo, hi = 0.0, 1.0
    for _ in range(HALVINGS // 4):
        points = [lo + (hi - lo) * i / 16 for i in range(1, 16)]
        at = dict(zip(points, sums(points), strict=True))
        for _ in range(4):
            mid = points[len(points) // 2]
            if flat_enough(mid, *at[mid]):
                lo, points = mid, points[len(points) // 2 + 1 :]
            else:
                hi, points = mid, points[: len(points) // 2]
    t = lo if target_entropy is not None else hi
    return t, sums([t])[0][0], most / total


def _hex(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def draw(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *,
    target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None, budget_share: float | None = None, block_rows: int = BLOCK_ROWS, seed: str = SEED,
) -> DataFrame:
    """One row per drawn document: doc_id, source, n_tokens, epoch, block_rank, place.

    ``budget`` counts tokens, ``budget_share`` is a multiple of the corpus; neither: the source with
    the largest share gets exactly one epoch and every other at least one, so nothing is lost.
    """
    units = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("n_tokens"))
    units = units.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    units = materialize(units.withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))), "mix-units")
    shares = materialize(source_shares(units), "mix-shares")
    if budget_share is not None:
        budget = int(round(budget_share * (shares.agg(F.sum("tokens")).first()[0] or 0)))
    t, z, largest = bisect_exponent(shares, target_entropy, repeat_limit, budget)
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(total or 1))
    epochs = F.lit(budget / total / z) * F.pow(share, F.lit(t - 1.0)) if budget is not None and total else F.pow(share / F.lit(largest), F.lit(t - 1.0))
    plan = shares.select(
        "src", "tokens", F.greatest(F.lit(1), F.floor(F.col("docs") / block_rows)).cast("long").alias("blocks"),
        F.when(F.col("tokens") > 0, F.round(epochs, 6)).otherwise(F.lit(1.0)).alias("epochs"),
    )
    plan = plan.select("src", "blocks", F.floor("epochs").cast("long").alias("whole"), F.floor((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).cast("long").alias("rest"))
    spread = F.conv(F.substring(_hex(seed, F.col("doc_id"), F.col("src")), 1, 8), 16, 10).cast("long")
    rows = units.join(plan, "src").withColumn("block", spread % F.col("blocks"))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1))).alias("epoch")
    some = (F.col("whole") > 0) | (F.col("rest") > 0)
    blocks = rows.groupBy("src", "block", "whole", "rest").agg(F.sum("n_tokens").alias("tokens")).where(some).select("*", every)
    blocks = blocks.withColumn("key", _hex(seed, F.col("epoch"), F.col("src"), F.col("block"))).withColumn("cell", F.substring("key", 1, 2))
    blocks = materialize(blocks, "mix-blocks")
    by_cell = Window.partitionBy("src", "epoch").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = blocks.groupBy("src", "epoch", "cell").agg(F.sum("tokens").alias("cell_tokens"), F.count(F.lit(1)).alias("cell_blocks"))
    cells = cells.select("src", "epoch", "cell", F.coalesce(F.sum("cell_tokens").over(by_cell), F.lit(0)).alias("t0"), F.coalesce(F.sum("cell_blocks").over(by_cell), F.lit(0)).alias("b0"))
    in_cell = Window.partitionBy("src", "epoch", "cell").orderBy("key", "block")
    placed = blocks.join(cells, ["src", "epoch", "cell"]).select(
        "src", "epoch", "block",
        (F.col("b0") + F.row_number().over(in_cell) - 1).alias("block_rank"),
        F.when(F.col("epoch") < F.col("whole"), F.lit(None)).otherwise(F.col("rest") - F.col("t0") - F.coalesce(F.sum("tokens").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left"),
    ).where("left IS NULL OR left > 0")
    in_block = Window.partitionBy("src", "block", "epoch").orderBy(F.col("order"), F.col("doc_id"))
    drawn = rows.select("doc_id", "source", "src", "block", "n_tokens").join(placed, ["src", "block"])
    drawn = drawn.withColumn("order", _hex(seed, F.col("epoch"), F.col("doc_id"), F.col("src")))
    drawn = drawn.select("*", F.row_number().over(in_block).cast("long").alias("place"), F.sum("n_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return drawn.where("left IS NULL OR run <= left").select("doc_id", "source", "n_tokens", "epoch", "block_rank", "place")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every row as often as it is drawn, in the columns it came with."""
    with temporary(docs.sparkSession) as scratch:
        times = draw(docs, id_col, source_col, text_col, **how).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("__times"))
        times = materialize(times.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "__times"), "mix-times")
        scratch.keep(times)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    names = docs.columns
    return docs.join(times, same).select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")
