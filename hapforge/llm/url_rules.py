"""URL filtering: listed rules first, mined association rules after.

A listed rule is a host and a path prefix; it fits that host and its subdomains, and the longest
rule that fits decides. Every other url is judged by rules that FP-growth mines from labelled urls:
combinations of url tokens, of any number, that go with the bad label. A rule needs a fixed number of
bad urls, whatever the size of the table; a confidence of so many times the share of bad urls among
all; and a lower bound of its confidence above that share, so that few urls don't make a rule by
chance. A rule goes if a part of it is at least as sure. They are matched through an inverted index from a
rule's rarest token, so a url looks at few rules.

Defined results: a null url, and one without ``://``, has an empty host and path and fits no listed
rule. Rows that repeat are judged each. Without labelled urls nothing is mined and the verdict is
allow. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Labelled bad urls that a rule's combination must occur in.
SUPPORT = 8
#: Times the share of bad urls that a rule's confidence must be, and standard errors by which it must exceed that share.
LIFT, ERRORS = 2.0, 2.0
BAD = "label=bad"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls. ``rules``: (verdict, host/path-prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host and the words of those with hyphens, segments of the path with digits folded, names in the query, and whether there is a fragment."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), p))
    segments = F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), "/")
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    words = F.flatten(F.transform(F.filter(F.split(host, "[.]"), lambda p: p.contains("-")), lambda p: F.split(p, "-")))
    return F.array_distinct(F.concat(tag("host=", F.split(host, "[.]")), tag("word=", words), tag("path=", segments), tag("query=", names)))


def lower_bound(share: Column, n: Column, errors: float) -> Column:
    """Wilson's lower bound of a share seen in n rows."""
    z = errors * errors
    return (share + z / (2 * n) - errors * F.sqrt((share * (1 - share) + z / (4 * n)) / n)) / (1 + z / n)


def mine(labelled: DataFrame, support: int = SUPPORT, lift: float = LIFT, errors: float = ERRORS) -> list[tuple[frozenset[str], float]]:
    """Rules (tokens, confidence) from (url, bad). Only rules that pass all bounds are collected."""
    from pyspark.ml.fpm import FPGrowth

    n, bad = labelled.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if bad < support:
        return []
    items = labelled.select(F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    fp = FPGrowth(itemsCol="items", minSupport=(support - 0.5) / n, minConfidence=min(1.0, lift * bad / n))
    sure = lower_bound(F.col("confidence"), F.round(F.col("support") * n / F.col("confidence")), errors)
    found = fp.fit(items).associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (sure > bad / n))
    rules = [(frozenset(r["antecedent"]), r["confidence"]) for r in found.select("antecedent", "confidence").collect()]
    known = dict(rules)
    part_of = lambda a: (a - {t} for t in a if len(a) > 1)
    return sorted(((a, c) for a, c in rules if not any(known.get(p, 0.0) >= c for p in part_of(a))), key=lambda r: (-r[1], sorted(r[0])))


def inverted(rules: list[tuple[frozenset[str], float]]) -> dict[str, list[frozenset[str]]]:
    """Each rule under its token that fewest rules have."""
    held: dict[str, int] = defaultdict(int)
    for tokens, _ in rules:
        for t in tokens:
            held[t] += 1
    index: dict[str, list[frozenset[str]]] = defaultdict(list)
    for tokens, _ in rules:
        index[min(tokens, key=lambda t: (held[t], t))].append(tokens)
    return dict(index)


def matches(tokens: Iterable[str], index: dict[str, list[frozenset[str]]]) -> bool:
    own = set(tokens)
    return any(rule <= own for t in own for rule in index.get(t, ()))


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: Iterable[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", support: int = SUPPORT, lift: float = LIFT, errors: float = ERRORS
) -> DataFrame:
    """page_id, host, path, rule, verdict of every url. ``labelled`` has url and bad (boolean)."""
    index = inverted(mine(labelled.where("bad IS NOT NULL"), support, lift, errors))
    sent = pages.sparkSession.sparkContext.broadcast(index)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "tokens")

    def run(batches):
        index = sent.value
        for batch in batches:
            said, tokens = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            out = [v or (BLOCK if matches(t or (), index) else ALLOW) for v, t in zip(said, tokens, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    if not index:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"))
    return rows.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
