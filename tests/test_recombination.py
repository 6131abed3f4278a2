import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

import __spark_entry__ as entry
from hapforge.operators import graph
from hapforge.plans import derive

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
import compare

TABLES = {"customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey"]}


def copies(folder, k):
    """The tables of sf0.001 k times with shifted keys; some quantities are missing or below every threshold."""
    for t, keys in TABLES.items():
        shifted = ", ".join(f"{x} + i * 1000000 AS {x}" for x in keys)
        odd = ", CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 0.5 ELSE l_quantity END AS l_quantity" if t == "lineitem" else ""
        duckdb.sql(f"COPY (SELECT * REPLACE ({shifted}{odd}) FROM '/root/testdata/sf0.001/{t}.parquet', (SELECT range AS i FROM range({k}))) TO '{folder}/{t}.parquet'")
    return str(folder)


def test_copies_of_haplotypes_add_no_rows_to_a_block_s_task(spark, tmp_path, monkeypatch):
    got_rows = []

    def watched(cls, name, frame):
        f = getattr(cls, name)
        monkeypatch.setattr(cls, name, lambda self, *a, **b: (got_rows.append(frame(self).count()), f(self, *a, **b))[1])

    for name in ("applyInPandas", "applyInArrow"):
        watched(PandasGroupedOpsMixin, name, lambda g: g._df)
        watched(PandasCogroupedOps, name, lambda g: g._gd1._df)
    seen = []
    for k in (1, 8):
        (tmp_path / str(k)).mkdir()
        folder = copies(tmp_path / str(k), k)
        got_rows.clear()
        got = entry.queries()["recombination"](spark, folder).toPandas()
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        want = con.sql(entry.oracle_sql()["recombination"]).df()
        assert sorted(got.columns) == sorted(want.columns) and compare.canonical(got) == compare.canonical(want)
        seen.append((got_rows[0], len(got)))
    assert seen[1][1] == 8 * seen[0][1] and seen[1][0] == seen[0][0]


def test_nested_lists_hold_the_nested_cells(spark, tmp_path):
    folder = copies(tmp_path, 1)
    lists, variants = derive.nested_lists(spark, folder)
    assert lists.where("list <> array_sort(array_distinct(list))").isEmpty()
    cells = lists.select("block", "hap_idx", F.explode("list").alias("code")).join(variants, ["block", "code"]).select("block", "v", "hap_idx")
    nested = derive.nested(spark, folder)
    assert cells.exceptAll(nested).isEmpty() and nested.exceptAll(cells).isEmpty()


def plain(lists, weights, least):
    """The greedy rule as it reads: the heaviest pair, of equal ones the least, until none has ``least``."""
    lists, made, base = [list(x) for x in lists], [], 1 + max((max(x, default=-1) for x in lists), default=-1)
    while True:
        size = Counter()
        for x, n in zip(lists, weights, strict=True):
            for pair in zip(x, x[1:], strict=False):
                size[pair] += int(n)
        best = min(size.items(), key=lambda s: (-s[1], s[0]), default=None)
        if best is None or best[1] < least:
            return made, lists, base
        for x in lists:
            for i in range(len(x) - 1):
                if (x[i], x[i + 1]) == best[0]:
                    x[i : i + 2] = [base + len(made)]
                    break
        made.append(best[0])


@pytest.mark.parametrize("seed", range(12))
def test_factoring_follows_the_greedy_rule(seed):
    rng = np.random.default_rng(seed)
    lists = sorted({tuple(np.flatnonzero(rng.random(14) < rng.uniform(0.1, 0.9)).tolist()) for _ in range(30)})
    weights, least = rng.integers(1, 4, len(lists)), 2 + seed % 2
    flat, lengths = np.array([c for x in lists for c in x], np.int32), np.array([len(x) for x in lists])
    left, right, kept, ids = graph._factor(lengths, flat, weights, least)
    made, want, base = plain(lists, weights, least)
    number = lambda x: x if x >= 0 else base - 1 - x
    assert [(number(a), number(b)) for a, b in zip(left.tolist(), right.tolist(), strict=True)] == made
    assert kept.tolist() == [len(x) for x in want] and [number(x) for x in ids.tolist()] == [y for x in want for y in x]
    again, codes = graph._expand(left, right, kept, ids)
    assert again.tolist() == lengths.tolist() and codes.tolist() == flat.tolist()


def test_factored_edges_reach_what_they_did(spark):
    rng = np.random.default_rng(5)
    names = ["q1", "q10", "q100", "q2", "x", "xa", "xb", "xb "]  # some begin with another
    rows = [(b, f"c{i}", v) for b in ("1", "2") for i in range(12) for v in rng.permutation(names)[: rng.integers(1, 8)].tolist()]
    rows += [("3", "alone", "x")]  # nothing to factor
    edges = spark.createDataFrame(rows + rows[:5], "block string, child string, parent string")
    got = {tuple(r) for r in graph.factor_recombinations(edges).collect()}
    below = {}
    for b, c, p in got:
        below.setdefault((b, c), []).append(p)
    leaves = lambda b, v: {v} if (b, v) not in below else set().union(*(leaves(b, p) for p in below[b, v]))
    reached = {(b, c, v) for b, c in below if "~r" not in c for v in leaves(b, c)}
    assert reached == set(rows) and len(got) < len(rows)
    made = {(b, c) for b, c in below if "~r" in c}
    assert made and all(len(below[x]) == 2 for x in made)
    assert ("3", "alone", "x") in got
    shared = Counter()
    for (b, c), ps in below.items():
        ps = sorted(ps, key=lambda p, b=b: min(leaves(b, p)))
        shared.update((b, *pair) for pair in zip(ps, ps[1:], strict=False))
    assert max(shared.values()) == 1


def test_shared_pairs_counts_children(spark):
    factored = spark.createDataFrame([("1", [0, 1, 2], 3, None, [0, 1, 2]), ("1", [0, 1], 2, None, [0, 1]), ("1", None, None, -1, [1, 2]), ("2", [0], 9, None, [0])], graph._FACTORED)
    assert {tuple(r) for r in graph.shared_pairs(factored).collect()} == {("1", 5)}
