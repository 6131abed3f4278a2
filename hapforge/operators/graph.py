"""The compressed form of a block: a weighted graph whose path sums give back the matrix.

Within a block, variants whose carriers are contained in another's stand below it. With R the 0/1
relation "contained in or equal" between distinct carrier sets, the weights A = I - R^-1 satisfy
(I - A)^-1 = R. A haplotype's edges are its row of X (I - A), so X = S (I - A)^-1 M with usually fewer
entries than X. R^-1 is the Möbius function of the order: an alternating count of chains, which joins
can count one length at a time.

Relations: cells (block, v, hap_idx); graphs are edges (block, child, parent[, weight]). All joins are
on the block as well, so work is spread over blocks and inside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hapforge.shared import materialize


def carrier_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("block", "v").agg(F.count(F.lit(1)).alias("n"))


def containment(cells: DataFrame) -> DataFrame:
    """(block, child, parent, n_child, n_parent): carriers of the child are among the parent's, child <> parent.

    A parent has every carrier of the child, so only variants of one of them can be parents: those of
    the child's carrier with the fewest variants, if they have as many carriers as the child and are
    also on its carrier with the most. Only these candidates are compared carrier by carrier.
    """
    load = cells.groupBy("block", "hap_idx").agg(F.count(F.lit(1)).alias("load"))
    known = materialize(cells.join(load, ["block", "hap_idx"]).join(carrier_counts(cells), ["block", "v"]), "carriers")
    ends = known.groupBy("block", F.col("v").alias("child")).agg(
        F.min(F.struct("load", "hap_idx")).alias("least"), F.max(F.struct("load", "hap_idx")).alias("most"), F.max("n").alias("n_child")
    )
    ends = ends.select("block", "child", "n_child", F.col("least.hap_idx").alias("hap_idx"), F.col("most.hap_idx").alias("other"))
    parents = known.select("block", "hap_idx", F.col("v").alias("parent"), F.col("n").alias("n_parent"))
    found = ends.join(parents, ["block", "hap_idx"]).where("child <> parent AND n_child <= n_parent").drop("hap_idx")
    also = parents.select("block", F.col("hap_idx").alias("other"), "parent")
    found = materialize(found.join(also, ["block", "other", "parent"], "left_semi").drop("other"), "candidates")
    # One or two carriers have been seen already.
    seen, rest = found.where("n_child <= 2"), found.where("n_child > 2")
    met = rest.join(known.select("block", F.col("v").alias("child"), "hap_idx"), ["block", "child"])
    met = met.join(parents.drop("n_parent"), ["block", "hap_idx", "parent"], "left_semi")
    held = met.groupBy("block", "child", "parent", "n_child", "n_parent").agg(F.count(F.lit(1)).alias("k")).where("k = n_child").drop("k")
    names = ["block", "child", "parent", "n_child", "n_parent"]
    return seen.select(names).unionByName(held.select(names))


def representatives(cells: DataFrame, contained: DataFrame) -> DataFrame:
    """(block, v, rep): the least variant with the same carriers."""
    same = contained.where("n_child = n_parent").groupBy("block", F.col("child").alias("v")).agg(F.min("parent").alias("least"))
    return carrier_counts(cells).join(same, ["block", "v"], "left").select("block", "v", F.least("v", F.coalesce("least", "v")).alias("rep"))


def closure(contained: DataFrame, reps: DataFrame) -> DataFrame:
    """(block, child, parent): proper containment between representatives."""
    only = reps.where("v = rep").select("block", "v")
    below = contained.where("n_child < n_parent").select("block", "child", "parent")
    below = below.join(only.withColumnRenamed("v", "child"), ["block", "child"], "left_semi")
    return below.join(only.withColumnRenamed("v", "parent"), ["block", "parent"], "left_semi").select("block", "child", "parent")


def _hops(closed: DataFrame) -> DataFrame:
    a, b = closed.select("block", "child", F.col("parent").alias("mid")), closed.select("block", F.col("child").alias("mid"), "parent")
    return a.join(b, ["block", "mid"]).select("block", "child", "parent").distinct()


def reduction(closed: DataFrame) -> DataFrame:
    """Edges of the closure that no two-hop path makes redundant."""
    return closed.join(_hops(closed), ["block", "child", "parent"], "left_anti")


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All ancestors over edges; paths double in length each round."""
    reach = materialize(edges.select("block", "child", "parent").distinct(), "reach")
    size = reach.count()
    while True:
        reach = materialize(reach.unionByName(_hops(reach)).distinct(), "reach")
        grown = reach.count()
        if grown == size:
            return reach
        size = grown


def reduction_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The transitive reduction of what two reductions reach together."""
    return reduction(transitive_closure(a.select("block", "child", "parent").unionByName(b.select("block", "child", "parent"))))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, v, level): the longest path down to each node from a node without parents; ValueError on a cycle."""
    total = nodes.count()
    level = materialize(nodes.select("block", "v", F.lit(0).alias("level")), "levels")
    for _ in range(total + 1):
        up = edges.join(level.withColumnRenamed("v", "parent"), ["block", "parent"]).groupBy("block", "child").agg((F.max("level") + 1).alias("down"))
        new = level.join(up.withColumnRenamed("child", "v"), ["block", "v"], "left").select("block", "v", F.greatest("level", F.coalesce("down", "level")).alias("level"), F.col("level").alias("was"))
        new = materialize(new, "levels")
        level = new.select("block", "v", "level")
        if new.where("level <> was").isEmpty():
            return level
        if not new.where(F.col("level") > total).isEmpty():
            break
    raise ValueError("the graph has a cycle")


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents before children, within a block."""
    w = Window.partitionBy("block").orderBy("level", "v")
    return levels(nodes, edges).withColumn("place", F.row_number().over(w) - 1)


def linearize(closed: DataFrame) -> DataFrame:
    """(block, child, parent, weight) of A = I - R^-1: the alternating count of chains from child to parent."""
    step = closed.select("block", F.col("child").alias("mid"), "parent")
    chains = materialize(closed.select("block", "child", "parent", F.lit(1).cast("long").alias("w")), "chains")
    total, sign = chains, 1
    while not chains.isEmpty():
        sign = -sign
        nxt = chains.withColumnRenamed("parent", "mid").join(step, ["block", "mid"]).groupBy("block", "child", "parent").agg(F.sum("w").alias("w"))
        chains = materialize(nxt, "chains")
        total = total.unionByName(chains.withColumn("w", F.col("w") * sign))
    return materialize(total.groupBy("block", "child", "parent").agg(F.sum("w").alias("weight")).where("weight <> 0"), "linear")


def path_sums(weighted: DataFrame) -> DataFrame:
    """(block, child, parent, total) of (I - A)^-1 off the diagonal: products of weights summed over all paths."""
    step = weighted.select("block", F.col("child").alias("mid"), "parent", F.col("weight").alias("s"))
    paths = materialize(weighted.select("block", "child", "parent", F.col("weight").alias("w")), "paths")
    total = paths
    while not paths.isEmpty():
        nxt = paths.withColumnRenamed("parent", "mid").join(step, ["block", "mid"]).groupBy("block", "child", "parent").agg(F.sum(F.col("w") * F.col("s")).alias("w"))
        paths = materialize(nxt, "paths")
        total = total.unionByName(paths)
    return total.groupBy("block", "child", "parent").agg(F.sum("w").alias("total")).where("total <> 0")


def sample_edges(cells: DataFrame, reps: DataFrame, weighted: DataFrame) -> DataFrame:
    """(block, hap_idx, v, weight): the rows of X (I - A) over representatives."""
    x = cells.join(reps.where("v = rep").select("block", "v"), ["block", "v"], "left_semi").select("block", "hap_idx", "v")
    back = x.withColumnRenamed("v", "child").join(weighted, ["block", "child"]).select("block", "hap_idx", F.col("parent").alias("v"), (-F.col("weight")).alias("w"))
    both = x.select("block", "hap_idx", "v", F.lit(1).cast("long").alias("w")).unionByName(back)
    return both.groupBy("block", "hap_idx", "v").agg(F.sum("w").alias("weight")).where("weight <> 0")


def solve(weighted: DataFrame, values: DataFrame, forward: bool = True) -> DataFrame:
    """x = (I - A)^-1 b (forward) or (I - A')^-1 b for b (block, v, x), by repeated products until they vanish."""
    src, dst = ("parent", "child") if forward else ("child", "parent")
    edges = weighted.select("block", F.col(src).alias("v"), F.col(dst).alias("to"), "weight")
    term = materialize(values.groupBy("block", "v").agg(F.sum("x").alias("x")), "solve")
    total = term
    while not term.isEmpty():
        nxt = term.join(edges, ["block", "v"]).groupBy("block", "to").agg(F.sum(F.col("x") * F.col("weight")).alias("x")).where("x <> 0")
        term = materialize(nxt.withColumnRenamed("to", "v"), "solve")
        total = total.unionByName(term)
    return total.groupBy("block", "v").agg(F.sum("x").alias("x"))


def graph_matvec(weighted: DataFrame, samples: DataFrame, reps: DataFrame, b: DataFrame) -> DataFrame:
    """(hap_idx, y) of X b through the graph; b has (block, v, x)."""
    nodes = b.join(reps, ["block", "v"]).select("block", F.col("rep").alias("v"), "x")
    x = solve(weighted, nodes)
    return samples.join(x, ["block", "v"]).groupBy("hap_idx").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))


def graph_rmatvec(weighted: DataFrame, samples: DataFrame, reps: DataFrame, y: DataFrame) -> DataFrame:
    """(block, v, x) of X' y through the graph; y has (hap_idx, y)."""
    nodes = samples.join(y, "hap_idx").groupBy("block", "v").agg(F.sum(F.col("weight") * F.col("y")).alias("x"))
    x = solve(weighted, nodes, forward=False)
    return reps.join(x.withColumnRenamed("v", "rep"), ["block", "rep"], "left").select("block", "v", F.coalesce("x", F.lit(0)).alias("x"))


def degrees(edges: DataFrame) -> DataFrame:
    """(block, v, outdegree, indegree)."""
    out = edges.groupBy("block", F.col("parent").alias("v")).agg(F.count(F.lit(1)).alias("outdegree"), F.lit(0).cast("long").alias("indegree"))
    into = edges.groupBy("block", F.col("child").alias("v")).agg(F.lit(0).cast("long").alias("outdegree"), F.count(F.lit(1)).alias("indegree"))
    return out.unionByName(into).groupBy("block", "v").agg(F.sum("outdegree").alias("outdegree"), F.sum("indegree").alias("indegree"))


def leaf_carriers(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(block, v, leaf): the leaves (block, v) that each node reaches downwards."""
    below = transitive_closure(edges).select("block", F.col("parent").alias("v"), F.col("child").alias("leaf"))
    return below.join(leaves.select("block", F.col("v").alias("leaf")), ["block", "leaf"], "left_semi").select("block", "v", "leaf")


def clique_sizes(edges: DataFrame) -> DataFrame:
    """(block, size): how many children share the pair of neighbouring parents that most do."""
    return trio_cliques(edges).groupBy("block").agg(F.max("size").alias("size"))


def without_isolated(nodes: DataFrame, edges: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Nodes with an edge, and those required, numbered anew."""
    used = edges.select("block", F.col("parent").alias("v")).union(edges.select("block", "child"))
    used = used if required is None else used.union(required.select("block", "v"))
    kept = nodes.select("block", "v").join(used.distinct(), ["block", "v"], "left_semi")
    return kept.withColumn("node", F.row_number().over(Window.partitionBy("block").orderBy("v")) - 1)


def with_individuals(samples: DataFrame, haps: DataFrame) -> DataFrame:
    """(block, iid, v, weight): an individual below both its haplotypes inherits the sum of their edges, path by path."""
    return samples.join(haps.select("hap_idx", "iid"), "hap_idx").groupBy("block", "iid", "v").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def trio_cliques(edges: DataFrame) -> DataFrame:
    """(block, left, right, size): children for which two parents are neighbours in parent order."""
    w = Window.partitionBy("block", "child").orderBy("parent")
    trios = edges.select("block", "child", F.col("parent").alias("left"), F.lead("parent").over(w).alias("right")).where("right IS NOT NULL")
    return trios.groupBy("block", "left", "right").agg(F.count(F.lit(1)).alias("size"))


def merge_blocks(parts: list[DataFrame]) -> DataFrame:
    """Edges of several graphs with node numbers (child, parent from 0), each part's numbers after those before."""
    merged, offset = None, 0
    for part in parts:
        size = part.agg(F.max(F.greatest("child", "parent"))).first()[0]
        moved = part.select((F.col("child") + offset).alias("child"), (F.col("parent") + offset).alias("parent"))
        merged = moved if merged is None else merged.unionByName(moved)
        offset += (size + 1) if size is not None else 0
    return merged


def coded(edges: DataFrame) -> DataFrame:
    """(block, v, code): the parents of each block, numbered from 0 in their order."""
    w = Window.partitionBy("block").orderBy("v")
    return edges.select("block", F.col("parent").alias("v")).distinct().withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def _in_blocks(df: DataFrame) -> DataFrame:
    # The number is given so that adaptive execution doesn't put all blocks into few tasks: they are small but take long.
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


def _factor(lengths, values, weights, least: int):
    """Left and right parent of each new node and what is left of the lists: (left, right, lengths, ids).

    ``values`` are the lists one after another, ``weights`` how many children have each. Codes stay
    as they are and node k is -k - 1. A pair is only followed while ``least`` children share it.
    """
    import heapq

    import numpy as np

    node = values.astype(np.int32)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    nxt, prv = np.arange(1, len(node) + 1, dtype=np.int32), np.arange(-1, len(node) - 1, dtype=np.int32)
    ends = np.cumsum(lengths)[lengths > 0]
    nxt[ends - 1] = -1
    prv[ends[:-1]] = -1
    prv[:1] = -1
    base = int(node.max()) + 1 if len(node) else 0
    size: dict[int, int] = {}
    where: dict = {}
    heap: list[tuple[int, int]] = []
    left: list[int] = []
    right: list[int] = []

    def groups(keys, at):
        """Positions and weight of each key, the keys in order."""
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = np.concatenate(([0], cuts))
        sums = np.add.reduceat(weights[row[at]], starts).tolist()
        return keys[starts].tolist(), sums, starts.tolist(), [*cuts.tolist(), len(at)], at

    def follow(key, total, positions):
        if total >= least:
            size[key], where[key] = total, positions
            heapq.heappush(heap, (-total, key))

    def lose(key, total):
        if key in size:
            size[key] -= total
            if size[key] < least:
                del size[key], where[key]

    p = np.flatnonzero(nxt >= 0).astype(np.int32)
    if len(p):
        keys, sums, starts, stops, at = groups(node[p].astype(np.int64) << 32 | node[nxt[p]], p)
        for key, total, i, j in zip(keys, sums, starts, stops, strict=True):
            follow(key, total, at[i:j])
    del p
    while heap:
        total, key = heapq.heappop(heap)
        if key not in size:
            continue
        if size[key] != -total:
            heapq.heappush(heap, (-size[key], key))
            continue
        at, a, b = where.pop(key), key >> 32, key & 0xFFFFFFFF
        del size[key]
        at = at[node[at] == a]
        at = at[nxt[at] >= 0]
        at = at[node[nxt[at]] == b]
        new = base + len(left)
        left.append(a)
        right.append(b)
        gone = nxt[at]
        after, before = nxt[gone], prv[at]
        node[at], node[gone], nxt[at] = new, -1, after
        has = after >= 0
        at, after, before = at[has], after[has], before[before >= 0]
        prv[after] = at
        if len(before):
            keys, sums, starts, stops, held = groups(node[before], before)
            for x, total, i, j in zip(keys, sums, starts, stops, strict=True):
                lose(x << 32 | a, total)
                follow(x << 32 | new, total, held[i:j])
        if len(at):
            keys, sums, starts, stops, held = groups(node[after], at)
            for x, total, i, j in zip(keys, sums, starts, stops, strict=True):
                lose(b << 32 | x, total)
                follow(new << 32 | x, total, held[i:j])
    kept = node >= 0
    ids = lambda x: np.where(x < base, x, base - 1 - x).astype(np.int32)
    return ids(np.array(left, np.int64)), ids(np.array(right, np.int64)), np.bincount(row[kept], minlength=len(lengths)), ids(node[kept])


def _expand(left, right, lengths, values):
    """What lists reach through the nodes: (lengths, codes)."""
    import numpy as np

    width: list[int] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):  # a node stands after those below it
        width.append((1 if a >= 0 else width[-a - 1]) + (1 if b >= 0 else width[-b - 1]))
    width = np.array(width, np.int64)
    wide = lambda x: np.where(x >= 0, 1, width[np.minimum(-x - 1, len(width) - 1)] if len(width) else 1)
    row, each, x = np.repeat(np.arange(len(lengths)), lengths), wide(values), values
    start = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.int32)
    while len(x):
        leaf = x >= 0
        out[start[leaf]] = x[leaf]
        k, start = -x[~leaf] - 1, start[~leaf]
        x, start = np.concatenate((left[k], right[k])), np.concatenate((start, start + wide(left[k])))
    return np.bincount(row, weights=each, minlength=len(lengths)).astype(np.int64), out


def _lists(column):
    """Lengths and values of an Arrow column of lists."""
    import numpy as np

    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _as_lists(lengths, values):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)


_FACTORED = "block string, list array<int>, n bigint, node int, parents array<int>"


def factor_lists(lists: DataFrame, least: int = 2) -> DataFrame:
    """Replace, greedily, the pair of neighbouring parents that most children share by a new node below both.

    ``lists`` are the distinct lists of codes (block, list, n), n the number of children that have one.
    Returns (block, list, n, node, parents): each list with the parents it is left with, and each new
    node, -1, -2, ... in the order they were made, with its two. Equal lists are factored alike, so they
    count as one with its weight. Sequential within a block and independent between blocks: a task holds
    the distinct lists of a block as whole numbers, about 20 bytes for each entry.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.combine_chunks()
        block, lists = table["block"][0], table["list"].combine_chunks()
        n = table["n"].to_numpy()
        left, right, lengths, ids = _factor(*_lists(lists), n, least)
        made = len(left)
        both = np.stack((left, right), 1).ravel()
        return pa.table(
            {
                "block": pa.repeat(block, len(n) + made),
                "list": pa.concat_arrays([lists, pa.nulls(made, lists.type)]),
                "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(made, pa.int64())]),
                "node": pa.concat_arrays([pa.nulls(len(n), pa.int32()), pa.array(-1 - np.arange(made), pa.int32())]),
                "parents": _as_lists(np.concatenate((lengths, np.full(made, 2))), np.concatenate((ids, both)).astype(np.int32)),
            }
        )

    return _in_blocks(lists.select("block", "list", "n")).groupBy("block").applyInArrow(run, _FACTORED)


def expand_lists(factored: DataFrame, variants: DataFrame) -> DataFrame:
    """(block, list, parents): the names of what each factored list reaches through the new nodes."""

    def run(table, names):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("block", pa.string()), ("list", pa.list_(pa.int32())), ("parents", pa.list_(pa.string()))])
        if not len(table):
            return schema.empty_table()
        nodes = table.filter(pc.is_valid(table["node"])).sort_by([("node", "descending")]).combine_chunks()
        lists = table.filter(pc.is_null(table["node"])).combine_chunks()
        both = _lists(nodes["parents"].combine_chunks())[1].reshape(-1, 2) if len(nodes) else np.empty((0, 2), np.int32)
        lengths, codes = _expand(both[:, 0], both[:, 1], *_lists(lists["parents"].combine_chunks()))
        v = names.sort_by("code")["v"].combine_chunks()
        return pa.table([lists["block"], lists["list"], _as_lists(lengths, v.take(pa.array(codes)))], schema=schema)

    both = _in_blocks(factored).groupBy("block").cogroup(_in_blocks(variants.select("block", "v", "code")).groupBy("block"))
    return both.applyInArrow(run, "block string, list array<int>, parents array<string>")


def shared_pairs(factored: DataFrame) -> DataFrame:
    """(block, size): how many children share the pair of neighbouring parents that most do."""
    pair = F.explode(F.expr("transform(sequence(1, size(parents) - 1), i -> struct(parents[i - 1] AS left, parents[i] AS right))")).alias("pair")
    pairs = factored.where("size(parents) > 1").select("block", F.coalesce("n", F.lit(1).cast("long")).alias("n"), pair)
    return pairs.groupBy("block", "pair").agg(F.sum("n").alias("size")).groupBy("block").agg(F.max("size").alias("size"))


def by_list(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Join on equal lists; the hash comes first because numbers sort faster, the lists decide."""
    key = F.xxhash64("block", "list").alias("_key")
    return lists.select("*", key).join(known.select("*", key), ["_key", "block", "list"]).drop("_key")


def factor_recombinations(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges with the neighbouring parents that most children share replaced by new nodes below both, as ``factor_lists`` does.

    Node k is named by the least parent it reaches, "~r" and k. Parents that begin with another's name
    can sort differently then; ``shared_pairs`` counts in the order of the lists.
    """
    variants = materialize(coded(edges), "variants")
    known = edges.select("block", "child", F.col("parent").alias("v")).join(variants, ["block", "v"])
    lists = materialize(known.groupBy("block", "child").agg(F.sort_array(F.collect_set("code")).alias("list")), "lists")
    factored = materialize(factor_lists(lists.groupBy("block", "list").agg(F.count(F.lit(1)).alias("n")), least), "factored")
    nodes = factored.where("node IS NOT NULL").select("block", "node", "parents")
    # The least parent of a node is the least of its left parent.
    lead = materialize(nodes.select("block", "node", F.col("parents")[0].alias("lead")), "lead")
    while not lead.where("lead < 0").isEmpty():
        up = lead.select("block", F.col("node").alias("lead"), F.col("lead").alias("next"))
        lead = materialize(lead.join(up, ["block", "lead"], "left").select("block", "node", F.coalesce("next", "lead").alias("lead")), "lead")
    made = lead.join(variants.withColumnRenamed("code", "lead"), ["block", "lead"])
    names = variants.select("block", F.col("code").alias("id"), "v").unionByName(made.select("block", F.col("node").alias("id"), F.concat("v", F.lit("~r"), (-F.col("node") - 1).cast("string")).alias("v")))
    names = materialize(names, "names")
    below = nodes.select("block", "node", F.explode("parents").alias("id")).join(names.withColumnRenamed("v", "parent"), ["block", "id"])
    below = below.join(names.select("block", F.col("id").alias("node"), F.col("v").alias("child")), ["block", "node"])
    left = factored.where("node IS NULL").select("block", "list", F.explode("parents").alias("id")).join(names.withColumnRenamed("v", "parent"), ["block", "id"])
    left = by_list(lists, left.select("block", "list", "parent"))
    return left.select("block", "child", "parent").unionByName(below.select("block", "child", "parent"))


def compression(cells: DataFrame, reps: DataFrame, weighted: DataFrame, samples: DataFrame) -> DataFrame:
    """(block, n_variants, nnz_matrix, nnz_graph)."""
    a = cells.groupBy("block").agg(F.countDistinct("v").alias("n_variants"), F.count(F.lit(1)).alias("nnz_matrix"))
    g = weighted.select("block").unionByName(samples.select("block")).groupBy("block").agg(F.count(F.lit(1)).alias("nnz_graph"))
    return a.join(g, "block", "left").na.fill(0, ["nnz_graph"])
