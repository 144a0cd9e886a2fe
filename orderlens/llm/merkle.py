"""A Merkle manifest of a table: digests of all rows, and a climb from any row's digest to the root.

Rows of a group, in the order of their ids, are the leaves of a tree; `FAN` consecutive nodes become
one node of the next level, whose digest is that of theirs written one after the other, until one is
left.  These subroots, in the order of the groups, are the leaves of one more tree, with the root.

Leaves are numbered without gathering a group: rows are sorted over range partitions, each knows how
many rows of its first group lie before it, and only those counts, one for each partition and group,
are summed.  Every built level is written as one row for each run of siblings: their digests, and the
node of the next level that the run becomes.  A recursive query then climbs: it holds one node for
each leaf, joins it with its run, appends the siblings met there as a row, and goes on as the run's
node with the digest of the siblings and its own, folded, one.  It ends at the root, which has no
run, after as many rounds as the trees have levels.  Rows are appended rather than a growing list in
one, so a round shuffles the node and its digest, not the proof gathered so far.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.sources.scratch import materialize

FAN = 3
TOP = -1  # the number of the tree over the groups
DIGEST = 32
FILE_ROWS = 20_000  # nodes of a level that one task makes runs of
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


# ---- digests ------------------------------------------------------------------------------------


def leaf_digest(values: Iterable[Column]) -> Column:
    """The digest of a row's values, each written so that no two rows are written alike."""
    return F.sha2(F.concat(*[_written(v) for v in values]), 256)


def _written(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


# ---- numbering ----------------------------------------------------------------------------------


def _numbered(rows: DataFrame, group: str, order: list[str], index: str) -> DataFrame:
    """`rows`, written, with their place in the group and the number of the group.

    `index` is the place by `order`, `_group` the number of the group in the order of groups (null
    first); `_row` differs between rows.  Equal rows are numbered in any order.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sort = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = materialize(
        rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("_row", F.monotonically_increasing_id()),
        "merkle_sorted",
    )
    part = F.shiftright("_row", 33)
    counts = placed.groupBy(part.alias("_part"), F.col(group).alias("_of")).agg(
        F.count("*").alias("n"), F.min("_row").alias("_first")
    )
    counts = materialize(counts, "merkle_counts")
    groups = counts.groupBy("_of").agg(F.sum("n").alias("_size"))
    # One row for each group, in its order: numbered over range partitions as well.
    known = materialize(_consecutive(groups, "_of", "_group", parts), "merkle_groups")
    earlier = F.sum("n").over(W.partitionBy("_of").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.withColumn("_before", F.coalesce(earlier, F.lit(0))).join(
        known.withColumnRenamed("_of", "_name"), F.col("_of").eqNullSafe(F.col("_name"))
    )
    starts = starts.select(
        F.col("_part").alias("_p"), F.col("_of").alias("_o"), "_group", "_size", (F.col("_before") - F.col("_first")).alias("_shift")
    )
    met = placed.join(starts, (part == F.col("_p")) & F.col(group).eqNullSafe(F.col("_o")))
    return materialize(met.withColumn(index, F.col("_row") + F.col("_shift")).drop("_p", "_o", "_shift"), "merkle_numbered")


def _consecutive(rows: DataFrame, key: str, name: str, parts: int) -> DataFrame:
    """`rows`, one for each key, with the place of the key, counted over range partitions."""
    sort = F.col(key).asc_nulls_first()
    placed = materialize(
        rows.repartitionByRange(parts, sort).sortWithinPartitions(sort).withColumn("_at", F.monotonically_increasing_id()),
        "merkle_keys",
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col("_part").alias("_p"), (before - F.shiftleft("_part", 33)).alias("_shift"))
    return placed.join(shifts, part == F.col("_p")).withColumn(name, F.col("_at") + F.col("_shift")).drop("_p", "_shift", "_at")


# ---- levels -------------------------------------------------------------------------------------


def _runs(leaves: DataFrame, tree_of: Column | None) -> tuple[list[DataFrame], DataFrame]:
    """The written runs of every level over `leaves` (tree, idx, n, digest), and the last nodes.

    A run is (tree, level, run, children, up_tree, up_level, up_idx).  The last node of a tree is the
    leaf `tree_of` of the tree over all, or has nothing above it.
    """
    levels: list[DataFrame] = []
    done: list[DataFrame] = []
    nodes, level = leaves, 0
    while True:
        done.append(nodes.where("n = 1").select("tree", "digest"))
        rest = nodes.where("n > 1")
        waiting = rest.count()
        if not waiting:
            break
        files = -(-waiting // FILE_ROWS)  # the upper levels are small
        run = F.floor(F.col("idx") / FAN)
        grouped = rest.groupBy("tree", run.alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("of"), F.first("n").alias("m")
        )
        children = F.aggregate("of", F.lit(b""), lambda a, c: F.concat(a, c["digest"]))
        n = F.ceil(F.col("m") / FAN)
        last = n == 1
        above = (F.lit(None).cast("long"),) * 2 if tree_of is None else (F.lit(TOP).cast("long"), tree_of)
        made = grouped.withColumn("children", children).select(
            "tree", F.lit(level).cast("long").alias("level"), "run", "children", n.alias("n"),
            F.when(last, above[0]).otherwise(F.col("tree")).alias("up_tree"),
            F.when(last, 0).otherwise(level + 1).cast("long").alias("up_level"),
            F.when(last, above[1]).otherwise(F.col("run")).alias("up_idx"),
        )
        levels.append(materialize(made.coalesce(files), f"merkle_level_{level}"))
        nodes = levels[-1].select("tree", F.col("run").alias("idx"), "n", F.unhex(F.sha2(_hex(F.col("children")), 256)).alias("digest"))
        level += 1
    subroots = done[0]
    for other in done[1:]:
        subroots = subroots.unionByName(other)
    return levels, materialize(subroots, "merkle_subroots")


# ---- the climb ----------------------------------------------------------------------------------

CLIMB = f"""
    WITH RECURSIVE climb (leaf, id, step, tree, level, idx, folded, siblings, original) AS (
        SELECT leaf, id, 0, tree, level, idx, folded, CAST('' AS BINARY), original FROM {{starts}}
        UNION ALL
        SELECT leaf, id, step + 1, up_tree, up_level, up_idx,
               unhex(sha2(concat(lower(hex(substring(children, 1, at))), lower(hex(folded)),
                                 lower(hex(substring(children, at + {DIGEST} + 1)))), 256)),
               concat(substring(children, 1, at), substring(children, at + {DIGEST} + 1)),
               CASE WHEN tree = {TOP} AND level = 0 THEN substring(children, at + 1, {DIGEST}) END
        FROM (SELECT c.leaf, c.id, c.step, c.tree, c.level, c.folded, {DIGEST} * CAST(c.idx % {FAN} AS INT) AS at,
                     r.children, r.up_tree, r.up_level, r.up_idx
              FROM climb c JOIN {{runs}} r
              ON c.tree = r.tree AND c.level = r.level AND c.idx DIV {FAN} = r.run)
    )
    SELECT leaf, id, step, folded, siblings, original FROM climb
"""


def _climbed(starts: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each leaf and step, written; every leaf climbs to the root."""
    spark = starts.sparkSession
    names = {"starts": "_merkle_starts", "runs": "_merkle_runs"}
    starts.createOrReplaceTempView(names["starts"])
    runs.createOrReplaceTempView(names["runs"])
    limit = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, -1)  # the rounds are as few as the levels, the rows are all leaves
    try:
        return materialize(spark.sql(CLIMB.format(**names)), "merkle_climb")
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)
        spark.conf.unset(ROW_LIMIT) if limit is None else spark.conf.set(ROW_LIMIT, limit)


def manifest(
    df: DataFrame, columns: list[str], tampered: dict[str, Column], group: str = "source", id_column: str = "doc_id"
) -> DataFrame:
    """`id, leaf, subroot, root, proof, folded_root, verified` for every row.

    `leaf` is the row's digest over `columns`; `tampered` gives other values for some columns, whose
    digest, folded along the stored siblings, gives `folded_root`.  `proof` holds the siblings' digests
    as hexadecimal text from the leaf to the root.  A null group is a group of its own and comes
    first, null ids come before others; rows that repeat an id are ordered by their digests; equal
    rows are separate leaves.  A single row is leaf, subroot and root at once, with an empty proof.
    An empty table gives an empty result; other columns are not read; texts are digested whole.
    """
    digest = lambda changed: F.unhex(leaf_digest([changed.get(c, F.col(c)) for c in columns]))
    rows = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(group).cast("string").alias("of"),
        digest({}).alias("digest"), digest(tampered).alias("changed"),
    )
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed")))
    leaves = _numbered(rows, "of", ["id", "digest"], "idx")
    groups = leaves.select(F.col("_group").alias("tree"), "idx", F.col("_size").alias("n"), "digest")
    levels, subroots = _runs(groups, F.col("tree"))
    upper = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(subroots.count()).alias("n"), "digest"
    )
    upper_levels, top = _runs(upper, None)
    found = top.first()
    root = F.lit(bytes(found["digest"]) if found else b"")
    runs = [*levels, *upper_levels]
    alone = F.col("_size") == 1  # such a leaf is a subroot already
    starts = leaves.select(
        F.col("_row").alias("leaf"), "id", F.when(alone, F.lit(TOP)).otherwise(F.col("_group")).cast("long").alias("tree"),
        F.lit(0).cast("long").alias("level"), F.when(alone, F.col("_group")).otherwise(F.col("idx")).alias("idx"),
        F.coalesce("changed", "digest").alias("folded"), F.col("digest").alias("original"),
    )
    if runs:
        stored = runs[0]
        for level in runs[1:]:
            stored = stored.unionByName(level)
        steps = _climbed(starts, stored.drop("n"))
    else:
        steps = starts.select("leaf", "id", F.lit(0).alias("step"), "folded", F.lit(b"").alias("siblings"), "original")
    path = F.array_sort(F.collect_list(F.struct("step", "siblings")))
    gathered = steps.groupBy("leaf").agg(
        F.first("id").alias("id"),
        path.alias("path"),
        F.max_by("folded", "step").alias("folded"),
        F.max(F.when(F.col("step") == 0, F.col("original"))).alias("digest"),
        F.max(F.when(F.col("step") > 0, F.col("original"))).alias("subroot"),
    )
    return gathered.select(
        F.col("id").alias(id_column), _hex(F.col("digest")).alias("leaf"),
        _hex(F.coalesce("subroot", root)).alias("subroot"), _hex(root).alias("root"),
        F.array_join(F.transform("path", lambda s: _hex(s["siblings"])), "").alias("proof"),
        _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )
