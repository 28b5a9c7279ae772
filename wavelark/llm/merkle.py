"""Merkle dataset manifest over nested-interval labels.

Rows are leaves, numbered within their source; sources are numbered in turn.
A node of the tree covers an interval [low, high) of leaf ranks and carries it
as its label.  Up to 16 neighbouring nodes become one node of the level above,
so the nodes of a level are buckets of equal width, and a node's ancestor is
the one of its level whose bucket holds the node's low end and whose interval
contains the node's: an equality join, checked by containment.  A node's
siblings are what its parent's interval leaves after its own.

Paths are made from the root down.  Every run (the children of one parent)
gets the path above it, siblings left and right per level, from its parent's
run; only runs of leaves, 16 times fewer than rows, carry long paths, and
leaves meet their run once.

Ranks need no window over a source: rows are sorted by range partitions, counted
per (partition, source), and only those counts are added up in order.

Defined results: a null value of a column counts as ``-``; a null source is a
source, before all others; null ids come first; rows of one id are ordered by
their hash; repeated rows are leaves of their own; an empty table gives an empty
result.  Only the columns named are read; texts are hashed where they are read
and never moved.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.llm.tables import shuffle_parts, written

RUN = 16


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _part(value: Column) -> Column:
    """``-`` for null, otherwise byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame, columns: list[str], source_col: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tree, leaf, given): ``given`` is the leaf after tampering, the same where nothing changed.

    ``tree`` orders sources bytewise, null first.
    """
    tampered = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    tampered = tampered & F.coalesce(F.col(text_col).rlike("[A-Z]"), F.lit(False))
    new = {text_col: lowered(F.col(text_col))}
    leaf = _digest(*[_part(F.col(c)) for c in columns])
    changed = _digest(*[_part(new.get(c, F.col(c))) for c in columns])
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    return docs.select(
        F.col(id_col).alias("doc_id"), tree.alias("tree"), leaf.alias("leaf"), F.when(tampered, changed).alias("changed")
    ).select("doc_id", "tree", "leaf", F.coalesce("changed", "leaf").alias("given"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 in each group along ``order``, and ``n``, the rows of the group.

    A group may span any number of range partitions.
    """
    parts = shuffle_parts(rows.sparkSession)
    sorted_rows = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    placed = written(sorted_rows.withColumn("place", F.monotonically_increasing_id()))
    shift = F.shiftright("place", 33).alias("part")
    counts = placed.groupBy(shift, group).agg(F.min("place").alias("first"), F.count("*").alias("own"))
    # One entry per partition a group reaches into: bounded by the number of partitions.
    pieces = counts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("part", "first", "own"))).alias("all"))
    before = F.aggregate(
        F.slice("all", 1, F.col("at")), F.lit(0).cast("long"), lambda total, one: total + one["own"]
    )
    total = F.aggregate("all", F.lit(0).cast("long"), lambda total, one: total + one["own"])
    offsets = pieces.select(group, "all", total.alias("n"), F.posexplode("all").alias("at", "one")).select(
        group, F.col("one.part").alias("part"), (F.col("one.first") - before).alias("base"), "n"
    )
    joined = placed.withColumn("part", shift).join(offsets, [group, "part"])
    return joined.withColumn("rank", F.col("place") - F.col("base")).drop("place", "part", "base")


def next_level(nodes: DataFrame) -> DataFrame:
    """Parents of a level: nodes of trees that still have several.

    ``nodes``: tree, at (place in the level), low, high, digest, n (nodes of the tree in the level).
    """
    run = F.floor(F.col("at") / RUN).cast("long")
    return (
        nodes.filter("n > 1").groupBy("tree", run.alias("run"))
        .agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.first("n").alias("below"),
            F.sort_array(F.collect_list(F.struct("at", "low", "high", "digest"))).alias("children"),
        )
        .select(
            "tree", F.col("run").alias("at"), "low", "high",
            _digest(F.array_join(F.transform("children", lambda c: c["digest"]), "")).alias("digest"),
            F.ceil(F.col("below") / RUN).cast("long").alias("n"), "children",
        )
    )


def levels(bottom: DataFrame) -> list[DataFrame]:
    """Written levels above ``bottom``, lowest first; each holds its nodes with their children."""
    found, below = [], bottom
    most = bottom.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = written(next_level(below))
        found.append(below)
        most = -(-most // RUN)
    return found


def _steps(children: Column, own: Column) -> Column:
    """Siblings of a node as (left, right): its parent's interval without its own."""
    left = F.filter(children, lambda c: c["high"] <= own["low"])
    right = F.filter(children, lambda c: c["low"] >= own["high"])
    text = lambda part: F.array_join(F.transform(part, lambda c: c["digest"]), "")
    return F.struct(text(left).alias("left"), text(right).alias("right"))


STEP_TYPE = "array<struct<left:string,right:string>>"


def paths(stages: list[DataFrame], above: DataFrame | None = None) -> DataFrame | None:
    """The lowest level's nodes with ``path``: siblings from their own level up, and ``top``, their tree's last digest.

    ``above`` (tree, path, top) continues the path of each tree's last node.
    """
    known = None
    for nodes in reversed(stages):
        ends = nodes.filter("n = 1").select(
            "tree", "at", "low", "high", "children", F.col("digest").alias("top"), F.array().cast(STEP_TYPE).alias("path")
        )
        if known is not None:
            parent = known.select(
                "tree", F.col("at").alias("run"), F.col("low").alias("from"), F.col("high").alias("to"), "top",
                F.col("path").alias("up"), F.col("children").alias("all"),
            )
            own = nodes.filter("n > 1").withColumn("run", F.floor(F.col("at") / RUN).cast("long"))
            inside = own.join(parent, ["tree", "run"]).filter("low >= from and high <= to")
            step = F.array(_steps(F.col("all"), F.struct("low", "high")))
            ends = ends.unionByName(
                inside.select("tree", "at", "low", "high", "children", "top", F.concat(step, "up").alias("path"))
            )
        known = ends
    return known


def _nodes(rows: DataFrame, digest: str) -> DataFrame:
    return rows.select(
        "tree", F.col("rank").alias("at"), F.col("rank").alias("low"), (F.col("rank") + 1).alias("high"),
        F.col(digest).alias("digest"), "n",
    )


def _folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda own, s: _digest(s["left"], own, s["right"]))


def _text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def source_trees(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels above the leaves, (tree, subroot) of every source) for ranked leaves."""
    stages = levels(_nodes(rows, "leaf"))
    roots = rows.filter("n = 1").select("tree", F.col("leaf").alias("subroot"))
    for nodes in stages:
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", F.col("digest").alias("subroot")))
    return stages, roots


def top_tree(roots: DataFrame) -> DataFrame:
    """(tree, subroot, root, above): every source with its path from the subroot to the root."""
    everything = written(ranked(roots.withColumn("corpus", F.lit("")), "corpus", ["tree"]))
    bottom = everything.select("corpus", F.col("rank"), "subroot", "n").withColumnRenamed("corpus", "tree")
    stages = levels(_nodes(bottom, "subroot"))
    lone = everything.filter("n = 1").select(
        "tree", "subroot", F.col("subroot").alias("root"), F.array().cast(STEP_TYPE).alias("above")
    )
    if not stages:
        return lone
    run = paths(stages).select(F.col("at").alias("run"), "children", F.col("top").alias("root"), F.col("path").alias("up"))
    own = everything.withColumn("run", F.floor(F.col("rank") / RUN).cast("long"))
    own = own.withColumn("low", F.col("rank")).withColumn("high", F.col("rank") + 1).join(run, "run")
    step = F.array(_steps(F.col("children"), F.struct("low", "high")))
    return own.select("tree", "subroot", "root", F.concat(step, "up").alias("above"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(
    docs: DataFrame, columns: list[str] | None = None, source_col: str = "source", id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per leaf: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, low, n_steps).

    ``low`` is the leaf's rank within its source, ``n_steps`` the length of its
    path.  ``columns`` are hashed in the order given.
    """
    made = written(leaves(docs, columns or COLUMNS, source_col, id_col, text_col))
    rows = written(ranked(made, "tree", ["doc_id", "leaf", "given"]))
    stages, roots = source_trees(rows)
    top = written(top_tree(written(roots)))
    # Runs of leaves with the whole path above them; a lone leaf is its source's subroot.
    alone = rows.filter("n = 1").join(top, "tree").select(
        "doc_id", "leaf", "given", "subroot", "root", F.lit(0).cast("long").alias("low"), F.col("above").alias("path")
    )
    found = alone
    if stages:
        runs = paths(stages).join(top, "tree").select(
            "tree", F.col("at").alias("run"), "children", "low", "high", F.concat("path", "above").alias("up"), "subroot", "root"
        )
        own = rows.filter("n > 1").withColumn("run", F.floor(F.col("rank") / RUN).cast("long"))
        inside = own.join(runs, ["tree", "run"]).filter("rank >= low and rank < high")
        step = F.array(_steps(F.col("children"), F.struct(F.col("rank").alias("low"), (F.col("rank") + 1).alias("high"))))
        found = alone.unionByName(
            inside.select(
                "doc_id", "leaf", "given", "subroot", "root", F.col("rank").alias("low"), F.concat(step, "up").alias("path")
            )
        )
    folded = found.withColumn("folded_root", _folded(F.col("given"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", _digest(_text(F.col("path"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), "low", F.size("path").alias("n_steps"),
    )


def verify(proofs: DataFrame, leaf_col: str = "leaf", path_col: str = "path", root_col: str = "root") -> DataFrame:
    """Proofs with ``verified``: whether folding a leaf along its path gives the root."""
    return proofs.withColumn("verified", _folded(F.col(leaf_col), F.col(path_col)) == F.col(root_col))
