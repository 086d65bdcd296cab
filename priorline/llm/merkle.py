"""Merkle manifest of a table: one tree per source, one tree over the sources, a proof per row.

Nodes are numbered inside their tree.  At every level a run of ``arity`` consecutive nodes becomes one parent: the node in
slot zero computes the numbers of its siblings (XOR for binary trees, slot offsets otherwise), an equi join fetches them,
and the slot-zero row emits the parent.  The texts of the runs are kept, so a row's siblings at every level are its run's
text without its own part, and a proof is folded with no more than one array per run shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .urlfilter import LOWER, UPPER

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_PART = 200_000
HEX = 64  # characters of a digest


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def number_nodes(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``idx`` from 0 inside ``tree`` in ``order``, and ``size``, the nodes of the tree; no tree is put into one task.

    Rows are cut into ranges over (tree, order), each range is numbered on its own and starts where the ranges before it
    end.  Equal rows come once with their number of ``copies`` and take as many numbers.
    """
    parts = max(1, -(-nodes.count() // ROWS_PER_PART))
    cut = scratch.stage(nodes.repartitionByRange(parts, "tree", *order).withColumn("_part", F.spark_partition_id()))
    per_tree = Window.partitionBy("tree")
    starts = cut.groupBy("tree", "_part").agg(F.sum("copies").alias("_n")).select(
        "tree", "_part", (F.sum("_n").over(per_tree.orderBy("_part")) - F.col("_n")).alias("_start"), F.sum("_n").over(per_tree).alias("size"))
    here = F.sum("copies").over(Window.partitionBy("tree", "_part").orderBy(*order)) - F.col("copies")
    first = cut.withColumn("_here", here).join(starts, ["tree", "_part"]).withColumn("_first", F.col("_start") + F.col("_here"))
    return first.withColumn("idx", F.explode(F.sequence("_first", F.col("_first") + F.col("copies") - 1))).drop("_part", "_here", "_start", "_first", "copies")


def build_trees(nodes: DataFrame, arity: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of numbered nodes (tree, idx, size, digest): the roots (tree, root), and the paths (tree, run, path).

    ``path`` is the text of the run, of the run that holds its parent, and so on; trees of one node have none.
    """
    nodes = nodes.select("tree", "idx", "size", "digest")
    tops, levels = [nodes.where("size = 1")], []
    height = nodes.agg(F.max("size")).first()[0] or 0
    rest = nodes.where("size > 1")
    while height > 1:
        zero = rest.where(F.col("idx") % arity == 0)
        others = F.array(F.col("idx"), F.col("idx").bitwiseXOR(F.lit(1))) if arity == 2 else F.sequence("idx", F.col("idx") + (arity - 1))
        wanted = zero.select("tree", F.col("idx").alias("zero"), F.explode(others).alias("idx"))
        met = wanted.join(rest.select("tree", "idx", "size", "digest"), ["tree", "idx"])
        runs = met.groupBy("tree", "zero").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda n: n["digest"]), "").alias("text"), F.max("size").alias("size"))
        level = scratch.stage(runs.select("tree", F.expr(f"zero div {arity}").alias("run"), "text", "size"))
        levels.append(level)
        parents = level.select("tree", F.col("run").alias("idx"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), F.sha2("text", 256).alias("digest"))
        tops.append(parents.where("size = 1"))
        rest = parents.where("size > 1")
        height = -(-height // arity)
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionByName(top)
    paths = None
    for level in reversed(levels):
        own = level.select("tree", "run", F.array("text").alias("path"))
        if paths is not None:
            above = paths.select("tree", F.col("run").alias("_up"), F.col("path").alias("_above"))
            own = own.withColumn("_up", F.expr(f"run div {arity}")).join(above, ["tree", "_up"], "left").select(
                "tree", "run", F.when(F.col("_above").isNull(), F.col("path")).otherwise(F.concat("path", "_above")).alias("path"))
        paths = scratch.stage(own)
    if paths is None:
        paths = nodes.limit(0).select("tree", F.col("idx").alias("run"), F.array("digest").alias("path"))
    return roots.select("tree", F.col("digest").alias("root")), paths


def _sides(path: Column, idx: Column, arity: int) -> Column:
    """Of every level: the siblings left of the node, and those right of it."""

    def side(text: Column, level: Column) -> Column:
        slot = F.pmod(F.floor(idx / F.pow(F.lit(float(arity)), level)), F.lit(arity)).cast("int")
        return F.struct(F.substring(text, F.lit(1), slot * HEX).alias("l"), F.substring(text, (slot + 1) * HEX + 1, F.length(text)).alias("r"))

    return F.transform(F.coalesce(path, F.array().cast("array<string>")), side)


def manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS, id_column: str = "doc_id", group: str = "source",
             text: str = "text", arity: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot`` of its source, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``tampered`` marks rows whose text is lower-cased (A-Z) before their proof is checked; null marks none.  A null source is
    a source of its own and the first; a null id comes before others of its source; rows with one id are ordered by leaf, and
    equal rows each take a leaf.  Empty and null texts give different leaves.  A tree of one leaf is its own root, with
    an empty list of siblings.  An empty table gives no rows.  Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    values = [F.col(c) for c in columns]
    altered = [F.translate(text, UPPER, LOWER) if c == text else F.col(c) for c in columns]
    leaf = leaf_digest(values)
    other = F.when(F.coalesce(tampered, F.lit(False)) & (F.translate(text, UPPER, LOWER) != F.col(text)), leaf_digest(altered)) if tampered is not None else F.lit(None).cast("string")
    # sources get a prefix, so that null is told from every text and comes first
    leaves = docs.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(id_column).alias("id"), leaf.alias("digest"), other.alias("other"))
    leaves = scratch.stage(leaves)
    numbered = scratch.stage(number_nodes(leaves.groupBy("tree", "id", "digest", "other").agg(F.count("*").alias("copies")), ["id", "digest"], scratch))
    scratch.release(leaves)
    subroots, paths = build_trees(numbered, arity, scratch)
    subroots = scratch.stage(subroots)
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_key"), F.col("root").alias("digest"), F.lit(1).cast("long").alias("copies"))
    tops = scratch.stage(number_nodes(tops, ["source_key"], scratch))
    root, over = build_trees(tops, arity, scratch)
    top_value = root.first()
    of_source = tops.withColumn("run", F.expr(f"idx div {arity}")).join(over, ["tree", "run"], "left").select(
        F.col("source_key").alias("tree"), F.col("digest").alias("subroot"), F.col("idx").alias("_top"), F.col("path").alias("_over"))
    rows = numbered.withColumn("run", F.expr(f"idx div {arity}")).join(paths, ["tree", "run"], "left").join(of_source, "tree")
    sides = F.concat(_sides(F.col("path"), F.col("idx"), arity), _sides(F.col("_over"), F.col("_top"), arity))
    proof = F.sha2(F.array_join(F.transform(sides, lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = F.aggregate(sides, F.coalesce("other", "digest"), lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))
    out = rows.select(F.col("id").alias(id_column), F.col("digest").alias("leaf"), "subroot", F.lit(top_value["root"] if top_value else None).cast("string").alias("root"),
                      proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
