"""Merkle manifest of a dataset: a tree of digests per group of rows, a tree over the groups, and a proof per row.

Places first: rows are written in the order of the tree (range partitioning), each
with a number that rises along that order; a small table of what every partition
holds of every group turns the numbers into places 0, 1, 2 ... of the group.

Then slot pivots, level by level: conditional aggregates spread the children of each
parent into `fanout` columns. All columns joined are the parent's content; all but
the own one are the siblings. A parent row keeps its children, so the way down joins
parents alone: every level unfolds its columns into the rows of the next one, each
with the siblings it met so far. No level is joined with all rows.

Digests are lowercase hex of SHA-256; tables hold their bytes. A group of one row has
the row's leaf as its subroot; the last parent of a level may have a single child.

Defined cases: null fields count as `-`, a null group is a group of its own before
all others, a null id comes before all others of its group; rows of one id are
ordered by their leaves, so repeated rows stand side by side and have proofs of their
own; other columns are not read and results of the same name replace them; an empty
table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import packs

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3


def digest(*parts: Column) -> Column:
    """Lowercase hex of the SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Byte count, `:` and value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column] | None = None, fields=FIELDS) -> Column:
    """Digest of a row; `values` stand in for fields."""
    values = values or {}
    return digest(*(field(values.get(name, F.col(name))) for name in fields))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


@dataclass
class Tree:
    """levels[k]: parents k + 1 levels above the leaves (grp, pos, total, node, and what each slot holds)."""

    levels: list[DataFrame]
    lone: DataFrame
    fanout: int

    def tops(self) -> DataFrame:
        """grp, height and node of the top of every group."""
        parts = [self.lone.select("grp", F.lit(0).alias("height"), F.col("row.node").alias("node"))]
        parts += [level.where("total = 1").select("grp", F.lit(k + 1).alias("height"), "node")
                  for k, level in enumerate(self.levels)]
        return reduce(DataFrame.unionByName, parts)


def placed(rows: DataFrame, group: Column, order: list[Column], work: packs.Work) -> DataFrame:
    """All columns, grp (a number that rises with the group), pos (from 0 in its group) and total (rows of the group).

    Whole equal rows are spread by a random number with a seed; they can change places with one another.
    """
    columns = rows.columns
    keyed = rows.withColumns({"_group": group, "_spread": F.rand(1)})
    by = [F.col("_group").asc_nulls_first(), *order, F.col("_spread")]
    sorted_ = keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ordered = work.keep(sorted_.drop("_spread"), "ordered").withColumn("_part", F.shiftright("_at", 33))
    held = ordered.groupBy("_group", "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = work.keep(held.select(
        F.col("_group").alias("_of"), F.col("_part").alias("_in"), "_low", F.min("_low").over(whole).alias("grp"),
        F.sum("_n").over(whole).alias("total"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "spans")
    return ordered.join(spans, ordered["_group"].eqNullSafe(spans["_of"]) & (ordered["_part"] == spans["_in"])).select(
        *columns, "grp", (F.col("_before") + F.col("_at") - F.col("_low")).alias("pos"), "total")


def _parents(children: DataFrame, fanout: int) -> DataFrame:
    """Slot pivot of children (grp, pos, total, row: struct with node and whatever else it carries)."""
    slots = [F.max(F.when(F.col("slot") == s, F.col("row"))).alias(f"slot{s}") for s in range(fanout)]
    spread = children.withColumn("slot", F.pmod("pos", F.lit(fanout))).groupBy(
        "grp", F.expr(f"pos div {fanout}").alias("pos")).agg(F.first("total").alias("below"), *slots)
    content = [F.coalesce(_hex(F.col(f"slot{s}.node")), F.lit("")) for s in range(fanout)]
    return spread.select(
        "grp", "pos", F.ceil(F.col("below") / fanout).cast("bigint").alias("total"),
        F.unhex(digest(*content)).alias("node"), *(f"slot{s}" for s in range(fanout)))


def grown(rows: DataFrame, work: packs.Work, fanout: int = FANOUT) -> Tree:
    """Tree of every group of rows (grp, pos, total, row: struct with `node`, the digest's bytes)."""
    most = rows.agg(F.max("total")).first()[0] or 0
    levels, children = [], rows
    while most > 1:
        level = work.keep(_parents(children.where("total > 1"), fanout), f"level{len(levels) + 1}")
        levels.append(level)
        children = level.select("grp", "pos", "total", F.struct("node").alias("row"))
        most = -(-most // fanout)
    return Tree(levels, rows.where("total = 1").select("grp", "row"), fanout)


def unfolded(tree: Tree, tops: DataFrame) -> DataFrame:
    """grp, row, path and the other columns of `tops` (grp, height, path, ...) for every leaf.

    path: array<struct<before, after>>, the siblings at both sides of each node on the way up.
    """
    carried = [c for c in tops.columns if c not in ("grp", "height", "path")]
    fanout = tree.fanout

    def starting(height):
        return tops.where(F.col("height") == height).select("grp", F.lit(0).cast("bigint").alias("pos"), "path", *carried)

    def child(slot):
        def side(slots):
            return F.concat(F.lit(b""), *(F.coalesce(F.col(f"slot{s}.node"), F.lit(b"")) for s in slots))

        step = F.struct(side(range(slot)).alias("before"), side(range(slot + 1, fanout)).alias("after"))
        return F.struct((F.col("pos") * fanout + slot).alias("pos"), F.col(f"slot{slot}").alias("row"),
                        F.concat(F.array(step), F.col("path")).alias("path"))

    reached = starting(len(tree.levels))
    for height in range(len(tree.levels), 0, -1):
        opened = tree.levels[height - 1].join(reached, ["grp", "pos"]).select(
            "grp", *carried, F.inline(F.filter(F.array(*(child(s) for s in range(fanout))), lambda c: c["row"].isNotNull())))
        if height == 1:
            lone = tree.lone.join(tops.where("height = 0"), "grp").select("grp", *carried, "row", "path")
            return opened.select("grp", *carried, "row", "path").unionByName(lone)
        reached = opened.select("grp", "pos", "path", *carried).unionByName(starting(height - 1))
    return tree.lone.join(tops.where("height = 0"), "grp").select("grp", *carried, "row", "path")


_PATH = "array<struct<before:binary,after:binary>>"


def proof_text(path: Column) -> Column:
    """All siblings of a path in hex, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(_hex(p["before"]), _hex(p["after"]))), "")


def folded(path: Column, leaf_hex: Column) -> Column:
    """Root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf_hex, lambda h, p: digest(_hex(p["before"]), h, _hex(p["after"])))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, group: str = "source", fields=FIELDS,
             fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, changed_leaf, subroot, root (hex) and path of every row.

    changed_leaf is the leaf of the row with `changed` fields (the row's own leaf
    where they leave it as it is), to be folded along the path of the row as it was.
    """
    work = packs.Work(docs.sparkSession, "merkle")
    own = leaf(fields=fields)
    leaves = work.keep(docs.select(
        F.col("doc_id"), F.col(group).alias("source"), F.unhex(own).alias("node"),
        F.unhex(leaf(changed, fields)).alias("other") if changed else F.lit(None).cast("binary").alias("other"),
    ).withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other"))), "leaves")
    at = placed(leaves, F.col("source"), [F.col("doc_id").asc_nulls_first(), F.col("node")], work)
    rows = work.keep(at.select("grp", "pos", "total", F.struct("node", "doc_id", "other").alias("row")), "rows")
    tree = grown(rows, work, fanout)

    # groups rise with `grp`: their tops are the leaves of the tree above
    tops = work.keep(tree.tops(), "tops")
    above = placed(tops.withColumnRenamed("grp", "of"), F.lit(0), [F.col("of")], work).select(
        "grp", "pos", "total", F.struct("node", "of", "height").alias("row"))
    crown = grown(work.keep(above, "groups"), work, fanout)
    peak = work.keep(crown.tops(), "root")
    found = peak.first()
    root = F.unhex(F.lit(bytes(found["node"]).hex())) if found else F.lit(None).cast("binary")
    ways = unfolded(crown, peak.select("grp", "height", F.array().cast(_PATH).alias("path"))).select(
        F.col("row.of").alias("grp"), F.col("row.height").alias("height"), "path", F.col("row.node").alias("subroot"))
    done = unfolded(tree, work.keep(ways, "ways"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), _hex(F.col("row.node")).alias("leaf"),
        _hex(F.coalesce(F.col("row.other"), F.col("row.node"))).alias("changed_leaf"),
        _hex(F.col("subroot")).alias("subroot"), _hex(root).alias("root"), "path")
