r"""Merkle manifest of a dataset: subtrees per group, one root, proofs and checks.

A leaf is the sha256 of a row's fields, each ``-`` if null, else its UTF-8 byte count,
``:`` and its value.  Inside a group leaves ascend by the key; every ``fanout``
consecutive nodes (the last run may be shorter, even one) become their parent, the
sha256 of their digests (hex text), until one node is left: the subroot.  Subroots in
group order (null first, then UTF-8 bytes) are joined to the root the same way.

*Sibling shift.*  Each level is a table (group, idx, digest).  It equijoins itself once
for every slot offset: with idx XOR 1 if ``fanout`` is 2, else with the node of the
same run that many slots on, around its end.  A node then knows the digests before and
after it in its run; the rows of slot zero emit the parents.  Nothing is gathered per
group, so a group may hold any share of all rows.

*Proofs* go down again: a node's path is its own siblings, then its parent's path, one
equijoin a level, each parent meeting at most ``fanout`` children.  Levels are written
to the shared folder, so a lost executor costs a re-read.  A row's index comes from its
range partition: counts per (partition, group), prefix sums over partitions, and a row
number inside; texts are hashed where they are read and never moved.

Defined cases: a null key sorts first and is ``-`` in the leaf; null groups are one
group; equal keys ascend by leaf digest, exact repeats are leaves each; empty texts are
``0:``; a lone leaf is its group's subroot, a lone subroot the root; an empty table has
no rows and no root (null); other columns are ignored and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import shuffle_partitions, stored

_PATH = "array<struct<b:string,a:string>>"
_STORE_EVERY = 3  # levels of the way down in one job


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    """sha256 of the fields of a row, as lowercase hex."""
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _group_key(c: Column) -> Column:
    """A group's name that is never null and sorts nulls first."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx (from 0, inside g, by ``order``) and n (rows of g)."""
    rows = stored(rows.withColumn("nth", F.monotonically_increasing_id()), "merkle-rows")
    key = ["g", *order, "nth"]
    parts = stored(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *key)
                   .withColumn("part", F.spark_partition_id()), "merkle-parts")
    by_group = Window.partitionBy("pg").orderBy("ppart")
    bases = (parts.groupBy(F.col("part").alias("ppart"), F.col("g").alias("pg")).agg(F.count(F.lit(1)).alias("c"))
             .select("ppart", "pg", F.coalesce(F.sum("c").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
                     F.sum("c").over(Window.partitionBy("pg")).alias("n")))
    inside = Window.partitionBy("part", "g").orderBy(*key)
    return (parts.withColumn("nr", F.row_number().over(inside))
            .join(bases, (F.col("part") == F.col("ppart")) & (F.col("g") == F.col("pg")))
            .withColumn("idx", F.col("base") + F.col("nr") - 1).drop("part", "ppart", "pg", "nr", "base", "nth"))


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds before and after: the digests of the run's other nodes, left and right of each node."""
    slot = F.pmod("idx", F.lit(fanout))
    out, found = nodes, []
    for o in range(1, fanout):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + F.pmod(slot + o, F.lit(fanout))
        other = nodes.select(F.col("g").alias(f"g{o}"), F.col("idx").alias(f"i{o}"), F.col("h").alias(f"h{o}"))
        out = (out.withColumn(f"at{o}", at)
               .join(other, (F.col("g") == F.col(f"g{o}")) & (F.col(f"at{o}") == F.col(f"i{o}")), "left"))
        found.append(F.struct(F.col(f"at{o}").alias("at"), F.col(f"h{o}").alias("h")))
    run = F.array_sort(F.filter(F.array(*found), lambda s: s["h"].isNotNull()))
    side = lambda keep: F.concat_ws("", F.transform(F.filter(run, keep), lambda s: s["h"]))
    return out.select(*nodes.columns, side(lambda s: s["at"] < F.col("idx")).alias("before"),
                      side(lambda s: s["at"] > F.col("idx")).alias("after"))


def levels(leaves: DataFrame, fanout: int = 2) -> list[DataFrame]:
    """Tables (g, idx, n, h, before, after) from the leaves up; n nodes of the group are at that level.

    ``leaves``: (g, idx, n, h).  A group ends at the level where its n is 1.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    out, nodes = [], leaves.select("g", "idx", "n", "h")
    while True:
        table = stored(_with_siblings(nodes, fanout), "merkle-level")
        out.append(table)
        if most <= 1:
            return out
        nodes = (table.where((F.pmod("idx", F.lit(fanout)) == 0) & (F.col("n") > 1))
                 .select("g", F.expr(f"idx div {fanout}").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"),
                         F.sha2(F.concat("h", "after"), 256).alias("h")))
        most = -(-most // fanout)


def paths(tree: list[DataFrame], tops: DataFrame | None, fanout: int = 2) -> DataFrame:
    """(g, idx, top, path): for every leaf its group's last node and the siblings on the way there.

    ``tops`` (tg, tpath) goes on with the path beyond the last node of each group.
    """
    down = None
    for k, table in enumerate(reversed(tree)):
        last = table.where("n = 1").select("g", "idx", F.col("h").alias("top"))
        if tops is not None:
            last = last.join(tops, F.col("g") == F.col("tg"), "left").drop("tg")
        else:
            last = last.withColumn("tpath", F.array().cast(_PATH))
        here = last.select("g", "idx", "top", F.col("tpath").alias("path"))
        if down is not None:
            up = down.select(F.col("g").alias("ug"), F.col("idx").alias("uidx"), "top", F.col("path").alias("rest"))
            here = here.unionByName(
                table.where("n > 1").withColumn("up", F.expr(f"idx div {fanout}"))
                .join(up, (F.col("g") == F.col("ug")) & (F.col("up") == F.col("uidx")))
                .select("g", "idx", "top", F.concat(F.array(F.struct(F.col("before").alias("b"), F.col("after").alias("a"))), "rest").alias("path")))
        down = stored(here, "merkle-paths") if k % _STORE_EVERY == _STORE_EVERY - 1 and k < len(tree) - 1 else here
    return down


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["b"], h, p["a"]), 256))


def proof(path: Column) -> Column:
    """sha256 of the siblings of all levels, left to right, from the leaf up."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["b"], p["a"]))), 256)


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", fanout: int = 2,
             claimed: list[Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per document: key, leaf, claim, subroot, root, path.

    ``claim`` is the leaf of the values to be checked: the columns ``claimed`` in place
    of ``fields`` for the rows ``where`` says so, else the leaf itself.
    ``fold(claim, path)`` equals the root if and only if they are the document's.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    other = F.lit(None).cast("string") if claimed is None else F.when(F.lit(True) if where is None else where, leaf(claimed))
    rows = docs.select(F.col(key).alias("id"), _group_key(F.col(group)).alias("g"), leaf([F.col(c) for c in fields]).alias("h"), other.alias("claim"))
    ranked = stored(_ranked(rows, ["id", "h"]), "merkle-leaves")
    tree = levels(ranked, fanout)
    ends = None
    for table in tree:
        part = table.where("n = 1").select(F.col("g").alias("name"), "h")
        ends = part if ends is None else ends.unionByName(part)
    subroots = stored(_ranked(ends.withColumn("g", F.lit("")), ["name"]), "merkle-subroots")  # one row per group
    top = levels(subroots, fanout)
    root = top[-1].where("n = 1").select("h").first()  # one row
    over = paths(top, None, fanout).select("idx", "path").join(subroots.select("name", F.col("idx").alias("i")), F.col("idx") == F.col("i"))
    down = paths(tree, stored(over.select(F.col("name").alias("tg"), F.col("path").alias("tpath")), "merkle-tops"), fanout)
    down = down.select(F.col("g").alias("dg"), F.col("idx").alias("di"), F.col("top").alias("subroot"), "path")
    return (ranked.join(down, (F.col("g") == F.col("dg")) & (F.col("idx") == F.col("di")))
            .select(F.col("id").alias(key), F.col("h").alias("leaf"), F.coalesce("claim", "h").alias("claim"), "subroot",
                    F.lit(root[0] if root else None).cast("string").alias("root"), "path"))
