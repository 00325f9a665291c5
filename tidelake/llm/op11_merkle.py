"""Merkle manifest of a table: aligned blocks of leaves, and a butterfly exchange of their roots.

Leaves are ordered by group and id and cut into aligned blocks of ``fanout ** b``, so a block is
a whole subtree. Blocks then swap roots round by round: in round r the blocks whose numbers agree but
for the digit r (to the base ``fanout``) meet, and every one of them hashes the common
ancestor for itself. After the last round every block holds the root and the siblings on its
way there; no pass from the root downwards is needed and no group is larger than ``fanout``.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1024
# groups are sent to every task up to this number
BROADCAST_GROUPS = 10_000
CHUNK_ROWS = 1024
STEP = "struct<before:string,after:string>"


def node(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_hash(*columns):
    """Digest of a row: each value as its length in bytes, a colon and its text; a null is a hyphen."""
    def field(column):
        text = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(field(F.col(c) if isinstance(c, str) else c) for c in columns)), 256)


def proof_hash(proof):
    """Digest of all siblings of a proof, level by level."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), 256)


def fold(leaf, proof):
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def rounds(nodes, fanout):
    """Levels above so many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def butterfly(rows, most, fanout):
    """(g, p, count, hash, proof) with the hash of the group's root and the proof of each node towards it.

    ``rows`` has a node p of ``count`` in group g with its hash; ``most`` is the largest
    count. Groups are filled up to a power of the fanout with empty nodes, fewer
    than ``fanout`` times as many, that take part in the exchange and stand in for
    partners which a last, partial subtree lacks.
    """
    last = rounds(most, fanout)
    power = F.lit(1).cast("long")
    for r in range(last):
        power = F.when(F.col("count") > fanout ** r, F.lit(fanout ** (r + 1))).otherwise(power)
    real = rows.select("g", "p", "count", "hash", F.array().cast(f"array<{STEP}>").alias("proof"), power.alias("width"))
    empty = real.where("p = 0 AND width > count").select(
        "g", F.explode(F.sequence("count", F.col("width") - 1)).alias("p"), "count", F.lit(None).cast("string").alias("hash"), "proof", "width")
    state = real.unionByName(empty)
    for r in range(last):
        step, up = fanout ** r, fanout ** (r + 1)
        open_ = F.col("width") > step
        place = F.when(open_, F.floor(F.col("p") / up) * step + F.col("p") % step).otherwise(F.col("p"))
        state = state.withColumn("place", place)
        state = state.withColumn("peers", F.sort_array(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("p", "hash"))).over(
            Window.partitionBy("g", "place"))))
        own = F.col("p")
        before = F.concat_ws("", F.transform(F.filter("peers", lambda x: x["p"] < own), lambda x: x["hash"]))
        after = F.concat_ws("", F.transform(F.filter("peers", lambda x: x["p"] > own), lambda x: x["hash"]))
        parent = F.sha2(F.concat_ws("", F.transform("peers", lambda x: x["hash"])), 256)
        state = state.select(
            "g", "p", "count", "width",
            F.when(open_, F.when(F.size("peers") > 0, parent)).otherwise(F.col("hash")).alias("hash"),
            F.when(open_, F.concat("proof", F.array(F.struct(before.alias("before"), after.alias("after"))))).otherwise(
                F.col("proof")).alias("proof"))
    return state.where("p < count").select("g", "p", "count", "hash", "proof")


def ordered(leaves):
    """The leaves with g (number of the group, null first, by bytes), n (leaves of the group) and pos (place in it).

    A range sort over group, id, leaf and row number, so equal ids and repeated rows are cut like any
    others. Places come from the rows that a group has in earlier ranges; groups are numbered in one
    task, one row each.
    """
    order = ["grp", "doc_id", "leaf", "row"]
    rows = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows, "ordered")
    part = F.shiftright("at", 33).alias("part")
    parts = rows.groupBy("grp", part).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("rows"))
    parts = materialize(parts, "ranges")
    groups = parts.groupBy("grp").agg(F.sum("rows").alias("n")).withColumn("g", F.row_number().over(Window.orderBy("grp")) - 1)
    groups = materialize(groups, "groups")
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("low"))
    parts = parts.join(groups.withColumnRenamed("grp", "name"), F.col("grp").eqNullSafe(F.col("name")))
    # a range is one key, so it is cut into pieces that rows look up
    piece = lambda c: F.floor(F.col(c) / CHUNK_ROWS)
    parts = parts.select(F.col("grp").alias("name"), "g", "n", "start", F.explode(F.sequence(piece("low"), piece("high"))).alias("piece"))
    found = rows.join(parts, (piece("at") == F.col("piece")) & F.col("grp").eqNullSafe(F.col("name")))
    return found.withColumn("pos", F.col("at") + F.col("start")).drop("at", "start", "piece", "name", "row"), groups


def levels_of(leaves, levels, count, fanout):
    """The digests of a block, level by level; stops where the whole group has one node left."""
    out = [leaves]
    for _ in range(levels):
        if count == 1:
            break
        below = out[-1]
        out.append([node(below[i:i + fanout]) for i in range(0, len(below), fanout)])
        count = -(-count // fanout)
    return out


def manifest(docs, columns=("doc_id", "source", "lang", "n_chars", "text"), group_col="lang", id_col="doc_id", fanout=2,
             block_rows=BLOCK_ROWS, also=()):
    """doc_id, grp, leaf, subroot, root, proof of every row, and the columns ``also`` (expressions over a row).

    Leaves of a group ascend by id (then by digest; a null id comes first) and every ``fanout`` neighbours
    become a node, the last run too if it is shorter, until one is left: ``subroot``, a lone leaf itself.
    Subroots in the order of groups (null first, by bytes) lead to ``root`` likewise. ``proof`` has, level by
    level, the digests before and after the row's own node in its run, see ``fold``. Nulls have
    a digest of their own, repeated rows are leaves of their own, an empty table gives no
    rows, and columns not named are not read.
    """
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    inner = 0
    while fanout ** (inner + 1) <= block_rows:
        inner += 1
    size = fanout ** inner
    names = [f"also_{i}" for i in range(len(also))]
    extra = [c.alias(n) for c, n in zip(also, names)]
    leaves = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("grp"),
                         leaf_hash(*columns).alias("leaf"), F.monotonically_increasing_id().alias("row"), *extra)
    placed, groups = ordered(materialize(leaves, "leaves"))
    placed = materialize(placed.withColumn("block", F.floor(F.col("pos") / size)), "placed")

    def column(table, name):
        return table.column(name).to_pylist()

    def root_of(key, table):
        table, n = table.sort_by("pos"), table.column("n")[0].as_py()
        tree = levels_of(column(table, "leaf"), inner, n, fanout)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "p": [key[1].as_py()], "count": [-(-n // size)], "hash": tree[-1]})

    roots = placed.select("g", "block", "pos", "n", "leaf").groupBy("g", "block").applyInArrow(root_of, "g int, p long, count long, hash string")
    most = groups.agg(F.max("n"), F.count("*")).first()
    blocks = materialize(butterfly(materialize(roots, "block-roots"), -(-(most[0] or 0) // size), fanout), "block-proofs")
    tops = blocks.where("p = 0").select(F.lit(0).alias("g"), F.col("g").cast("long").alias("p"), F.lit(most[1]).cast("long").alias("count"), "hash")
    tops = butterfly(tops, most[1], fanout).select(F.col("p").cast("int").alias("g"), F.col("hash").alias("root"), F.col("proof").alias("rest"))
    tops = materialize(tops, "group-proofs")
    blocks = blocks.join(F.broadcast(tops) if most[1] <= BROADCAST_GROUPS else tops, "g").select(
        "g", F.col("p").alias("block"), F.col("hash").alias("subroot"), "root", F.concat("proof", "rest").alias("proof"))

    def prove(key, table, found):
        table, n = table.sort_by("pos"), table.column("n")[0].as_py()
        tree = levels_of(column(table, "leaf"), inner, n, fanout)
        upper = column(found, "proof")[0]
        up_before, up_after = [s["before"] for s in upper], [s["after"] for s in upper]
        before, after = [], []
        for i in range(len(tree[0])):
            at = i
            for level in tree[:-1]:
                low = at - at % fanout
                before.append("".join(level[low:at]))
                after.append("".join(level[at + 1:low + fanout]))
                at //= fanout
            before += up_before
            after += up_after
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        length = len(tree) - 1 + len(upper)
        proof = pa.ListArray.from_arrays(pa.array(np.arange(table.num_rows + 1, dtype=np.int32) * length), steps)
        both = {c: pa.array(column(found, c) * table.num_rows, pa.string()) for c in ("subroot", "root")}
        return pa.table({c: table.column(c) for c in ("doc_id", "grp", "leaf")} | both | {"proof": proof}
                        | {c: table.column(c) for c in names})

    kinds = "".join(f", {c} {placed.schema[c].dataType.simpleString()}" for c in names)
    proved = placed.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(
        prove, f"doc_id long, grp string, leaf string, subroot string, root string, proof array<{STEP}>{kinds}")
    return proved
