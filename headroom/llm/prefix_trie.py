"""Prefix trie of conversations by hashes of blocks of turns.

Conversations are cut into blocks of four turns. A prefix has a digest of 128 bits, the exclusive or of hashes of its turns
with their places, so digests at block ends follow from running totals over blocks and not from a chain that one
task would have to walk. Conversations are grouped by the digests before and after each block. Where
all members of a group go on with the same block, the turn boundaries inside it have the same members: they are read off
one of them. Only where siblings diverge are the blocks opened, and turn by turn grouped again.

Every node belongs to its smallest member, and the nodes of one conversation are the last ones of its path. Sums over a
subtree are therefore sums over the members of its top, of what their own nodes hold, less what the
owner's nodes above the top hold: two groupings, whatever the depth. Texts are hashed once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom.operators import ordering
from headroom.session import settle

BLOCK = 4
SHARING, MOST_SHARED = 5, 9  # the rebuild takes its head from a neighbour in the same five ids, fewer than nine turns
IDS_IN_ROW = 4096
_NO_IDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, rows: int = ordering.ROWS_PER_TASK) -> DataFrame:
    """``conv_id, position, n, h1, h2, bytes``: hashes of role and text of each turn, by turn, null first.

    Null role and text are empty. Equal turn numbers come in the order of their hashes, repeated rows are
    turns of their own. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    least = conversations.agg(F.min(F.col("turn").cast("long"))).first()[0] or 0
    coarse = F.coalesce(F.shiftright("turn", 2), F.lit((least >> 2) - 1))  # spans of any numbers fit a long
    placed = ordering.with_position(turns.withColumn("at", coarse), series=["conv_id"], order="at", tie=["turn", "h1", "h2"], rows=rows)
    return settle(placed.select("conv_id", F.col("rn").alias("position"), "n", "h1", "h2", "bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations whose first ``h`` turns are those of the first id of their five, and all ids.

    ``h`` is the checksum of the id modulo 9. Both results are written: turns as by ``ordered_turns``, and ``conv_id, n``.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).alias("h")
    first = (F.col("conv_id") - F.col("conv_id") % SHARING).alias("first")
    ids = turns.where("position = 1").select("conv_id", F.col("n").alias("own_n"), first, h)
    lengths = ids.select(F.col("conv_id").alias("first"), F.col("own_n").alias("first_n"))
    known = ids.join(lengths, "first", "left").withColumn("head", F.least("h", F.coalesce("first_n", F.lit(0))))
    known = settle(known.withColumn("new_n", F.col("head") + F.greatest(F.lit(0), F.col("own_n") - F.col("h"))))
    what = ["h1", "h2", "bytes"]
    shared = turns.where(F.col("position") < MOST_SHARED).withColumnRenamed("conv_id", "first")
    heads = known.select("conv_id", "first", "head", "new_n").join(shared, "first").where("position <= head")
    tails = turns.join(known.select("conv_id", "h", "head", "new_n"), "conv_id").where("position > h")
    tails = tails.withColumn("position", F.col("head") + F.col("position") - F.col("h"))
    columns = ["conv_id", "position", F.col("new_n").alias("n"), *what]
    return settle(heads.select(*columns).unionByName(tails.select(*columns))), known.select("conv_id", F.col("new_n").alias("n"))


def _running_digest(blocks: DataFrame, longest: int, rows: int) -> DataFrame:
    """``p1, p2`` before and ``q1, q2`` after each block; conversations of many blocks in chunks."""
    chunked = blocks.withColumn("chunk", F.expr(f"block div {rows}L"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    found = chunked.withColumns({"q1": F.bit_xor("x1").over(inside), "q2": F.bit_xor("x2").over(inside)})
    if longest // BLOCK >= rows:
        ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        totals = chunked.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("a1"), F.bit_xor("x2").alias("a2"))
        totals = totals.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(a).over(ahead), F.lit(0)).alias(a) for a in ("a1", "a2")])
        found = found.join(totals, ["conv_id", "chunk"])
        found = found.withColumns({q: F.col(q).bitwiseXOR(F.col(a)) for q, a in (("q1", "a1"), ("q2", "a2"))})
    return found.withColumns({p: F.col(q).bitwiseXOR(F.col(x)) for p, q, x in (("p1", "q1", "x1"), ("p2", "q2", "x2"))})


def _blocks(turns: DataFrame, longest: int, rows: int) -> DataFrame:
    """One row per conversation and block, with its few turns and the digests around it."""
    mixed = turns.withColumns(
        {"m1": F.xxhash64("position", "h1", "h2"), "m2": F.xxhash64(F.lit(2), "h2", "position", "h1"), "block": F.expr(f"(position - 1) div {BLOCK}")}
    )
    blocks = mixed.groupBy("conv_id", "block").agg(
        F.bit_xor("m1").alias("x1"),
        F.bit_xor("m2").alias("x2"),
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("position", "m1", "m2", "bytes"))).alias("turns"),
    )
    last = (F.col("block") == F.expr(f"(n - 1) div {BLOCK}")).alias("last")
    return _running_digest(blocks, longest, rows).select("conv_id", "block", "p1", "p2", "q1", "q2", last, "turns")


def _grouped(blocks: DataFrame) -> DataFrame:
    """Blocks with ``least, members, together``: of the conversations that share what comes before the block.

    All conversations share the empty prefix, so the first blocks meet as numbers, not as one group of a join.
    """
    same = (F.min("q1") == F.max("q1")) & (F.min("q2") == F.max("q2"))
    facts = [F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("members"), same.alias("together")]
    later = blocks.where("block > 0")
    joined = later.join(later.groupBy("block", "p1", "p2").agg(*facts), ["block", "p1", "p2"])
    first = blocks.where("block = 0").agg(*facts).first()
    starts = blocks.where("block = 0").withColumns(
        {"least": F.lit(first["least"]).cast("long"), "members": F.lit(first["members"]).cast("long"), "together": F.lit(first["together"]).cast("boolean")}
    )
    return settle(joined.unionByName(starts))


def _opened(blocks: DataFrame, *columns: str) -> DataFrame:
    """One row per turn of the blocks: ``depth``, digests ``k1, k2`` up to it and ``up1, up2`` before it, ``bytes``."""

    def upto(p: str, m: str, i: Column) -> Column:
        return F.aggregate(F.slice("turns", F.lit(1), i + 1), F.col(p), lambda digest, t: digest.bitwiseXOR(t[m]))

    keyed = F.transform(
        "turns",
        lambda t, i: F.struct(
            t["position"].alias("depth"), t["bytes"].alias("bytes"), t["m1"].alias("m1"), t["m2"].alias("m2"), upto("p1", "m1", i).alias("k1"), upto("p2", "m2", i).alias("k2")
        ),
    )
    rows = blocks.select("conv_id", *columns, F.explode(keyed).alias("t")).select("conv_id", *columns, "t.*")
    return rows.withColumns({"up1": F.col("k1").bitwiseXOR(F.col("m1")), "up2": F.col("k2").bitwiseXOR(F.col("m2"))}).drop("m1", "m2")


def _nodes(blocks: DataFrame) -> DataFrame:
    """Nodes below the root. ``g0, g1, g2`` name the group whose members they have: a block's, or their own."""
    agreed = _opened(blocks.where("together AND conv_id = least"), "block", "p1", "p2", "members")
    agreed = agreed.withColumnsRenamed({"block": "g0", "p1": "g1", "p2": "g2", "members": "n_convs"})
    apart = _opened(blocks.where("NOT together")).groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "bytes", "up1", "up2")],
    )
    apart = apart.withColumns({"g0": F.lit(-1).cast("long"), "g1": F.col("k1"), "g2": F.col("k2")})
    nodes = agreed.unionByName(apart).withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes"))
    children = nodes.groupBy(F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = settle(nodes).join(children, ["k1", "k2"], "left")
    return settle(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def _owned_above(nodes: DataFrame, longest: int, rows: int) -> DataFrame:
    """``above``: what the owner's nodes higher up weigh."""
    if longest > rows:
        summed = ordering.running_total(nodes.withColumn("rn", F.col("depth")), F.col("weight"), "through", series=["conv_id"], rows=rows)
        return summed.withColumn("above", F.col("through") - F.col("weight")).drop("through", "rn")
    before = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("above", F.coalesce(F.sum("weight").over(before), F.lit(0)))


def _group_sums(blocks: DataFrame, shares: DataFrame) -> DataFrame:
    """``g0, g1, g2, inside, leaves``: what the members of each group own, as far as any of them owns a node."""
    shared = blocks.join(shares, "conv_id")
    whole = shared.where("together").select(F.col("block").alias("g0"), F.col("p1").alias("g1"), F.col("p2").alias("g2"), "own", "leaf")
    parts = _opened(shared.where("NOT together"), "own", "leaf").select(F.lit(-1).cast("long").alias("g0"), F.col("k1").alias("g1"), F.col("k2").alias("g2"), "own", "leaf")
    return whole.unionByName(parts).groupBy("g0", "g1", "g2").agg(F.sum("own").alias("inside"), F.sum("leaf").alias("leaves"))


def _digests_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by node and place; a node's digest goes on over its rows, so no list is held whole."""
    names, now, digest = ["k1", "k2", "ends_sha256"], None, None
    for batch in batches:
        done = []
        for key, ids in zip(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()), batch.column("ids").to_pylist()):
            if key != now:
                if digest is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, digest.hexdigest())], names)


def _ends(blocks: DataFrame, conversations: DataFrame, rows: int) -> DataFrame:
    """``k1, k2, ends_sha256`` of nodes where conversations end; a node's ids travel in rows of some thousand."""
    ends = blocks.where("last").select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), "conv_id")
    none = F.lit(0).cast("long")
    ends = ends.unionByName(conversations.where("n = 0").select(none.alias("k1"), none.alias("k2"), "conv_id"))
    ends = ends.withColumn("at", F.shiftright("conv_id", 2))
    placed = ordering.with_position(ends, series=["k1", "k2"], order="at", tie=["conv_id"], rows=rows)
    row = F.expr(f"(rn - 1) div {IDS_IN_ROW}")
    listed = placed.groupBy("k1", "k2", row.alias("row")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    listed = listed.select("k1", "k2", "row", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    listed = listed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "row")
    return listed.mapInArrow(_digests_of_ids, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, rows: int = ordering.ROWS_PER_TASK) -> DataFrame:
    """Nodes of the trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` are as by ``ordered_turns``, written; ``conversations`` has ``conv_id, n``, each id once, those without turns included.
    A node is known by its smallest member and its depth. ``n_leaves`` and ``saved_tokens`` cover the subtree with its top,
    ``saved_tokens`` being the bytes of last texts that all members but one repeat. No conversation, no node, not even a root.
    """
    total = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.max("n").alias("longest")).first()
    longest = total["longest"] or 0
    blocks = _grouped(settle(_blocks(turns, longest, rows)))
    nodes = _nodes(blocks)
    own = nodes.groupBy("conv_id").agg(F.sum("weight").alias("own"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    shares = settle(own)
    sums = _group_sums(blocks, shares)
    ends = settle(_ends(blocks, conversations, rows))

    found = _owned_above(nodes, longest, rows).join(sums, ["g0", "g1", "g2"], "left")
    owners = nodes.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent"))
    least = F.lit(total["least"]).cast("long")
    deeper = found.where("depth > 1").join(owners, ["up1", "up2"])
    found = deeper.unionByName(found.where("depth = 1").withColumn("parent", least))
    found = found.join(ends, ["k1", "k2"], "left").select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("inside") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_IDS)).alias("ends_sha256"),
    )
    whole = shares.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("own"), F.coalesce(F.sum("leaf"), F.lit(1)).alias("leaf"))
    here = ends.where("k1 = 0 AND k2 = 0").agg(F.coalesce(F.max("ends_sha256"), F.lit(_NO_IDS)).alias("ends_sha256"))
    below = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    if not total["n"]:
        return found
    top = {**whole.first().asDict(), **here.first().asDict(), **below.first().asDict()}  # one row of numbers each
    root = turns.sparkSession.range(1).select(
        least.alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(total["n"]).cast("long").alias("n_convs"),
        F.lit(top["n_children"]).cast("long").alias("n_children"),
        F.lit(top["leaf"]).cast("long").alias("n_leaves"),
        F.lit(top["own"]).cast("long").alias("saved_tokens"),
        F.lit(top["ends_sha256"]).alias("ends_sha256"),
    )
    return found.unionByName(root)
