"""Conversation prefix trie (operator 13): a node for each distinct beginning of conversations, rolled up by pointer jumping.

A node's key is the digest of its parent's key and its last turn, so a path needs no numbering and equal beginnings meet by
key, whichever task made them. Values are then summed over subtrees in doubling rounds: after round k a node holds the
sum of its descendants nearer than 2^k, and a pointer to its ancestor 2^k above. A round adds the sums of all nodes to
where they point (pre-aggregated before the shuffle, so the root and other popular nodes get one row a task) and doubles
the pointers with a join of the table with itself. Only nodes at least 2^k deep take part in round k, and the
number of rounds is the logarithm of the depth.

Nodes with very many children are looked up with salts (``salted_lookup``). Texts do not move: turns are digests and lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Tables, record_batch, salted_lookup, small_batches

ROOT = bytes(16)
#: Decimal ids are joined to strings of about so many characters before they are dealt by node.
PIECE = 60_000
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv, pos, turn_digest, bytes): turns numbered from 1.

    Turns go by number, those without one first; equal numbers go by the digest of role and text. A null role or text is
    empty. Turns without a conversation are in none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.md5(content.cast("binary")).alias("hex"), F.octet_length(text).cast("long").alias("bytes")
    )
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "hex"))
    return rows.select("conv", place.cast("long").alias("pos"), F.unhex("hex").alias("turn_digest"), "bytes")


def rebuilt(turns: DataFrame, tables: Tables) -> DataFrame:
    """(conv, pos, turn_digest, bytes) of conversations that begin with up to 8 turns of another one.

    Conversation c begins with the first h turns of c - c % 5 (``%`` as in SQL), h being crc32(c) % 9, and goes on with its
    own turns after the first h. A conversation that is lent from lends 8 turns at most to 9 others at most.
    """
    ids = turns.select("conv").distinct().select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("lender"))
    lent = tables.keep(turns.filter("conv % 5 = 0 and pos <= 8").select(F.col("conv").alias("lender"), "pos", "turn_digest", "bytes"), "lent")
    lengths = lent.groupBy("lender").agg(F.max("pos").alias("n"))
    starts = ids.join(lengths, "lender", "left").select("conv", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("start"))
    own = salted_lookup(turns, starts, ["conv"], F.col("pos")).filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("start")).alias("pos"), "turn_digest", "bytes")
    begun = ids.join(lent, "lender").filter("pos <= h").select("conv", "pos", "turn_digest", "bytes")
    return begun.union(own)


_PATH = [("conv", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("ends", pa.bool_())]
PATH = "conv long, depth long, node binary, parent binary, bytes long, ends boolean"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on the path of each conversation, whose turns come together and in order."""
    held: tuple | None = None
    for batch in batches:
        out = []
        for conv, turn, size in zip(*(c.to_pylist() for c in batch.columns)):
            same = held is not None and held[0] == conv
            if held is not None:
                out.append((*held, not same))
            depth, parent = (held[1] + 1, held[2]) if same else (1, ROOT)
            held = (conv, depth, hashlib.blake2b(parent + turn, digest_size=16).digest(), parent, size)
        yield record_batch(_PATH, out)
    if held is not None:
        yield record_batch(_PATH, [(*held, True)])


_PIECES = [("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv) as comma-joined pieces of a node's ids."""
    now, first, ids, size = None, None, [], 0
    for batch in batches:
        out = []
        for node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if node != now or size > PIECE:
                if ids:
                    out.append((now, first, ",".join(ids)))
                now, first, ids, size = node, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield record_batch(_PIECES, out)
    if ids:
        yield record_batch(_PIECES, [(now, first, ",".join(ids))])


_HASHED = [("node", pa.binary()), ("ends_sha256", pa.string())]


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come together and in order."""
    now, sha = None, None
    for batch in batches:
        out = []
        for node, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if node != now:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.encode())
        yield record_batch(_HASHED, out)
    if sha is not None:
        yield record_batch(_HASHED, [(now, sha.hexdigest())])


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int, tables: Tables) -> DataFrame:
    """(node, and for each value the sum over its descendants) of nodes that have any; ``nodes`` are (node, parent, depth, values)."""
    active = nodes.filter("depth >= 1").select("node", F.col("parent").alias("up"), "depth", *values)
    rounds = []
    reach = 1
    while reach <= deepest:
        arrived = tables.keep(active.groupBy("up").agg(*[F.sum(v).alias(v) for v in values]), "arrived")
        rounds.append(arrived)
        if 2 * reach <= deepest:
            gained = arrived.select(F.col("up").alias("node"), *[F.col(v).alias(f"more_{v}") for v in values])
            far = active.filter(F.col("depth") >= 2 * reach).join(gained, "node", "left")
            far = far.select("node", "up", "depth", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
            jumps = active.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            doubled = salted_lookup(far, jumps, ["up"], F.col("node")).select("node", F.col("higher").alias("up"), "depth", *values)
            before, active = active, tables.keep(doubled, "active")
            tables.drop(before)
        reach *= 2
    if not rounds:
        return active.select("node", *values).limit(0)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out.groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(v) for v in values])


def prefix_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, turn, role, text): (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id is the node's smallest member, parent_conv_id its parent's (null at the root), n_leaves the childless nodes of
    its subtree, saved_tokens the sum over its subtree of (n_convs - 1) times the UTF-8 bytes of a node's last text,
    ends_sha256 the digest of the ids of members that end at the node. ``rebuild`` lets conversations begin with turns
    of others first (``rebuilt``). Null roles and texts are empty; turns without number come first; equal turn
    numbers go by digest, repeated rows are turns of their own; turns without conversation are left out. Texts of any
    length count whole. Other columns are not read. An empty table has no nodes, not even a root.
    """
    small_batches()
    tables = Tables(conversations.sparkSession)
    turns = tables.keep(turns_in_order(conversations), "turns")
    ids = turns.select("conv").distinct()
    rows = rebuilt(turns, tables) if rebuild else turns
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "turn_digest", "bytes")
    paths = tables.keep(dealt.mapInArrow(_paths, PATH), "paths")

    root = F.lit(ROOT)
    found = paths.groupBy("node").agg(F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"))
    top = ids.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = top.select(root.alias("node"), "conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), "n_convs")
    bare = tables.keep(found.unionByName(top), "bare")
    kids = bare.filter("depth >= 1").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = bare.join(kids, "node", "left").select(
        "node", "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    nodes = tables.keep(nodes, "nodes")
    tables.drop(bare)

    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below = subtree_sums(nodes, ["n_leaves", "saved_tokens"], deepest, tables)
    below = below.select("node", F.col("n_leaves").alias("leaves_below"), F.col("saved_tokens").alias("saved_below"))

    # Conversations without turns end at the root.
    turnless = ids.join(paths.filter("depth = 1").select("conv"), "conv", "left_anti").select(root.alias("node"), "conv")
    ends = paths.filter("ends").select("node", "conv").union(turnless)
    pieces = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_joined_ids, "node binary, first long, ids string")
    hashed = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_hashed_ids, "node binary, ends_sha256 string")

    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    placed = salted_lookup(nodes.filter("depth >= 1"), parents, ["parent"], F.col("node"))
    placed = placed.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = placed.join(below, "node", "left").join(hashed, "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations, each begun with turns of the one before that five divides."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)
