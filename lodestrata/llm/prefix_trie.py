"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

1. Turns become narrow rows (SHA-256 of role and text, bytes of the text); texts are not shuffled.
   They are range partitioned by conversation and order, written once, and get their place from the
   place in the partition plus what earlier partitions hold of the conversation, so that a
   conversation with a third of all turns lies in many tasks.
2. A rebuilt conversation is the head of its base (at most 8 turns a conversation, one equi join) and its own rest.
3. The key of a prefix is the exclusive-or of 128 bits of SHA-256 over (place, turn). It is a running
   aggregate, so long conversations are cut into blocks whose totals are carried over; and the parent's key is
   the key without the own turn. Nodes are one aggregate on that key, combined before the shuffle. From then
   on a node is called (smallest member, depth), which is unique.
4. Totals of subtrees come from tree contraction. A round rakes and compresses:
   rake: a node without children hands its sum to its parent and is done;
   compress: a node with one child is spliced out of its chain if its coin shows heads and its parent's shows
   tails (coins are hashes of the node and the round, so no two neighbours go). Its sum goes to its
   parent, its child moves up. A chain of any length loses a quarter of its nodes a round.
   What is left shrinks geometrically, so the rounds grow with the logarithm of the number of nodes.
   Then the rounds are gone back through: total of a spliced node = its sum then + total of its child then.
5. Ids of the conversations that end in a node are range partitioned in order, joined to pieces of ``PIECE`` ids,
   and hashed piece after piece as they stream by; no list of a node is ever held.

Each round writes two tables, which later ones read: a lost executor repeats its own tasks only.
Nothing but one emptiness test a round comes to the driver.

Defined cases: rows with a null conv_id take no part; null turns come first; turns with equal
numbers are ordered by role and text (first 64 characters of each, then SHA-256), repeated rows are turns of
their own; null roles and texts are empty; a remainder has the sign of its number; an empty
table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import discard, saved, table

#: A conversation takes its first ``crc32 % HEADS`` turns from that whose number is the next multiple of ``FAMILY`` below.
FAMILY = 5
HEADS = 9
#: Turns of a conversation that one window orders.
BLOCK = 4096
#: Ids joined into one row before they are hashed.
PIECE = 256


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % F.lit(HEADS)


def _lanes(*parts: Column) -> list[Column]:
    """128 bits of SHA-256 as two longs."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(2)]


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written turns (conv_id, part, at, digest, bytes) in order, and for each (conv_id, part) the first ``at`` and the turns before it."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("n"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "r", "t", "digest"]
    turns = saved(narrow.repartitionByRange(*order, "n").sortWithinPartitions(*order)
                  .select("conv_id", "digest", "bytes", F.monotonically_increasing_id().alias("at"))
                  .withColumn("part", F.shiftright("at", 33)), "turns")
    parts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # At most one row per range partition and conversation.
    earlier = Window.partitionBy("conv_id").orderBy("part")
    return turns, saved(parts.select("conv_id", "part", "first", (F.sum("n").over(earlier) - F.col("n")).alias("before"),
                                     F.sum("n").over(Window.partitionBy("conv_id")).alias("turns")), "parts")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, bytes) of all rebuilt turns, depth from 1, and (conv_id, length) of all conversations."""
    turns, parts = placed_turns(conversations)
    lengths = parts.select("conv_id", "turns").distinct()
    base = F.col("conv_id") - F.col("conv_id") % F.lit(FAMILY)
    wanted = lengths.select("conv_id", "turns", head_length(F.col("conv_id")).alias("h"), base.alias("base"))
    whole = lengths.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = saved(wanted.join(whole, "base", "left")
                  .withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0)).cast("long"))), "convs")
    # The place is joined per (conversation, range partition): no more rows of a key than a partition has.
    where = parts.select("conv_id", "part", "first", "before").join(convs.select("conv_id", "h", "head"), "conv_id")
    placed = saved(turns.join(where, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "h", "head", "digest", "bytes"), "placed")
    own = placed.filter("place >= h").select("conv_id", (F.col("head") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    heads = placed.filter(F.col("place") < HEADS - 1).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    taken = (convs.filter("head > 0").select("conv_id", "base", "head").join(heads, "base").filter("place < head")
             .select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes"))
    length = F.col("head") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    return own.unionByName(taken), convs.select("conv_id", length.alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the keys (k0, k1) of the prefix that ends with the turn and (u0, u1) of the one before it."""
    lanes = _lanes(F.col("depth"), F.col("digest"))
    rows = saved(turns.select("conv_id", "depth", "bytes", F.floor((F.col("depth") - 1) / F.lit(BLOCK)).cast("long").alias("block"),
                              *[x.alias(f"x{i}") for i, x in enumerate(lanes)]), "turn_keys")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select("*", *[F.bit_xor(f"x{i}").over(inside).alias(f"r{i}") for i in range(2)])
    long = rows.filter("block > 0").select("conv_id").distinct()
    totals = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", *[F.bit_xor(f"x{i}").over(earlier).alias(f"c{i}") for i in range(2)]).filter("block > 0")
    key = [F.col(f"r{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in range(2)]
    return (running.join(carried, ["conv_id", "block"], "left")
            .select("conv_id", "depth", "bytes", *[k.alias(f"k{i}") for i, k in enumerate(key)],
                    *[k.bitwiseXOR(F.col(f"x{i}")).alias(f"u{i}") for i, k in enumerate(key)]))


def trie(keyed: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes: depth, k0, k1, conv_id, parent_conv_id, n_convs, n_children, own (tokens saved by the node itself)."""
    found = keyed.groupBy("depth", "k0", "k1").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                                   *[F.max(c).alias(c) for c in ("u0", "u1", "bytes")])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k0"), zero.alias("k1"), "conv_id", "n_convs", none.alias("u0"), none.alias("u1"), zero.alias("bytes"))
    nodes = saved(found.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("u0"), F.col("k1").alias("u1"), F.col("conv_id").alias("parent_conv_id"))
    joined = saved(nodes.join(above, ["depth", "u0", "u1"], "left").select(
        "depth", "k0", "k1", "conv_id", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")), "joined")
    children = (joined.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    out = saved(joined.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "trie")
    discard(nodes)
    discard(joined)
    return out


SUMS = ("n_leaves", "saved_tokens")


def _heads(node: list[str], turn: int) -> Column:
    return F.xxhash64(F.lit(turn), *node).bitwiseAND(1) == 1


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(c, d, n_leaves, saved_tokens) of the subtree of every node.

    ``nodes`` has a node (c, d), its parent (pc, pd), null for a root, its number of children ``kids``, and its own
    n_leaves and saved_tokens. There may be several trees.
    """
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    live = saved(nodes.select("c", "d", "pc", "pd", "kids", *SUMS), "live")
    history, turn = [], 0
    while True:
        # Rake.
        handed = (live.filter("kids = 0 AND pc IS NOT NULL").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d"))
                  .agg(F.count(F.lit(1)).alias("gone"), *[F.sum(s).alias(f"h_{s}") for s in SUMS]))
        inner = saved(live.filter("kids > 0").join(handed, ["c", "d"], "left").select(
            "c", "d", "pc", "pd", (F.col("kids") - zero("gone")).alias("kids"), *[(F.col(s) + zero(f"h_{s}")).alias(s) for s in SUMS]), "inner")
        if inner.isEmpty():
            discard(inner)
            break
        # Compress.
        goes = (F.col("kids") == 1) & F.col("pc").isNotNull() & _heads(["c", "d"], turn) & ~_heads(["pc", "pd"], turn)
        marked = inner.withColumn("goes", F.coalesce(goes, F.lit(False)))
        spliced = marked.filter("goes").select(F.col("c").alias("pc"), F.col("d").alias("pd"), F.col("pc").alias("up_c"),
                                               F.col("pd").alias("up_d"), *[F.col(s).alias(f"v_{s}") for s in SUMS])
        passed = (marked.filter("goes").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d"))
                  .agg(*[F.sum(s).alias(f"h_{s}") for s in SUMS]))
        after = saved(marked.filter("NOT goes").join(passed, ["c", "d"], "left").join(spliced, ["pc", "pd"], "left").select(
            "c", "d", F.coalesce("up_c", "pc").alias("pc"), F.coalesce("up_d", "pd").alias("pd"), "kids",
            *[(F.col(s) + zero(f"h_{s}")).alias(s) for s in SUMS],
            F.when(F.col("up_c").isNotNull(), F.struct(F.col("pc").alias("c"), F.col("pd").alias("d"),
                                                       *[F.col(f"v_{s}").alias(s) for s in SUMS])).alias("out")), "after")
        discard(inner)
        history.append((live, after))
        live, turn = after, turn + 1
    leaves = lambda alive: alive.filter("kids = 0").select("c", "d", *SUMS)
    totals = saved(leaves(live), "totals")
    for before, after in reversed(history):
        # ``totals`` has every node of ``after``; a spliced node stands in the row of its child.
        child = after.filter("out IS NOT NULL").select("c", "d", "out")
        back = child.join(totals, ["c", "d"]).select("out.c", "out.d", *[(F.col(f"out.{s}") + F.col(s)).alias(s) for s in SUMS])
        wider = saved(totals.unionByName(back).unionByName(leaves(before)), "totals")
        discard(totals)
        discard(after)
        totals = wider
    discard(history[0][0] if history else live)
    return totals


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined, ascending conv_ids of each (depth, k0, k1)."""
    node = ["depth", "k0", "k1"]

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def close():
            if ids:
                rows.append((*key, ids[0], ",".join(map(str, ids))))
                ids.clear()
        names = [*node, "first", "ids"]
        for batch in batches:
            for *at, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if at != key or len(ids) >= PIECE:
                    close()
                    key = at
                ids.append(conv)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=PIECES)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=PIECES)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []
        flush = lambda: pa.RecordBatch.from_pylist(rows, schema=DIGESTS)
        for batch in batches:
            for *at, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if at != key:
                    if key:
                        rows.append({**dict(zip(node, key)), "ends_sha256": state.hexdigest()})
                    key, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield flush()
                rows.clear()
        if key:
            rows.append({**dict(zip(node, key)), "ends_sha256": state.hexdigest()})
            yield flush()

    ordered = ends.select(*node, "conv_id").repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    joined = saved(ordered.mapInArrow(pieces, "depth long, k0 long, k1 long, first long, ids string"), "pieces")
    return (joined.repartition(*[F.col(c) for c in node]).sortWithinPartitions(*node, "first")
            .mapInArrow(digests, "depth long, k0 long, k1 long, ends_sha256 string"))


_NODE = [("depth", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64())]
PIECES = pa.schema([*_NODE, ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([*_NODE, ("ends_sha256", pa.string())])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes with their totals; see the module's text."""
    turns, convs = rebuilt_turns(conversations)
    keyed = saved(prefixes(turns), "prefixes")
    nodes = trie(keyed, convs)
    last = keyed.join(convs.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("depth", "k0", "k1", "conv_id")
    zero = F.lit(0).cast("long")
    none = convs.filter("length = 0").select(zero.alias("depth"), zero.alias("k0"), zero.alias("k1"), "conv_id")
    ends = saved(end_digests(last.unionByName(none)), "ends")
    totals = subtree_totals(nodes.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"),
        F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"), F.col("n_children").alias("kids"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens")))
    empty = hashlib.sha256(b"").hexdigest()
    return (nodes.join(totals.withColumnsRenamed({"c": "conv_id", "d": "depth"}), ["conv_id", "depth"])
            .join(ends, ["depth", "k0", "k1"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# A node's subtree: the nodes whose smallest member is one of the node's members, at its depth or below.
ORACLE = f"""WITH turns AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 64), left(coalesce(text, ''), 64),
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text FROM (
    SELECT c.conv_id, 0 AS own, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND place < h
    UNION ALL SELECT c.conv_id, 1, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place >= h)),
paths AS MATERIALIZED (
  SELECT conv_id, depth, text, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '')
    OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '' FROM convs),
nodes AS MATERIALIZED (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS own
  FROM paths GROUP BY depth, k),
family AS MATERIALIZED (SELECT n.*, p.k AS parent_k, q.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
  LEFT JOIN nodes q ON q.depth = p.depth AND q.k = p.k),
children AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n_children FROM family WHERE depth > 0 GROUP BY ALL),
counted AS MATERIALIZED (SELECT f.*, coalesce(n_children, 0) AS n_children FROM family f LEFT JOIN children USING (depth, k)),
totals AS (SELECT p.depth, p.k, sum((x.n_children = 0)::BIGINT) AS n_leaves, sum(x.own) AS saved_tokens
  FROM counted x JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY ALL),
ends AS (SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM paths SEMI JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id) USING (conv_id, depth) GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted JOIN totals USING (depth, k) LEFT JOIN ends USING (depth, k)"""
