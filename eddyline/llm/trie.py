"""The trie of conversations' prefixes by SQL's ROLLUP.

A conversation's turns, each a digest of role and text with its number of words, stand in ``BLOCK`` positional columns, and one
ROLLUP over them aggregates all prefixes together, grouping_id telling how long each is. A longer conversation goes on in
further rows of columns, whose key is the node that the block before ended in: 128 bits of hash of the turns so far, xored
turn by turn with their positions, so that keys come from sums of blocks instead of a walk along the conversation.

Sums over subtrees are a second ROLLUP, of one row a node: it adds a block's nodes to all their ancestors in it. What hangs
below a block's last node is added first: totals of blocks climb their tree by pointers that double in each round, so
rounds grow with the logarithm of the longest conversation and none are needed where all fit in a block.

Turns get their positions by range: rows are dealt by (conversation, turn), counted where they are, and each share starts at
the sum of the shares before, so no task gets all of a long conversation; equal rows are counted before they are dealt.
A node with very many children is met in parts. A node's ids are hashed from pieces that were joined where sorted ranges
of them lie.

Defined results: a null turn comes first; turns of one number are in the order of role, then digest; null roles and texts are empty;
rows with a null id belong to no conversation; other columns are ignored; an empty table gives no node, the root included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.llm.common import discard, saved, spread_join, table

BLOCK = 8
#: Blocks that one window adds up; longer conversations are added up by such groups first.
GROUP = 4096
#: The first turns that a conversation may take from another: fewer than this.
LENT = 4
#: Ids that a piece of a node's list has.
PIECE = 4096
_NONE = hashlib.sha256(b"").hexdigest()
_SLOTS = [f"t{i}" for i in range(BLOCK)]
_KEY = ("depth", "a", "b")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, turn struct<digest, words>: every turn of ``conversations`` (conv_id, turn, role, text) with its place
    in its conversation, from 0."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.struct(digest.alias("digest"), words.alias("words")).alias("it"))
    counted = rows.groupBy("conv_id", "turn", "role", "it").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("it").asc()]
    dealt = saved(counted.repartitionByRange(*order).withColumn("share", F.spark_partition_id()), "trie-turns")
    here = Window.partitionBy("conv_id", "share").orderBy(*order[1:])
    own = dealt.withColumn("before", F.sum("n").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    shares = dealt.groupBy("conv_id", "share").agg(F.sum("n").alias("m"))
    starts = shares.withColumn("start", F.sum("m").over(Window.partitionBy("conv_id").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)))
    begin = F.coalesce("before", F.lit(0)) + F.coalesce("start", F.lit(0))
    # a (conversation, share) is at most what one task was dealt
    placed = own.join(starts.select("conv_id", "share", "start"), ["conv_id", "share"]).select("conv_id", "it", F.explode(F.sequence(begin, begin + F.col("n") - 1)).alias("pos"))
    return placed.select("conv_id", "pos", F.col("it").alias("turn"))


def rebuilt(own: DataFrame, ids: DataFrame) -> DataFrame:
    """``own`` (conv_id, pos, turn) with the first h turns of each of ``ids`` taken from those of the twentieth conversation
    before or at it, h being a hash of the id."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).alias("h")
    lenders = own.where((F.col("conv_id") % 20 == 0) & (F.col("pos") < LENT - 1)).select(F.col("conv_id").alias("lender"), "pos", "turn")
    lent = ids.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % 20).alias("lender")).join(lenders, "lender").where("pos < h").select("conv_id", "pos", "turn")
    taken = lent.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    kept = own.withColumn("h", h).where("pos >= h").join(taken, "conv_id", "left")
    return kept.select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("pos"), "turn").unionByName(lent)


def _code(turn: Column, pos: Column, seed: int) -> Column:
    return F.xxhash64(turn, pos.cast("long"), F.lit(seed))


def _xor(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def blocks(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, n (its turns), depth, a, b (the node before the block) and the block's turns t0, t1, ..., of ``rows`` (conv_id, pos,
    turn); a first block for each of ``ids``, if empty."""
    block, slot = F.floor(F.col("pos") / BLOCK).cast("long"), F.col("pos") % BLOCK
    laid = rows.withColumns({"block": block, "slot": slot, "span": F.floor(F.col("pos") / (BLOCK * GROUP)).cast("long")})
    parts = [F.max(F.when(F.col("slot") == i, F.col("turn"))).alias(t) for i, t in enumerate(_SLOTS)]
    sums = [F.bit_xor(_code(F.col("turn"), F.col("pos"), s)).alias(f"{x}s") for s, x in enumerate("ab")]
    made = saved(laid.groupBy("conv_id", "span", "block").agg(*parts, *sums, F.count(F.lit(1)).alias("m")), "trie-blocks")
    spans = made.groupBy("conv_id", "span").agg(F.bit_xor("as").alias("sa"), F.bit_xor("bs").alias("sb"), F.sum("m").alias("sm"))
    along, whole = Window.partitionBy("conv_id").orderBy("span"), Window.partitionBy("conv_id")
    spans = spans.select("conv_id", "span", F.sum("sm").over(whole).alias("n"), *(F.bit_xor(f"s{x}").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{x}0") for x in "ab"))
    inside = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    keyed = made.select("conv_id", "span", (F.col("block") * BLOCK).alias("depth"), *_SLOTS, *(zero(F.bit_xor(f"{x}s").over(inside)).alias(x) for x in "ab"))
    full = keyed.join(spans, ["conv_id", "span"]).select("conv_id", "n", "depth", F.col("a").bitwiseXOR(zero(F.col("a0"))).alias("a"), F.col("b").bitwiseXOR(zero(F.col("b0"))).alias("b"), *_SLOTS)
    lacking = ids.join(made.where("block = 0").select("conv_id"), "conv_id", "left_anti")
    none = lacking.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("n", *_KEY)), *(F.lit(None).cast(rows.schema["turn"].dataType).alias(t) for t in _SLOTS))
    return full.unionByName(none)


def _rolled(rows: DataFrame, *sums: Column) -> DataFrame:
    """The ROLLUP of block rows over their turns, a row a node below the block's key: k (turns of the block that it has), the
    key's columns, its turns and ``sums``."""
    key = F.struct(*_KEY)
    out = rows.withColumn("key", key).rollup("key", *_SLOTS).agg(F.grouping_id().alias("g"), *sums)
    # one bit a column that is rolled up, the last column's the lowest
    level = F.lit(BLOCK) - sum((F.shiftright("g", i).bitwiseAND(F.lit(1)) for i in range(BLOCK)), F.lit(0))
    depth_of = out.where(F.shiftright("g", BLOCK) == 0).withColumn("k", level.cast("int"))
    there = F.lit(True)
    for i, t in enumerate(_SLOTS):
        there = there & ((F.col("k") <= i) | F.col(t).isNotNull())
    return depth_of.where(there & ((F.col("k") > 0) | (F.col("key.depth") == 0))).drop("g")


def _keys(k: Column) -> list[Column]:
    """depth, a, b of the node that has k turns of a block row's."""
    out = [(F.col("key.depth") + k).alias("depth")]
    for s, x in enumerate("ab"):
        codes = [F.when(F.lit(i) < k, _code(F.col(t), F.col("key.depth") + i, s)).otherwise(F.lit(0).cast("long")) for i, t in enumerate(_SLOTS)]
        out.append(_xor([F.col(f"key.{x}"), *codes]).alias(x))
    return out


def nodes(block_rows: DataFrame) -> DataFrame:
    """A row a node: id (its key), up (its parent's; the root: null), key and turns of its block, k, conv_id, depth, n_convs, leaf,
    saved (tokens of its own turn)."""
    out = _rolled(block_rows, F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("longest"))
    k = F.col("k")
    words = F.coalesce(*(F.when(k == i + 1, F.col(f"{t}.words")) for i, t in enumerate(_SLOTS)), F.lit(0))
    named = out.withColumn("id", F.struct(*_keys(k))).withColumn("up", F.when((k > 0), F.struct(*_keys(k - 1))))
    return named.select("id", "up", "key", *_SLOTS, "k", "conv_id", F.col("id.depth").alias("depth"), "n_convs", (F.col("longest") == F.col("id.depth")).alias("leaf"), ((F.col("n_convs") - 1) * words).cast("long").alias("saved"))


def _hanging(told: DataFrame) -> DataFrame:
    """id, leaves, saved: what all blocks below each block's last node hold together."""
    total = [F.sum(F.col("leaf").cast("long")).alias("leaves"), F.sum("saved").alias("saved")]
    own = told.where("key.depth > 0").groupBy(F.col("key").alias("id")).agg(*total)
    # a block's key is the last node of the block above, whose own key is the next one up
    above = told.where(F.col("k") == BLOCK).select("id", F.when(F.col("key.depth") > 0, F.col("key")).alias("to"))
    now = saved(own.join(above, "id"), "trie-below")
    while not now.where("to is not null").isEmpty():
        sent = now.where("to is not null").groupBy(F.col("to").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count(F.lit(1)).alias("n"))
        nexts = saved(now.select(F.col("id").alias("to"), F.col("to").alias("next")).join(sent.select(F.col("id").alias("to"), "n"), "to"), "trie-next")
        moved = spread_join(now, nexts, "to", "left").select("id", "leaves", "saved", F.col("next").alias("to"))
        old, now = now, saved(moved.join(sent.drop("n"), "id", "left").select("id", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), "to"), "trie-below")
        discard(old)
        discard(nexts)
    return now.drop("to")


def subtrees(told: DataFrame) -> DataFrame:
    """id, n_leaves, saved_tokens of each of ``nodes``' rows."""
    below = _hanging(told)
    more = told.join(below.select("id", F.col("leaves").alias("l"), F.col("saved").alias("s")), "id", "left")
    weighed = more.select(F.col("key.depth").alias("depth"), F.col("key.a").alias("a"), F.col("key.b").alias("b"), *_SLOTS, (F.col("leaf").cast("long") + F.coalesce("l", F.lit(0))).alias("l"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("s"))
    return _rolled(weighed, F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens")).select(F.struct(*_keys(F.col("k"))).alias("id"), "n_leaves", "saved_tokens")


def ends(block_rows: DataFrame) -> DataFrame:
    """id, ends_sha256 of the nodes that a conversation ends in."""
    last = block_rows.where((F.col("n") - F.col("depth")).between(F.when(F.col("depth") > 0, 1).otherwise(0), BLOCK))
    keyed = last.withColumn("key", F.struct(*_KEY)).select(*_keys((F.col("n") - F.col("depth")).cast("int")), "conv_id")
    fields = "depth long, a long, b long, conv_id long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, done = None, [], []

        def close() -> None:
            if ids:
                done.append((*node, ids[0], ",".join(map(str, ids))))

        def made() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["depth", "a", "b", "conv_id", "ids"])

        for batch in batches:
            for *at, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != node or len(ids) == PIECE:
                    close()
                    node, ids = at, []
                ids.append(conv_id)
            if len(done) >= PIECE:
                yield made()
                done.clear()
        close()
        if done:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], ["depth", "a", "b", "ends_sha256"])

        for batch in batches:
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = at, hashlib.sha256(ids.encode())
            if len(done) >= PIECE:
                yield made()
                done.clear()
        if node is not None:
            done.append((*node, sha.hexdigest()))
        if done:
            yield made()

    ranged = keyed.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(pieces, f"{fields}, ids string")
    whole = ranged.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")
    return whole.select(F.struct(*_KEY).alias("id"), "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, see ``op13_trie``."""
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = saved(blocks(rebuilt(saved(turns(conversations), "trie-places"), ids), ids), "trie-rows")
    told = saved(nodes(rows), "trie-nodes")
    children = told.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    parents = saved(told.join(children, "id").select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n"), "trie-parents")
    named = spread_join(told.select("id", "up", "conv_id", "depth", "n_convs"), parents, "up", "left")
    counted = named.join(children, "id", "left").join(subtrees(told), "id").join(ends(rows), "id", "left")
    return counted.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every prefix."""
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: crc32 of the id's digits, bit by bit; prefixes as lists; subtrees by comparing prefixes.
SQL = r"""
WITH rows_ AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM rows_ GROUP BY conv_id),
coded AS (
  SELECT conv_id, turns, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda crc, byte: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)), 4294967295::BIGINT), 4294967295) % 4 AS h
  FROM own),
full_ AS (
  SELECT c.conv_id, list_concat(coalesce(l.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM coded c LEFT JOIN own l ON l.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (
  SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS prefix FROM full_, (SELECT unnest(range((SELECT max(len(turns)) + 1 FROM full_))) AS d) WHERE d <= len(turns)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, prefix),
weighed AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth]['text'], '[^\x20\x09-\x0D]+')) END AS saved FROM nodes),
sums AS (
  SELECT a.depth, a.prefix, count(*) FILTER (WHERE b.leaf) AS n_leaves, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children
  FROM weighed a JOIN weighed b ON b.depth >= a.depth AND b.prefix[1:a.depth] = a.prefix GROUP BY a.depth, a.prefix)
SELECT w.conv_id::BIGINT AS conv_id, w.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, w.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM weighed w JOIN sums s ON s.depth = w.depth AND s.prefix = w.prefix
LEFT JOIN weighed p ON p.depth = w.depth - 1 AND w.depth > 0 AND p.prefix = w.prefix[1:w.depth - 1]
"""
