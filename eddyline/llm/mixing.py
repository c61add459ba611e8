"""Mixing sources to target weights, in DataFrame functions alone.

1. Targets. Sources in the order of their code points (null last) weigh 3, 1, 2 and so on and share 150 %
   of all words; a target stops at twice its source's size and the excess goes to the others by weight.
2. Blocks. Each source's documents, in a pseudorandom order, make one stream of words, cut in blocks of
   ``BLOCK`` words. Positions come from a two-level running sum (chunks of about the square root of a
   source's documents), so no task ever holds a source.
3. Draws. The output is a run of slots, one block each, in shards of ``SHARD``. How many slots of a shard each source
   has is drawn as multinomial counts given that the totals meet the targets, which is a draw without replacement: a
   pseudorandom permutation deals all slots to the sources' quotas, and a shard's counts are what falls in it. The
   counts then settle the slots: in a shard its sources' slots follow one another, and a source's slots are numbered
   on from shard to shard by a running sum of its counts (in two levels, as positions are).
4. A source's k-th slot takes block ``permutation(k mod blocks)`` of it, a new permutation for each pass, so
   no block is taken more often than the passes there are, and no document exceeds twice its size.
5. Slots and documents meet in an equi-join on (source, block index); ``packed`` gives the slots' words, ``mix`` what
   each document contributes, ``mixed_texts`` that as documents.

Permutations are swap-or-not shuffles of an interval of any length, plain arithmetic on an index; nothing is
sorted or gathered for them, and a rerun gives the same. The table of sources has a row a source; it is
broadcast only while its counted rows are few, and joined by shuffle otherwise.

Defined results: a null or wordless text has size 0 and takes nothing; a null source is a source; repeated
rows are rows of their own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.llm.common import saved, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 64
SHARD = 4096
ROUNDS = 20
#: Rows up to which the table of sources is broadcast.
FEW = 10_000


def permuted(index: Column, n: Column, key: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. n-1 that ``key`` (a number) names sends ``index`` (swap or not: each
    round pairs x with k - x and a hash of the pair decides whether they swap)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(r, key, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    # never null, and said so, lest joins on it check by computing it once more
    return F.coalesce(F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), index, step), F.lit(0).cast("long"))


def sized(documents: DataFrame, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    code = F.xxhash64("doc_id", "source", "text")
    return documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), code.alias("code"), *more)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size, n_docs, target, n_blocks, quota (slots) and first_slot: a row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * float(CAP)).withColumn("total", F.sum("source_size").over(everything) * SHARE)
    # fill by rising cap over weight: a source is capped if its cap is below its part of what those before it leave
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("final", F.min_by("level", F.when(free, F.col("place"))).over(everything)).withColumn("final", F.coalesce("final", F.lit(float("inf"))))
    per = per.withColumn("target", F.when(F.col("final") * F.col("weight") < F.col("cap"), F.col("final") * F.col("weight")).otherwise(F.col("cap")))
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))).cast("long"), F.col("n_blocks") * CAP)).otherwise(F.lit(0).cast("long"))
    per = per.withColumn("n_blocks", blocks).withColumn("quota", quota)
    first = F.coalesce(F.sum("quota").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("source", F.col("rank").cast("long").alias("rank"), "source_size", "n_docs", "target", "n_blocks", "quota", first.cast("long").alias("first_slot"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def positioned(sizes: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """``sizes`` with its source's columns and ``start``, the position of its first word in the source."""
    t = targets.withColumnRenamed("source", "its_source")
    docs = sizes.join(_small(t, n_sources), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source", "quota", "first_slot")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.greatest(F.lit(1024.0), F.sqrt("n_docs")))).cast("long")
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("code", "rank"), chunks))
    sums = docs.groupBy("rank", "chunk").agg(F.sum("size").alias("chunk_size"))
    earlier = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "chunk", F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("chunk_start"))
    inside = Window.partitionBy("rank", "chunk").orderBy(F.xxhash64("code", F.lit("order")), *(c for c in sizes.columns if c not in ("source",))).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.join(sums, ["rank", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("within")).drop("chunk", "chunk_start", "within", "n_docs", "n_blocks")


def shard_counts(targets: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """shard, rank, n: how many blocks of each source a shard is drawn."""
    spark = targets.sparkSession
    width = max(1, -(-n_slots // 1024))
    parts = max(spark.sparkContext.defaultParallelism, -(-n_slots // 250_000))
    dealt = spark.range(0, n_slots, 1, parts).withColumnRenamed("id", "slot").withColumn("dealt", permuted(F.col("slot"), F.lit(n_slots).cast("long"), F.lit(7).cast("long"))).withColumn("bin", F.floor(F.col("dealt") / width))
    last = F.col("first_slot") + F.col("quota") - 1
    bins = targets.where("quota > 0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor(last / width)))).select("bin", "rank", "first_slot", "quota")
    found = dealt.join(_small(bins, n_sources + 1024), "bin").where("dealt >= first_slot and dealt < first_slot + quota")
    return found.groupBy(F.floor(F.col("slot") / SHARD).alias("shard"), "rank").agg(F.count(F.lit(1)).alias("n"))


def slots(counts: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """slot, shard, rank, pass, block: what each slot of the output takes, by the shards' counts of sources."""
    until = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    many = counts.withColumn("part", F.floor(F.col("shard") / SHARD))
    parts = many.groupBy("rank", "part").agg(F.sum("n").alias("in_part"))
    parts = parts.select("rank", "part", F.coalesce(F.sum("in_part").over(until("rank").orderBy("part")), F.lit(0)).alias("part_start"))
    placed = many.join(parts, ["rank", "part"]).withColumn("start", F.col("part_start") + F.coalesce(F.sum("n").over(until("rank", "part").orderBy("shard")), F.lit(0)))
    placed = placed.withColumn("before", F.coalesce(F.sum("n").over(until("shard").orderBy("rank")), F.lit(0)))
    one = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).join(_small(targets.select("rank", "n_blocks"), n_sources), "rank")
    one = one.withColumn("k", F.col("start") + F.col("i")).withColumn("pass", F.floor(F.col("k") / F.col("n_blocks"))).withColumn("key", F.xxhash64("rank", "pass"))
    block = permuted(F.pmod("k", "n_blocks"), F.col("n_blocks"), F.col("key"))
    return one.select((F.col("shard") * SHARD + F.col("before") + F.col("i")).alias("slot"), "shard", "rank", "pass", block.alias("block"))


def plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their positions, slots); ``sizes`` should be a written table, as it is read thrice."""
    targets = saved(source_targets(sizes), "mix-targets")
    n_sources, n_slots = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    counts = saved(shard_counts(targets, int(n_slots), n_sources), "mix-draws")
    return positioned(sizes, targets, n_sources), slots(counts, targets, n_sources)


def _pieces(docs: DataFrame) -> DataFrame:
    """A row for each block that a document has words in, and those words: from, n (from its first word)."""
    start, stop = F.col("start"), F.col("start") + F.col("size")
    cut = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / BLOCK), F.floor((stop - 1) / BLOCK))))
    begin = F.greatest(start, F.col("block") * BLOCK)
    return cut.withColumn("from", begin - start).withColumn("n", F.least(stop, (F.col("block") + 1) * BLOCK) - begin)


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row."""
    docs, dealt = plan(saved(sized(documents), "mix-sizes"))
    docs = saved(docs, "mix-positions")
    takes = dealt.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    key = ["rank", "start", "doc_id", "code", "size", "source_size", "target"]
    taken = _pieces(docs).join(takes, ["rank", "block"], "left").groupBy(*key).agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    none = docs.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _numbered(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with __code and __copy, which name a row; sizes with their positions and the same names; slots)."""
    code = F.xxhash64("doc_id", "source", "text")
    number = lambda name, doc: F.row_number().over(Window.partitionBy(name, doc).orderBy(F.lit(1)))
    docs, dealt = plan(saved(sized(documents).withColumn("copy", number("code", "doc_id")), "mix-sizes"))
    whole = documents.withColumn("__code", code).withColumn("__copy", number("__code", "doc_id"))
    return whole, docs, dealt


def _words_taken(runs: str) -> Column:
    """The words of ``text`` in the runs (from, n) of a column, an array of arrays; words are bound once, not split anew
    for each run."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    taken = lambda w: F.transform(runs, lambda r: F.slice(w, (r["from"] + 1).cast("int"), r["n"].cast("int")))
    return F.element_at(F.transform(F.array(words), taken), 1)


def packed(documents: DataFrame) -> DataFrame:
    """shard, slot, source, words (``BLOCK`` of them, fewer in a source's last block): the mix itself, a row a slot, each
    source's blocks made of its documents' words in a row."""
    whole, docs, dealt = _numbered(documents)
    pieces = _pieces(docs).join(dealt.select("rank", "block", "slot", "shard"), ["rank", "block"])
    runs = pieces.groupBy("doc_id", "code", "copy").agg(F.collect_list(F.struct("shard", "slot", (F.col("start") + F.col("from")).alias("at"), "from", "n")).alias("__runs"))
    runs = runs.select("__runs", *(F.col(c).alias(f"__{c}") for c in ("code", "copy")), F.col("doc_id").alias("__doc_id"))
    joined = whole.join(runs, ["__code", "__copy"]).where(F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")))
    parts = joined.select(F.col("source").cast("string").alias("source"), F.explode(F.arrays_zip(F.col("__runs").alias("r"), _words_taken("__runs").alias("w"))).alias("p"))
    return parts.groupBy(F.col("p.r.shard").alias("shard"), F.col("p.r.slot").alias("slot"), "source").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("p.r.at").alias("at"), F.col("p.w").alias("w")))), lambda x: x["w"])).alias("words"))


def mixed_texts(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix as documents. A document has a row for each pass that takes words of it, with
    its whole text where the pass takes all, else the words taken, in order, joined by spaces; ``n_chars``
    follows. Wordless documents have no words to take and leave no row."""
    whole, docs, dealt = _numbered(documents)
    takes = dealt.select("rank", "block", "pass")
    pieces = _pieces(docs).join(takes, ["rank", "block"]).groupBy("rank", "start", "doc_id", "size", "code", "copy", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "n"))).alias("runs"), F.sum("n").alias("words"))
    runs = pieces.select("runs", *(F.col(c).alias(f"__{c}") for c in ("doc_id", "code", "copy")), (F.col("words") == F.col("size")).alias("__all")).withColumnRenamed("runs", "__runs")
    joined = whole.join(runs, ["__code", "__copy"]).where(F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")))
    joined = joined.withColumn("text", F.when(F.col("__all"), F.col("text")).otherwise(F.array_join(F.flatten(_words_taken("__runs")), " ")))
    joined = joined.withColumn("n_chars", F.when(F.col("__all"), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return joined.select(*documents.columns)
