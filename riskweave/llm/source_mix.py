"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a hash of their ids, which permutes them. Targets
give each source an exact quota of blocks. A binary tree deals the quotas to the output shards:
each node gives half of its blocks to its left child, with the numbers by source drawn without
replacement. A shard then takes its own range of each source's permuted blocks, so that blocks are
disjoint and quotas hold exactly, and rows are shuffled inside a shard. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm.common import free_name, freeze, spread_join, stored, words

WEIGHTS = (3, 1, 2)
#: Words of a block. More blocks make the tree's draws longer, fewer make shards less even.
BLOCK_WORDS = 1_000_000
SHARDS = 16
SUPER = 1024


def sizes(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source: size, target and number of blocks.

    Sources in code-point order (null last) weigh ``weights``, over and over. They share ``share``
    of all sizes by weight; none gets over ``most`` times its size, and what is over is shared by
    weight again. The level that this comes to is found by sorting the sources by the level at
    which they fill up. Sources are the entries of a mixture, so that one task can sort them.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(by_name) - 1
    rows = rows.withColumn("pos", place)
    rows = rows.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("pos") % len(weights)).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", "pos")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * share
    rows = rows.withColumn(
        "level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    level = F.first(F.when(F.col("level") <= F.col("full_at"), F.col("level")), ignorenulls=True).over(everything)
    rows = rows.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return rows.select("source", "pos", "source_size", "target")


def _hypergeometric(counts: Column, node: Column, depth: int, seed: int) -> Column:
    """Blocks by source for the left child: half of all, drawn one by one without replacement."""

    def draw(total: Column, wanted: Column, count: Column, pos: Column) -> Column:
        start = F.struct(total.alias("total"), wanted.alias("wanted"), F.lit(0).cast("long").alias("got"))

        def one(a: Column, j: Column) -> Column:
            noise = F.xxhash64(F.lit(seed), F.lit(depth), node, pos, j)
            chance = F.shiftrightunsigned(noise, 11).cast("double") * 2.0**-53
            hit = F.when(chance * a["total"] < a["wanted"], 1).otherwise(0).cast("long")
            return F.struct(
                (a["total"] - 1).alias("total"), (a["wanted"] - hit).alias("wanted"), (a["got"] + hit).alias("got")
            )

        steps = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, start, one)

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    empty = F.array().cast("array<bigint>")
    start = F.struct(total.alias("total"), F.floor(total / 2).cast("long").alias("wanted"), empty.alias("out"))

    def source(a: Column, x: Column) -> Column:
        drawn = draw(a["total"], a["wanted"], x["c"], x["i"])
        return F.transform(
            F.array(drawn),
            lambda d: F.struct(
                d["total"].alias("total"), d["wanted"].alias("wanted"), F.concat(a["out"], F.array(d["got"])).alias("out")
            ),
        )[0]

    indexed = F.transform(counts, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(indexed, start, source, lambda a: a["out"])


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Blocks by shard from ``pos`` and ``quota``: a row for each source with ``ends``, where each
    shard's range of the source's blocks ends. ``shards`` is a power of two."""
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("quota").cast("long").alias("quota"))))
    nodes = quotas.agg(F.transform(listed, lambda x: x["quota"]).alias("counts")).withColumn("node", F.lit(0).cast("long"))
    for depth in range(shards.bit_length() - 1):
        nodes = nodes.withColumn("left", F.explode(F.array(_hypergeometric(F.col("counts"), F.col("node"), depth, seed))))
        right = F.zip_with("counts", "left", lambda c, x: c - x)
        nodes = nodes.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")),
                )
            ).alias("x")
        ).select("x.*")
    leaves = nodes.select(F.col("node").cast("int").alias("shard"), F.posexplode("counts").alias("pos", "blocks"))
    upto = F.sum("blocks").over(Window.partitionBy("pos").orderBy("shard"))
    ordered = F.array_sort(F.collect_list(F.struct("shard", "upto")))
    return leaves.withColumn("upto", upto).groupBy("pos").agg(F.transform(ordered, lambda x: x["upto"]).alias("ends"))


def _hash(seed: int, key: Column) -> Column:
    """Sixty bits that permute the documents of a source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    shards: int = SHARDS,
    block_words: int = BLOCK_WORDS,
    seed: int = 7,
) -> DataFrame:
    """Decides which documents (``doc_id``, ``source``, ``size``) the mix takes, and into which shards.

    Adds ``source_size``, ``target`` (of its source), ``taken`` (words, repeats counted) and
    ``shards`` (one entry for each time the document is taken, at most ``most`` times). A source is
    taken whole as often as its target holds it; the rest is the documents at the front of its
    permutation up to the target, and one more if that comes nearer (none of no words). Null sources are a source, null
    sizes count as 0, null ids hash alike, repeated rows are documents of their own. The same
    input gives the same result. An empty table gives an empty table.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    for name in ("source_size", "target", "taken", "shards"):
        if name in map(str.lower, sized.columns):
            sized = sized.withColumnRenamed(name, free_name(f"_{name}", sized.columns))
    uid = free_name("mix_row", sized.columns)
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    numbered = sized.withColumn("size", size).withColumn(uid, F.monotonically_increasing_id())
    held = stored(numbered, "sized")
    narrow = held.select(F.col(uid).alias("uid"), "doc_id", "source", "size")
    wanted = freeze(targets(narrow, weights, share, most))
    total = F.col("source_size")
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(total, F.lit(0))), F.lit(0))
    wanted = (
        wanted.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(total / block_words)).cast("long"))
        .withColumn("whole", whole.cast("long"))
        .withColumn("part", F.col("target") - F.col("whole") * total)
    )
    place = F.shiftright(F.shiftright("u", 30) * F.col("n_blocks"), 30)
    rows = freeze(
        spread_join(narrow.withColumn("u", _hash(seed, F.col("doc_id"))), wanted, "source")
        .withColumn("block", place)
        .drop("source")
    )

    # Words before each block, in two steps, so that no task sorts all blocks of a large source.
    def words_before(*keys: str) -> Column:
        ordered = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("words").over(earlier), F.lit(0))

    blocks = rows.groupBy("pos", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("super", F.floor(F.col("block") / SUPER))
    supers = blocks.groupBy("pos", "super").agg(F.sum("words").alias("words"))
    supers = supers.select("pos", "super", words_before("pos", "super").alias("base"))
    inner = words_before("pos", "super", "block")
    blocks = blocks.withColumn("inner", inner).join(supers, ["pos", "super"])
    blocks = blocks.select("pos", "block", (F.col("base") + F.col("inner")).alias("before"))
    known = wanted.select("pos", "n_blocks", "whole", "part")
    blocks = freeze(blocks.join(known, "pos"))

    begun = blocks.where("before < part").groupBy("pos").agg((F.max("block") + 1).alias("begun"))
    quotas = known.join(begun, "pos", "left").select(
        "pos", (F.col("whole") * F.col("n_blocks") + F.coalesce("begun", F.lit(0))).alias("quota")
    )
    ranges = split_quotas(quotas, shards, seed).join(quotas, "pos")
    step = F.when(F.col("quota") % 1_000_003 != 0, 1_000_003).otherwise(1_000_033)

    def shard_of(copy: Column) -> Column:
        rank = (F.col("block") + copy * F.col("n_blocks")) * step % F.greatest(F.col("quota"), F.lit(1))
        return F.size(F.filter("ends", lambda e: e <= rank))

    copies = F.sequence(F.lit(0).cast("long"), F.col("whole"))
    dealt = blocks.join(ranges, "pos").select(
        "pos", "block", "before", F.transform(copies, shard_of).alias("dealt")
    )

    # Documents that end before the target are in; one more of the block that the target cuts may
    # come nearer to it.
    inside = Window.partitionBy("pos", "block").orderBy("u", "doc_id", "size", "uid")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    end = F.col("before") + F.col("ahead") + F.col("size")
    chosen = freeze(ordered.join(dealt, ["pos", "block"]).withColumn("inside", (end <= F.col("part")) & (F.col("size") > 0)))
    last = blocks.where("before < part").groupBy("pos").agg(F.max("block").alias("block"))
    cut = chosen.join(last, ["pos", "block"])
    reached = F.when(F.col("inside"), end).otherwise(F.col("before"))
    short = cut.groupBy("pos").agg(F.min(F.col("part") - reached).alias("short"))
    off = F.abs(F.col("size") - F.col("short"))
    more = (
        cut.where("not inside")
        .join(short, "pos")
        .where(off < F.col("short"))
        .groupBy("pos")
        .agg(F.min(F.struct(off, "u", "uid")).alias("best"))
        .select(F.col("best.uid").alias("uid"), F.lit(True).alias("more"))
    )
    chosen = chosen.join(more, "uid", "left")
    extra = F.col("inside") | F.coalesce("more", F.lit(False))
    times = F.col("whole") + F.when(extra, 1).otherwise(0)
    decided = chosen.select(
        F.col("uid").alias(uid),
        "source_size",
        "target",
        F.slice("dealt", F.lit(1), times.cast("int")).alias("shards"),
    ).withColumn("dealt_", F.size("shards"))
    return held.join(decided, uid).withColumn("taken", F.col("size") * F.col("dealt_")).drop(uid, "dealt_")


def shuffled(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """A row for each time a document is taken, in its ``shard``, shuffled inside it."""
    names = [c for c in mixed.columns if c != "shards"]
    shard, copy = free_name("shard", names), free_name("copy", names)
    rows = mixed.select(*names, F.posexplode("shards").alias(copy, shard))
    order = F.xxhash64(F.lit(seed), F.col(copy), F.col("doc_id"), F.col("size"))
    return rows.repartition(shard, F.pmod(order, F.lit(8))).sortWithinPartitions(shard, order)
