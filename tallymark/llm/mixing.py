"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words.  Sources, in code-point order with null last, weigh
``weights`` in turn and share ``volume`` times all words; a target stops at
``max_epochs`` times its source, and what is cut off is shared again by weight
until none is above (water filling over the sources sorted by size per
weight).

A source is dealt by hash into about sqrt(documents) blocks, and its blocks are
put into an order by hash.  An epoch takes whole blocks in that order while
they fit; the block at the border gives the documents that still fit, largest
first.  So no window ever sees more than about sqrt(documents) rows of a
source, whatever its share.

The blocks drawn are the exact quotas.  ``split_quotas`` halves the vector of
quotas again and again: at each node the left half draws its number of blocks
of every source from the hypergeometric law, given what the sources before it
left over, until each leaf is one output shard.  Shard s takes the next
``quota[source, s]`` blocks of the source's order, which makes the draws
disjoint, and shuffles its rows locally by hash.

Mixing takes whole documents: a source ends below its target by less than the
smallest document that its border block left over.

Defined results: a null text has size 0; a null source is a source of its own,
last; rows that repeat count each, being numbered among themselves; an empty
table gives no rows.  Everything derives from hashes of ``seed``, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, VOLUME, MAX_EPOCHS, SHARD_LEVELS, SEED = (5, 2, 1), 1.5, 2, 5, 20240101


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, row``: the only pass over the texts."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), common.n_words(F.col("text")).alias("size"), common.row_key().alias("row"))


def targets(sized: DataFrame, weights=WEIGHTS, volume: float = VOLUME, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source, n_docs, source_size, weight, target``."""
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    # One row per source from here: these windows hold as many rows as there are sources.
    every = Window.partitionBy(F.lit(1))
    turn = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = per.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"))
    # Sources reach their ceiling in the order of ceiling per weight; those before the first that doesn't are full.
    full = F.col("source_size").cast("double") * max_epochs
    order = every.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    step = weighed.select("*", full.alias("full"), F.coalesce(F.sum(full).over(before), F.lit(0.0)).alias("given"), F.sum("weight").over(after).alias("left_weight"), (F.sum("source_size").over(every) * F.lit(float(volume))).alias("total"))
    level = (F.col("total") - F.col("given")) / F.col("left_weight")
    step = step.select("*", level.alias("level"), (F.col("full") > level * F.col("weight")).alias("open"))
    water = F.min(F.when(F.col("open"), F.struct((F.col("full") / F.col("weight")).alias("o"), F.col("level")))).over(every)["level"]
    step = step.select("*", water.alias("water"))
    return step.select("source", "n_docs", "source_size", "weight", F.when(F.col("water").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("weight") * F.col("water"))).alias("target"))


def draw(sized: DataFrame, per_source: DataFrame, seed: int = SEED) -> DataFrame:
    """A row per document and epoch that is taken: ``..., target, epoch, block, block_rank``; not taken: epoch null."""
    blocks = F.ceil(F.sqrt(F.col("n_docs"))).cast("long")
    ps = per_source.select(F.col("source").alias("s_source"), "n_docs", "source_size", "target")
    dealt = sized.join(ps, sized.source.eqNullSafe(F.col("s_source")), "left").drop("s_source")
    dealt = dealt.select("*", F.pmod(F.xxhash64(F.lit(seed), "row", "copy"), blocks).alias("block"))
    words = dealt.groupBy("source", "block", "source_size", "target").agg(F.sum("size").alias("block_words"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    words = words.select("*", F.row_number().over(order).alias("block_rank"), (F.sum("block_words").over(order) - F.col("block_words")).alias("block_from"))
    # An epoch offers the source once; epoch e wants what of the target lies in [e, e + 1) times the source.
    want = F.least(F.greatest(F.col("target") - F.col("epoch") * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double"))
    offers = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))).alias("epoch")).select("*", (want - F.col("block_from")).alias("room")).where(F.col("room") > 0)
    offers = offers.groupBy(F.col("source").alias("o_source"), F.col("block").alias("o_block"), "block_rank").agg(F.collect_list(F.struct("epoch", F.least(F.col("room"), F.col("block_words").cast("double")).alias("room"), (F.col("room") >= F.col("block_words")).alias("whole"))).alias("offers"))
    full = dealt.join(offers, dealt.source.eqNullSafe(F.col("o_source")) & (F.col("block") == F.col("o_block")), "left").drop("o_source", "o_block")
    # In a border block the largest documents that still fit go first: fit, or leave room for the smaller.
    size_order = Window.partitionBy("source", "block").orderBy(F.desc("size"), F.xxhash64(F.lit(seed + 2), "row", "copy"), "row", "copy")
    ranked = full.select("*", F.row_number().over(size_order).alias("nth"))
    border = ranked.where(F.exists(F.coalesce("offers", F.expr("array()").cast("array<struct<epoch:int,room:double,whole:boolean>>")), lambda o: ~o["whole"]))
    fitting = border.groupBy(F.col("source").alias("b_source"), F.col("block").alias("b_block")).agg(F.sort_array(F.collect_list(F.struct("nth", "size"))).alias("in_order"), F.first(F.filter("offers", lambda o: ~o["whole"])).alias("o"))
    fits = lambda room: F.aggregate("in_order", F.struct(room.alias("room"), F.expr("cast(array() as array<int>)").alias("taken")), lambda a, d: F.when(d["size"] <= a["room"], F.struct((a["room"] - d["size"]).alias("room"), F.array_append(a["taken"], d["nth"]).alias("taken"))).otherwise(a))["taken"]
    fitting = fitting.select("b_source", "b_block", F.explode(F.transform("o", lambda o: F.struct(o["epoch"].alias("epoch"), fits(o["room"]).alias("taken")))).alias("f")).select("b_source", "b_block", F.col("f.epoch").alias("b_epoch"), F.explode("f.taken").alias("b_nth"))
    taken_whole = F.transform(F.filter(F.coalesce("offers", F.expr("array()").cast("array<struct<epoch:int,room:double,whole:boolean>>")), lambda o: o["whole"]), lambda o: o["epoch"])
    cols = [*sized.columns, "source_size", "target", "block", "block_rank", "nth"]
    some = fitting.groupBy("b_source", "b_block", "b_nth").agg(F.collect_list("b_epoch").alias("part_epochs"))
    joined = ranked.select(*cols, taken_whole.alias("whole_epochs")).join(some, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")) & (F.col("nth") == F.col("b_nth")), "left")
    epochs = F.sort_array(F.concat("whole_epochs", F.coalesce("part_epochs", F.expr("cast(array() as array<int>)"))))
    return joined.select(*cols, epochs.alias("epochs"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def split_quotas(quotas: DataFrame, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """``source, epoch, quota`` -> ``source, epoch, shard, quota``: the splitting tree.

    A node is one row: its shard prefix and the array of its quotas, one per
    source and epoch.  The left child draws half of the node's blocks, each
    source from the hypergeometric law given the blocks and draws left over:
    item by item, an exact draw.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "epoch", "quota"))).alias("quotas")).select(F.lit(0).alias("shard"), "quotas")

    def left_of(level: int):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["quota"])
        start = F.struct(total.alias("items"), F.floor(total / 2).cast("long").alias("draws"), F.expr("cast(array() as array<bigint>)").alias("got"))

        def one_source(a, q):
            # q.quota items one after another: each is drawn with probability draws / items.
            step = lambda s, j: F.when(
                uniform(F.lit(seed), F.lit(level), F.col("shard"), q["source"], q["epoch"], j) * s["items"] < s["draws"],
                F.struct((s["items"] - 1).alias("items"), (s["draws"] - 1).alias("draws"), (s["x"] + 1).alias("x")),
            ).otherwise(F.struct((s["items"] - 1).alias("items"), s["draws"].alias("draws"), s["x"].alias("x")))
            end = F.aggregate(F.when(q["quota"] > 0, F.sequence(F.lit(1).cast("long"), q["quota"])).otherwise(F.expr("cast(array() as array<bigint>)")), F.struct(a["items"].alias("items"), a["draws"].alias("draws"), F.expr("0L").alias("x")), step)
            return F.struct(end["items"].alias("items"), end["draws"].alias("draws"), F.array_append(a["got"], end["x"]).alias("got"))

        return F.aggregate("quotas", start, one_source)["got"]

    for level in range(levels):
        node = node.select("shard", "quotas", left_of(level).alias("got"))
        take = lambda side: F.zip_with("quotas", "got", lambda q, g: F.struct(q["source"].alias("source"), q["epoch"].alias("epoch"), (g if side == 0 else q["quota"] - g).alias("quota")))
        node = node.select(F.explode(F.array(*[F.struct((F.col("shard") * 2 + side).alias("shard"), take(side).alias("quotas")) for side in (0, 1)])).alias("c")).select("c.shard", "c.quotas")
    return node.select("shard", F.inline("quotas"))


def place(sized: DataFrame, levels: int = SHARD_LEVELS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The rows of ``draw``, and the mix: a row per copy taken, with its output ``shard`` and local order ``mix_key``.

    ``sized``: numbered sizes.
    """
    drawn = common.cut(draw(sized, targets(sized), seed))
    copies = drawn.where(F.size("epochs") > 0).select("row", "copy", "source", "block", "block_rank", F.explode("epochs").alias("epoch"))
    used = copies.select("source", "epoch", "block", "block_rank").distinct()
    order = Window.partitionBy("source", "epoch").orderBy("block_rank")
    used = common.cut(used.select("*", F.row_number().over(order).alias("nth_block")))
    quota = split_quotas(used.groupBy("source", "epoch").agg(F.count(F.lit(1)).alias("quota")), levels, seed)
    upto = Window.partitionBy("source", "epoch").orderBy("shard")
    spans = quota.where("quota > 0").select(F.col("source").alias("q_source"), F.col("epoch").alias("q_epoch"), "shard", F.sum("quota").over(upto).alias("last"), F.col("quota").alias("n"))
    # Shard s takes the next quota[source, s] blocks in order.
    blocks = spans.select("q_source", "q_epoch", "shard", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))).alias("q_block"))
    placed = used.join(blocks, used.source.eqNullSafe(F.col("q_source")) & (F.col("epoch") == F.col("q_epoch")) & (F.col("nth_block") == F.col("q_block")))
    placed = placed.select(F.col("source").alias("p_source"), F.col("epoch").alias("p_epoch"), F.col("block").alias("p_block"), "shard")
    out = copies.join(placed, copies.source.eqNullSafe(F.col("p_source")) & (F.col("epoch") == F.col("p_epoch")) & (F.col("block") == F.col("p_block")))
    return drawn, out.select("row", "copy", "epoch", "shard", F.xxhash64(F.lit(seed + 3), "row", "copy", "epoch").alias("mix_key"))


def mixture(docs: DataFrame, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """Every row's ``doc_id, size, source_size, target, taken``, and the ``shards`` that take it."""
    # Numbers only; cut, as they are read for the totals, the blocks and the draw.
    drawn, copies = place(common.cut(common.numbered(common.cut(sizes(docs)))), levels, seed)
    times = copies.groupBy("row", "copy").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    out = drawn.select("doc_id", "size", "source_size", "target", "row", "copy").join(times, ["row", "copy"], "left")
    shards = F.coalesce("shards", F.expr("cast(array() as array<int>)"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size(shards)).cast("long").alias("taken"), shards.alias("shards"))


def query(spark, sf_dir: str) -> DataFrame:
    return mixture(common.documents(spark, sf_dir))


def mix(docs: DataFrame, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """``docs`` as mixed: rows not drawn go, rows drawn twice come twice.

    The output is in ranges of shards, and shuffled by a hash in each shard, so
    written files follow each other shard by shard.
    """
    _, copies = place(common.cut(common.numbered(common.cut(sizes(docs)))), levels, seed)
    places = copies.select(F.col("row").alias("__row"), F.col("copy").alias("__copy"), F.col("shard").alias("__shard"), F.col("mix_key").alias("__key"))
    rows = common.numbered(docs.withColumn("__own", common.row_key()), "__own", "__nth")
    joined = rows.join(places, (F.col("__own") == F.col("__row")) & (F.col("__nth") == F.col("__copy")))
    return joined.repartitionByRange(common.parallel(docs), "__shard", "__key").sortWithinPartitions("__shard", "__key").select(*docs.columns)
