"""Mixing sources to target weights, in DataFrame operations only.

Each source is a stream of its words, cut into blocks of ``block`` words. Output
slots are dealt to shards. ``draws`` has how many slots each source gets in each shard:
multinomial draws with the sources' totals held at their targets, which are made by
giving every slot a ticket, a keyed pseudorandom permutation of all of them, of which
each source owns as many as its target has blocks. The draws alone say what a shard
holds: a source's slots of all shards, in order, are its indexes 0, 1, 2, ..., and an
index names a block through the source's own permutation, so a source's blocks are all
used before one is used again. Blocks and slots then meet in a join by (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, durable

#: Weights by rank of the source; share of all words to take; most passes over a source.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words in a block; slots in an output shard, more where there would be over MAX_SHARDS; rounds of a permutation.
BLOCK, SHARD_SLOTS, MAX_SHARDS, ROUNDS = 128, 8192, 65_536, 24
#: Rows that share one prefix sum, prefix sums that share another; slots that a row is exploded to.
GROUP_ROWS, GROUP_SUMS, PIECE = 1024, 1024, 8192


def permute(x: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """A keyed pseudorandom permutation of 0..n-1 for any n: the swap-or-not shuffle.

    Each round pairs x with key - x (mod n) and a bit of the pair's hash says
    whether they change places.
    """

    def step(y: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, n, r, F.lit(1)), n) - y, n)
        return F.when(F.xxhash64(seed, n, r, F.greatest(y, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("bigint"), step)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Targets share ``share`` times all words by weight; one above ``most`` times its
    source's size stops there and its excess goes to the others by weight, until
    none is above. Computed by water filling: sources in order of size / weight are
    capped while the level exceeds theirs. Sources number far fewer than rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    s = sizes.withColumn("_w", w).withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = s.withColumn("_total", share * F.sum("source_size").over(every))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_left", F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_caps")) / F.col("_left"))
    # Levels rise up to the first at which the next source isn't filled, which holds, and fall after it.
    s = s.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every))
    return s.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_w") * F.col("_level")), F.col("_cap")).cast("double").alias("target"))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``size`` and two hashes of the row."""
    return docs.withColumns({"size": word_count(F.col("text")), "_key": F.xxhash64(F.lit(seed), "doc_id", "text"), "_spread": F.xxhash64(F.lit(seed + 1), "doc_id", "text")})


def _starts(sized: DataFrame) -> tuple[int, DataFrame]:
    """(groups, what each source has before each group: source, group, before, source_size, target).

    Prefix sums are taken over a group's rows, over GROUP_SUMS groups, and over
    those, so that a source of any size is spread.
    """
    groups = max(1, -(-sized.count() // GROUP_ROWS))
    sums = sized.groupBy("source", F.pmod("_spread", F.lit(groups)).alias("group")).agg(F.sum("size").alias("_sum"))
    sums = durable(sums.withColumn("_super", F.expr(f"group div {GROUP_SUMS}")))
    earlier = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    supers = sums.groupBy("source", "_super").agg(F.sum("_sum").alias("_sum"))
    supers = supers.select(F.col("source").alias("_s"), F.col("_super").alias("_n"), earlier(Window.partitionBy("source").orderBy("_super")).alias("_before"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))).withColumnRenamed("source", "_t")
    out = sums.withColumn("_within", earlier(Window.partitionBy("source", "_super").orderBy("group")))
    # null-safe joins: rows without a source form a source of their own
    out = out.join(supers, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_super") == F.col("_n"))).join(targets, F.col("source").eqNullSafe(F.col("_t")))
    return groups, durable(out.select("source", "group", (F.col("_before") + F.col("_within")).alias("before"), "source_size", "target"))


def _placed(keyed: DataFrame, groups: int, starts: DataFrame) -> DataFrame:
    """``keyed`` with ``source_size``, ``target`` and ``start``, the place of the row's first word in its source's stream.

    The stream's order is pseudorandom by key; rows alike in id and size are alike.
    """
    d = keyed.withColumn("_group", F.pmod("_spread", F.lit(groups)))
    within = Window.partitionBy("source", "_group").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    s = starts.withColumnRenamed("source", "_source")
    d = d.join(s, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("group")))
    return d.withColumn("start", F.col("_start") + F.col("before")).drop("_key", "_spread", "_group", "_start", "_source", "group", "before")


def _targets(starts: DataFrame) -> DataFrame:
    return starts.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))


def draws(targets: DataFrame, block: int = BLOCK, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """How many slots of each shard each source gets: ``shard, source, source_no, blocks, n``; no rows for none.

    ``targets`` has source, source_size and target. A source gets round(target /
    mean words of its blocks) slots in all, at most twice its number of blocks. Given
    these totals a shard's counts are distributed as multinomial ones.
    """
    t = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    want = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint")
    t = t.withColumn("_slots", F.least(want, F.col("blocks") * int(MOST)))
    order = Window.orderBy(F.col("source").isNull(), "source")
    t = t.withColumn("_end", F.sum("_slots").over(order)).withColumn("_all", F.sum("_slots").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = t.withColumn("source_no", F.row_number().over(order)).withColumn("_width", F.greatest(F.lit(shard_slots).cast("bigint"), F.ceil(F.col("_all") / MAX_SHARDS)))
    # Tickets of a source come in pieces, so that no task explodes a whole source.
    t = _exploded(t.select("*", F.col("_slots").alias("n")))
    ticket = permute(F.col("_end") - F.col("_slots") + F.col("r"), F.col("_all"), F.lit(seed))
    return t.withColumn("shard", F.floor(ticket / F.col("_width"))).groupBy("shard", "source", "source_no", "blocks").agg(F.count("*").alias("n"))


def _exploded(rows: DataFrame) -> DataFrame:
    """Each row ``n`` times, with ``r`` from 0, by way of pieces that are dealt out evenly."""
    # a fixed number, so that a few hundred short rows, each of many, aren't dealt to one task
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.explode(F.expr(f"IF(n > 0, sequence(0L, (n - 1) div {PIECE}), array())")).alias("_piece")
    rows = rows.select("*", piece)
    rows = rows.repartition(width, F.xxhash64(*rows.columns))
    return rows.select("*", F.explode(F.expr(f"sequence(_piece * {PIECE}, least(n, (_piece + 1) * {PIECE}) - 1)")).alias("r")).drop("_piece")


def slots(drawn: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each slot that ``draws`` has counted: ``shard, slot, source, block, pass``."""
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = drawn.withColumn("_index", before("source_no", "shard")).withColumn("_slot", before("shard", "source_no")).withColumn("_filled", F.sum("n").over(Window.partitionBy("shard")))
    d = _exploded(d)
    index = F.col("_index") + F.col("r")
    block = permute(index % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed + 7), "source_no"))
    slot = permute(F.col("_slot") + F.col("r"), F.col("_filled"), F.xxhash64(F.lit(seed + 9), "shard"))
    return d.select("shard", slot.alias("slot"), "source", block.alias("block"), F.floor(index / F.col("blocks")).alias("pass"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block that a document reaches: its columns, ``block``, ``from`` (word within the document) and ``words``."""
    reach = F.explode(F.expr(f"IF(size > 0, sequence(start div {block}, (start + size - 1) div {block}), array())")).alias("block")
    p = placed.select("*", reach)
    a = F.greatest(F.col("start"), F.col("block") * block)
    b = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return p.withColumn("from", a - F.col("start")).withColumn("words", b - a)


def mixed_counts(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken.

    Null texts have size 0 and are never taken; null sources are one source, last
    in order; repeated rows are rows of their own; an empty table gives none; columns
    other than doc_id, source and text aren't read. ``taken`` counts each word as
    often as its blocks are drawn. Texts are read once.
    """
    keyed = durable(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    groups, starts = _starts(keyed)
    placed = durable(_placed(keyed, groups, starts))
    # Draws of a block are counted before the join: one row for each block on either side's key.
    drawn = slots(durable(draws(_targets(starts), block, seed)), seed).groupBy("source", "block").agg(F.count("*").alias("_n")).withColumnsRenamed({"source": "_source", "block": "_block"})
    # A row whose words are all in blocks [a, b]: its row key is its place in the stream.
    # Both sides grow with the words: never broadcast, whatever the estimates say.
    got = pieces(placed, block).hint("merge").join(drawn, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    got = got.groupBy("source", "start", "doc_id", "size", "source_size", "target").agg(F.sum(F.coalesce("_n", F.lit(0)) * F.col("words")).alias("taken"))
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return got.select(*cols).unionByName(none.select(*cols))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix itself, as rows of ``docs``: a row for each document's part in each drawn block.

    Blocks and slots are joined by (source, block). A part keeps its document's
    columns, whatever their names; ``text`` is its words with the white space between
    them, whole where the document lies in one block, and ``n_chars`` counts the part.
    Null, empty and blank texts aren't drawn; null sources are one source, last in
    order; repeated rows are rows of their own; an empty table gives none.
    """
    keyed = durable(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    groups, starts = _starts(keyed)
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars"))).alias("_row"))
    placed = _placed(_keyed(whole, seed), groups, starts)
    # Words with what follows them; the first takes what stands before it too. The array
    # goes through a generator so that it is made once for a document, not once for a part.
    words = F.regexp_extract_all("text", F.lit(f"^[\\x20\\x09-\\x0D]*{WORD_RE}[\\x20\\x09-\\x0D]*|{WORD_RE}[\\x20\\x09-\\x0D]*"), F.lit(0))
    cut = placed.where("size > 0").select("source", "start", "size", "_row", F.explode(F.array(words)).alias("_w"))
    first, end = F.col("start"), F.col("start") + F.col("size")

    def part(b: Column) -> Column:
        a = F.greatest(first, b * block)
        return F.struct(b.alias("block"), F.array_join(F.slice("_w", (a - first + 1).cast("int"), (F.least(end, (b + 1) * block) - a).cast("int")), "").alias("text"))

    parts = F.transform(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"), part)
    cut = cut.select("source", "_row", F.explode(parts).alias("_p")).select(F.col("source").alias("_of"), "_row", F.col("_p.block").alias("_block"), F.col("_p.text").alias("_part"))
    drawn = slots(durable(draws(_targets(starts), block, seed)), seed).select(F.col("source").alias("_source"), F.col("block").alias("_drawn")).hint("merge")
    mix = drawn.join(cut, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_drawn") == F.col("_block")))
    out = {"text": F.col("_part"), "n_chars": F.length("_part").cast("bigint")}
    return mix.select(*((out[c] if c in out else F.col("_row").getField(c)).alias(c) for c in docs.columns))
