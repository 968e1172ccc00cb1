"""Mixing sources to target weights (operator 10).

The words of each source form one stream, cut into blocks of ``block_words`` words (the last one
may be shorter). A source's target is its weighted share of all words, at most ``max_repeats``
times its size, what is cut off being shared again by weight. The target is met by slots: whole
passes (epochs) over all blocks first, then one pass in part. Slot ``k`` of a pass takes the block
that a pseudorandom permutation of that source and pass gives for ``k`` (a Feistel network on
a x b >= blocks with cycle walking, so no sort and no table is needed); the shorter last block comes
last in a pass, and the last slot of the pass in part takes only the words that are still missing.

Output shards have ``shard_slots`` slots each (the last one what is left). How many of them a shard
takes from each source is drawn: multinomially, conditioned on the sources' totals, by dealing the
tickets of all sources to the shards in a pseudorandom order. The counts decide the slots: running
sums over the shards give each shard its range of a source's slots, the source's permutation turns
them into blocks, and they join the blocks by (source, index). So every source's total equals its target
to the word. ``mix_report`` gives, per document row, the words that each shard takes of it; the rows of
``mix_documents`` are per document and pass.

Defined cases: NULL or empty text has size 0 and is never taken; a NULL source is a source of its
own, last in order; rows that repeat a doc_id are separate rows, each with its own words; a table
without words gives targets of 0; other columns are ignored, whatever their names. Results depend
on the rows and the seed only (rows that repeat a doc_id are placed by the scan's row number as well, so
that an id with many rows is spread like any others).

Skew: a source's prefix sums are taken in two levels, inside buckets of about ``bucket_rows`` rows
and over the buckets' sums, slots are made in runs of 4,096, and the block join's key is (source,
block), so a source with a third of all rows is spread like the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from clickweave.llm.common import WORD, bounded, free_name, words_of, written

WEIGHTS = (5, 2, 1)
_RUN = 4096


@dataclass(frozen=True)
class Mix:
    """sized: one row per document row; sources: one per source; pieces: a document's part of a
    block; slots: what each shard takes, in order of ``slot``."""

    sized: DataFrame
    sources: DataFrame
    pieces: DataFrame
    slots: DataFrame

    def spans(self) -> DataFrame:
        """(rid, epoch, shard, lo, hi): words [lo, hi) of the document that a slot takes."""
        p, s = self.pieces, self.slots
        upto = F.least(F.col("to"), F.col("take"))
        return (s.hint("merge").join(p, ["sid", "block"]).where(F.col("from") < F.col("take"))
                .select("rid", "epoch", "shard", (F.col("from") + F.col("shift")).alias("lo"),
                        (upto + F.col("shift")).alias("hi")))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """One row per source: sid (its place by code point, NULL last), weight, source_size, target.

    The windows without a partition run over one row per source, after the aggregation."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    s = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("sid", F.row_number().over(by_name)).withColumn("weight", w)
         .withColumn("cap", F.col("source_size") * max_repeats))
    # from the source that its cap binds first: what is left for it and those after it
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything)
                               - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    s = s.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    s = s.withColumn("level", F.max(F.when(F.col("free"), F.col("level"))).over(everything))
    return s.select("sid", "source", "weight", "source_size",
                    F.when(F.col("free"), F.col("level") * F.col("weight"))
                    .otherwise(F.col("cap").cast("double")).alias("target"))


def _permuted(k: str, n: str, key: str) -> str:
    """SQL: the image of ``k`` in [0, n) under the permutation that ``key`` names."""
    a, b = f"cast(ceil(sqrt({n})) as bigint)", f"cast(ceil({n} / ceil(sqrt({n}))) as bigint)"
    step = (f"aggregate(array(1, 2, 3, 4, 5, 6), named_struct('l', x div {b}, 'r', x % {b}), (s, t) -> "
            f"if(t % 2 = 1, named_struct('l', (s.l + pmod(xxhash64({key}, t, s.r), {a})) % {a}, 'r', s.r), "
            f"named_struct('l', s.l, 'r', (s.r + pmod(xxhash64({key}, t, s.l), {b})) % {b})), "
            f"s -> s.l * {b} + s.r)")
    # a x b exceeds n by less than a: the walk back into [0, n) ends after one step nearly always
    lost = "cast(raise_error('a permutation left its range') as bigint)"
    return f"aggregate(sequence(1, 64), {k}, (x, i) -> if(i > 1 and x < {n}, x, {step}), x -> if(x < {n}, x, {lost}))"


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3,
                block_words: int = 512, shard_slots: int = 4096, seed: int = 20, bucket_rows: int = 5_000) -> Mix:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sized = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"),
                                F.col("source"), size.alias("size")), "mix-sized")
    rows = sized.count()
    sources = written(source_targets(sized, weights, max_repeats), "mix-sources")
    known = bounded(sources)

    # positions in the source's stream: prefix sums inside buckets and over the buckets' sums
    buckets = max(1, -(-rows // bucket_rows))
    several = written(sized.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                      .select(F.col("doc_id").alias("d_"), F.lit(True).alias("several")), "mix-repeated")
    own = F.when(F.col("doc_id").isNull() | F.col("several"), F.col("rid"))
    mixed = F.xxhash64(F.lit(seed), F.coalesce("doc_id", "rid"), own)
    placed = (sized.where(F.col("size") > 0).join(bounded(several), F.col("doc_id") == F.col("d_"), "left")
              .withColumn("mixed", mixed).drop("d_", "several")
              .withColumn("bucket", F.pmod("mixed", F.lit(buckets)))
              .join(known.select(F.col("source").alias("s_"), "sid"), F.col("source").eqNullSafe(F.col("s_"))))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("sid", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = (Window.partitionBy("sid", "bucket").orderBy("mixed", "doc_id", "size", "rid")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.col("base") + F.col("inside") - F.col("size")
    placed = (placed.withColumn("inside", F.sum("size").over(inside)).join(bases, ["sid", "bucket"])
              .select("sid", "rid", "size", start.alias("start")))

    words = F.lit(block_words)
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    pieces = (placed.withColumn("block", F.explode(F.sequence(first, last)))
              .withColumn("at", F.col("block") * words)
              .select("sid", "block", "rid", (F.greatest("start", "at") - F.col("at")).alias("from"),
                      (F.least(F.col("start") + F.col("size"), F.col("at") + words) - F.col("at")).alias("to"),
                      (F.col("at") - F.col("start")).alias("shift")))

    plan = (sources.where("source_size > 0").withColumn("want", F.round("target").cast("long"))
            .withColumn("full", F.expr("want div source_size"))
            .withColumn("rest", F.expr("want - full * source_size"))
            .withColumn("whole", F.expr(f"source_size div {block_words}"))
            .withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
            .withColumn("n", F.expr(f"full * blocks + (rest + {block_words - 1}) div {block_words}")).where("n > 0"))
    # the draw: every source has as many tickets as slots, dealt to the shards in a pseudorandom order
    before = F.sum("n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1))  # over one row per source
    plan = (plan.withColumn("ahead", F.coalesce(before, F.lit(0).cast("long"))).withColumn("tickets", F.sum("n").over(Window.partitionBy())))
    draw = (plan.withColumn("run", F.explode(F.expr(f"sequence(0L, n - 1, {_RUN}L)"))).repartition("sid", "run")
            .withColumn("ticket", F.explode(F.expr(f"sequence(ahead + run, ahead + least(run + {_RUN - 1}, n - 1))")))
            .withColumn("shard", F.expr(f"{_permuted('ticket', 'tickets', f'{seed}')} div {shard_slots}"))
            .groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("drawn")))
    upto = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = draw.withColumn("first", F.coalesce(F.sum("drawn").over(upto), F.lit(0)))
    slots = (counts.join(bounded(plan), "sid").withColumn("slot", F.explode(F.expr("sequence(first, first + drawn - 1)")))
             .withColumn("epoch", F.expr("slot div blocks")).withColumn("k", F.expr("slot % blocks"))
             .withColumn("block", F.expr(f"if(k < whole, {_permuted('k', 'whole', f'{seed}, sid, epoch')}, k)"))
             .withColumn("take", F.expr(f"if(epoch < full, if(k < whole, {block_words}, source_size - k * {block_words}),"
                                        f" least({block_words}, rest - k * {block_words}))")))
    slots = slots.select("sid", "slot", "epoch", "block", F.col("take").cast("long").alias("take"), "shard")
    return Mix(sized, known, pieces, slots)


def shard_counts(mix: Mix) -> DataFrame:
    """The draw: blocks that each output shard takes from each source."""
    return mix.slots.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("blocks"), F.sum("take").alias("words"))


def mix_report(mix: Mix) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, and ``shards``, the words
    that each output shard takes of it, in order of the shards."""
    by_shard = mix.spans().groupBy("rid", "shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("words"))
    taken = by_shard.groupBy("rid").agg(F.sum("words").alias("taken"),
                                        F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    known = mix.sources.select(F.col("source").alias("s_"), "source_size", "target")
    return (mix.sized.join(known, F.col("source").eqNullSafe(F.col("s_"))).join(taken, "rid", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
                    F.coalesce("shards", F.array().cast("array<struct<shard:bigint,words:bigint>>")).alias("shards")))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per document and pass, its text the
    words taken in that pass; a text taken whole stays as it is. Row ids are the scan's, so ``docs``
    must be a table that reads the same each time."""
    mix = mix_sources(docs, **params)
    row, size, passes, one = (free_name(docs, x) for x in ("_row", "_size", "_passes", "_pass"))
    by_pass = (mix.spans().groupBy("rid", "epoch")
               .agg(F.sum(F.col("hi") - F.col("lo")).alias("got"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
               .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("epoch", "got", "parts"))).alias(passes)))
    by_pass = by_pass.join(mix.sized.select("rid", F.col("size").alias(size)), "rid").withColumnRenamed("rid", row)
    rows = (docs.withColumn(row, F.monotonically_increasing_id()).join(by_pass, row)
            .withColumn(one, F.explode(passes)))
    words = words_of(F.col("text"))
    cut = F.array_join(F.flatten(F.transform(F.col(f"{one}.parts"), lambda p: F.slice(
        words, (p.lo + 1).cast("int"), (p.hi - p.lo).cast("int")))), " ")
    rows = rows.withColumn("text", F.when(F.col(f"{one}.got") == F.col(size), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
