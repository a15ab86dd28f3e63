"""Mixing sources to target weights by a low-discrepancy schedule.

1. Each source gets a target: its share of the budget by weight, at most
   ``CAP`` times its size; what is over goes to the others by weight, until
   none is above its cap.
2. The schedule has slots. Slot i's van der Corput point falls into one source's
   interval of the cumulative targets; slots are ranked within their source.
3. A source's documents are shuffled (by a keyed digest of their id) and laid
   end to end, again and again; rank r of the source takes its r-th block of
   ``block`` tokens. The last block is cut where the target is reached; blocks
   that the points left short are appended to the schedule's end.

Words are the tokens here: runs of [^\\x20\\x09-\\x0D].

Running offsets come from two levels (document in bucket, bucket in source), so
a source with a third of all rows is spread over ``BUCKETS`` tasks. Sources are
one row each: their table is aggregated first and its size is their number.

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, ordered last; repeated rows (same id) each have a place of
their own; an empty table gives an empty one; other columns are ignored by
``plan`` and kept by ``mix``, whose rows come in the schedule's order;
``mix_in_order`` shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairfeat.llm.native import blank_words, content, whole
from pairfeat.session import scratch_dir

CAP = 3
SEED = "mix-1"
#: Parts of each source's shuffled order that are numbered apart.
BUCKETS = 512
#: Slots of the schedule (a power of two); a block is the budget divided by them.
SLOTS = 1 << 16
#: More than that where this many a source take it.
SLOTS_PER_SOURCE = 64


def default_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the source's rank from 0."""
    return rank % 3 + 1


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size, tie, order`` (shuffle key) of every row, written once so that texts are read once."""
    text = F.col(f"`{text_col}`")
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                      F.size(blank_words(whole(text))).cast("long").alias("size"),
                      key.alias("order"), F.xxhash64(*content(docs)).alias("tie"))
    path = scratch_dir(docs.sparkSession, "mix")
    out.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def targets(sizes: DataFrame, weight=default_weight, cap: int = CAP) -> DataFrame:
    """``source, source_size, target``: water-filling in closed form.

    Sources are ordered by cap over weight. Those before the first one that the
    remaining budget cannot fill take their caps; the rest share what is left by
    weight. The windows run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    code_points = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("w", weight(F.row_number().over(code_points) - 1).cast("double"))
    filling = Window.orderBy((F.col("source_size") * cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = (ranked.withColumn("total", F.sum("source_size").over(everything))
            .withColumn("left", F.col("total") - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
            .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
            .withColumn("level", F.col("left") / F.col("w_left"))
            .withColumn("capped", F.col("source_size") * cap <= F.col("level") * F.col("w")))
    # Once one is not capped, no later one is, and their levels only fall: that of the first of them, the largest, holds for all.
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return full.withColumn("target", F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(
        level * F.col("w"))).select("source", "source_size", "target")


def laid_out(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``offset``: tokens of the source before the document in its shuffled order."""
    bucket = F.conv(F.substring("order", 1, 6), 16, 10).cast("int") % BUCKETS
    dealt = sizes.withColumn("bucket", bucket)
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("order", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.alias("p").join(sums.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))
                                    & (F.col("p.bucket") == F.col("s.bucket")))
    return joined.select("p.id", "p.source", "p.size", "p.order", "p.tie", (F.col("s.base") + F.col("p.inner")).alias("offset"))


def _point(i: Column, bits: int) -> Column:
    """Van der Corput point of i in base two, as an integer out of 2^bits: its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def schedule(spark: SparkSession, goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot, source, block, tokens``: which block of which source each slot takes, and how much of it.

    ``goals`` has whole targets (``goal``). Slots meet sources by the grid cells
    that a source's interval covers: an equi-join, no product of the two.
    """
    bits = slots.bit_length() - 1
    everything = Window.partitionBy()
    ahead = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cells = 1 << min(bits, 10)
    edges = (goals.withColumn("budget", F.sum("goal").over(everything))
             .withColumn("lo", F.coalesce(F.sum("goal").over(ahead), F.lit(0)))
             .filter("goal > 0")
             .withColumn("block_size", F.greatest(F.ceil(F.col("budget") / F.lit(slots)).cast("long"), F.lit(1)))
             .withColumn("low", F.col("lo").cast("decimal(38,0)") * slots / F.col("budget"))
             .withColumn("high", (F.col("lo") + F.col("goal")).cast("decimal(38,0)") * slots / F.col("budget")))
    per = slots // cells
    spread = edges.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / per).cast("long"), F.least(F.floor(F.col("high") / per).cast("long"), F.lit(cells - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id"), bits).alias("point")).withColumn(
        "cell", F.floor(F.col("point") / per).cast("long"))
    at = F.col("point").cast("decimal(38,0)") * F.col("budget")
    drawn = points.join(spread, "cell").filter((at >= F.col("lo") * slots) & (at < (F.col("lo") + F.col("goal")) * slots))
    rank = Window.partitionBy("source").orderBy("slot")
    ranked = drawn.withColumn("block", F.row_number().over(rank).cast("long") - 1).select("slot", "source", "block", "goal", "block_size")
    # Blocks that discrepancy left short go to the end; their number is bounded by it, not by the data.
    got = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    e, g = edges.alias("e"), got.alias("g")
    missing = (e.join(g, F.col("e.source").eqNullSafe(F.col("g.source")), "left")
               .withColumn("need", F.ceil(F.col("goal") / F.col("block_size"))).withColumn("have", F.coalesce("got", F.lit(0)))
               .filter("need > have")
               .select(F.lit(slots).alias("slot"), F.col("e.source").alias("source"),
                       F.explode(F.sequence("have", F.col("need") - 1)).alias("block"), "goal", "block_size"))
    taken = F.least(F.col("goal") - F.col("block") * F.col("block_size"), F.col("block_size"))
    return ranked.unionByName(missing).withColumn("tokens", taken).filter("tokens > 0")


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight=default_weight, cap: int = CAP,
           slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Every row with its place and its source's target; and ``source, offset, from, slot, block, n``: the words that a
    block takes of the copy that starts at ``from`` of the row at ``offset``."""
    spark = docs.sparkSession
    sizes = sized(docs, id_col, text_col, source_col)
    goal = targets(sizes, weight, cap).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    path = scratch_dir(spark, "goals")
    goal.write.parquet(path)
    goal = spark.read.parquet(path)
    # Sources get points in proportion to their goals: with many sources there must be many points.
    slots = max(slots, 1 << (goal.count() * SLOTS_PER_SOURCE - 1).bit_length())
    blocks = schedule(spark, goal, slots)
    docs_at = laid_out(sizes)
    joined = docs_at.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select(
        "d.*", "g.source_size", "g.target", "g.goal")
    budget = goal.agg(F.sum("goal").alias("budget")).select(F.greatest(F.ceil(F.col("budget") / F.lit(slots)).cast("long"), F.lit(1)).alias("block_size"))
    # Each round of the source that the goal reaches, and each block that the document meets in it.
    rounds = F.floor((F.col("goal") - F.col("offset") - 1) / F.col("source_size")).cast("long")
    block_size = budget.first()["block_size"] or 1
    met = (joined.filter("size > 0 AND goal > offset")
           .withColumn("from", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), rounds), lambda e: e * F.col("source_size") + F.col("offset"))))
           .withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / F.lit(block_size)).cast("long"),
                                                     F.floor((F.col("from") + F.col("size") - 1) / F.lit(block_size)).cast("long")))))
    b = blocks.select("source", "slot", "block", "tokens")
    hit = met.alias("m").join(b.alias("b"), F.col("m.source").eqNullSafe(F.col("b.source")) & (F.col("m.block") == F.col("b.block")))
    start = F.col("m.block") * F.lit(block_size)
    overlap = F.greatest(F.least(F.col("from") + F.col("size"), start + F.col("tokens")) - F.greatest(F.col("from"), start), F.lit(0))
    return joined, hit.select(F.col("m.source").alias("source"), "offset", "from", "slot", F.col("m.block").alias("block"), overlap.alias("n"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight=default_weight,
         cap: int = CAP, slots: int = SLOTS) -> DataFrame:
    """``id, source, size, tie, order, source_size, target, taken, first_slot`` of every row: the words that the schedule
    takes of it, and the first slot that does (null where none does)."""
    joined, hit = _drawn(docs, id_col, text_col, source_col, weight, cap, slots)
    # A source's offset names one document that has words.
    drawn = hit.filter("n > 0").groupBy("source", "offset").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"))
    done = joined.alias("j").join(drawn.alias("t"), F.col("j.source").eqNullSafe(F.col("t.source"))
                                  & (F.col("j.offset") == F.col("t.offset")) & (F.col("j.size") > 0), "left")
    return done.select("j.id", "j.source", "j.size", "j.tie", "j.order", "j.source_size", "j.target",
                       F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"), F.col("t.first_slot").cast("long").alias("first_slot"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in the order of the schedule, with the columns of ``docs``: a document once for each time it is
    taken whole, and the words of a last part. ``n_chars``, where there is such a column, follows the text. Equal rows
    share their draws. Rows are range-partitioned by slot, so every part file is a stretch of the schedule."""
    rows, columns = _ordered(docs, id_col, text_col, source_col, SLOTS)
    return rows.orderBy("_at").select(*columns)


def mix_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 slots: int = SLOTS) -> DataFrame:
    """The rows of ``mix`` with the schedule's ``slot`` and ``block`` (after the columns of ``docs``) that first take of each.

    By ``slot, block`` every stretch from the start holds the sources near their weights, to one document of each.
    """
    rows, columns = _ordered(docs, id_col, text_col, source_col, slots)
    return rows.select(*columns, F.col("_at.slot").alias("slot"), F.col("_at.block").alias("block"))


def _ordered(docs: DataFrame, id_col: str, text_col: str, source_col: str, slots: int) -> tuple[DataFrame, list[Column]]:
    """Rows of the mix with ``_at`` (slot and block that first take of each), and the columns of ``docs`` in them."""
    joined, hit = _drawn(docs, id_col, text_col, source_col, slots=slots)
    first = F.min(F.struct("slot", "block"))
    copies = hit.filter("n > 0").groupBy("source", "offset", "from").agg(F.sum("n").alias("_n"), first.alias("_at"))
    held = joined.alias("j").join(copies.alias("t"), F.col("j.source").eqNullSafe(F.col("t.source"))
                                  & (F.col("j.offset") == F.col("t.offset")) & (F.col("j.size") > 0)).select(
        "j.order", "j.tie", F.col("j.size").alias("_size"), "t._n", "t._at")
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    # The row's own columns travel as one, so none of them can clash with a working column.
    keyed = docs.select(F.struct("*").alias("_doc"), key.alias("order"),
                        F.xxhash64(*content(docs)).alias("tie")).dropDuplicates(["order", "tie"])
    text = F.col(f"_doc.`{text_col}`")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0)), 1, F.col("_n").cast("int")), "")
    out = keyed.join(held, ["order", "tie"]).withColumn("_text", F.when(F.col("_n") < F.col("_size"), part).otherwise(text))
    new = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out, [new[c].alias(c) if c in new else F.col(f"_doc.`{c}`") for c in docs.columns]


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", "source",
                             "first_slot")


SQL = {"op7_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
             md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT z FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE w FROM s),
f AS (SELECT *, (sum(z) OVER () - coalesce(sum(z * {CAP}) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) lev FROM r
      WINDOW b AS (ORDER BY z * {CAP} / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, z, CASE WHEN z * {CAP} <= lev * w THEN (z * {CAP})::DOUBLE ELSE w * max(lev) FILTER (z * {CAP} > lev * w) OVER () END target FROM f),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(ord, 1, 6))::INT % {BUCKETS}, ord
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT off FROM d),
-- Van der Corput points (the bits of a slot in reverse) in the sources' stretches of the budget, ranked per source: {SLOTS} slots for up to {SLOTS // SLOTS_PER_SOURCE} sources.
q AS (SELECT i slot, list_sum(list_transform(range({SLOTS.bit_length() - 1}), lambda b: ((i >> b) & 1) << ({SLOTS.bit_length() - 2} - b)))::HUGEINT p
      FROM (SELECT unnest(range({SLOTS})) i)),
c AS (SELECT source, floor(target + 0.5)::HUGEINT goal, (coalesce(sum(floor(target + 0.5)) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0))::HUGEINT lo, (sum(floor(target + 0.5)) OVER ())::HUGEINT budget FROM t),
k AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 block FROM q JOIN c
      ON p * budget >= lo * {SLOTS} AND p * budget < (lo + goal) * {SLOTS})
SELECT doc_id, size, z source_size, round(target, 6) target,
       list_sum(list_transform(range({CAP}), lambda e: greatest(least(e * z + off + size, floor(target + 0.5)) - (e * z + off), 0)))::BIGINT taken, o.source,
       CASE WHEN size > 0 AND off < floor(target + 0.5) THEN coalesce(k.slot, {SLOTS}) END::BIGINT first_slot
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT greatest(ceil(sum(floor(target + 0.5)) / {SLOTS}), 1)::BIGINT bs FROM t)
LEFT JOIN k ON k.source IS NOT DISTINCT FROM o.source AND k.block = off // bs
"""}
QUERIES = {"op7_mixing": op7_mixing}
