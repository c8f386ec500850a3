"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Sizes are words. A source's documents, in the order of a hash, form one stream that is cut into blocks of nearly equal size.
The schedule is a row of slots. Slot i looks at the point frac(i * golden ratio), finds the source whose stretch of cumulative
weight holds it, and takes that source's next block; after the last block the source starts again, three times at most.

Null and empty texts have size 0, take part in nothing and are returned with 0 taken. A null source is a source of its own, last
in order. Repeated rows are documents of their own. Where all sizes are 0, all targets are 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import WORD, read, running_totals
from chatlake.llm.registry import query
from chatlake.session import discard, materialise

WEIGHTS = (5.0, 2.0, 1.0)
#: A source is read so often at most.
MAX_PASSES = 3
BLOCK_WORDS = 32
#: Slots of one slice of the schedule; a slice's slots are made and ranked in one task.
SLICE = 4096
#: Slices of one task.
SLICES_PER_TASK = 64
#: The golden ratio's fraction in units of 2^-31, an odd number; after 2^31 slots the points repeat.
POINTS = 1 << 31
GOLDEN = 1327217885
#: Cells by which points and stretches of weight are matched.
CELLS = 4096
SEED = 17
#: With up to so many sources, their stretches are broadcast: a row for each source and each cell.
BROADCAST_SOURCES = 100_000
#: Beyond it, rows meet their source's figures dealt out by source and so many parts.
PARTS = 16


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``row`` (a hash of id and text) of every row."""
    return docs.select("doc_id", F.col(source).alias("source"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("row"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = MAX_PASSES,
            block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: number in order, size, target, blocks, and its stretch [low, high) of the 2^31 points.

    All words are shared by weight. A source's target stops at ``passes`` times its size and the excess is shared among the rest
    by weight: with sources in the order of limit / weight, those before the first whose limit lies above its share stop.
    The ordering windows run over one row per source, never over documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    numbered = sources.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights))
    limited = numbered.withColumns({"weight": weight, "limit": passes * F.col("source_size").cast("double")})
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    shared = limited.withColumn("share", share).withColumn("over", F.col("limit") > F.col("share") * F.col("weight"))
    level = F.first(F.when(F.col("over"), F.col("share")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("limit") > F.coalesce(level, F.lit(float("inf"))) * F.col("weight"), level * F.col("weight")).otherwise(F.col("limit"))
    blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / block))).otherwise(0).cast("long")
    planned = shared.withColumn("target", target).withColumn("n_blocks", blocks).withColumn(
        "turns", F.when(F.col("n_blocks") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    sofar = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    all_turns = F.sum("turns").over(all_rows)
    edge = F.when(all_turns > 0, F.round(F.sum("turns").over(sofar) / all_turns * POINTS)).otherwise(0).cast("long")
    stretched = planned.withColumns({"high": edge, "n_slots": F.ceil(all_turns)})
    return stretched.select("source", "source_no", "source_size", "target", "n_blocks", "n_slots",
                            F.coalesce(F.lag("high").over(Window.orderBy("source_no")), F.lit(0)).alias("low"), "high")


def schedule(plan: DataFrame, passes: int = MAX_PASSES, bound: int = BROADCAST_SOURCES) -> DataFrame:
    """The slots in use: ``slot``, ``source_no``, ``block`` and ``pass``; built from ``targets``, with no row of a document."""
    slots = plan.agg(F.max("n_slots").alias("n")).filter("n > 0")
    slices = slots.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLICE))).alias("slice"))
    # The few rows of slices become many slots, so the number of tasks follows from the slots; it is not left to the rows' size.
    planned = plan.agg(F.max("n_slots")).first()[0] or 0
    slices = slices.repartition(max(1, -(-int(planned) // (SLICE * SLICES_PER_TASK))), "slice")
    each = slices.select("slice", F.explode(F.sequence(
        F.col("slice") * SLICE, F.least(F.col("n"), (F.col("slice") + 1) * SLICE) - 1)).alias("slot"))
    point = F.pmod(F.pmod("slot", F.lit(POINTS)) * F.lit(GOLDEN).cast("long"), F.lit(POINTS))
    points = each.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS / POINTS))
    width = POINTS // CELLS
    cells = plan.filter("high > low").select(
        "source_no", "n_blocks", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    # Spark takes rows made by explode for as few as their input; without a hint it would broadcast the slots.
    few = plan.limit(bound + 1).count() <= bound
    placed = points.join(cells.hint("broadcast" if few else "merge"), "cell").filter("point >= low AND point < high")
    inside = placed.withColumn("rank", F.row_number().over(Window.partitionBy("slice", "source_no").orderBy("slot")) - 1)
    counts = placed.groupBy("source_no", "slice").count()
    before = counts.select("source_no", "slice", (F.sum("count").over(
        Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    ranked = inside.join(before.hint("merge"), ["slice", "source_no"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("slot", "source_no", (F.col("rank") % F.col("n_blocks")).alias("block"),
                         F.floor(F.col("rank") / F.col("n_blocks")).alias("pass")).filter(F.col("pass") < passes)


def _known(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``sizes`` with the figures of each row's source."""
    named = sizes.withColumns({"_key": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()})
    sources = plan.select(F.coalesce("source", F.lit("")).alias("_key"), F.col("source").isNull().alias("_null"), "source_no",
                          "source_size", "target", "n_blocks")
    return named.join(sources, ["_key", "_null"]).drop("_key", "_null")


def _hash(doc_id: str, row: Column, seed: int) -> Column:
    """Place in the order of a source's documents; rows without an id are told apart by their text."""
    return F.when(F.col(doc_id).isNull(), F.xxhash64(row, F.lit(seed))).otherwise(F.xxhash64(doc_id, F.lit(seed)))


def _placed(known: DataFrame, seed: int) -> DataFrame:
    """Rows with words, with ``_hash`` and the ``start`` of their words in their source's stream."""
    shuffled = known.filter("size > 0").withColumn("_hash", _hash("doc_id", F.col("row"), seed))
    return running_totals(shuffled, "source_no", [F.col("_hash"), F.col("doc_id"), F.col("row"), F.col("size")], "size", "start")


def _edge(block: Column) -> Column:
    """Where a block begins: of a source's n blocks for S words, the first S mod n have one word more than the others."""
    return block * F.floor(F.col("source_size") / F.col("n_blocks")) + F.least(block, F.col("source_size") % F.col("n_blocks"))


def mixed_counts(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = MAX_PASSES, block: int = BLOCK_WORDS,
                 seed: int = SEED) -> DataFrame:
    """Per row of ``sizes`` (stored): ``doc_id``, ``source``, ``size``, ``row``, ``source_size``, ``target`` and ``taken``."""
    plan = materialise(targets(sizes, weights, passes, block), "mix-plan")
    known = _known(sizes, plan)
    placed = _placed(known, seed)
    small, extra = F.floor(F.col("source_size") / F.col("n_blocks")), F.col("source_size") % F.col("n_blocks")
    wide = extra * (small + 1)
    block_of = lambda x: F.when(x < wide, F.floor(x / (small + 1))).otherwise(extra + F.floor((x - wide) / F.greatest(small, F.lit(1))))
    first, last = block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    pieces = pieces.withColumn("words", F.least(F.col("start") + F.col("size"), _edge(F.col("block") + 1))
                               - F.greatest(F.col("start"), _edge(F.col("block"))))
    times = schedule(plan, passes).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (pieces.select("source_no", "block", "start", "words").join(times.hint("merge"), ["source_no", "block"])
             .groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    columns = ["doc_id", "source", "size", "row", "source_size", "target"]
    used = placed.join(taken, ["source_no", "start"], "left").select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return used.unionByName(known.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def cuts(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = MAX_PASSES, block: int = BLOCK_WORDS,
         seed: int = SEED) -> DataFrame:
    """Per source, in the order of its documents: up to which document it is taken once more than ``full`` times.

    The schedule takes a source's blocks in order, so after T slots of n blocks each was taken T div n times and the first T mod n once
    more. ``cut_hash``, ``cut_id`` and ``cut_row`` name the document that holds the place where this ends (null if all are taken equally often) and
    ``cut_share`` is how much of it lies before. Rows alike in id and text are one document here.
    """
    plan = materialise(targets(sizes, weights, passes, block), "mix-plan")
    slots = schedule(plan, passes).groupBy("source_no").agg(F.count(F.lit(1)).alias("slots"))
    ends = materialise(plan.join(slots, "source_no").select(
        "source", "source_no", F.floor(F.col("slots") / F.col("n_blocks")).alias("full"), _edge(F.col("slots") % F.col("n_blocks")).alias("at")), "mix-ends")
    placed = _placed(_known(sizes, plan), seed).select("source_no", "_hash", "doc_id", "row", "start", "size")
    # Rows alike lie side by side, so the least start and the sum of sizes are those of their document.
    holds = (F.col("first") <= F.col("at")) & (F.col("at") < F.col("first") + F.col("words")) & (F.col("at") > 0)
    whole = placed.groupBy("source_no", "_hash", "doc_id", "row").agg(F.min("start").alias("first"), F.sum("size").alias("words"))
    held = whole.join(ends.select("source_no", "at"), "source_no").filter(holds).select(
        "source_no", F.col("_hash").alias("cut_hash"), F.col("doc_id").alias("cut_id"), F.col("row").alias("cut_row"),
        ((F.col("at") - F.col("first")) / F.col("words")).alias("cut_share"))
    found = materialise(ends.join(held, "source_no", "left").select("source", "full", "cut_hash", "cut_id", "cut_row", "cut_share"), "mix-cuts")
    discard(plan, ends)
    return found


def mixed(docs: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, passes: int = MAX_PASSES,
          block: int = BLOCK_WORDS, seed: int = SEED, bound: int = BROADCAST_SOURCES) -> DataFrame:
    """The documents of the mix, each as often as its words are taken, rounded to whole documents.

    Blocks are used in order, so all but one document of a source are taken a whole number of times, which follows from the document's
    place before or after the cut: texts stay where they are. Rows alike in id and text get their rounded mean. A row without
    words is not in the mix.
    """
    sizes = materialise(sized(docs, source), "mix-sizes")
    figures = cuts(sizes, weights, passes, block, seed)
    discard(sizes)
    side = figures.withColumns({"_key": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}).drop("source")
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_row"), F.coalesce(source, F.lit("")).alias("_key"),
                       F.col(source).isNull().alias("_null"), F.struct("*").alias("_doc"))
    rows = rows.filter(F.coalesce("_doc.text", F.lit("")).rlike(WORD)).withColumn("_hash", _hash("_id", F.col("_row"), seed))
    if figures.limit(bound + 1).count() <= bound:
        met = rows.join(F.broadcast(side), ["_key", "_null"])
    else:
        parts = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = rows.withColumn("_part", F.pmod("_row", F.lit(PARTS)).cast("int")).join(parts, ["_key", "_null", "_part"])
    # Null ids come first among equal hashes, as they do in the order of the stream.
    same_id = F.col("_id").eqNullSafe(F.col("cut_id"))
    less_id = (F.col("_id").isNull() & F.col("cut_id").isNotNull()) | F.coalesce(F.col("_id") < F.col("cut_id"), F.lit(False))
    before = (F.col("_hash") < F.col("cut_hash")) | ((F.col("_hash") == F.col("cut_hash")) & (
        less_id | (same_id & (F.col("_row") < F.col("cut_row")))))
    at = (F.col("_hash") == F.col("cut_hash")) & same_id & (F.col("_row") == F.col("cut_row"))
    more = F.when(F.col("cut_hash").isNull(), 0).when(before, 1).when(at, F.round("cut_share").cast("int")).otherwise(0)
    copies = (F.col("full") + more).cast("int")
    return met.filter(copies > 0).select("_doc", F.explode(F.sequence(F.lit(1), copies))).select("_doc.*")


@query()
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = materialise(sized(read(spark, folder, "documents")), "mix-sizes")
    return mixed_counts(sizes).select("doc_id", "size", "source_size", "target", "taken")
