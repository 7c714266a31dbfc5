"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _stage

#: 1 / golden ratio as a 64-bit fraction (a fixed value), for exact points in integer arithmetic.
GOLDEN = 11400714819323198485
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 2048
#: Slots of the schedule, and documents of a source (on average), that are ranked together.
GROUP, PART = 1024, 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, source: str = "source") -> DataFrame:
    """source, source_size, weight, target for each source; sizes has source and source_size.

    Sources in code point order, null last, get the weights in turn and share `share` times all sizes by weight. Targets stop at
    `most` times their source's size; what is left over goes to the others by weight, until none is above: with sources ordered by
    cap / weight, the capped ones are a prefix, found by running sums.
    """
    # One row for each source: these windows go over a table of sources, not of documents.
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("_nth", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))).withColumn("weight", w)
    x = x.withColumn("_cap", most * F.col("source_size")).withColumn("_total", share * F.sum("source_size").over(Window.partitionBy(F.lit(1))))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    x = x.withColumn("_open", F.sum("weight").over(Window.partitionBy(F.lit(1))) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("_level", F.col("_left") / F.col("_open")).withColumn("_free", F.col("_cap") >= F.col("_level") * F.col("weight"))
    level = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap"))))
    return x.select(source, "source_size", "weight", "target", "_nth")


def _points(slots: DataFrame) -> DataFrame:
    """slots (slot) with point: slot * golden ratio mod 1, to 48 bits, in integer arithmetic."""
    # slot * GOLDEN mod 2^64 in longs: the product wraps in 32-bit halves, and each partial product stays below 2^63.
    k, mask = F.col("slot"), F.lit((1 << 32) - 1)
    gl, gh = F.lit(GOLDEN & ((1 << 32) - 1)), F.lit(GOLDEN >> 32)
    kl, kh = k.bitwiseAND(mask), F.shiftrightunsigned(k, 32)
    lo16, hi16 = kl.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(kl, 16)
    a = lo16 * gl
    b = hi16 * gl + F.shiftrightunsigned(a, 16)
    carry = F.shiftrightunsigned(b, 16)
    high = (carry + ((lo16 * gh + F.shiftleft((hi16 * gh).bitwiseAND(mask), 16)).bitwiseAND(mask)) + (kh.bitwiseAND(F.lit(0xFFFF)) * gl).bitwiseAND(mask) + F.shiftleft((F.shiftrightunsigned(kh, 16) * gl).bitwiseAND(mask), 16)).bitwiseAND(mask)
    return slots.withColumn("point", (high.cast("double") * 65536 + b.bitwiseAND(F.lit(0xFFFF))) / float(1 << 48))


def _drawn(intervals: DataFrame, first: int, slots: int, buckets: int) -> DataFrame:
    """slot, nth for slots first to slots - 1: whose interval [low, high) the slot's point lies in. A point looks only at the intervals of its bucket."""
    at = lambda x: F.least(F.floor(x * buckets), F.lit(buckets - 1))
    cut = intervals.select("nth", "low", "high", F.explode(F.sequence(at(F.col("low")), at(F.col("high")))).alias("bucket"))
    points = _points(intervals.sparkSession.range(first, slots).withColumnRenamed("id", "slot")).withColumn("bucket", at(F.col("point")))
    return points.join(_stage.bounded(cut), "bucket").where("low <= point and point < high").select("slot", "nth")


def schedule(quotas: DataFrame) -> DataFrame:
    """slot, nth, rank: which source each slot of the mix takes its next block from, and how many it took before.

    quotas, kept still: nth (a source's number) and quota (blocks, one at least). The unit interval is cut in proportion to the
    quotas, and slot k draws the source at the point k * golden ratio mod 1, so that sources follow their quotas closely at every prefix.
    Slots are drawn until each source has met its quota; a source that has is passed over, and slots are numbered gaplessly. Ranks are
    counted in groups of slots, and the groups' counts are summed up, so no task holds a source's whole schedule.
    """
    sources, total = quotas.agg(F.count("*"), F.sum("quota")).first()
    if not total:
        return quotas.select(F.lit(0).cast("long").alias("slot"), "nth", F.lit(0).cast("long").alias("rank")).limit(0)
    upto = F.sum("quota").over(Window.orderBy("nth"))  # a row for each source
    ends = _stage.frozen(quotas.select("nth", "quota", ((upto - F.col("quota")) / F.lit(float(total))).alias("low"), F.when(upto == total, 1.0).otherwise(upto / F.lit(float(total))).alias("high")))
    buckets = 1 << (4 * sources).bit_length()
    # Three distances: the points of 2.7 slots a block leave no gap as wide as a block's interval, and large sources lack less.
    slots = total + total // 8 + 64
    while True:
        drawn = _drawn(ends, 0, slots, buckets)
        per = _stage.frozen(drawn.groupBy("nth", F.floor(F.col("slot") / GROUP).alias("grp")).agg(F.count("*").alias("n")))
        lacking = ends.join(per.groupBy("nth").agg(F.sum("n").alias("had")), "nth", "left").where("coalesce(had, 0) < quota")
        if lacking.isEmpty():
            break
        slots += slots // 2
    before = per.withColumn("had", F.sum("n").over(Window.partitionBy("nth").orderBy("grp")) - F.col("n")).drop("n")
    ranked = drawn.withColumn("grp", F.floor(F.col("slot") / GROUP))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("grp", "nth").orderBy("slot")) - 1)
    ranked = ranked.join(before, ["nth", "grp"]).withColumn("rank", F.col("place") + F.col("had"))
    kept = _stage.frozen(ranked.join(_stage.bounded(ends.select("nth", "quota")), "nth").where("rank < quota").select("slot", "nth", "rank", "grp"))
    # Numbers without gaps: slots of a group, after those of the groups before. Runs of GROUP groups are summed first.
    counts = kept.groupBy("grp").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("grp") / GROUP))
    runs = counts.groupBy("run").agg(F.sum("n").alias("n"))
    runs = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("of_run"))  # a row for GROUP * GROUP slots
    starts = counts.withColumn("in_run", F.sum("n").over(Window.partitionBy("run").orderBy("grp")) - F.col("n")).join(runs, "run").select("grp", (F.col("of_run") + F.col("in_run")).alias("start"))
    nth_slot = F.row_number().over(Window.partitionBy("grp").orderBy("slot")) - 1
    return kept.withColumn("k", nth_slot).join(starts, "grp").select((F.col("start") + F.col("k")).alias("slot"), "nth", "rank")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 7, doc_id: str = "doc_id", source: str = "source", size: str = "size") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, pieces, sources) of a mix of docs, which has doc_id, source and size (words).

    placed: row (a number), doc (a struct of docs' columns), nth (the source's number), size, begin (words of its source before it, in
    shuffled order).
    pieces: slot, epoch, row, from_word, n_words: what each slot of the mix takes of which document, in schedule order.
    sources: nth, source, source_size, weight, target.
    A source is shuffled by a hash of doc_id and cut into blocks of equally many words; its ranks go through the blocks again and
    again, and its last block is cut short, so it gives its target to within a word. A document is in each pass once, and passes
    are at most `most`. Null sources are a source, null ids and repeated rows are documents like others (equal ones are
    interchangeable), documents without words are never taken, and an empty table gives empty results.
    """
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"), F.struct("*").alias("doc"))
    x = _stage.frozen(x.withColumn("key", F.xxhash64(F.lit(seed), "id", "size")))
    sizes = _stage.frozen(x.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / PART).alias("parts")))
    sources = _stage.frozen(targets(sizes.select("source", "source_size"), weights, share, most).withColumnRenamed("_nth", "nth"))
    # A row for each source: a hot one is cut into as many more parts, so all parts are of about PART documents.
    numbers = _stage.bounded(sources.select(F.col("source").alias("name"), "nth").join(sizes.select(F.col("source").alias("other"), "parts"), F.col("name").eqNullSafe(F.col("other"))).select("name", "nth", "parts"))
    x = x.join(numbers, F.col("source").eqNullSafe(F.col("name"))).withColumn("part", F.pmod("key", "parts")).drop("name", "parts")
    parts = x.groupBy("nth", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("before", F.sum("words").over(Window.partitionBy("nth").orderBy("part")) - F.col("words")).drop("words")
    inside = F.sum("size").over(Window.partitionBy("nth", "part").orderBy("key", "id", "size", "row")) - F.col("size")
    placed = x.withColumn("inside", inside).join(parts, ["nth", "part"])
    placed = placed.select("row", "doc", "nth", "size", (F.col("before") + F.col("inside")).alias("begin"))

    quotas = sources.where("source_size > 0").withColumn("words", F.floor(F.col("target") + 1e-6)).where("words > 0")
    quotas = _stage.frozen(quotas.select("nth", F.ceil(F.col("words") / block_words).alias("quota"), "words", "source_size"))
    few = _stage.bounded(quotas.select("nth", "words", "source_size"))
    # The mix takes words [rank * block, ...) of the source's endless stream, cut at the target; a pass is source_size words of it.
    taken = schedule(quotas).join(few, "nth").select("slot", "nth", F.col("rank") * block_words, F.least((F.col("rank") + 1) * block_words, F.col("words")), "source_size").toDF("slot", "nth", "from", "to", "source_size")
    passes = F.explode(F.sequence(F.floor(F.col("from") / F.col("source_size")), F.floor((F.col("to") - 1) / F.col("source_size"))))
    taken = taken.withColumn("epoch", passes).withColumn("from", F.greatest(F.col("from") - F.col("epoch") * F.col("source_size"), F.lit(0)))
    taken = taken.withColumn("to", F.least(F.col("to") - F.col("epoch") * F.col("source_size"), F.col("source_size")))
    # A slot's words lie in one or two blocks' cells of the pass; documents lie in as many as they have words for.
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / block_words), F.floor((b - 1) / block_words)))
    taken = taken.withColumn("cell", cells(F.col("from"), F.col("to")))
    spans = placed.where("size > 0").select("nth", "row", "begin", (F.col("begin") + F.col("size")).alias("end")).withColumn("cell", cells(F.col("begin"), F.col("end")))
    low = F.greatest("from", "begin", F.col("cell") * block_words)
    high = F.least("to", "end", (F.col("cell") + 1) * block_words)
    pieces = taken.join(spans, ["nth", "cell"]).withColumns({"low": low, "high": high}).where("low < high")
    pieces = pieces.select("slot", "epoch", "row", (F.col("low") - F.col("begin")).alias("from_word"), (F.col("high") - F.col("low")).alias("n_words"))
    return placed, pieces, sources


def taken_words(docs: DataFrame, weights: list[float], **kw) -> DataFrame:
    """docs with source_size and target of their source, taken (words that the mix takes of them, repeats counted), first_slot (the first
    slot of the schedule that takes from them, null if none does) and n_slots. Columns of these names are replaced."""
    made = ("source_size", "target", "taken", "first_slot", "n_slots")
    placed, pieces, sources = mix(docs, weights, **kw)
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    few = _stage.bounded(sources.select("nth", "source_size", "target"))
    out = placed.join(taken, "row", "left").join(few, "nth")
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in made]
    return out.select(*kept, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))
