"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a share of all words and a weight schedule over training time, t from 0 to 1.
The schedule's integral up to t is the source's word demand so far; a copy of a document that
starts at word u of its source's stream is due when the demand reaches u, so its position is the
inverse of the integral at u. Documents are dealt by range of position.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, few, word_count

#: A source's words may be taken this often at most.
MOST = 3
#: Weights of the sources in code point order, repeating, and how each source's schedule leans:
#: it runs from (1 - lean) to (1 + lean) times its mean.
WEIGHTS = (1, 2, 3)
LEANS = (0.5, 0.0, -0.5)
#: Ranges of position that are put in order apart.
RANGES = 4096


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(38,0)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, leans: tuple[float, ...] = LEANS) -> DataFrame:
    """Of (source, source_size): weight, lean, target and quota (the target in whole words).

    Targets share the sum of all sizes by weight; one that would pass MOST times its source's
    size stops there and the others share what it leaves. In order of size by weight, sources
    stop as long as the share of the next is beyond its limit; all that is compared and divided
    is whole numbers. One row a source: the windows without a key hold no more than that.
    """
    ranked = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(ranked) - 1) % len(weights) + 1
    rows = sizes.select("source", "source_size", place.cast("int").alias("place"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place")).cast("long"))
    rows = rows.withColumn("lean", F.element_at(F.array(*map(F.lit, leans)), F.col("place")))
    by_limit = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.asc_nulls_last("source"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("source_size").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({
        "left": F.sum("source_size").over(whole) - MOST * stopped,
        "weights": F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
        "at": F.row_number().over(by_limit),
    })
    goes_on = _exact("left") * F.col("weight") <= MOST * F.col("source_size") * F.col("weights")
    rows = rows.withColumn("first", F.min(F.when(goes_on, F.col("at"))).over(whole))
    here = F.when(F.col("at") == F.col("first"), F.struct("left", "weights"))
    rows = rows.withColumn("share", F.max(here).over(whole))
    shared = (F.col("share.left") * F.col("weight")).cast("double") / F.col("share.weights")
    target = F.when(F.coalesce(F.col("at") < F.col("first"), F.lit(True)), (MOST * F.col("source_size")).cast("double")).otherwise(shared)
    return rows.select("source", "source_size", "weight", "lean", target.alias("target"), F.round(target).cast("long").alias("quota"))


def due(x: Column, lean: Column) -> Column:
    """The time at which a schedule leaning so has used up the part x of its demand.

    The demand by t is t + lean * (t * t - t); this is its inverse, in a form that holds for lean 0.
    """
    return 2 * x / ((1 - lean) + F.sqrt((1 - lean) * (1 - lean) + 4 * lean * x))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, leans: tuple[float, ...] = LEANS) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, taken, positions), one row each (doc_id, source, size).

    positions: one number (0 to 1) a copy to train on. rows: how many rows of docs the three
    name; they share one decision, so repeated rows are all taken or all left.
    Every document is taken as many whole times as its source's quota holds the source, and
    some once more, so that the words come near the quota: first among documents larger than
    their source's mean, in order of a hash of the id, then among the others, which settle what
    the larger ones leave over or overdrew. No document is taken more than MOST times.

    A null text has no words; documents without words, or of a source without, are not taken
    (no positions). A null source is a source of its own, last in order; null ids are one id.
    No rows in, none out. Hashes of the id also cut each source into slices, summed before
    they are put in order, so a source that holds most rows is no single task's. Only ids,
    sources and sizes are shuffled.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    rows = cut(rows.withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    rows = rows.withColumn("_slice", F.substring("_md5", 1, 2)).withColumn("_words", F.col("size") * F.col("rows"))
    sizes = cut(rows.groupBy("source").agg(F.sum("_words").alias("source_size"), F.sum("rows").alias("_n")), "sources")
    goals = targets(sizes, weights, leans).join(sizes.select(F.col("source").alias("_s"), "_n"), F.expr("source <=> _s")).drop("source")
    rows = rows.join(few(cut(goals, "goals")), F.expr("source <=> _s")).drop("_s")
    rows = rows.withColumn("_small", F.col("size") * F.col("_n") <= F.col("source_size"))

    # words before each document: in its source, size class and slice, and in the slices before
    groups = rows.groupBy(F.col("source").alias("_s"), F.col("_small").alias("_c"), F.col("_slice").alias("_i")).agg(F.sum("_words").alias("_sum"))
    earlier = Window.partitionBy("_s", "_c").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    groups = groups.select("_s", "_c", "_i", start.alias("_start"), F.sum("_sum").over(Window.partitionBy("_s", "_c")).alias("_class"))
    rows = rows.join(few(cut(groups, "slices")), F.expr("source <=> _s and _small = _c and _slice = _i")).drop("_s", "_c", "_i")
    inside = Window.partitionBy("source", "_small", "_slice").orderBy("_md5", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_words").over(inside), F.lit(0)))

    passes = F.floor(F.col("quota") / F.greatest("source_size", F.lit(1))).cast("long")
    rows = rows.withColumn("_passes", passes).withColumn("_rest", F.col("quota") - F.col("_passes") * F.col("source_size"))
    large_part = F.round((_exact("_rest") * F.col("_class")).cast("double") / F.greatest("source_size", F.lit(1))).cast("long")

    def fits(quota: Column) -> Column:
        return (F.col("size") > 0) & (2 * F.col("_before") + F.col("_words") <= 2 * quota)

    rows = cut(rows.withColumn("_large", ~F.col("_small") & fits(large_part)), "order")
    used = rows.groupBy(F.col("source").alias("_s")).agg(F.sum(F.when(F.col("_large"), F.col("_words")).otherwise(0)).alias("_used"))
    rows = rows.join(few(cut(used, "used")), F.expr("source <=> _s")).drop("_s")
    once_more = F.when(F.col("_small"), fits(F.col("_rest") - F.col("_used"))).otherwise(F.col("_large"))

    # where each copy starts in its source's stream: pass by pass, the larger documents first
    ahead = F.col("_before") + F.when(F.col("_small"), F.col("source_size") - F.col("_class")).otherwise(0)
    again = F.col("_before") + F.when(F.col("_small"), F.col("_used")).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("_passes") + once_more.cast("long")).otherwise(0)

    def begins(k: Column) -> Column:
        return F.when(k < F.col("_passes"), k * F.col("source_size") + ahead).otherwise(F.col("_passes") * F.col("source_size") + again)

    numbers = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<long>"))
    part = lambda k: F.least(begins(k) / F.col("target"), F.lit(1.0))
    rows = rows.withColumn("positions", F.transform(numbers, lambda k: due(part(k), F.col("lean"))))
    taken = (F.col("size") * F.size("positions")).alias("taken")
    return rows.select("doc_id", "source", "size", "rows", "source_size", "target", taken, "positions")


def placed(planned: DataFrame) -> DataFrame:
    """A plan with first_position, the first copy's position, and place, its number in the training stream from 0.

    The stream is the range sort of all copies of all rows by position, then doc_id, source and
    size; a copy of several rows comes once for each. Ranges of position are of equal width, so
    their bounds are known, and are numbered each on its own behind the counts of those before.
    Rows that are not taken have neither. Among ties null ids come first and null sources
    last. No rows in, none out.
    """
    copies = planned.select("*", F.posexplode("positions").alias("_k", "_at"))
    copies = copies.withColumn("_range", F.least(F.floor(F.col("_at") * RANGES), F.lit(RANGES - 1)).cast("int"))
    copies = cut(copies.select("doc_id", "source", "size", "rows", "source_size", "target", "taken", "positions", "_k", "_at", "_range"), "copies")
    counts = copies.groupBy("_range").agg(F.sum("rows").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", before.alias("_before"))
    order = Window.partitionBy("_range").orderBy("_at", F.asc_nulls_first("doc_id"), F.asc_nulls_last("source"), "size", "_k").rowsBetween(Window.unboundedPreceding, -1)
    numbered = copies.withColumn("_ahead", F.coalesce(F.sum("rows").over(order), F.lit(0))).join(F.broadcast(counts), "_range")
    first = numbered.where("_k = 0").withColumns({"first_position": F.col("_at"), "place": F.col("_before") + F.col("_ahead")})
    none = planned.where(F.size("positions") == 0).withColumns({"first_position": F.lit(None).cast("double"), "place": F.lit(None).cast("long")})
    return first.select(*none.columns).unionByName(none)


#: Rows of one group that are made at once.
ROWS = 4096


def each_row(placed: DataFrame) -> DataFrame:
    """A placed plan with a row for each of its `rows`, places counted on; a large group's rows are made in pieces by several tasks."""
    piece = lambda first, n: F.explode(F.sequence(first, first + n - 1))
    zero, rows = F.lit(0).cast("long"), F.col("rows")
    few_rows = placed.where(rows <= ROWS).withColumn("_row", piece(zero, rows))
    pieces = placed.where(rows > ROWS).withColumn("_piece", F.explode(F.sequence(zero, F.floor((rows - 1) / ROWS))))
    dealt = pieces.repartition("doc_id", "source", "size", "_piece")
    many = dealt.withColumn("_row", piece(F.col("_piece") * ROWS, F.least(F.lit(ROWS).cast("long"), rows - F.col("_piece") * ROWS))).drop("_piece")
    return few_rows.unionByName(many).withColumn("place", F.col("place") + F.col("_row")).drop("_row")


def materialize(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, leans: tuple[float, ...] = LEANS) -> DataFrame:
    """(doc, position): the training stream, each copy of each document as a row, range-sorted by position.

    doc is a struct of the document's columns, so none of their names clash. Ties of position
    are in order of doc_id and a hash of the row. Repeated rows are rows of their own; null and
    empty texts, and documents of a source without words, aren't in the stream; null ids and
    sources are as in plan(). Texts of any length are copied whole. No rows in, none out.
    """
    planned = plan(docs, weights, leans).where(F.size("positions") > 0)
    planned = planned.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("positions").alias("_p"))
    sized = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("_size"))
    found = sized.join(planned, F.expr("doc_id <=> _d and source <=> _s and _size = _z")).select("doc", F.explode("_p").alias("position"))
    return found.repartitionByRange("position").sortWithinPartitions("position", "doc.doc_id", F.xxhash64("doc"))


def stream_order(stream: DataFrame) -> DataFrame:
    """A materialized stream, written as files and read again, with stream_part and stream_row: ordered by both it is in order of position.

    The range sort numbers the files, and rows stand in order in each; reading in any order
    doesn't change that. Both are null if the stream isn't read from Parquet files. Files must be
    one a task: a stream written with maxRecordsPerFile has several that share a number.
    """
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        stream.select(name, row)
    except AnalysisException:
        name, row = F.lit(None).cast("string"), F.lit(None).cast("long")
    return stream.select("*", F.regexp_extract(name, r"part-(\d+)", 1).cast("int").alias("stream_part"), row.alias("stream_row"))
