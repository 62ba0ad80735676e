"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The paper's linear congruential generator: state * MULTIPLIER + 1 modulo 2^64 (fixed value).
MULTIPLIER = 2862933555777941757
#: Steps tried at first; the few keys that need more take the others too.
STEPS = 64
#: Slices of a shard that are numbered apart; a power of two.
SLICES = 1024


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, in halves of 32 bits, so that no product leaves a long."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & 0xFFFF_FFFF
    m1, m0 = m_lo >> 16, m_lo & 0xFFFF
    cross = lo * m1
    low = lo * m0 + F.shiftleft(cross.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(cross, 16)

    def times(x: Column, by: int) -> Column:  # modulo 2^32
        return (x * (by & 0xFFFF) + F.shiftleft((x * (by >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFF_FFFF)

    return (carry + times(hi, m_lo) + times(lo, m_hi)).bitwiseAND(0xFFFF_FFFF), low.bitwiseAND(0xFFFF_FFFF)


def _halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(0xFFFF_FFFF)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long key. One more shard takes keys only into itself. A null key's shard is 0, whatever their number."""
    hi, lo = _halves(key)
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        leap = ((s["to"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.when(s["to"] < shards, F.struct(hi.alias("hi"), lo.alias("lo"), s["to"].alias("at"), leap.alias("to"))).otherwise(s)

    def steps(state: Column, first: int, last: int) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, step)

    done = steps(start, 1, min(shards, STEPS))
    if shards > STEPS:
        done = F.when(done["to"] < shards, steps(done, STEPS + 1, shards)).otherwise(done)
    return done["at"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more); columns of docs so named are replaced.

    The law is `key`: doc_id and the number of shards decide, so a document stays where it is
    whatever else comes or goes. size is the text's UTF-8 bytes plus 1 (null: 1; its crc32 is
    that of no bytes). slot numbers a shard's rows from 0 without gaps, slice by slice of a
    hash of id and text, then by doc_id, text_crc32 and size; rows that agree in all these are
    interchangeable. So neither an id on many texts (null, say, which counts as 0) nor a text
    under many ids is one slice's. Repeated rows each get a slot. Texts of any length are only
    measured and summed. The counts that are broadcast number SLICES * shards at most, whatever
    the table holds.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({
        "size": F.octet_length(text).cast("long") + 1,
        "text_crc32": F.crc32(text.cast("binary")),
        "law": F.lit("key"),
        "shard": jump_shard(key, shards),
        "grown_shard": jump_shard(key, shards + 1),
        "_slice": (F.shiftright(_next(*_halves(key))[0], 1) + F.crc32(text.cast("binary"))).bitwiseAND(SLICES - 1).cast("int"),
    })
    counts = rows.groupBy("shard", "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    order = Window.partitionBy("shard", "_slice").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    numbered = rows.withColumn("_n", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "_slice"])
    return numbered.withColumn("slot", (F.col("_offset") + F.col("_n") - 1).cast("long")).drop("_slice", "_n", "_offset")
