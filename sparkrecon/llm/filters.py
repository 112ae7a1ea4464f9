"""A bounded bitmap of keys, so that a join on few keys shuffles few of the other side's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap row, as Spark's bitmap functions have them.
ROW_BITS = 32768
#: Bits at most: 16 MB are broadcast, whatever the number of keys.
MOST_BITS = 1 << 27


def flagged(rows: DataFrame, key: Column, keys: DataFrame, into: str, bits_a_key: int = 16) -> DataFrame:
    """Add into: false if key is surely not among keys (a written table of one column of 64-bit hashes); null keys are false.

    A bitmap of so many bits a key, MOST_BITS at most, is broadcast. Rows that are flagged without need are about one in
    bits_a_key, more only where the keys outgrow the bitmap; they cost a join, never a row.
    """
    n = max(1, keys.count())
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (bits_a_key * n - 1).bit_length()))
    name = keys.columns[0]
    slot = F.pmod(F.col(name), F.lit(bits))
    maps = keys.filter(F.col(name).isNotNull()).select((slot / ROW_BITS).cast("int").alias("_row"), (slot % ROW_BITS).alias("_bit"))
    maps = maps.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    own = F.pmod(key, F.lit(bits))
    rows = rows.withColumn("_slot", own)
    joined = rows.join(F.broadcast(maps), (F.col("_slot") / ROW_BITS).cast("int") == F.col("_row"), "left")
    bit = (F.col("_slot") % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(into, F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))).drop("_slot", "_row", "_map")
