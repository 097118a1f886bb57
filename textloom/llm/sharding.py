"""Sharding by sampled splitters, with DataFrame functions only.

Law ``bytes``: the shards' sizes are near equal. The records' sort key is the hash of
their text, then their id, so equal texts lie together and share a shard as far as
balance allows. Size-weighted draws of that key give quantile boundaries; records are
range-partitioned by them; a range that holds more than its share of bytes or rows
(one text may hold a third of all rows) is subdivided by the record's own hash into
cells. Exact running sums inside cells, over the cells' exact totals, then give each
record its place in the global order, and the place in bytes gives the shard.

Only (id, size, crc, hash) is shuffled, never a text. The tables of boundaries and
cells have a size that ``target_rows`` fixes per record, and are joined by broadcast
only below ``MAX_CELLS``.

Defined results: a null text has size 1 and crc32 0; repeated rows each get a place;
an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 8
#: Ranges at least; more where records are more than this many each.
RANGES, TARGET_ROWS = 1024, 200_000
#: Expected draws for each range.
DRAWS = 24
#: More cells than this are joined by shuffle.
MAX_CELLS = 200_000


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``key``, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = _longs(bounds[step - 1 :: step]), _longs(bounds)
    c = F.size(F.filter(coarse, lambda b: b <= key))
    return c * step + F.size(F.filter(F.slice(fine, c * step + 1, F.lit(step)), lambda b: b <= key))


def _longs(values: list[int]) -> Column:
    """A constant array, written as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def assign(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, draws: int = DRAWS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col), text, F.lit(17)).alias("own"),
    ))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(ranges, math.ceil(n / TARGET_ROWS))
    share = 0.5 * F.col("size") / F.lit(float(max(total, 1))) + 0.5 / max(n, 1)  # of bytes and of rows
    # A record of weight w is drawn floor(w + u) times, u being a uniform hash of the record.
    u = F.pmod(F.xxhash64("own", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor(share * float(ranges * draws) + u).cast("int")
    drawn = rows.where(copies > 0).select("h", F.explode(F.sequence(F.lit(1), copies)).alias("k"))
    quantiles = F.split(F.lit(",".join(repr(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    bounds = drawn.agg(F.percentile_approx("h", quantiles, F.lit(10 * ranges)).alias("q")).first()["q"] or []
    at = rows.withColumn("range", range_of(F.col("h"), sorted(set(bounds))))
    held = at.groupBy("range").agg(F.sum(share).alias("share"))
    limit = 1.0 / ranges
    parts = held.select("range", F.greatest(F.lit(1), F.ceil(F.col("share") / limit * 0.75)).cast("int").alias("parts"))
    placed = cut(_small_join(at, parts, "range", ranges).select("id", "size", "crc", "h", "own", "range", F.when(F.col("parts") > 1, F.pmod("own", "parts")).otherwise(0).alias("sub")))
    cells = placed.groupBy("range", "sub").agg(F.sum("size").alias("cell_bytes"), F.count("*").alias("cell_rows"))
    before = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("range", "sub", F.coalesce(F.sum("cell_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range", "sub").orderBy("h", F.col("id").asc_nulls_first(), "own", "size", "crc")
    joined = _small_join(placed, offsets, ["range", "sub"], 2 * ranges)
    middle = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    ordered = cut(joined.select("id", "size", "crc", F.least(F.lit(shards - 1), F.floor(middle * shards / float(max(total, 1)))).cast("int").alias("shard"), (F.col("rows_before") + F.row_number().over(inside) - 1).cast("bigint").alias("place")))
    first = ordered.groupBy("shard").agg(F.min("place").alias("first"))
    return ordered.join(F.broadcast(first), "shard").select(  # as many rows as shards
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _small_join(rows: DataFrame, small: DataFrame, on, size: int) -> DataFrame:
    return rows.join(F.broadcast(small) if size <= MAX_CELLS else small, on)
