"""Lookups on keys of which a few hold most of the rows.

A shuffle sends all rows of a key to one task. Here a frequent-items sketch over the rows finds
the heavy keys (of constant size, merged like a count; no key with more than its share is missed), their lookup rows
are broadcast, which is bounded by the number of keys that can have such a share, and the rows of
all other keys are shuffled. Rows of heavy keys, and rows without a key, pass the
shuffle spread evenly, because a salt keeps them from meeting anything there.

The spread does not depend on what the runtime sees and splits. A lookup that Spark
broadcasts as a whole needs none of this and is joined plainly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.session import estimated_bytes, written

# A key is heavy if it holds more than one in HEAVY_SHARE rows, so there are fewer than that many.
HEAVY_SHARE = 200
TRACKED = 16 * HEAVY_SHARE
SALTS = 1 << 16


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the table's size is within its broadcast limit."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return limit > 0 and estimated_bytes(df) <= limit


def _token(keys: Sequence[str]) -> Column:
    """The key as one text; null if any part of it is."""
    return F.concat(*[part for k in keys for part in (F.col(k).cast("string"), F.lit("\x1f"))])


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: int = HEAVY_SHARE) -> DataFrame:
    """``_token`` of every key with more than one in ``share`` of the rows: at most ``share`` rows."""
    told = rows.select(_token(keys).alias("_token")).agg(
        F.expr(f"approx_top_k(_token, {share}, {16 * share})").alias("_top"), F.count("*").alias("_all")
    )
    often = F.filter("_top", lambda x: x["item"].isNotNull() & (x["count"] * share > F.col("_all")))
    return told.select(F.explode(F.transform(often, lambda x: x["item"])).alias("_token"))


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], seen_in: DataFrame | None = None, share: int = HEAVY_SHARE) -> DataFrame:
    """``rows`` left joined with ``table``, which has one row per key.

    ``seen_in`` has the same keys as ``rows`` about as often, and is cheaper to count (rows before
    they were joined to other tables). Its heavy keys are then sought at once and their few rows written, so that
    the join's plan reads ``rows`` only.
    """
    keys = list(keys)
    if fits_broadcast(table):
        return rows.join(table, keys, "left")
    more = [c for c in table.columns if c not in keys]
    found = table.select(_token(keys).alias("_token"), F.struct(*more).alias("_found")).filter("_token IS NOT NULL")
    heavy = heavy_keys(rows if seen_in is None else seen_in, keys, share).join(found, "_token", "left").withColumn("_heavy", F.lit(True))
    if seen_in is not None:
        heavy = written(heavy, "heavy")
    marked = rows.withColumn("_token", _token(keys)).join(F.broadcast(heavy), "_token", "left")
    apart = F.col("_heavy").isNotNull() | F.col("_token").isNull()
    # All columns take part in the salt, so that rows of one key differ by it. No token holds its sign.
    salt = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(SALTS)).cast("string")
    marked = marked.withColumn("_key", F.when(apart, F.concat(F.lit("\x1e"), salt)).otherwise(F.col("_token")))
    cold = found.select(F.col("_token").alias("_key"), F.col("_found").alias("_cold"))
    joined = marked.join(cold, "_key", "left")
    return joined.select(
        *rows.columns, *[F.coalesce(F.col(f"_found.{c}"), F.col(f"_cold.{c}")).alias(c) for c in more]
    )
