"""Shared pieces of the training-data operators: storage for intermediate tables, joins that stand hot keys, text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.storage import drop_table, materialize, shared_dir  # noqa: F401  (used through this module)

#: A word is a longest run of characters other than these six (space and code points 9 to 13).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only when it has at most this many rows and this many key bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20
#: Keys with at least 1/HOT_SHARE of all rows are hot; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Items that a running expression appends to before it begins another array.
BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where lambdas inside ``body`` use it many times."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, state: Column, kind: str, step) -> Column:
    """An array of what ``step(state, item) -> (state, array of kind)`` gives out along ``items`` (a bound array).

    Arrays are appended to in blocks, so the cost is not in the square of their length.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, number: Column) -> Column:
        done = F.aggregate(F.slice(items, number * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(numbers, start, block, lambda acc: acc["out"]))).otherwise(empty)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def count_words(text: Column) -> Column:
    """Number of words: places where a word begins."""
    return F.coalesce(F.size(words_of(text)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) from a hash: the first 52 bits of the MD5 of the values joined by a colon (null as empty)."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def join_back(left: DataFrame, right: DataFrame, key: str, count: str, salt: Column) -> DataFrame:
    """Left join of ``left`` with the per-key table ``right`` on the string ``key``; null equals null.

    ``right`` has each key once and in ``count`` the number of left rows with it. A small ``right`` (its rows and bytes
    are counted) is broadcast whole. Otherwise keys with a thousandth of all rows or more, at most ``HOT_SHARE`` of
    them, are broadcast, and the rest joins by a shuffle in which rows of hot keys are spread by ``salt``.
    """
    size = right.agg(
        F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length(key), F.lit(0))).alias("bytes"), F.sum(count).alias("total")
    ).first()
    values = [c for c in right.columns if c != key]
    if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        small = right.select(F.col(key).alias("__key"), *values)
        return left.join(F.broadcast(small), left[key].eqNullSafe(F.col("__key")), "left").drop("__key")
    hot = right.where(F.col(count) * HOT_SHARE >= F.lit(size["total"] or 0)).select(
        F.col(key).alias("__hot"), F.struct(*values).alias("__hot_values")
    )
    left = left.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left").drop("__hot")
    left = left.withColumn(
        "__key",
        F.when(F.col("__hot_values").isNotNull(), F.concat(F.lit("\x00hot"), F.pmod(F.xxhash64(salt), F.lit(65536)).cast("string"))).otherwise(
            F.coalesce(F.col(key), F.lit("\x00null"))
        ),
    )
    cold = right.select(F.coalesce(F.col(key), F.lit("\x00null")).alias("__key"), F.struct(*values).alias("__cold_values"))
    joined = left.join(cold, "__key", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__hot_values.{c}"), F.col(f"__cold_values.{c}")) for c in values}).drop(
        "__key", "__hot_values", "__cold_values"
    )


def beta_prior(groups: DataFrame, n: str, k: str, least: float = 2.0, most: float = 200.0) -> tuple[float, float]:
    """Mean and strength of an empirical beta prior by moments, from per-group trials ``n`` and failures ``k``.

    One row of sums comes to the driver. Without trials: mean 0, strength ``least``.
    """
    p = F.col(k) / F.col(n)
    s = (
        groups.where(F.col(n) > 0)
        .agg(F.count("*").alias("j"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(F.col(n) * p * p).alias("q"))
        .first()
    )
    if not s["n"]:
        return 0.0, least
    mean = s["k"] / s["n"]
    noise = mean * (1 - mean)
    between = s["q"] / s["n"] - mean * mean - s["j"] * noise / s["n"]
    strength = noise / between - 1 if between > 0 else most
    return mean, min(max(strength, least), most)


def odds_times(rate: float, factor: float) -> float:
    """The rate whose odds are ``factor`` times those of ``rate``."""
    return rate * factor / (1 - rate + rate * factor)


def lower_bound(n: Column, k: Column, mean: Column, strength: float, z: float) -> Column:
    """``z`` posterior deviations under the posterior mean of a rate with ``k`` of ``n``, prior ``mean`` and ``strength``."""
    a, total = k + F.lit(strength) * mean, n + F.lit(strength)
    m = a / total
    return m - F.lit(z) * F.sqrt(m * (1 - m) / (total + 1))
