"""Relational helpers with the null, duplicate and skew rules in one place.

Skew.  A key may hold a third of all rows.  Three rules keep such a key from
landing in one task:

* grouping goes through aggregates with a map-side partial step;
* keep-first uses ``row_number() <= k``, which Spark limits on the map side
  (``WindowGroupLimit``) so a hot key sends at most k rows per task;
* looking up one row per key (``enrich``) first measures the key column, unless
  Spark will broadcast the lookup table by its size, and cuts the rows of hot
  keys, and the rows with no key, into pieces.

No join is forced to broadcast except against tables with a row bound built
into the plan; Spark's own size check decides for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from careerloom.session import stored

#: A key with more than this share of the rows is hot.
HOT_SHARE = 1 / 256
#: Keys the frequency sketch reports, and counters it keeps: with 8192 counters
#: its error is below a tenth of a percent of the rows, so no hot key escapes.
SKETCH_KEYS, SKETCH_COUNTERS = 256, 8192
#: Rows per key up to which Spark limits the groups of a window before its shuffle, and buckets of a key beyond that.
GROUP_LIMIT, BUCKETS = 1000, 256
#: Leading hexadecimal digits by which ``sample_n`` finds where its rows end.
CUT_DIGITS = 4


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# --- projection and filters -------------------------------------------------

def keep_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Listed columns that exist, in the listed order (F1)."""
    return df.select(*[c for c in columns if c in df.columns])


def columns_like(df: DataFrame, parts: Iterable[str], boolean_only: bool = False) -> list[str]:
    """Column names containing one of the parts, optionally booleans only."""
    parts = [p.lower() for p in parts]
    return [
        f.name
        for f in df.schema
        if any(p in f.name.lower() for p in parts) and (not boolean_only or isinstance(f.dataType, BooleanType))
    ]


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Mapping rename of the columns present."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def any_of(columns: Iterable[str]) -> Column:
    """Row-wise OR; null counts as False."""
    return reduce(or_, [F.coalesce(F.col(c), F.lit(False)) for c in columns])


def any_differs(columns: Sequence[str]) -> Column:
    """True when some column differs from the first."""
    first = F.col(columns[0])
    return reduce(or_, [~F.col(c).eqNullSafe(first) for c in columns[1:]])


def not_in(c: str, values: Sequence) -> Column:
    """Negated membership that keeps null rows (F8)."""
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """Ratio, null when the denominator is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def with_share(counts: DataFrame, n: str, to: str = "share") -> DataFrame:
    """Share of each row of a count table in its total, a scalar subquery."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(to, F.try_divide(F.col(n).cast("double"), total.cast("double")))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and share per combination of values, nulls included."""
    return with_share(df.groupBy(*columns).agg(F.count("*").alias("n")), "n")


# --- joins ------------------------------------------------------------------

def prefix_shared(df: DataFrame, other: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Suffix the non-key columns that both sides have."""
    clash = (set(df.columns) & set(other.columns)) - set(keys)
    return df.withColumnsRenamed({c: c + suffix for c in clash})


@dataclass(frozen=True)
class Skew:
    """Hot values of a key column, and the number of pieces to cut their rows into (at least 1)."""

    values: tuple = ()
    pieces: int = 1

    @property
    def found(self) -> bool:
        return self.pieces > 1


def measure_skew(df: DataFrame, on: str, nulls: bool = False) -> Skew:
    """One pass over the key column: a mergeable frequency sketch and two counts.

    Nothing is shuffled by key and the driver gets at most ``SKETCH_KEYS``
    values.  Rows without a key count as one more key; ``nulls`` says that
    there will be many of them.
    """
    row = df.agg(
        F.count("*").alias("n"),
        F.count(on).alias("known"),
        F.expr(f"approx_top_k(`{on}`, {SKETCH_KEYS}, {SKETCH_COUNTERS})").alias("top"),
    ).first()
    limit = row.n * HOT_SHARE
    hot = [(t["item"], t["count"]) for t in row.top if t["item"] is not None and t["count"] > limit]
    shares = [n / row.n for _, n in hot]
    if row.n - row.known > limit:
        shares.append((row.n - row.known) / row.n)
    if nulls:
        shares.append(1.0)
    if not shares:
        return Skew()
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Skew(tuple(v for v, _ in hot), min(4096, max(2, math.ceil(max(shares) * width))))


def broadcast_by_size(df: DataFrame) -> bool:
    """Whether Spark's own estimate puts the table under its broadcast limit."""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def enrich(df: DataFrame, dim: DataFrame, on: str, how: str = "left", skew: Skew | None = None) -> DataFrame:
    """Add the columns of ``dim`` to every row of ``df`` by key.

    When Spark is going to broadcast ``dim`` by its size, or the key is not
    skewed, this is the plain join.  A ``dim`` that Spark expects to be larger
    is stored first, as an aggregate may have far fewer rows than Spark
    expects: measuring the keys means one more run of all that ``df`` is made
    of, and a join without broadcast moves every row.  Otherwise the rows of hot keys and
    the rows without a key carry a piece number taken from the input
    partition, which a retried task gives again, and the hot rows of ``dim``
    are repeated once per piece.
    """
    dim = dim.where(F.col(on).isNotNull())
    if skew is None and not broadcast_by_size(dim):
        dim = stored(dim, "lookup")
        skew = Skew() if broadcast_by_size(dim) else measure_skew(df, on)
    if not skew or not skew.found:
        return df.join(dim, on, how)
    hot = F.col(on).isin(*skew.values) if skew.values else F.lit(False)
    piece = F.pmod(F.spark_partition_id(), F.lit(skew.pieces))
    left = df.withColumn("_piece", F.when(F.col(on).isNull() | hot, piece).otherwise(F.lit(0)))
    every = F.when(hot, F.sequence(F.lit(0), F.lit(skew.pieces - 1))).otherwise(F.array(F.lit(0)))
    return left.join(dim.withColumn("_piece", F.explode(every)), [on, "_piece"], how).drop("_piece")


def flag_in_keys(df: DataFrame, keys: DataFrame, on: str, flag: str, skew: Skew | None = None) -> DataFrame:
    """Membership as a column instead of a filter (J6); null keys are False."""
    out = enrich(df, keys.select(on).distinct().withColumn(flag, F.lit(True)), on, skew=skew)
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def _key_set(keys: DataFrame, on: str, other: str | None) -> DataFrame:
    return keys.select(F.col(other or on).alias(on)).where(F.col(on).isNotNull()).distinct()


def in_keys(df: DataFrame, keys: DataFrame, on: str, other: str | None = None) -> DataFrame:
    """Rows whose key is in the key set (J5): a lookup of the distinct keys that drops the misses."""
    return enrich(df, _key_set(keys, on, other), on, how="inner").select(*df.columns)


def not_in_keys(df: DataFrame, keys: DataFrame, on: str, other: str | None = None) -> DataFrame:
    """Rows whose key is not in the key set; null keys stay."""
    return flag_in_keys(df, _key_set(keys, on, other), on, "_in").where(~F.col("_in")).select(*df.columns)


def require_unique(dim: DataFrame, on: str) -> DataFrame:
    """Fail the job when a key occurs twice (J4); otherwise the table itself.

    The check is part of the aggregate that yields one row per key, so it
    cannot be skipped and costs no second pass.
    """
    rest = [c for c in dim.columns if c != on]
    checked = dim.where(F.col(on).isNotNull()).groupBy(on).agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest]
    )
    guard = F.assert_true(F.col("_n") == 1, F.concat(F.lit("key is not unique: "), F.col(on).cast("string")))
    return checked.where(guard.isNull()).select(on, *rest)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all common columns."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the tables share no column")
    return left.join(right, common)


# --- dedupe -----------------------------------------------------------------

def _order(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None) -> list[Column]:
    """The given order, then every remaining column, so that ties cannot matter."""
    given = [F.col(o) if isinstance(o, str) else o for o in (order or [])]
    return given + [F.asc_nulls_first(c) for c in df.columns if c not in keys]


def first_k(df: DataFrame, keys: str | Sequence[str], k: int, order: Sequence[Column | str] | None = None) -> DataFrame:
    """First k rows per key under a full order (W2, W6, W10, T4); null keys form a group.

    Up to ``GROUP_LIMIT`` rows Spark limits each task's groups before the
    shuffle.  For a larger k each key is first dealt over buckets by a hash of
    the row and every bucket keeps its first k, so the rows of a hot key spread
    over as many tasks, and at most ``BUCKETS`` times k rows of a key meet in
    the second step.
    """
    keys = _names(keys)
    full = _order(df, keys, order)
    if k > GROUP_LIMIT:
        buckets = min(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        bucket = F.pmod(F.xxhash64(*df.columns), F.lit(buckets))
        dealt = Window.partitionBy(*keys, "_bucket").orderBy(*full)
        df = df.withColumn("_bucket", bucket).withColumn("_rn", F.row_number().over(dealt)).where(F.col("_rn") <= k).drop("_rn", "_bucket")
    w = Window.partitionBy(*keys).orderBy(*full)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def keep_first(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """One row per key (W2); ``order`` descending gives keep-last."""
    return first_k(df, keys, 1, order)


def repeat_counts(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows with ``copies`` and ``repeats``, the copies that are not the first row of their key.

    Counts stand in for a flag on every row: exact copies of a row cannot be
    told apart, and numbering them would bring them all into one task.
    """
    cols = df.columns
    one, none = F.lit(1), F.lit(0)
    rows = df.select("*", one.alias("copies"), none.alias("firsts"))
    first = keep_first(df, key).select("*", none.alias("copies"), one.alias("firsts"))
    counted = rows.unionByName(first).groupBy(*cols).agg(F.sum("copies").alias("copies"), F.sum("firsts").alias("_f"))
    return counted.withColumn("repeats", F.col("copies") - F.col("_f")).drop("_f")


def only_unrepeated(df: DataFrame, key: str) -> DataFrame:
    """Drop every row of a key that occurs more than once."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
        .where("_n = 1")
        .select(*df.columns)
    )


# --- sets and samples -------------------------------------------------------

def union_all(*tables: DataFrame) -> DataFrame:
    """Stack by column name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def seeded(key: Column | str, seed: int) -> Column:
    """Pseudo-random order value of a key: same seed, same order, on every engine that has md5."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hash_bucket(key: Column | str, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a key, evenly filled by distinct keys."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substr(F.md5(k.cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(buckets))


def sample_candidates(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The rows that ``sample_n`` puts in order: its n rows and few more.

    Rows are first counted by the leading digits of their order value, at most
    16 ** CUT_DIGITS counts; the digits at which n rows are reached cut off all
    later rows.
    """
    digits = F.coalesce(F.substring(seeded(key, seed), 1, CUT_DIGITS), F.lit(""))
    counts = df.select(digits.alias("_digits")).groupBy("_digits").agg(F.count("*").alias("_n"))
    reached = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_digits"))).where(F.col("_upto") >= n)
    cut = F.coalesce(reached.agg(F.min("_digits")).scalar(), F.lit("g"))
    return df.where(digits <= cut)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement (T6).  The limit is the operator.

    The tasks send little more than n rows to the final top-n, not n rows each.
    """
    rest = [F.asc(c) for c in df.columns]
    return sample_candidates(df, n, key, seed).orderBy(seeded(key, seed), *rest).limit(n)


def two_samples(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Disjoint samples of n keys each, column ``part`` = train / test.

    Only the 2n chosen rows reach the window.
    """
    chosen = sample_n(df.select(key).distinct(), 2 * n, key, seed)
    w = Window.orderBy(seeded(key, seed), F.col(key))
    return chosen.withColumn("part", F.when(F.row_number().over(w) <= n, "train").otherwise("test"))
