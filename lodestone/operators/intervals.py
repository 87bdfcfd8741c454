"""Joins of closed intervals and points of numbers, by buckets of several widths.

An interval has a level: the smallest of a ladder of bucket widths that is no smaller than the interval,
so it meets two buckets of its own level at most. Two intervals that meet do so in a bucket of the longer
one's level. So the longer one stands in its own level only, the shorter one also in each higher level that
the other side has, and the join is one on equality of program, level and bucket: long and short intervals
mix without every short one meeting a long one's whole reach, and one program is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dealt

#: Bucket widths are 2 ** (first + i * step).
FIRST_BITS, STEP_BITS, LAST_BITS = 4, 3, 61


def _level(lo: Column, hi: Column) -> Column:
    """Bits of the bucket width of an interval."""
    ladder = range(FIRST_BITS, LAST_BITS + 1, STEP_BITS)
    out = F.lit(LAST_BITS)
    for bits in reversed(ladder):
        out = F.when(hi - lo < (1 << bits), bits).otherwise(out)
    return out


def _bucket(x: Column, bits: Column) -> Column:
    """Numbers may be negative: the shift rounds down."""
    return F.call_function("shiftright", x, bits)


def _levels(df: DataFrame) -> dict[int, int]:
    """How many rows each level has that occurs, at most as many as the ladder has."""
    return dict(sorted(map(tuple, df.groupBy("__level").agg(F.count("*")).collect())))


def _dealt(df: DataFrame, lo: str, hi: str, bits: Column) -> DataFrame:
    """A row for each level in ``bits``, an array, and each bucket there, two at most."""
    spread = df.withColumn("__bits", F.explode(bits))
    return spread.withColumn("__bucket", F.explode(F.sequence(_bucket(F.col(lo), F.col("__bits")), _bucket(F.col(hi), F.col("__bits")))))


def _higher(levels: dict[int, int], or_equal: bool) -> Column:
    given = F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")
    return F.filter(given, (lambda x: x >= F.col("__level")) if or_equal else (lambda x: x > F.col("__level")))


def overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], key: str = "program_id") -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals meet: the columns of both, the key once.

    Ends are whole numbers; an interval that ends before it begins, or has a null end or key, meets none.
    Other columns of the two sides must have different names. Which levels occur is looked up first.
    """
    return counted_overlaps(left, right, left_ends, right_ends, key)[0]


def counted_overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], key: str = "program_id") -> tuple[DataFrame, int]:
    """``overlaps``, and how many intervals the two sides have."""
    (a, b), (c, d) = left_ends, right_ends
    bucket = [key, "__bits", "__bucket"]
    long = lambda df, lo, hi: df.withColumns({x: F.col(x).cast("long") for x in (lo, hi)}).where(F.col(lo) <= F.col(hi)).withColumn("__level", _level(F.col(lo), F.col(hi)))
    one, two = long(left, a, b), long(right, c, d)
    own = F.array("__level")
    levels, others = _levels(one), _levels(two)
    n = sum(levels.values()) + sum(others.values())
    wide_left = dealt(_dealt(one, a, b, own), n, *bucket).join(dealt(_dealt(two, c, d, _higher(levels, True)).drop("__level"), n, *bucket), bucket)
    wide_right = dealt(_dealt(one, a, b, _higher(others, False)), n, *bucket).join(dealt(_dealt(two, c, d, own).drop("__level"), n, *bucket), bucket)
    both = wide_left.unionByName(wide_right)
    # a pair is kept in the first bucket that both reach
    meets = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("__bucket") == _bucket(F.greatest(a, c), F.col("__bits")))
    return both.where(meets).drop("__level", "__bits", "__bucket"), n


def holders(points: DataFrame, intervals: DataFrame, at: str, ends: tuple[str, str], key: str = "program_id") -> DataFrame:
    """Pairs of a point and an interval with equal keys that holds it: the columns of both, the key once."""
    lo, hi = ends
    two = intervals.withColumns({x: F.col(x).cast("long") for x in ends}).where(F.col(lo) <= F.col(hi)).withColumn("__level", _level(F.col(lo), F.col(hi)))
    levels = _levels(two)
    probes = F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")
    asked = points.withColumn("__bits", F.explode(probes)).withColumn("__bucket", _bucket(F.col(at).cast("long"), F.col("__bits")))
    bucket, n = [key, "__bits", "__bucket"], sum(levels.values())
    found = dealt(asked, n, *bucket).join(dealt(_dealt(two, lo, hi, F.array("__level")).drop("__level"), n, *bucket), bucket)
    return found.where(F.col(at).between(F.col(lo), F.col(hi))).drop("__bits", "__bucket")
