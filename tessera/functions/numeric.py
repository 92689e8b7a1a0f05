"""Scalar column expressions.

All of these are built-in Spark expressions so that they stay inside
whole-stage code generation; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text forms a lenient number parser accepts.  A plain
# decimal or scientific literal with optional sign and surrounding blanks, or
# the words inf / infinity / nan.  Spark alone would also accept a trailing
# "d"/"f" ("1d"), which is why the pattern guards the cast.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def nan_to_null(c: Column) -> Column:
    """NaN and NULL are one missing value."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Parse a value as double; anything unparsable becomes NULL.

    Numeric input is cast directly; text is cast only when it matches
    NUMBER_PATTERN (case-insensitive), booleans map to 1.0/0.0.
    """
    if dtype is not None and is_numeric_type(dtype):
        return nan_to_null(c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    s = c.cast("string")
    parsed = F.when(F.lower(s).rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
    return nan_to_null(parsed)


def coerce_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column in ``cols`` by its numeric parse."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.withColumns({c: to_number(F.col(c), types[c]) for c in cols})


def sq_dist(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared Euclidean distance between two coordinate tuples."""
    terms = [(x - y) * (x - y) for x, y in zip(a, b)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def l1_dist(a: Sequence[Column], b: Sequence[Column]) -> Column:
    terms = [F.abs(x - y) for x, y in zip(a, b)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def euclid(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance."""
    return F.sqrt(sq_dist(a, b))


def tidy(c: Column, digits: int = 6) -> Column:
    """Round for comparison and turn -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def two_decimals(c: Column) -> Column:
    """Two-decimal text of a double's exact binary value, ties to even (D3): 0.125 is 0.12 and 2.675 is 2.67.

    The fraction is taken apart into 80 exact binary digits (fewer than that can only be below half a hundredth) and
    rounded as a whole number of hundredths.  NaN and infinities are ``nan``, ``inf`` and ``-inf``.
    """
    x = c.cast("double")
    size = F.abs(x)
    whole = F.floor(size).cast("long")
    high = (size - whole.cast("double")) * F.lit(float(1 << 26))
    mid = (high - F.floor(high).cast("double")) * F.lit(float(1 << 27))
    low = (mid - F.floor(mid).cast("double")) * F.lit(float(1 << 27))

    def big(v: Column | int) -> Column:
        return (F.lit(str(v)) if isinstance(v, int) else F.floor(v).cast("long")).cast("decimal(38,0)")

    def times(v: Column, n: int, digits: int) -> Column:
        return (v * F.lit(str(n)).cast(f"decimal({digits},0)")).cast("decimal(38,0)")

    digits = times(big(high).cast("decimal(9,0)"), 1 << 54, 17) + times(big(mid).cast("decimal(9,0)"), 1 << 27, 9) + big(low)
    scaled = times(digits.cast("decimal(25,0)"), 100, 3)
    unit, half = big(1 << 80), big(1 << 79)
    rest = scaled % unit
    down = F.floor((scaled - rest).cast("decimal(38,0)") / unit).cast("long")
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    hundredths = down + up.cast("long")
    text = F.concat(F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")),
                    (whole + F.when(hundredths >= 100, F.lit(1)).otherwise(F.lit(0))).cast("string"), F.lit("."),
                    F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return (F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
            .otherwise(text))


def gaussian_from_key(key: Column, seed: int) -> Column:
    """Standard normal deviate derived from a row key.

    Box-Muller over two independent 64-bit hashes of (key, seed): the value
    depends only on the key, never on partitioning or retry order, so a lost
    executor recomputes the same jitter.
    """
    two53 = float(2**53)
    h1 = F.xxhash64(key.cast("string"), F.lit(seed), F.lit("u1"))
    h2 = F.xxhash64(key.cast("string"), F.lit(seed), F.lit("u2"))
    u1 = (F.shiftrightunsigned(h1, 11).cast("double") + F.lit(0.5)) / F.lit(two53)
    u2 = (F.shiftrightunsigned(h2, 11).cast("double") + F.lit(0.5)) / F.lit(two53)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)
