"""Column-expression kernels shared by batch and streaming code.

Everything here returns a ``Column`` built from built-in functions, so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour):
# null tokens after lower-casing: "-", "?", "nan"
NULL_TOKENS = ("-", "?", "nan")
# numbers accepted by the numeric-share rule (what pandas.to_numeric accepts:
# optional blanks, sign, digits with optional fraction, optional exponent,
# or inf / infinity); "1d", "1f" and "1_0" are rejected.
NUMERIC_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INF_PATTERN = r"^\s*[+-]?(inf|infinity)\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_token(c: str | Column, tokens=NULL_TOKENS) -> Column:
    """lower(c), with exact-match tokens turned into NULL (no trim)."""
    low = F.lower(col(c))
    return F.when(low.isin(*tokens), F.lit(None).cast("string")).otherwise(low)


def is_number_text(c: str | Column) -> Column:
    s = col(c)
    return s.rlike(NUMERIC_PATTERN) | F.lower(s).rlike(INF_PATTERN)


def parse_number(c: str | Column) -> Column:
    """Guarded parse: the text must look like a number before the cast."""
    s = col(c)
    return F.when(is_number_text(s), F.trim(s).try_cast("double"))


def finite_or_default(c: str | Column, default: float) -> Column:
    x = col(c).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(default))).otherwise(x)


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def r6(c: str | Column) -> Column:
    """Round a measure to 6 decimals for reporting."""
    return F.round(col(c).cast("double"), 6)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def nearest_rank(sorted_values: Column, n: Column, p: float) -> Column:
    """Element at index round_half_even((n-1)*p) of a sorted array (1-based
    element_at), the rule of Python's round on the index."""
    idx = F.bround((n - F.lit(1)).cast("double") * F.lit(float(p)), 0).cast("int") + F.lit(1)
    return F.element_at(sorted_values, idx)


def sig(c: str | Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (for large sums and variances
    whose last bits depend on the summation order)."""
    return F.format_string(f"%.{digits - 1}e", col(c).cast("double")).cast("double")
