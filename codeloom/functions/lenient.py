"""Parsing of textual cells by the two sets of rules that the two statistics engines use.

Where the input column is numeric already, NaN counts as a parsed value, as text "nan" would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.functions.text import strip

_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"


def to_double(c: Column) -> Column:
    """A double, 0 for what does not parse. Java's suffixes (1.0d) do not parse; "inf" and "nan" do."""
    text = strip(c.cast("string"))
    return F.coalesce(F.when(F.rlike(text, F.lit(_FLOAT)), text.try_cast("double")), F.lit(0.0))


def to_int(c: Column) -> Column:
    """Truncated towards zero; 0 for what does not parse and for NaN and infinities."""
    value = to_double(c)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0)).otherwise(value.try_cast("bigint"))


def to_bool(c: Column) -> Column:
    """True only for the words of the first engine."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*X.TRUE_WORDS_A), F.lit(False))


def strict_int(c: Column) -> Column:
    """Only digits with a sign; 0 for anything else, such as "3.0"."""
    text = strip(c.cast("string"))
    return F.coalesce(F.when(F.rlike(text, F.lit(r"^[+-]?\d+$")), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def strict_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*X.TRUE_WORDS_B), F.lit(False))
