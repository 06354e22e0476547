"""Column transforms of raw text, and what kind of value a text is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


@F.pandas_udf(StringType())
def nfc(values):
    """Unicode normal form C, which Spark has no function for."""
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def apply(name: str, c: Column) -> Column:
    """One declared transform of a text column."""
    if name == "IDENTITY":
        return c
    if name == "TRIM":
        return F.trim(c)
    if name == "UPPERCASE":
        return F.upper(c)
    if name == "EMPTY_TO_NULL":
        return F.nullif(F.trim(c), F.lit(""))
    if name == "NORMALIZE_UNICODE_NFC":
        return nfc(c)
    if name == "PARSE_INTEGER":
        return c.try_cast("bigint")
    if name == "PARSE_DECIMAL":
        number = c.try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if name == "BOOLEAN_FLAG":
        low = F.lower(F.trim(c))
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    raise ValueError(f"no transform {name}")


def chain(names: tuple[str, ...], c: Column) -> list[Column]:
    """The value before and after each step; a step's receipt counts the rows it changed."""
    out = [c]
    for name in names:
        out.append(apply(name, out[-1]))
    return out


def classify(c: Column) -> Column:
    """EMPTY, BOOLEAN, INTEGER, DECIMAL, DATE, DATETIME or TEXT."""
    t = F.trim(c)
    return (
        F.when(c.isNull() | (t == ""), "EMPTY")
        .when(F.lower(t).isin("true", "false", "yes", "no"), "BOOLEAN")
        .when(t.rlike(r"^[+-]?[0-9]+$"), "INTEGER")
        .when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "DECIMAL")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "DATE")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$"), "DATETIME")
        .otherwise("TEXT")
    )


def name_similarity(a: Column, b: Column) -> Column:
    """The greater of the Jaccard share of words and the Dice share of letter pairs."""

    def words(c):
        return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))

    def pairs(c):
        flat = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - 1, F.lit(1))), lambda i: F.substr(flat, i, F.lit(2))))

    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))), F.lit(0.0))
    return F.greatest(jaccard, 2 * F.size(F.array_intersect(pairs(a), pairs(b))) / (F.size(pairs(a)) + F.size(pairs(b))))
