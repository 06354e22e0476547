"""Content addresses: identifiers that follow from what a row says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    """A field with the separators of the payload escaped."""
    for plain, code in (("\\", "\\\\"), ("|", "\\p"), (",", "\\c"), ("=", "\\e")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def instant(c: Column) -> Column:
    """ISO 8601 in UTC, with a fraction only if there is one."""
    whole = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(c.cast("timestamp"), "SSSSSS")
    return F.concat(whole, F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


def address(prefix: str, *fields: Column) -> Column:
    """prefix:16 hex digits of the SHA-256 of the escaped fields; null fields count as empty."""
    payload = F.concat_ws("|", *[escape(F.coalesce(f.cast("string"), F.lit(""))) for f in fields])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(payload, 256), 1, 16))
