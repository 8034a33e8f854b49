"""Seeded hashes that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_RANGE = 1 << HASH_BITS


def hash60(*parts: Column | str | int) -> Column:
    """First 60 bits of md5 over the parts joined with ':' as a non-negative BIGINT."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash_unit(*parts: Column | str | int) -> Column:
    """The same hash as a double in [0, 1)."""
    return hash60(*parts).cast("double") / F.lit(float(HASH_RANGE))


def text_key(text: Column) -> Column:
    """SHA-1 of the text in base64, with the three non-alphanumeric signs replaced by 0."""
    return F.translate(F.base64(F.unhex(F.sha1(text.cast("binary")))), "+=/", "000")
