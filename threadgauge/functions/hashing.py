"""Keyed hashes shared by draws, splits and surrogate ids.

Every random choice in the package is a function of a seed and a row key, so a
lost task recomputes the same rows and results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def _joined(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash60(*parts) -> Column:
    """First 15 hex digits of md5 over ``part|part|…`` as BIGINT in [0, 2^60)."""
    digest = F.substring(F.md5(_joined(parts)), 1, 15)
    return F.conv(digest, 16, 10).cast("bigint")


def hash32(*parts) -> Column:
    """First 8 hex digits of md5 as BIGINT in [0, 2^32)."""
    digest = F.substring(F.md5(_joined(parts)), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint")


def unit_interval(*parts) -> Column:
    """Keyed uniform in the open interval (0, 1), never exactly 0 or 1."""
    return (F.shiftright(hash60(*parts), 8) + F.lit(0.5)) / F.lit(float(2**52))


def sha_id15(*parts) -> Column:
    """Surrogate id: first 15 hex digits of sha256 over ``a|b`` (TXT-19)."""
    return F.conv(F.substring(F.sha2(_joined(parts), 256), 1, 15), 16, 10).cast("bigint")


def sha_id63(*parts) -> Column:
    """Surrogate id: first 8 bytes of sha256, sign bit cleared (TXT-19)."""
    digest = F.sha2(_joined(parts), 256)
    top = F.conv(F.substring(digest, 1, 1), 16, 10).cast("bigint").bitwiseAND(F.lit(7))
    rest = F.conv(F.substring(digest, 2, 15), 16, 10).cast("bigint")
    return F.shiftleft(top, 60) + rest


def half_split(key, salt: str) -> Column:
    """explore/confirm by the parity of the first sha256 byte of ``salt:key`` (SNP-18)."""
    key = F.col(key) if isinstance(key, str) else key
    byte = F.conv(
        F.substring(F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256), 1, 2), 16, 10
    ).cast("int")
    return F.when(key.isNotNull(), F.when(byte % 2 == 0, F.lit("explore")).otherwise(F.lit("confirm")))
