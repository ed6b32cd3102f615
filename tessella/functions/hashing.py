"""Seeded, order-independent randomness and content hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: object, *cols: str | Column) -> Column:
    """Hex SHA-256 of ``seed:col:col...``: sort by it for a permutation that the seed and the values fix."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]), 256)


def seeded_int(seed: object, *cols: str | Column) -> Column:
    """The first eight hex digits of ``seeded`` as a number, 0 to 2^32 - 1."""
    return F.conv(F.substring(seeded(seed, *cols), 1, 8), 16, 10).cast("bigint")


def variant_index(identifier: Column, epoch: Column, n: int = 4) -> Column:
    """SHA-256 of ``id:epoch`` modulo a power of two up to 2^28: the last hex digits decide it."""
    if n & (n - 1) or n > 1 << 28:
        raise ValueError("n must be a power of two up to 2^28")
    digest = F.sha2(F.concat_ws(":", identifier.cast("string"), epoch.cast("string")), 256)
    return F.conv(F.substring(digest, 58, 7), 16, 10).cast("bigint") % n


def set_hash(values: Column) -> Column:
    """SHA-256 of the distinct values of a group, sorted, a line each (aggregate)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(values.cast("string"))), "\n"), 256)


def hash_dict(value: dict) -> str:
    """Hash of a JSON tree that doesn't depend on key order."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()
