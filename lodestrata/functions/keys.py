"""Stable fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts; a null part differs from an empty one."""
    marked = [F.coalesce(F.concat(F.lit("s"), p.cast("string")), F.lit("n")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)
