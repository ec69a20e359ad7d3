"""The unkeyed hashes of the scheme as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .commitments import OWN, Scheme


def sha256(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaf_hash(path: Column, vh: Column, scheme: Scheme = OWN) -> Column:
    return sha256(F.lit(scheme.leaf), path, vh)


def inner_hash(left: Column, right: Column, scheme: Scheme = OWN) -> Column:
    return sha256(F.lit(scheme.inner), left, right)
