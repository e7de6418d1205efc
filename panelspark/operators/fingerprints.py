"""Fingerprints that depend on the order of rows, merged like (hash, length) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Primes below 2^31, so that products of two residues are longs, and the base of positions; equal states differ in rows with a chance of about 2^-90.
PRIMES, BASE = (2147483647, 2147483629, 2147483587), 1000003
DIGITS = 5  # of eight bits: positions below 2^40

STATE = ["rows", *[f"hash_{j}" for j in range(len(PRIMES))]]


def _power(exponent: Column, prime: int) -> Column:
    """BASE to the power of a column, modulo a prime: one look-up for every eight bits of the exponent."""
    out = None
    for d in range(DIGITS):
        step = pow(BASE, 1 << (8 * d), prime)
        table = F.expr("array(" + ",".join(f"{pow(step, k, prime)}L" for k in range(256)) + ")")
        factor = F.get(table, F.shiftright(exponent, 8 * d).bitwiseAND(F.lit(255)).cast("int"))
        out = factor if out is None else out * factor % prime
    return out


def row_text(*columns: Column) -> Column:
    """The values of a row as one text that no other row has: each behind its length, nulls as a dash."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fingerprint_states(rows: DataFrame, keys: Sequence[str], pos: str | Column, values: Sequence[Column]) -> DataFrame:
    """One row per group: (keys, rows, hash_0, hash_1, hash_2), the sum over rows of digest x BASE^position per prime.

    ``pos`` numbers the rows of a group from 0 in any order of delivery.  Sums are combined before
    the shuffle, so no group is gathered and the result doesn't depend on partitioning; two rows
    that change places change it.  Null values differ from empty ones; no rows give no rows; a position that is
    null, negative or beyond 2^40 fails the job.
    """
    at = F.col(pos) if isinstance(pos, str) else pos
    fine = (at >= 0) & (at < 1 << (8 * DIGITS))
    at = F.when(fine, at.cast("bigint")).otherwise(F.raise_error(F.lit("a position must be between 0 and 2^40")).cast("bigint"))
    digest = F.md5(row_text(*values))
    plain = rows.select(*keys, at.alias("_at"), digest.alias("_digest"))
    sums = []
    for j, prime in enumerate(PRIMES):
        own = F.conv(F.substring("_digest", 8 * j + 1, 8), 16, 10).cast("bigint") % prime
        total = F.sum((own * _power(F.col("_at"), prime) % prime).cast("decimal(20,0)"))
        sums.append((total % F.lit(prime).cast("decimal(20,0)")).cast("bigint").alias(f"hash_{j}"))
    return plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *sums)


def follow(first: str, then: str) -> list[Column]:
    """State columns of the rows of struct column ``first`` followed by those of ``then``; a null state has no rows."""
    get = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), F.lit(0).cast("bigint"))
    hashes = [
        ((get(first, f"hash_{j}") + _power(get(first, "rows"), prime) * get(then, f"hash_{j}") % prime) % prime).alias(f"hash_{j}") for j, prime in enumerate(PRIMES)
    ]
    return [(get(first, "rows") + get(then, "rows")).alias("rows"), *hashes]


def fingerprint() -> Column:
    """The hashes of a state as 24 hexadecimal digits."""
    return F.concat(*[F.lower(F.lpad(F.hex(f"hash_{j}"), 8, "0")) for j in range(len(PRIMES))])
