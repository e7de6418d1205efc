"""Ordered computations that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(date)`` sends a whole series to one task.  Here a
series is cut into pieces that shuffle independently:

* ``with_position``  numbers rows through per-slice counts (slice = stretch of the order column),
* ``framed``         evaluates bounded ROWS frames inside position blocks, each block receiving
                     copies of the few neighbour rows its frames reach into,
* ``running``        evaluates unbounded prefix (or suffix) aggregates as block totals carried
                     over blocks plus an in-block window,
* ``attach``         joins one row of per-key values back to the rows, salted,
* ``by_size``        tells the few keys that need pieces from the many that a plain window serves.

All of them give exactly the rows of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut

BLOCK_ROWS = 1 << 16
SLICE_DAYS = 30
SLICE_STEPS = 4096
SALTS = 16


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _slice(df: DataFrame, order: str, width: float | None) -> Column:
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.datediff(F.col(order), F.lit("1970-01-01").cast("date")) / (width or SLICE_DAYS))
    if isinstance(kind, T.TimestampNTZType):
        col = F.unix_micros(F.to_timestamp_ltz(F.col(order).cast("string")))
        return F.floor(col / F.lit((width or SLICE_DAYS) * 86400e6))
    if isinstance(kind, T.TimestampType):
        return F.floor(F.unix_micros(F.col(order)) / F.lit((width or SLICE_DAYS) * 86400e6))
    return F.floor(F.col(order) / F.lit(float(width or SLICE_STEPS)))


def by_size(df: DataFrame, key: str | Sequence[str], most: int = BLOCK_ROWS, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most ``most`` rows, rows of the longer keys or None where there are none).

    Rows with a null key are left out, as by the joins of the functions below.  Of N rows at most
    N / most keys are long, so their list is broadcast and the rows aren't shuffled for it.
    ``counted``: a table with at least as many rows of each key that is cheaper to count.
    """
    keys = _keys(key)
    some = lambda rows: rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    known = some(df)
    long = cut(some(df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > most).drop("_c"))
    if long.isEmpty():
        return known, None
    return known.join(F.broadcast(long), keys, "left_anti"), known.join(F.broadcast(long), keys, "left_semi")


def numbered(
    df: DataFrame, key: str | Sequence[str], order: str, *, ties: Sequence[str] = (), pos: str = "pos", n: str | None = "n", most: int = BLOCK_ROWS
) -> DataFrame:
    """``with_position`` for many keys: those of up to ``most`` rows are shuffled once and numbered by a plain window."""
    short, long = by_size(df, key, most)
    w = Window.partitionBy(*_keys(key))
    out = short.withColumn(pos, (F.row_number().over(w.orderBy(order, *ties)) - 1).cast("bigint"))
    if n:
        out = out.withColumn(n, F.count(F.lit(1)).over(w))
    out = out.filter(F.col(order).isNotNull())  # counted, but left out, as there
    return out if long is None else out.unionByName(with_position(long, key, order, ties=ties, pos=pos, n=n))


def with_position(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    *,
    ties: Sequence[str] = (),
    width: float | None = None,
    pos: str = "pos",
    n: str | None = "n",
) -> DataFrame:
    """Add the 0-based position of every row inside its key, and the key's row count.

    ``width`` is the stretch of ``order`` held by one task: days for dates, units for numbers.
    """
    keys = _keys(key)
    rows = df.withColumn("_slice", _slice(df, order, width))
    per_slice = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    over_key = Window.partitionBy(*keys)
    before = over_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(over_key).alias("_n"),
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(order, *ties)
    out = rows.join(offsets, [*keys, "_slice"]).withColumn(
        pos, (F.row_number().over(in_slice) - 1 + F.col("_off")).cast("bigint")
    )
    if n:
        out = out.withColumn(n, F.col("_n"))
    return out.drop("_slice", "_off", "_n")


def framed(
    df: DataFrame,
    key: str | Sequence[str],
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    *,
    back: int = 0,
    ahead: int = 0,
    pos: str = "pos",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns computed from the ``back`` previous and ``ahead`` following rows.

    ``columns`` maps a name to a function of the (key, block) window ordered by position.
    """
    keys = _keys(key)
    size = max(block, back, ahead, 1)
    home = F.floor(F.col(pos) / size)
    spots = [home]
    if back:
        spots.append(F.when(F.col(pos) % size >= size - back, home + 1))
    if ahead:
        spots.append(F.when((F.col(pos) % size < ahead) & (home > 0), home - 1))
    copies = F.array_compact(F.array(*spots))
    rows = df.withColumn("_home", home).withColumn("_blk", F.explode(copies))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    for name, build in columns.items():
        rows = rows.withColumn(name, build(w))
    return rows.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def running(
    df: DataFrame,
    key: str | Sequence[str],
    columns: Mapping[str, tuple[str, Column, bool]],
    *,
    pos: str = "pos",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Add unbounded prefix aggregates.

    ``columns`` maps a name to ``(kind, value, inclusive)``; kind is one of ``min``, ``max``,
    ``sum``, ``last`` (latest non-null so far) and ``next`` (first non-null from here on).
    """
    keys = _keys(key)
    rows = df.withColumn("_blk", F.floor(F.col(pos) / block))
    for name, (_, value, _) in columns.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals, carries = [], []
    fwd = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bwd = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)
    for name, (kind, _, _) in columns.items():
        v, t = F.col(f"_v_{name}"), f"_t_{name}"
        if kind == "last":
            totals.append(F.max_by(v, F.when(v.isNotNull(), F.col(pos))).alias(t))
            carries.append(F.last(t, ignorenulls=True).over(fwd).alias(f"_p_{name}"))
        elif kind == "next":
            totals.append(F.min_by(v, F.when(v.isNotNull(), F.col(pos))).alias(t))
            carries.append(F.first(t, ignorenulls=True).over(bwd).alias(f"_p_{name}"))
        else:
            agg = getattr(F, kind)
            totals.append(agg(v).alias(t))
            carries.append(agg(t).over(fwd).alias(f"_p_{name}"))
    carry = rows.groupBy(*keys, "_blk").agg(*totals).select(*keys, "_blk", *carries)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    rows = rows.join(carry, [*keys, "_blk"])
    for name, (kind, _, inclusive) in columns.items():
        v, p = F.col(f"_v_{name}"), F.col(f"_p_{name}")
        if kind == "next":
            frame = w.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
            rows = rows.withColumn(name, F.coalesce(F.first(v, ignorenulls=True).over(frame), p))
            continue
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if kind == "last":
            rows = rows.withColumn(name, F.coalesce(F.last(v, ignorenulls=True).over(frame), p))
        elif kind == "sum":
            here = F.sum(v).over(frame)
            rows = rows.withColumn(name, F.coalesce(here + p, here, p))
        else:
            pick = F.least if kind == "min" else F.greatest
            rows = rows.withColumn(name, pick(getattr(F, kind)(v).over(frame), p))
    drop = ["_blk"] + [f"_v_{c}" for c in columns] + [f"_p_{c}" for c in columns]
    return rows.drop(*drop)


def attach(
    df: DataFrame,
    per_key: DataFrame,
    key: str | Sequence[str],
    spread: str,
    *,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join one row per key to all rows of the key.

    Spark broadcasts ``per_key`` itself when its measured size is under the session's threshold;
    beyond it, rows of a key are spread over ``salts`` tasks by the hash of ``spread``.
    """
    keys = _keys(key)
    salted = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = df.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    return rows.join(salted, [*keys, "_salt"], how).drop("_salt")
