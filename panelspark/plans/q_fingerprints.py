"""Fingerprints of series and their partitions that depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fingerprints as P
from ..operators import split as J
from ..operators.ordered import with_position
from .panels import DAILY, MONTHLY, POS, SPLIT, daily, monthly, with_sql
from .q_panel import SPEC
from .registry import query

KEY = "series_id"


def _text(*values: str) -> str:
    return " || ".join(f"coalesce(length({v}) || ':' || {v}, '-')" for v in values)


def _horner(keys: str, source: str, more: str = "") -> str:
    """Rows of a group from the last to the first: hash = hash x base + digest, so that the row at position p has the factor base^p."""
    lists = ", ".join(f"list(('0x' || substr(m, {8 * j + 1}, 8))::BIGINT % {p} ORDER BY pos DESC) AS l{j}" for j, p in enumerate(P.PRIMES))
    folds = " || ".join(f"printf('%08x', list_reduce(list_prepend(0::BIGINT, l{j}), lambda h, x: (h * {P.BASE} + x) % {p}))" for j, p in enumerate(P.PRIMES))
    return f"SELECT {keys}, rows{more}, {folds} AS fingerprint FROM (SELECT {keys}, count(*) AS rows{more}, {lists} FROM {source} GROUP BY {keys}{more})"


DAY, VALUE = "strftime(date, '%Y-%m-%d')", "CAST(CAST(round(target * 1e6) AS BIGINT) AS VARCHAR)"


@query("ordered_fingerprints", with_sql(DAILY, POS, tail=_horner("series_id", f"(SELECT series_id, pos, md5({_text(DAY, VALUE)}) AS m FROM pos)")))
def ordered_fingerprints(spark, sf):
    rows = with_position(daily(spark, sf), KEY, "date", n=None)
    states = P.fingerprint_states(rows, [KEY], "pos", _values())
    return states.select(KEY, "rows", P.fingerprint().alias("fingerprint"))


@query(
    "fingerprints_up_to_test",
    with_sql(
        MONTHLY, POS, SPLIT,
        tail=_horner("series_id", f"(SELECT series_id, pos, md5({_text(DAY, VALUE)}) AS m FROM parts WHERE n_train >= 30 AND n_val >= 3 AND n_test >= 3 AND split <> 'test')"),
    ),
)
def fingerprints_up_to_test(spark, sf):
    """Training and validation have a state each; the one of both in a row is made from the two."""
    parts = J.chronological(monthly(spark, sf), SPEC).filter("split <> 'test'")
    own = F.col("pos") - F.when(F.col("split") == "validation", F.col("n_train")).otherwise(0)
    states = P.fingerprint_states(parts, [KEY, "split"], own, _values())
    state = F.struct(*P.STATE)
    sides = states.groupBy(KEY).agg(*[F.max(F.when(F.col("split") == s, state)).alias(s) for s in ("train", "validation")])
    return sides.select(KEY, *P.follow("train", "validation")).select(KEY, "rows", P.fingerprint().alias("fingerprint"))


def _values():
    return [F.date_format("date", "yyyy-MM-dd"), F.round(F.col("target") * 1e6).cast("bigint")]
