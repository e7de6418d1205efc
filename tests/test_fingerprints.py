"""Order-sensitive fingerprints."""

import hashlib

import pytest
from pyspark.sql import functions as F

from panelspark.operators import fingerprints as P


def states(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, "k string, pos long, a string, b long").repartition(parts)
    return {r["k"]: tuple(r[c] for c in P.STATE) for r in P.fingerprint_states(frame, ["k"], "pos", [F.col("a"), F.col("b")]).collect()}


def plain(values):
    text = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    digests = [hashlib.md5("".join(map(text, v)).encode()).hexdigest() for v in values]
    return (len(values), *[sum(int(d[8 * j : 8 * j + 8], 16) * pow(P.BASE, i, p) for i, d in enumerate(digests)) % p for j, p in enumerate(P.PRIMES)])


VALUES = [("x", 1), ("", 1), (None, 1), ("x", None), (None, None), ("x|1", 1), ("x", 1)] * 60


def rows_of(key, values):
    return [(key, i, a, b) for i, (a, b) in enumerate(values)]


def test_equals_the_sum_over_rows_whatever_the_partitions(spark):
    want = plain(VALUES)
    assert states(spark, rows_of("k", VALUES), 1) == states(spark, rows_of("k", VALUES)[::-1], 7) == {"k": want}


def test_order_nulls_and_borders_of_values_count(spark):
    swapped = [VALUES[1], VALUES[0], *VALUES[2:]]
    cases = {"plain": VALUES, "swapped": swapped, "shorter": VALUES[:-1], "null": [("x", None)], "empty": [("", None)], "ab": [("1:1", 1)], "other": [("1", 11)]}
    found = states(spark, [r for k, v in cases.items() for r in rows_of(k, v)])
    assert len(set(found.values())) == len(cases)


def test_states_of_neighbours_are_put_together(spark):
    cuts = {"none": 0, "some": 300, "all": len(VALUES)}
    for cut in cuts.values():
        found = states(spark, rows_of("l", VALUES[:cut]) + rows_of("r", VALUES[cut:]))
        kind = "struct<" + ",".join(f"{c}:bigint" for c in P.STATE) + ">"
        both = spark.createDataFrame([(found.get("l"), found.get("r"))], f"l {kind}, r {kind}")
        assert tuple(both.select(*P.follow("l", "r")).first()) == plain(VALUES)


def test_far_positions_and_wrong_ones(spark):
    far = (1 << 40) - 1
    (state,) = states(spark, [("k", far, "x", 1)]).values()
    assert state == (1, *[plain([("x", 1)])[j + 1] * pow(P.BASE, far, p) % p for j, p in enumerate(P.PRIMES)])
    assert states(spark, []) == {}
    for wrong in (-1, 1 << 40, None):
        with pytest.raises(Exception, match="position"):
            states(spark, [("k", wrong, "x", 1)])
