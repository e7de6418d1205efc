"""Conversation trie, periodic runs and source mix against their plain versions and SQL."""

from __future__ import annotations

import random
import zlib

import brute
import duckdb
import numpy as np
import pytest

from panelspark.llm import mixing, periods, prefixes

FULL = lambda r: tuple((x is not None, x) for x in r)


def rows_of(df, cols=None):
    return sorted((tuple(r) for r in (df.select(cols) if cols else df).collect()), key=FULL)


def talks() -> list[tuple]:
    draw = random.Random(1)
    openings = [[("system", f"rules {k}  for all"), ("user", "hello there"), ("assistant", "hi\tyou")] for k in range(2)]
    rows = []
    for c in [*range(0, 130), *range(400, 460), -5, -20, 990]:
        said = list(draw.choice(openings))[: draw.randrange(0, 4)] if c % 3 else list(openings[0])
        said += [(draw.choice(["user", "assistant", None]), draw.choice(["a b", "a", "c d e", None, ""])) for _ in range(draw.randrange(0, 4))]
        rows += [(c, k if k else draw.choice([0, None]), *t) for k, t in enumerate(said)]
    rows += [(700 + k, t, "user", f"turn {t}") for k in range(3) for t in range(60 + 25 * k)]  # deep ones
    rows += [(800 + k, t, "user", "same") for k in range(60) for t in range(3)]  # many copies
    rows += [(900, 1, "user", "tie"), (900, 1, "user", "another"), (900, 1, "user", "tie"), (None, 1, "user", "lost")]
    rows += [(1001, 0, "user", "only its own first turn")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, path string, words int, `first` string"


def test_conversation_trie(spark):
    rows = talks()
    table = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(5)
    want = sorted(brute.conversation_nodes(rows), key=FULL)
    assert rows_of(prefixes.conversation_trie(table), prefixes.NODES) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    # SQL's ids without a sign, as the given tables have them
    plain = [r for r in rows if (r[0] or 0) >= 0]
    con.execute("DELETE FROM conversations WHERE conv_id < 0")
    got = con.execute(f"SELECT {', '.join(prefixes.NODES)} FROM ({prefixes.ORACLE})").fetchall()
    assert sorted(got, key=FULL) == sorted(brute.conversation_nodes(plain), key=FULL)
    assert prefixes.conversation_trie(table.limit(0)).count() == 0


def test_conversations_without_turns(spark):
    some = [c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4][:2]  # the first of their family is absent
    rows = [(some[0], 0, "user", "gone"), (some[1], None, None, None)]
    got = rows_of(prefixes.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), prefixes.NODES)
    assert got == sorted(brute.conversation_nodes(rows), key=FULL) and len(got) == 1 and got[0][3] == 2


def test_ranges_of_paths_give_one_trie():
    draw = random.Random(2)
    turn = [bytes([k]) * 16 for k in range(3)]
    paths = sorted({b"".join(draw.choice(turn) for _ in range(draw.randrange(0, 7))) for _ in range(80)})
    words, n = [np.full(len(p) // 16, 2, "<i4").tobytes() for p in paths], np.arange(1, len(paths) + 1)

    def nodes(cuts):
        import pandas as pd
        import pyarrow as pa

        tables = [pa.Table.from_batches(list(prefixes.peeled(paths[a:b], words[a:b], n[a:b], n[a:b], ["e"] * (b - a)))) for a, b in zip([0, *cuts], [*cuts, len(paths)])]
        rows = pd.concat([t.to_pandas() for t in tables])
        open_ = prefixes.merged_open(rows[rows["open"]])
        low = dict(zip(open_["key"], open_["conv_id"]))
        shut = rows[~rows["open"]].copy()
        shut["parent_conv_id"] = [p if k is None else low[k] for p, k in zip(shut["parent_conv_id"], shut["parent"])]
        both = pd.concat([open_, shut])
        return sorted(tuple(-1 if pd.isna(x) else int(x) for x in r) for r in both[prefixes.NODES[:-1]].itertuples(index=False))

    whole = nodes([])
    assert all(nodes(sorted(draw.sample(range(1, len(paths)), k))) == whole for k in (1, 2, 5, 20))


def test_periodic_runs_of_random_words():
    draw = random.Random(3)
    for _ in range(150):
        docs = []
        for _ in range(draw.randrange(1, 6)):
            k, v = draw.choice([0, 1, 5, 23, 24, 30, 80, 200, 600]), draw.choice([1, 2, 3, 10, 100])
            words = [draw.randrange(v) for _ in range(k)]
            if k > 40 and draw.random() < 0.7:
                a = draw.randrange(k)
                p = draw.randrange(1, max(2, (k - a) // 3 + 1))
                for i in range(a, min(k, a + p * draw.randrange(3, 9))):
                    words[i] = words[a + (i - a) % p]
            docs.append(words)
        found = periods.periodic_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]))
        for k, words in enumerate(docs):
            assert sorted((s, n, p) for d, s, n, p in zip(*(x.tolist() for x in found)) if d == k) == brute.periodic_runs(words)


def test_grammar_extensions():
    draw = random.Random(4)
    line = [99] + [draw.choice([0, 0, 0, 1, 2]) for _ in range(400)] + [100] + [0] * 200 + [101]
    grammar = periods.Grammar(np.array(line), 99)
    assert all(len(a.symbol) > len(b.symbol) for a, b in zip(grammar.levels, grammar.levels[1:]))
    a = np.array([draw.randrange(1, len(line) - 1) for _ in range(500)])
    b = np.array([draw.randrange(1, len(line) - 1) for _ in range(500)])
    a, b = a[a != b], b[a != b]
    for got, step in ((grammar.common(a, b), 1), (grammar.common(a, b, back=True), -1)):
        for x, y, n in zip(a.tolist(), b.tolist(), got.tolist()):
            k = 0
            while line[x + step * k] == line[y + step * k]:
                k += 1
            assert n == k


def test_period_report(spark):
    draw = random.Random(5)
    rows = [(None, "a b " * 20), (0, None), (1, ""), (2, " \n"), (3, "x " * 30), (4, "é ü " * 40), (3, "x " * 30)]
    rows += [(10 + k, draw.choice([" ", "\n", "  "]).join(draw.choice(["Foo", "foo", "bar,", "b"]) for _ in range(draw.randrange(1, 300)))) for k in range(150)]
    rows += [(500, "  ".join(f"w{k % 700}" for k in range(5000)))]
    schema = "doc_id long, text string, h int, period string, start string"
    got = rows_of(periods.period_report(spark.createDataFrame([(*r, 1, "p", None) for r in rows], schema).repartition(3)))
    assert got == sorted(brute.period_report(rows), key=FULL) and sum(r[1] for r in got) > 10
    assert periods.period_report(spark.createDataFrame([], schema)).count() == 0


def _mixed(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()


def test_source_mix(spark):
    draw = random.Random(6)
    say = lambda: " ".join(draw.choice(["alpha", "beta,", "7", "--", "ñ"]) for _ in range(draw.randrange(1, 60)))
    rows = [(k, say(), draw.choice(["a", "a", "a", "b", "é", "c", None])) for k in range(600)]
    rows += [(700, None, "a"), (701, "", "empty"), (None, "p q", "b"), (702, "one two", "tiny"), (703, "w " * 4000, "c")]
    schema = "doc_id long, text string, source string, name string, `key` int, total int"
    table = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], schema).repartition(4)
    got = rows_of(mixing.source_mix(table))
    # what differs in the last digit only is the same target
    rounded = lambda found: sorted(((d, s, t, round(x, 6), k) for d, s, t, x, k in found), key=FULL)
    assert rounded(got) == rounded(_mixed(rows))
    assert rows_of(mixing.source_mix(table.repartition(2))) == got
    of = {(d, t): s for d, t, s in rows}
    words = {}
    for d, size, _, target, taken in got:
        assert taken in (0, size, 2 * size)
        source = of[d, next(t for x, t, _ in rows if x == d)]
        words.setdefault(source, [target, 0])[1] += taken
    assert all(abs(target - total) <= 5 for source, (target, total) in words.items() if source in ("a", "b", "é"))
    assert mixing.source_mix(table.limit(0)).count() == 0


def test_repeated_rows_share_a_quota(spark):
    rows = [(1, "a b c", "s")] * 300 + [(2, "d e f g", "t")] * 100 + [(k, f"x{k} y", "s") for k in range(10, 60)]
    got = mixing.source_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert len(got) == len(rows)
    for source, size in (("s", 1000), ("t", 400)):
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2
    assert {r.taken for r in got} <= {0, 2, 3, 4, 6, 8}


def test_targets_stop_at_their_cap(spark):
    totals = {"a": 1000, "b": 10, "c": 500, "d": 1, None: 3000}
    sized = spark.createDataFrame(list(totals.items()), "source string, total long")
    got = {r.source: r.target for r in mixing.with_targets(mixing.weighted_sources(sized)).collect()}
    assert got["b"] == 20 and got["d"] == 2 and got["a"] == 2000
    assert sum(got.values()) == pytest.approx(1.5 * sum(totals.values()))
    # weights 5, 2, 1, 5, 2: of c (1) and null (2) neither reaches its cap
    assert got[None] / got["c"] == pytest.approx(2) or got["c"] == 1000
