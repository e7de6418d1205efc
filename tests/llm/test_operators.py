"""Every operator against its plain version, on tables with nulls, empty, long and repeated texts, and clashing columns."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pytest

from panelspark.llm import decontaminate, eliasfano, fingerprints, grammar, jaccard, ngrams, packing, queries, shards, suffixes, toxicity, wordpiece
from panelspark.llm.encode import Encoder

VOCABULARY = [f"w{i}" for i in range(900)]
SCHEMA = "doc_id long, text string, `bucket` string, `row` int, `key` long, `tokens` string, source string"


def corpus() -> list[tuple]:
    draw = random.Random(5)
    say = lambda n: " ".join(draw.choice(VOCABULARY) for _ in range(n))
    base = [draw.choice(VOCABULARY) for _ in range(150)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b c d"), (6, "a b c d e"), (7, "Ünïcödé ñandú “quoted” 日本語 テキスト"), (8, "x" * 400), (9, "x" * 60)]
    rows += [(20 + k, " ".join(base)) for k in range(6)]
    for k in range(60):
        some = list(base)
        for _ in range(draw.choice([0, 1, 2, 4, 5, 6, 8])):
            some[draw.randrange(150)] = draw.choice(VOCABULARY)
        rows.append((100 + 3 * k, " ".join(some)))
    rows += [(400 + k, say(draw.randrange(1, 40))) for k in range(60)]
    rows += [(500, say(9000)), (501, say(30) + " " + " ".join(base[:40]) + " " + say(30)), (502, say(20) + ". " + " ".join(base[30:80]).upper())]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "b", 1, None, "t", "s") for d, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def ids_of(name, text):
    return Encoder.of(queries.tokenizer(name)).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_jaccard_groups(docs, empty, spark):
    assert rows_of(jaccard.jaccard_groups(docs)) == sorted(brute.jaccard_groups(ROWS))
    assert jaccard.jaccard_groups(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "k l m n o p q"), (3, "k l m n o p q"), (None, "a b c d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(odd).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (2, 3, 1), (3, 3, 1), (None, 2, None)}


def test_links_across_a_crowd_are_complete():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        places = draw.choice(200, draw.integers(0, 40), replace=False)
        own[places] = draw.integers(0, 2**63, len(places), dtype=np.uint64)
        sets.append(np.unique(own))
    found = jaccard.joining_links(sets, list(range(120)), sets, list(range(120)))
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def groups(pairs):
        parent[:] = range(120)
        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(120)]

    every = [(a, b) for a in range(120) for b in range(a) if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))]
    assert groups(found) == groups(every)


def test_repeated_spans(docs, empty, spark):
    assert rows_of(suffixes.repeated_spans(docs)) == sorted(brute.repeated_spans(ROWS))
    assert suffixes.repeated_spans(empty).count() == 0
    odd = [(1, "q" * 70), (1, "q" * 70), (2, "é" * 40 + "z"), (3, "ab" + "é" * 40), (None, "q" * 70), (4, "q" * 49)]
    got = suffixes.repeated_spans(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute.repeated_spans(odd), key=key)


def test_column_transform(tmp_path):
    draw = random.Random(2)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 30))) for _ in range(40)]
    size = np.array([len(s) for s in strings])
    bwt, lcp = suffixes.column_transform(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, str(tmp_path))
    order = sorted((s[k:], -len(s) + k and 0, j, k) for j, s in enumerate(strings) for k in range(len(s) + 1))
    want = [s for s, *_ in order]
    common = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(want, want[1:])]
    assert lcp.tolist() == common
    assert sorted(bwt.tolist()) == sorted([suffixes.END] * 40 + [c for s in strings for c in s])


def test_language_scores(docs, empty):
    got = ngrams.language_scores(docs).collect()
    want = {w[0]: w for w in brute.language_base(ROWS)}
    distinct = len({w for d, t in ROWS if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*brute.BLANK.findall(brute.lower(t)), None]})
    scores = brute.language_model(ROWS, ngrams.BIGRAM, ngrams.UNIGRAM, distinct)
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r)[:5] == want[r.doc_id][:5]
        assert r.base_score == pytest.approx(want[r.doc_id][5], abs=1e-6)
        assert abs(r.score - scores[r.doc_id]) < 1e-3 * r.n_tokens
    assert ngrams.language_scores(empty).count() == 0


def test_elias_fano(tmp_path):
    draw = np.random.default_rng(3)
    for n, bound in ((0, 5), (1, 1), (50, 60), (3000, 1 << 40)):
        values = np.unique(draw.integers(0, bound, n).astype(np.uint64))
        out = eliasfano.Writer(str(tmp_path / "x"))
        form = eliasfano.EliasFano.write(out, values, bound)
        out.put(np.zeros(1, np.uint64))
        out.close()
        held = eliasfano.EliasFano.read(np.memmap(tmp_path / "x", np.uint8, "r"), form)
        asked = np.concatenate((values, draw.integers(0, bound, 200).astype(np.uint64)))
        place, equal = held.successor(asked)
        assert (equal == np.isin(asked, values)).all()
        assert (place[equal] == np.searchsorted(values, asked[equal])).all()


def test_packing(docs, empty):
    got = packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json")).collect()
    want = []
    for d, t in ROWS:
        ids = np.array([*ids_of("byte_bpe_50k.json", t), 0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], [*range(first, len(ids), 2048), len(ids)])):
            want.append((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(empty, queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_two_documents_replace_the_smallest_of_a_bin():
    assert sorted(map(sorted, packing.best_two_fit([7, 2, 2, 1], 10))) == [[0, 2, 3], [1]] or packing.best_two_fit([6, 5, 5], 10) == [[1, 2], [0]]
    lengths = [random.Random(4).randrange(1, 100) for _ in range(400)]
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)


def test_grammar_files(docs, empty):
    got = rows_of(grammar.grammar_round_trip(docs, queries.tokenizer("word_bpe_49k.json")))
    want, start = [], 0
    for d, t in sorted(ROWS):
        ids = np.array([*ids_of("word_bpe_49k.json", t), 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert grammar.grammar_round_trip(empty, queries.tokenizer("word_bpe_49k.json")).count() == 0


def test_grammar_random_access():
    draw = random.Random(6)
    ids = [np.array([draw.randrange(4) for _ in range(draw.randrange(1, 300))] + [9], np.uint32) for _ in range(80)]
    image = grammar.to_file(list(range(80)), [i.copy() for i in ids], 10)
    file = grammar.GrammarFile(image)
    assert len(file.rules) > 5 and len(file.symbols) < sum(map(len, ids))
    assert all((file.document(k) == ids[k]).all() for k in range(80))
    assert sum(file.token_length(int(s)) for s in file.symbols) == sum(map(len, ids))


def test_wordpieces(docs, empty):
    initial, later = {b"a", b"ab", b"abc", b"xy"}, {b"c", b"cd", b"d", b"bcde"}
    automaton = wordpiece.Automaton(initial, later)
    draw = random.Random(7)
    for _ in range(2000):
        word = bytes(draw.choice(b"abcdexy") for _ in range(draw.randrange(1, 9)))
        pieces = brute.wordpieces(word, initial, later)
        assert automaton.count(word) == ((1, True) if pieces is None else (len(pieces), False))
        block = np.frombuffer(word, np.uint8)
        assert automaton.counts(block, np.array([0]), np.array([len(word)]))[0][0] == automaton.count(word)[0]
    whole = wordpiece.Automaton.of_vocabulary(queries.tokenizer("byte_bpe_50k.json"))
    want = []
    for d, t in ROWS:
        words = brute.BLANK.findall(t or "")
        counts = [whole.count(w.encode()) for w in words]
        want.append((d, len(words), sum(c for c, _ in counts), sum(u for _, u in counts)))
    assert rows_of(wordpiece.token_counts(docs, queries.tokenizer("byte_bpe_50k.json"))) == sorted(want)
    assert wordpiece.token_counts(empty, queries.tokenizer("byte_bpe_50k.json")).count() == 0


def _duck(sql, rows, items=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    if items:
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return con.execute(sql)


def test_contamination(docs, empty, spark):
    words = next(t for d, t in ROWS if d == 20).split()
    items = [(1, " ".join(words[:12]).upper()), (2, " ".join(words[5:16]) + " w1"), (3, "ÜNÏCÖDÉ"), (4, "a-b C"), (5, ""), (6, None), (7, " ".join(words[40:49]) + " nowhere"), (8, words[3] + " " + words[4])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = _duck(f"SELECT {', '.join(cols)} FROM ({decontaminate.ORACLE})", ROWS, items).fetchall()
    got = rows_of(decontaminate.contamination(docs, benchmark).select(cols))
    assert got == sorted(want) and any(r[2] for r in got)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_shards(docs, empty):
    limit = 2000
    cols = ["doc_id", "n_bytes", "depth", "prefix", "shard", "shard_bytes", "shard_docs"]
    want = _duck(f"SELECT {', '.join(cols)} FROM ({shards.ORACLE.replace(str(shards.LIMIT_BYTES), str(limit))})", ROWS).fetchall()
    got = rows_of(shards.extendible_shards(docs, limit=limit).select(cols))
    assert got == sorted(want)
    assert all(r[5] <= limit or r[6] == 1 for r in got)
    assert shards.extendible_shards(empty).count() == 0


def test_fingerprints(docs, empty):
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(docs).collect()}
    order = sorted(ROWS)
    for k, (d, t) in enumerate(order):
        text, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].edited_fingerprint == fingerprints.fingerprints([edited.encode()])[0]
        assert got[d].fingerprint == fingerprints.fingerprints([text.encode()])[0]
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[20].near_next == 1.0 and got[500].near_edited > 0.3 > got[500].near_next
    assert fingerprints.neighbour_fingerprints(empty).count() == 0


def test_toxicity(spark, empty):
    draw = random.Random(8)
    rows, marks = [], []
    for k in range(400):
        words = [draw.choice(VOCABULARY) for _ in range(draw.randrange(5, 120))]
        toxic = int(draw.random() < 0.3)
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(["moronic", "moron", "morons!", "scum", "scumbag"])
        rows.append((k, " ".join(words)))
        marks.append((k, toxic))
    rows += [(900, None), (901, ""), (None, "moron moron"), (902, "scum " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    toxic, clean = ([got[k].score for k, t in marks if t == want and got[k].held_out] for want in (1, 0))
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.9
    assert got[900].score == got[901].score == 0 and got[902].predicted == 1
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in marks)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).filter("score not in (0, 0.5)").count() == 0


def test_gradients():
    draw = np.random.default_rng(9)
    net = toxicity.Network(np.zeros(0, np.uint64), np.zeros(0, np.uint64), draw)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors = draw.standard_normal((12, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    index = draw.integers(-1, 12, (3, toxicity.WINDOW))
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-net.logits(vectors, index)))
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    g, d_vectors = net.gradients(vectors, index, label)
    for name, grad, place in [("Wf", g["Wf"], (3, 5)), ("Ub", g["Ub"], (2, 30)), ("A", g["A"], (4, 1)), ("o", g["o"], (7,)), (None, d_vectors, (int(index[index >= 0][0]), 2))]:
        held = vectors if name is None else net.p[name]
        was = held[place]
        held[place] = was + 1e-4
        up = loss()
        held[place] = was - 1e-4
        down = loss()
        held[place] = was
        assert grad[place] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5)


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert json.dumps(sorted(queries.ORACLES)) == json.dumps(["op11_conversation_trie", "op13_source_mix", "op3_extendible_shards", "op6_winnowed_contamination"])


def test_language_scores_of_large_batches(spark):
    """More documents in one Arrow batch than 16 bits can number."""
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        docs = spark.range(80_000, numPartitions=1).selectExpr("id AS doc_id", "'' AS text")
        got = ngrams.language_scores(docs).selectExpr("min(score) AS a", "max(score) AS b", "min(n_known) AS c", "max(n_known) AS d", "count(*) AS n").first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got.a == got.b <= 0 and got.c == got.d == 1 and got.n == 80_000
