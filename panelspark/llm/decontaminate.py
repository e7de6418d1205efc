"""Benchmark passages in documents: winnowed fingerprints are joined, hits extended to whole windows.  DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Words of a window, of a hashed gram, and grams in the sliding window of the winnowing: GRAM + SLIDE - 1 = WINDOW,
#: so every span of WINDOW shared words shares the smallest gram hash of its grams.
WINDOW, GRAM = 10, 5
SLIDE = WINDOW - GRAM + 1
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INSIDE_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _windows(words: str, n: int) -> Column:
    """1-based starts of all windows of ``n`` words."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))


def _spell(words: str, start: Column, n: int) -> Column:
    """A window as two independent 64-bit hashes."""
    part = F.slice(words, start, n)
    return F.struct(F.xxhash64(part).alias("k1"), F.xxhash64(F.lit(n), F.reverse(part)).alias("k2"))


def _grams(words: str) -> Column:
    return F.transform(_windows(words, GRAM), lambda i: F.xxhash64(F.slice(words, i, GRAM)))


def _winnowed(grams: str) -> Column:
    """The smallest gram hash of every run of SLIDE grams."""
    return F.array_distinct(F.transform(_windows(grams, SLIDE), lambda i: F.array_min(F.slice(grams, i, SLIDE))))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once per row: a generator keeps the planner from copying them into every use."""
    named = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(named)))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see ``contaminated_rows``."""
    return contaminated_rows(docs, benchmark, doc_id, text, item_id, item_text).drop("row_hash")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, row_hash (xxhash64 of its text), n_words, n_hit, n_items, items_sha256, contaminated.

    A window is WINDOW consecutive words of a benchmark item; a shorter item, but not an empty one,
    is one window.  Each document word inside an occurrence of a window is hit.  Null texts have no
    words.  Items without item_id are left out.  Repeated rows and rows without doc_id are judged
    like any other; without documents there are no rows, without benchmark nothing is hit.

    Items shorter than WINDOW can't be winnowed with this guarantee; documents are compared with
    them by all grams of just the lengths that occur (at most WINDOW - 1 of them).
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_hash", F.xxhash64("text"))
    items = benchmark.filter(F.col(f"`{item_id}`").isNotNull()).select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    items = written(_held(items, words=words_of(F.col("text"))).filter(F.size("words") > 0).drop("text"))

    def item_windows(some: DataFrame, n: int) -> DataFrame:
        spelt = some.select("item_id", F.explode(F.transform(_windows("words", n), lambda i: _spell("words", i, n))).alias("key"))
        return written(spelt.select("item_id", "key.k1", "key.k2").distinct())

    long_items = items.filter(F.size("words") >= WINDOW)
    marks = _held(long_items, grams=_grams("words")).select(F.explode(_winnowed("grams")).alias("gram")).distinct()
    marks = written(marks)
    spelled = _held(rows, words=words_of(F.col("text"))).select("doc_id", "row_hash", "words")

    # documents that share a fingerprint, with the shared ones
    found = (
        _held(spelled.filter(F.size("words") >= WINDOW), grams=_grams("words"))
        .select("doc_id", "row_hash", F.explode(_winnowed("grams")).alias("gram"))
        .join(marks, "gram")
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("gram").alias("shared"))
    )
    same = (F.col("r.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("r.row_hash") == F.col("f.row_hash"))
    near = rows.alias("r").join(found.alias("f"), same).select("r.doc_id", "r.row_hash", "r.text", "shared")
    # all windows around a shared gram
    near = _held(_held(near, words=words_of(F.col("text"))), grams=_grams("words"))
    near = _held(near, at=F.filter(_windows("words", GRAM), lambda i: F.array_contains("shared", F.element_at("grams", i))))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(F.greatest(i - (SLIDE - 1), F.lit(1)), F.least(i, F.size("words") - (WINDOW - 1))))))
    around = near.filter(F.size("at") > 0).select("doc_id", "row_hash", "words", F.explode(starts).alias("start"))
    around = around.withColumn("key", _spell("words", F.col("start"), WINDOW)).select("doc_id", "row_hash", "start", F.lit(WINDOW).alias("length"), "key.k1", "key.k2")
    hits = around.join(item_windows(long_items, WINDOW), ["k1", "k2"]).select("doc_id", "row_hash", "start", "length", "item_id")

    short = [r.n for r in items.filter(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect()]  # at most WINDOW - 1 numbers
    for n in sorted(short):
        every = spelled.select("doc_id", "row_hash", F.explode(F.transform(_windows("words", n), lambda i: F.struct(i.alias("start"), _spell("words", i, n).alias("key")))).alias("w"))
        every = every.select("doc_id", "row_hash", "w.start", F.lit(n).alias("length"), "w.key.k1", "w.key.k2")
        of_length = item_windows(items.filter(F.size("words") == n), n)
        hits = hits.unionByName(every.join(of_length, ["k1", "k2"]).select("doc_id", "row_hash", "start", "length", "item_id"))

    judged = hits.groupBy("doc_id", "row_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
    )
    judged = judged.select(
        "doc_id", "row_hash", "ids",
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long").alias("hit"),
    )
    counted = rows.select("doc_id", "row_hash", F.regexp_count("text", F.lit(INSIDE_ANY_CASE)).cast("long").alias("n_words"))
    match = (F.col("c.doc_id").eqNullSafe(F.col("j.doc_id"))) & (F.col("c.row_hash") == F.col("j.row_hash"))
    ids = F.coalesce("j.ids", F.array().cast("array<string>"))
    return counted.alias("c").join(judged.alias("j"), match, "left").select(
        "c.doc_id", "c.row_hash", "c.n_words",
        F.coalesce("j.hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("j.hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), starts_b AS (
  SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, l, array_to_string(list_slice(w, s, s + l - 1), ' ') AS win FROM starts_b
), starts_d AS (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) lengths
), dw AS (
  SELECT doc_id, s, l, array_to_string(list_slice(w, s, s + l - 1), ' ') AS win FROM starts_d
), hit AS (
  SELECT DISTINCT doc_id, s, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win
), places AS (
  SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) x GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
