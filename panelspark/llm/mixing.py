"""Mixing sources to target weights by Efraimidis-Spirakis sampling, without sorting a source as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import attach
from .storage import written

#: Weights of the sources in their order, repeating; words of the mix and most words of a source, as multiples of what there is.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = "mix-1"
#: Slices of the keys of a source, spots that copies of a row are counted by, parts in which sources are numbered.
SLICES, SPOTS, PARTS = 1 << 13, 1 << 10, 16
WORDS = r"[^\x20\x09-\x0D]+"
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


def quality(text: Column) -> Column:
    """Weight of a text, 0.1 to 1: the fewer of its characters are digits and ASCII marks, the more; 1 for an empty one."""
    n = F.length(text)
    return F.when(n == 0, 1.0).otherwise(1 - 0.9 * (n - F.length(F.translate(text, MARKS, ""))) / n)


def exponential(seed: str, weight: Column, *parts: Column) -> Column:
    """-ln(u) / weight with u in (0, 1] from the digest of ``parts``: the smallest keys are a weighted sample without replacement."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / float(1 << 52)
    return -F.log(u) / weight


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, total) with the weight of each source: by code point, null last, ``weights`` in turn."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = written(sizes.repartitionByRange(PARTS, *order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # at most PARTS rows
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    which = F.pmod(rank, F.lit(len(weights)))
    weight = reduce(lambda rest, k: F.when(which == k, float(weights[k])).otherwise(rest), range(len(weights)), F.lit(None).cast("double"))
    return dealt.join(before, "part").select("source", "total", weight.alias("weight"))


def with_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` with the target of each: its weight's part of ``share`` times all words, at most ``most`` times its own.

    All that isn't capped gets the same number of words per unit of weight.  That number only rises
    as sources reach their cap, and a round that caps no further one is the last.
    """
    sums = sources.agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).first()
    total, rate = share * (sums["total"] or 0), 0.0
    spent, open_weight = 0.0, sums["weight"] or 0.0
    while open_weight and (total - spent) / open_weight > rate:
        rate = (total - spent) / open_weight
        over = most * F.col("total") < rate * F.col("weight")
        found = sources.agg(F.sum(F.when(over, most * F.col("total")).otherwise(0.0)).alias("spent"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        spent, open_weight = found["spent"], found["weight"]
    return sources.withColumn("target", F.least(F.lit(float(most)) * F.col("total"), rate * F.col("weight")))


def selected(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, key, quota): copies of a row that are taken where this isn't simply all below ``least_open`` and none above; with the budgets' columns.

    rows (source, key, size): the budget of a source is filled in the order of the keys; what is left
    goes to the one open row whose size is nearest to it, if it is nearer than nothing.  The words of
    slices of the keys are summed first, so that only the slice where a budget ends is sorted.
    """
    slice_of = F.floor((1 - F.exp(-F.col("key"))) * SLICES)
    sized = rows.filter("size > 0").withColumn("slice", slice_of)
    sums = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    in_order = Window.partitionBy("source").orderBy("slice")  # at most SLICES + 1 rows of a source
    open_ = budgets.filter("budget > 0").select(F.col("source").alias("s"), "budget")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    walked = sums.withColumn("until", F.sum("words").over(in_order)).join(open_, same("source", "s")).drop("s")
    ends = walked.filter("until > budget and until - words <= budget").select("source", "slice", "budget", (F.col("until") - F.col("words")).alias("before"))
    ends = written(ends)
    inside = sized.join(ends.withColumnsRenamed({"source": "s", "slice": "l"}), same("source", "s") & (F.col("slice") == F.col("l"))).groupBy("source", "key", "size", "budget", "before").agg(F.count(F.lit(1)).alias("copies"))
    words = F.col("size") * F.col("copies")
    within = Window.partitionBy("source").orderBy("key", "size")  # distinct keys of one slice
    steps = inside.withColumn("at", F.col("before") + F.sum(words).over(within) - words)
    edge = steps.filter((F.col("at") <= F.col("budget")) & (F.col("at") + words > F.col("budget")))
    fits = F.floor((F.col("budget") - F.col("at")) / F.col("size"))
    edge = written(edge.select("source", F.col("key").alias("edge"), F.col("size").alias("edge_size"), "copies", fits.alias("fits"), (F.col("budget") - F.col("at") - fits * F.col("size")).alias("gap")))
    # the closing row: of all open ones, the edge's included
    rest = attach(sized.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()), edge.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "edge", "edge_size", "gap", "copies", "fits"), ["name", "none"], "key")
    rest = rest.filter("(key > edge or (key = edge and size > edge_size) or (key = edge and size = edge_size and copies > fits)) and abs(size - gap) < gap")
    closing = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("key").alias("closing"), F.col("size").alias("closing_size"))).alias("c"))
    joined = edge.join(closing.select(F.col("source").alias("s"), "c.closing", "c.closing_size"), same("source", "s"), "left").drop("s")
    return joined.select("source", "edge", "edge_size", "fits", "closing", "closing_size")


def source_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight=quality, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Sizes are words; the sources' targets are ``share`` times all words by ``weights``, none above
    ``most`` times its source.  A source is taken as a whole as often as its target allows; the rest
    is a sample without replacement, weighted by ``weight`` of the text and drawn by keys that only
    depend on seed, doc_id and text, so reruns agree.  Null texts are empty; a null source is one of
    its own; rows that are alike in all of this are interchangeable, each is taken at most ``most``
    times; further columns are left out; an empty table gives no rows.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    body = F.col("text")
    key = exponential(seed, weight(body), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), body)
    spot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPOTS)).cast("int")
    rows = written(plain.select("doc_id", "source", F.regexp_count(body, F.lit(WORDS)).cast("long").alias("size"), key.alias("key"), spot.alias("spot")))
    sources = written(with_targets(weighted_sources(rows.groupBy("source").agg(F.sum("size").alias("total")), weights), share, most))
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    sources = sources.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("total"))
    chosen = written(selected(rows, sources))
    per_source = sources.join(chosen.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    named = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")]
    per_source = per_source.select(*named, "total", "target", "epochs", "budget", "edge", "edge_size", "fits", "closing", "closing_size")
    placed = attach(rows.select(*named, "doc_id", "size", "key", "spot"), per_source, ["name", "none"], "key")
    at_edge = F.coalesce((F.col("key") == F.col("edge")) & (F.col("size") == F.col("edge_size")), F.lit(False))
    at_closing = F.coalesce((F.col("key") == F.col("closing")) & (F.col("size") == F.col("closing_size")), F.lit(False))
    quota = F.when(at_edge, F.col("fits")).otherwise(0) + F.when(at_closing, 1).otherwise(0)
    below = (F.col("budget") > 0) & (F.col("size") > 0) & (F.col("edge").isNull() | (F.col("key") < F.col("edge")) | ((F.col("key") == F.col("edge")) & (F.col("size") < F.col("edge_size"))))
    out = ["doc_id", "size", F.col("total").alias("source_size"), "target"]
    special = placed.filter(at_edge | at_closing).withColumn("quota", quota)
    counts = special.groupBy("name", "none", "key", "size", "spot").agg(F.count(F.lit(1)).alias("n"))
    same_row = Window.partitionBy("name", "none", "key", "size").orderBy("spot")  # at most SPOTS rows
    before = counts.select("name", "none", "key", "size", "spot", (F.sum("n").over(same_row) - F.col("n")).alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("name", "none", "key", "size", "spot").orderBy("doc_id"))
    numbered = special.join(before, ["name", "none", "key", "size", "spot"]).withColumn("extra", F.when(nth <= F.col("quota"), 1).otherwise(0))
    others = placed.filter(~(at_edge | at_closing)).withColumn("extra", F.when(below, 1).otherwise(0))
    taken = (F.col("size") * (F.col("epochs") + F.col("extra"))).cast("long").alias("taken")
    return others.select(*out, taken).unionByName(numbered.select(*out, taken))


#: The same by windows over whole sources.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text), 1, 13) AS BIGINT) + 1) / {float(1 << 52)!r})
    / CASE WHEN length(text) = 0 THEN 1.0::DOUBLE ELSE 1 - 0.9::DOUBLE * (length(text) - length(translate(text, '{MARKS.replace("'", "''")}', ''))) / length(text) END AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS total, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), c AS (
  SELECT *, {MOST}.0::DOUBLE * total / weight AS full_at,
    coalesce(sum({MOST}.0::DOUBLE * total) OVER (ORDER BY {MOST}.0::DOUBLE * total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (ORDER BY {MOST}.0::DOUBLE * total / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s
), r AS (
  SELECT ({SHARE}::DOUBLE * (SELECT sum(total) FROM s) - spent) / open_weight AS rate FROM c
  WHERE ({SHARE}::DOUBLE * (SELECT sum(total) FROM s) - spent) / open_weight <= full_at ORDER BY full_at, source LIMIT 1
), t AS (
  SELECT source, total, least({MOST}.0::DOUBLE * total, rate * weight) AS target FROM s, r
), e AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, k.key, e.source, e.total, e.target, e.epochs, e.target - e.epochs * e.total AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id ROWS UNBOUNDED PRECEDING) AS until
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
), f AS (
  SELECT *, until <= budget AND size > 0 AS inside, budget - coalesce(max(until) FILTER (until <= budget) OVER (PARTITION BY source), 0) AS gap FROM p
), g AS (
  SELECT *, NOT inside AND size > 0 AND budget > 0 AND abs(size - gap) < gap AS may FROM f
), h AS (
  SELECT *, may AND row_number() OVER (PARTITION BY source, may ORDER BY abs(size - gap), key, size, doc_id) = 1 AS closing FROM g
)
SELECT doc_id, size::BIGINT AS size, total AS source_size, target, CAST(size * (epochs + CASE WHEN inside OR closing THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM h
"""
