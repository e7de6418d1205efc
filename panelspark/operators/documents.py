"""Dated documents: validation, date ranges, selection, chunks, fact dedupe and compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import strict_date
from .lineage import cut
from .ordered import attach, with_position
from .similarity import ngram_weights, similar_components

KEY = "series_id"
DOC = "doc_id"
# fixed values: reasons a document row is dropped, in the order they are tested
DROP_REASONS = [
    "missing_temporal_interval_columns",
    "invalid_start_date",
    "invalid_end_date",
    "invalid_interval_order",
    "missing_semantic_text",
]


def validate(docs: DataFrame, facts: Column | None = None) -> DataFrame:
    """Parse the interval endpoints and name the first reason a row fails; nothing is dropped yet.

    The assignment date is the end if the source has one, else the start.
    """
    has_start, has_end = "start_date" in docs.columns, "end_date" in docs.columns
    start = strict_date(F.col("start_date")) if has_start else F.lit(None).cast("date")
    end = strict_date(F.col("end_date")) if has_end else F.lit(None).cast("date")
    out = docs.withColumn("facts", F.coalesce(X.strip(facts if facts is not None else F.col("facts")), F.lit("")))
    out = out.withColumn("start_date", start).withColumn("end_date", end)
    missing, bad_start, bad_end, order, no_text = DROP_REASONS
    reason = F.when(F.lit(not has_start and not has_end), missing)
    if has_start:
        reason = reason.when(F.col("start_date").isNull(), bad_start)
    if has_end:
        reason = reason.when(F.col("end_date").isNull(), bad_end)
    if has_start and has_end:
        reason = reason.when(F.col("start_date") > F.col("end_date"), order)
    reason = reason.when(F.col("facts") == "", no_text)
    return out.withColumn("drop_reason", reason).withColumn("date", F.col("end_date" if has_end else "start_date"))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def drop_audit(validated: DataFrame) -> DataFrame:
    """Counts per source and, with a null source, over all sources."""
    counts = [F.sum((F.col("drop_reason") == r).cast("bigint")) for r in DROP_REASONS]
    return validated.rollup("source").agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.sum(F.col("drop_reason").isNull().cast("bigint")).alias("accepted_rows"),
        F.sum(F.col("drop_reason").isNotNull().cast("bigint")).alias("dropped_rows"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(r) for c, r in zip(counts, DROP_REASONS)],
    )


def undated(docs: DataFrame) -> DataFrame:
    """Number of documents without an assignment date; it must be 0 before anything else reads them."""
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("date").isNull().cast("bigint")).alias("undated"))


def require_dates(docs: DataFrame) -> DataFrame:
    """The same documents; the job fails on the first one without an assignment date."""
    problem = F.raise_error(F.lit("document without a valid assignment date")).cast("date")
    return docs.withColumn("date", F.when(F.col("date").isNull(), problem).otherwise(F.col("date")))


def series_bounds(panel: DataFrame) -> DataFrame:
    return panel.groupBy(KEY).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def mark_in_range(docs: DataFrame, panel: DataFrame) -> DataFrame:
    """Add ``in_range``: the document's date lies between the first and last date of its series."""
    rows = attach(docs, series_bounds(panel), KEY, DOC)
    return rows.withColumn("in_range", F.col("date").between(F.col("first_date"), F.col("last_date"))).drop("first_date", "last_date")


def partition_ends(parts: DataFrame) -> DataFrame:
    """Last date of training, of validation and of the search rows per series."""
    at = lambda s: F.max(F.when(F.col("split") == s, F.col("date")))
    return parts.groupBy(KEY).agg(
        at("train").alias("train_end"), at("validation").alias("validation_end"),
        F.max(F.when(F.col("split") != "test", F.col("date"))).alias("search_end"),
    )


def assign_partition(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Label documents train, validation, after_validation by the split dates of their series."""
    rows = attach(docs, partition_ends(parts), KEY, DOC)
    label = (
        F.when(F.col("date") <= F.col("train_end"), "train")
        .when(F.col("date") <= F.col("validation_end"), "validation")
        .otherwise("after_validation")
    )
    return rows.withColumn("partition", label).withColumn("before_test", F.col("date") <= F.col("search_end")).drop(
        "train_end", "validation_end", "search_end"
    )


def leaks(train_docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Training documents dated after the end of training; must be empty."""
    ends = partition_ends(parts).select(KEY, "train_end")
    return attach(train_docs, ends, KEY, DOC).filter(F.col("date") > F.col("train_end"))


def newest(docs: DataFrame, count: int, oldest: bool = False) -> DataFrame:
    """The ``count`` newest (or oldest) documents of each series; ties by arrival (doc_id)."""
    order = [F.asc("date"), F.asc(DOC)] if oldest else [F.desc("date"), F.desc(DOC)]
    ranked = docs.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(*order)))
    return ranked.filter(F.col("_r") <= count).drop("_r")


def recent_balanced(docs: DataFrame, max_docs: int) -> DataFrame:
    """At most ``max_docs`` per series: first every source's newest quota, then the newest of the rest.

    Only ``max_docs`` rows per series and per source can ever be chosen, and Spark cuts both
    rankings to that before it shuffles.
    """
    stats = docs.groupBy(KEY, "source").agg(F.count(F.lit(1)).alias("_c"))
    stats = stats.groupBy(KEY).agg(F.count("source").alias("_sources"), F.sum("_c").alias("_total"))
    quota = F.when(F.col("_sources") > 1, F.greatest(F.lit(1), F.floor(F.lit(max_docs) / F.col("_sources")))).otherwise(0)
    stats = stats.select(KEY, "_total", quota.alias("_quota"))
    newest_first = [F.desc("date"), F.desc(DOC)]
    per_source = docs.select(KEY, DOC, "date", "source").withColumn(
        "_s", F.row_number().over(Window.partitionBy(KEY, "source").orderBy(*newest_first))
    ).filter(F.col("_s") <= max_docs)
    per_source = per_source.filter(F.col("source").isNotNull()).join(stats, KEY).filter(F.col("_s") <= F.col("_quota"))
    chosen = per_source.select(KEY, DOC, "date", F.lit(0).alias("_late"))
    recent = newest(docs.select(KEY, DOC, "date"), max_docs)
    rest = recent.join(chosen.select(KEY, DOC), [KEY, DOC], "left_anti").withColumn("_late", F.lit(1))
    # quota rows come before leftovers; with more sources than places, the newest quota rows win
    pool = chosen.unionByName(rest)
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy("_late", *newest_first))
    picked = pool.withColumn("_r", rank).filter(F.col("_r") <= max_docs).select(KEY, DOC)
    return docs.join(picked, [KEY, DOC], "left_semi")


def chunked(docs: DataFrame, size: int, max_chunks: int = 0) -> DataFrame:
    """Number the documents of a series by date and cut them into chunks of ``size``."""
    rows = with_position(docs, KEY, "date", ties=[DOC], pos="doc_pos", n=None)
    rows = rows.withColumn("chunk", F.floor(F.col("doc_pos") / size).cast("bigint"))
    return rows.filter(F.col("chunk") < max_chunks) if max_chunks > 0 else rows


def chunk_payloads(chunks: DataFrame, per_doc: int, total: int, text: str = "facts") -> DataFrame:
    """JSON of (date, text) per chunk, every text cut to its share of the character budget.

    A chunk holds a fixed number of documents, so the collected list is bounded.
    """
    clean = X.strip(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\\n"), F.lit(" ")))
    rows = chunks.withColumn("_text", clean).filter(F.col("_text") != "")
    n_docs = F.count(F.lit(1)).over(Window.partitionBy(KEY, "chunk"))
    cap = F.greatest(F.lit(1), F.least(F.lit(per_doc), F.floor(F.lit(max(1, total)) / n_docs))).cast("int")
    rows = rows.withColumn("_cap", cap).withColumn("_cut", F.substr("_text", F.lit(1), F.col("_cap")))
    listed = F.sort_array(F.collect_list(F.struct("doc_pos", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("_cut").alias("text"))))
    return rows.groupBy(KEY, "chunk").agg(
        F.count(F.lit(1)).alias("documents"),
        F.max("_cap").cast("bigint").alias("cap"),
        F.sum(F.length("_cut")).alias("characters"),
        F.to_json(F.transform(listed, lambda r: F.struct(r["date"].alias("date"), r["text"].alias("text")))).alias("payload"),
    )


# ---------------------------------------------------------------- facts


def facts(docs: DataFrame, text: str = "facts") -> DataFrame:
    """One row per fact: (series, doc, date, fact_no, fact, normalized); empty ones are left out."""
    rows = docs.select(KEY, DOC, "date", F.posexplode(X.split_facts(F.col(text))).alias("fact_no", "fact"))
    return rows.withColumn("normalized", X.normalize_fact(F.col("fact"))).filter(F.col("normalized") != "")


def exact_facts(rows: DataFrame) -> DataFrame:
    """Distinct normalised facts of each series with occurrences and first occurrence.

    ``fact_id`` numbers a fact by the place of its first occurrence, so that later joins need not
    carry the text.
    """
    first = F.min_by(F.struct(F.col(DOC).alias("first_doc"), "fact_no", "fact"), F.struct("date", DOC, "fact_no"))
    out = rows.groupBy(KEY, "normalized").agg(F.count(F.lit(1)).alias("occurrences"), first.alias("_f"))
    place = F.concat(F.col("_f.first_doc").cast("string"), F.lit(":"), F.col("_f.fact_no").cast("string"))
    return out.select(KEY, "normalized", "occurrences", "_f.first_doc", "_f.fact", place.alias("fact_id"))


def fact_components(unique: DataFrame, threshold: float = 0.90, min_ratio: float = 0.75, **how) -> DataFrame:
    """(series, normalized, component): facts that are near copies of each other share a component."""
    items = cut(unique.select(KEY, "fact_id", "normalized", F.length("normalized").alias("_size")))
    weights = ngram_weights(items, KEY, "fact_id", "normalized", lo=3, hi=5, packed="_size")
    found = similar_components(items, weights, KEY, "fact_id", threshold=threshold, size="_size", min_ratio=min_ratio, **how)
    return items.select(KEY, "fact_id", "normalized").join(found, [KEY, "fact_id"]).drop("fact_id")


def represent(rows: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """One row per component: the earliest wording, its document and the support note.

    Without ``components`` every distinct normalised fact stands for itself.
    """
    if components is None:
        joined = rows.withColumn("component", F.col("normalized"))
    else:
        joined = rows.join(components, [KEY, "normalized"])
    # documents first, so that a component with very many occurrences is reduced before it meets
    per_doc = joined.groupBy(KEY, "component", DOC, "date").agg(
        F.min(F.struct("fact_no", "fact")).alias("_f"), F.count(F.lit(1)).alias("_occ")
    )
    reps = per_doc.groupBy(KEY, "component").agg(
        F.min_by(F.struct(DOC, "_f.fact_no", "_f.fact"), F.struct("date", DOC)).alias("_r"),
        F.count(F.lit(1)).alias("documents"),
        F.sum("_occ").alias("occurrences"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    note = F.concat(
        F.lit(" [represented in "), F.col("documents").cast("string"), F.lit(" documents; "), day("first_date"), F.lit(" to "), day("last_date"), F.lit("]")
    )
    return reps.select(
        KEY, "component", F.col(f"_r.{DOC}").alias(DOC), F.col("_r.fact_no").alias("fact_no"),
        F.concat(F.col("_r.fact"), F.when(F.col("documents") > 1, note).otherwise("")).alias("fact"),
        "documents", "occurrences",
    )


def compress(docs: DataFrame, threshold: float = 1.0, text: str = "facts", **how) -> DataFrame:
    """Documents with ``compacted``: every repeated fact is kept once, in its earliest document."""
    rows = facts(docs, text)
    groups = fact_components(exact_facts(rows), threshold, **how) if threshold < 1.0 else None
    reps = represent(rows, groups)
    listed = F.sort_array(F.collect_list(F.struct("fact_no", "fact")))
    texts = reps.groupBy(KEY, DOC).agg(F.array_join(F.transform(listed, lambda r: r["fact"]), "; ").alias("compacted"))
    return docs.join(texts, [KEY, DOC], "left").withColumn("compacted", F.coalesce("compacted", F.lit("")))


def compression_audit(docs: DataFrame, threshold: float = 1.0, text: str = "facts", **how) -> DataFrame:
    """Per series: documents, facts, duplicates removed, characters before and after."""
    rows = facts(docs, text)
    unique = exact_facts(rows) if threshold < 1.0 else None
    groups = fact_components(unique, threshold, **how) if threshold < 1.0 else None
    reps = represent(rows, groups)
    per_doc = reps.groupBy(KEY, DOC).agg(
        (F.sum(F.length("fact")) + 2 * (F.count(F.lit(1)) - 1)).alias("_chars"), F.count(F.lit(1)).alias("_kept"), F.sum("occurrences").alias("_found")
    )
    after = per_doc.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("documents_with_evidence"), F.sum("_chars").alias("compacted_characters"), F.sum("_kept").alias("unique_facts"),
        F.sum("_found").alias("_occurrences"),
    )
    before = docs.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("documents_input"), F.sum(F.length(X.strip(F.col(text)))).alias("original_characters")
    )
    if unique is None:  # each distinct fact stands for itself: the facts need not be made twice
        after = after.withColumn("facts_input", F.col("_occurrences")).withColumn("_distinct", F.col("unique_facts"))
    else:
        after = after.join(unique.groupBy(KEY).agg(F.sum("occurrences").alias("facts_input"), F.count(F.lit(1)).alias("_distinct")), KEY)
    out = before.join(after, KEY)
    ratio = F.when(F.col("original_characters") > 0, 1.0 - F.col("compacted_characters") / F.col("original_characters")).otherwise(0.0)
    return out.select(
        KEY, "documents_input", "documents_with_evidence", "facts_input", "unique_facts",
        (F.col("facts_input") - F.col("_distinct")).alias("exact_duplicates_removed"),
        (F.col("_distinct") - F.col("unique_facts")).alias("near_duplicates_removed"),
        "original_characters", "compacted_characters",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)).alias("compression_ratio"),
    )
