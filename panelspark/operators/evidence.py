"""Aggregation of textual signals: votes, label clusters, family support and target resolution.

A signals table has one row per extraction: series_id, ord (arrival), chunk_index, text_obs,
domain_confidence, target_confidence, text fields, and arrays of family statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .components import connected_components
from .lineage import cut
from .similarity import cosines, ngram_weights, similar_components, similar_edges

KEY = "series_id"
# fixed values: label clustering
LABEL_GRAMS = (2, 4)
SIMILARITY = 0.80
LABEL_WEIGHT, CONTEXT_WEIGHT, MIN_OVERLAP = 0.6, 0.4, 0.15


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def observations(signals: DataFrame) -> Column:
    return F.greatest(F.lit(1.0), F.coalesce(F.col("text_obs"), F.lit(1)).cast("double"))


def weighted(signals: DataFrame) -> DataFrame:
    """Add ``domain_weight`` and ``target_weight``: clamped confidence times observations (at least one)."""
    obs = observations(signals)
    return (
        signals.withColumn("obs", obs)
        .withColumn("domain_weight", clamp(F.col("domain_confidence")) * obs)
        .withColumn("target_weight", clamp(F.col("target_confidence")) * obs)
    )


# ---------------------------------------------------------------- votes

EXACT_FIELDS = {
    "domain_parent": "domain",
    "value_type": "target",
    "task_type": "target",
    "temporal_granularity": "target",
}
CLUSTER_FIELDS = {
    "primary_entity": "target",
    "spatial_scope": "target",
    "measure": "target",
    "physical_quantity": "target",
}


def long_fields(signals: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(series, field, ord, value, norm, weight, obs): one row per signal and voted field."""
    rows = weighted(signals)
    entries = [
        F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("unknown")).alias("value"), F.col(f"{kind}_weight").alias("weight"))
        for f, kind in fields.items()
    ]
    rows = rows.select(KEY, "ord", "obs", F.explode(F.array(*entries)).alias("e")).select(KEY, "ord", "obs", "e.*")
    return rows.withColumn("norm", X.normalize_label(F.col("value")))


def vote(candidates: DataFrame, threshold: float, by: tuple[str, ...] = (KEY, "field")) -> DataFrame:
    """Pick the heaviest candidate (the earliest on ties); list alternatives with enough support.

    ``candidates``: by, label, weight, obs, first_ord.  Alternatives have at least ``threshold``
    of the total, so their list is short whatever the number of candidates.
    """
    totals = candidates.groupBy(*by).agg(
        F.sum("total_weight").alias("_total"),
        F.max_by(F.struct("label", "weight", "obs", "first_ord"), F.struct("weight", -F.col("first_ord"))).alias("_w"),
    )
    support = F.col("weight") / F.col("_total")
    other = F.col("first_ord") != F.col("_w.first_ord")
    keep = other & (support >= threshold) & (F.col("label") != "unknown")
    confidence = F.when(F.col("obs") > 0, F.col("weight") / F.col("obs")).otherwise(0.0)
    alts = (
        candidates.join(totals.filter(F.col("_total") > 0), list(by))
        .filter(keep)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct((-support).alias("s"), F.col("label").alias("l"), confidence.alias("c")))).alias("_alts"))
    )
    some = F.col("_total") > 0
    return totals.join(alts, list(by), "left").select(
        *by,
        F.when(some, F.col("_w.label")).otherwise("unknown").alias("value"),
        F.when(some, F.col("_w.weight") / F.col("_total")).otherwise(0.0).alias("agreement"),
        F.when(some & (F.col("_w.obs") > 0), F.col("_w.weight") / F.col("_w.obs")).otherwise(0.0).alias("confidence"),
        F.coalesce(F.transform("_alts", lambda a: F.struct(a["l"].alias("label"), (-a["s"]).alias("support"), a["c"].alias("confidence"))), F.array()).alias("alternatives"),
    )


def exact_vote(rows: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Weighted vote over normalised values."""
    votes = rows.groupBy(KEY, "field", F.col("norm").alias("label")).agg(
        F.sum("weight").alias("weight"), F.sum("obs").alias("obs"), F.min("ord").alias("first_ord")
    )
    return vote(votes.withColumn("total_weight", F.col("weight")), threshold)


def label_items(rows: DataFrame) -> DataFrame:
    """Distinct known normalised labels per (series, field), with how often each occurs."""
    known = rows.filter(F.col("norm") != "unknown")
    return known.groupBy(F.concat_ws("\u0001", KEY, "field").alias("grp"), KEY, "field", "norm").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("weight").alias("weight"), F.sum("obs").alias("obs"), F.min("ord").alias("first_ord")
    )


def corpus(rows: DataFrame) -> DataFrame:
    """All labels of a (series, field) including ``unknown``: the n-gram statistics are taken over these."""
    return rows.groupBy(F.concat_ws("\u0001", KEY, "field").alias("grp"), "norm").agg(F.count(F.lit(1)).alias("copies"))


def label_weights(rows: DataFrame) -> DataFrame:
    lo, hi = LABEL_GRAMS
    return ngram_weights(corpus(rows), "grp", "norm", "norm", lo=lo, hi=hi, copies="copies")


def label_clusters(rows: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(grp, norm, component) of the known labels of every (series, field)."""
    items = cut(label_items(rows))
    weights = cut(label_weights(rows).filter(F.col("norm") != "unknown"))
    return similar_components(items, weights, "grp", "norm", threshold=threshold)


def medoids(rows: DataFrame, clusters: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(series, field, component, label): the label closest to the weighted centre of its cluster.

    The sum of weighted similarities to all members equals the product with the weighted sum of
    their unit vectors, so no pairs are formed.  Ties: heavier label first, then by name.
    """
    weights = label_weights(rows) if weights is None else weights
    named = rows.filter(F.col("norm") != "unknown").groupBy(F.concat_ws("\u0001", KEY, "field").alias("grp"), KEY, "field", "norm", "value").agg(
        F.sum("weight").alias("_lw")
    )
    items = label_items(rows).select("grp", "norm", F.col("weight").alias("_iw")).join(clusters, ["grp", "norm"])
    vec = weights.join(items, ["grp", "norm"])
    centre = vec.groupBy("grp", "component", "gid").agg(F.sum(F.col("w") * F.col("_iw")).alias("_c"))
    score = vec.join(centre, ["grp", "component", "gid"]).groupBy("grp", "component", "norm").agg(F.round(F.sum(F.col("w") * F.col("_c")), 9).alias("_score"))
    # the least of (-score, -weight, name) is the best label
    order = F.struct((-F.col("_score")).alias("s"), (-F.col("_lw")).alias("w"), F.col("value").alias("v"))
    return named.join(score, ["grp", "norm"]).groupBy("grp", KEY, "field", "component").agg(F.min_by("value", order).alias("label"))


def cluster_candidates(rows: DataFrame, clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Vote candidates: one per cluster; an ``unknown`` signal stands alone, so only the heaviest can win."""
    items = label_items(rows).join(clusters, ["grp", "norm"])
    sums = items.groupBy("grp", KEY, "field", "component").agg(
        F.sum("weight").alias("weight"), F.sum("obs").alias("obs"), F.min("first_ord").alias("first_ord")
    )
    known = sums.join(labels.select("grp", "component", "label"), ["grp", "component"]).select(
        KEY, "field", "label", "weight", "obs", "first_ord", F.col("weight").alias("total_weight")
    )
    unknown = rows.filter(F.col("norm") == "unknown").groupBy(KEY, "field").agg(
        F.max_by(F.struct("weight", "obs", F.col("ord").alias("first_ord")), F.struct("weight", -F.col("ord"))).alias("_u"),
        F.sum("weight").alias("total_weight"),
    )
    unknown = unknown.select(KEY, "field", F.lit("unknown").alias("label"), "_u.weight", "_u.obs", "_u.first_ord", "total_weight")
    return known.unionByName(unknown)


def cluster_vote(rows: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Weighted vote over clusters of similar labels, named by their medoids."""
    rows = cut(rows)
    clusters = label_clusters(rows)
    labels = medoids(rows, clusters)
    return vote(cluster_candidates(rows, clusters, labels), threshold)


def field_votes(signals: DataFrame) -> DataFrame:
    """All voted fields in long form."""
    return exact_vote(long_fields(signals, EXACT_FIELDS)).unionByName(cluster_vote(long_fields(signals, CLUSTER_FIELDS)))


# ---------------------------------------------------------------- domains with context


def domain_items(signals: DataFrame) -> DataFrame:
    """Distinct (label, parent, concepts) of each series with weight, observations and first place."""
    rows = weighted(signals)
    label = X.first_known(F.col("domain_label"), F.col("inferred_domain"))
    concepts = F.array_sort(F.array_distinct(F.transform(F.coalesce("domain_concepts", F.array()), X.normalize_label)))
    rows = rows.select(
        KEY, "ord", "obs", F.col("domain_weight").alias("weight"), label.alias("label"),
        X.normalize_label(label).alias("norm"), X.normalize_label(F.col("domain_parent")).alias("parent"), concepts.alias("concepts"),
    )
    out = rows.groupBy(KEY, "norm", "parent", "concepts").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("weight").alias("weight"), F.sum("obs").alias("obs"), F.min("ord").alias("ord"),
        F.min_by("label", "ord").alias("label"),
    )
    text = F.concat_ws(" ", "norm", "parent", F.array_join("concepts", " "))
    return out.withColumn("rep", F.rtrim(text))


def domain_edges(items: DataFrame) -> DataFrame:
    """Edges between domain items of differing labels: label similarity 0.6 + context similarity 0.4.

    Similar labels link alone; otherwise the parents must agree and the concepts overlap.  Items of
    one label are alike by definition and need no edge.  Column ``sim`` is the linking similarity.
    """
    known = cut(items.filter(F.col("norm") != "unknown"))
    lo, hi = LABEL_GRAMS
    labels = items.groupBy(KEY, "norm").agg(F.sum("copies").alias("copies"))
    lw = cut(ngram_weights(labels, KEY, "norm", "norm", lo=lo, hi=hi, copies="copies").filter(F.col("norm") != "unknown"))
    # below this label similarity even equal contexts cannot reach the threshold
    least = (SIMILARITY - CONTEXT_WEIGHT) / LABEL_WEIGHT
    near = similar_edges(known.select(KEY, "norm").distinct(), lw, KEY, "norm", threshold=least)
    a = known.select(KEY, F.col("norm").alias("a"), F.col("ord").alias("oa"), F.col("parent").alias("pa"), F.col("concepts").alias("ca"))
    b = known.select(KEY, F.col("norm").alias("b"), F.col("ord").alias("ob"), F.col("parent").alias("pb"), F.col("concepts").alias("cb"))
    pairs = near.withColumnRenamed("cosine", "label_sim").join(a, [KEY, "a"]).join(b, [KEY, "b"])
    overlap = F.size(F.array_intersect("ca", "cb")) / F.greatest(F.lit(1), F.size(F.array_union("ca", "cb")))
    pairs = pairs.withColumn("overlap", overlap).withColumn("same_parent", F.col("pa") == F.col("pb"))
    reps = items.select(KEY, F.col("ord").alias("item"), "rep", "copies")
    rw = ngram_weights(reps, KEY, "item", "rep", lo=lo, hi=hi, copies="copies")
    vec = rw.groupBy(KEY, "item").agg(F.sort_array(F.collect_list(F.struct("gid", "w"))).alias("_v"))
    vec = cut(vec.select(KEY, "item", F.col("_v.gid").alias("_gids"), F.col("_v.w").alias("_ws")))
    slim = pairs.select(KEY, F.col("oa").alias("a"), F.col("ob").alias("b"), "label_sim", "overlap", "same_parent")
    both = cosines(slim, vec, KEY, "item").withColumnRenamed("cosine", "context_sim")
    mixed = LABEL_WEIGHT * F.col("label_sim") + CONTEXT_WEIGHT * F.col("context_sim")
    linked = (F.col("label_sim") >= SIMILARITY) | ((mixed >= SIMILARITY) & F.col("same_parent") & (F.col("overlap") >= MIN_OVERLAP))
    return both.filter(linked).withColumn("sim", F.greatest("label_sim", mixed)).select(KEY, "a", "b", "label_sim", "context_sim", "overlap", "sim")


def domain_vote(signals: DataFrame, threshold: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(vote per series, items with their cluster): the domain of each series."""
    items = cut(domain_items(signals))
    edges = cut(domain_edges(items))
    known = items.filter(F.col("norm") != "unknown")
    # items of one label hang on the label's first item
    first = known.groupBy(KEY, "norm").agg(F.min("ord").alias("_first"), F.sum("weight").alias("_label_weight"))
    hung = known.join(first, [KEY, "norm"])
    spokes = hung.filter(F.col("ord") != F.col("_first")).select(KEY, F.col("_first").alias("a"), F.col("ord").alias("b"))
    comps = connected_components(known.select(KEY, F.col("ord").alias("item")), edges.select(KEY, "a", "b").unionByName(spokes), KEY, "item")
    placed = hung.join(comps.select(KEY, F.col("item").alias("ord"), "component"), [KEY, "ord"])
    both = edges.select(KEY, F.col("a").alias("ord"), F.col("b").alias("_o"), "sim").unionByName(
        edges.select(KEY, F.col("b").alias("ord"), F.col("a").alias("_o"), "sim")
    )
    others = known.select(KEY, F.col("ord").alias("_o"), F.col("weight").alias("_ow"))
    reach = both.join(others, [KEY, "_o"]).groupBy(KEY, "ord").agg(F.sum(F.col("sim") * F.col("_ow")).alias("_reach"))
    scored = placed.join(reach, [KEY, "ord"], "left").withColumn(
        "_score", F.round(F.col("_label_weight") + F.coalesce("_reach", F.lit(0.0)), 9)
    )
    order = F.struct((-F.col("_score")).alias("s"), (-F.col("weight")).alias("w"), F.col("label").alias("l"))
    clusters = scored.groupBy(KEY, "component").agg(
        F.min_by("label", order).alias("label"), F.sum("weight").alias("weight"), F.sum("obs").alias("obs"), F.min("ord").alias("first_ord")
    ).withColumn("total_weight", F.col("weight"))
    rows = weighted(signals)
    lone = X.normalize_label(X.first_known(F.col("domain_label"), F.col("inferred_domain"))) == "unknown"
    unknown = rows.filter(lone).groupBy(KEY).agg(
        F.max_by(F.struct(F.col("domain_weight").alias("weight"), "obs", F.col("ord").alias("first_ord")), F.struct("domain_weight", -F.col("ord"))).alias("_u"),
        F.sum("domain_weight").alias("total_weight"),
    )
    unknown = unknown.select(KEY, F.lit("unknown").alias("label"), "_u.weight", "_u.obs", "_u.first_ord", "total_weight")
    result = vote(clusters.drop("component").unionByName(unknown), threshold, (KEY,))
    return result, placed.select(KEY, "ord", "norm", "parent", "concepts", "weight", "component")


# ---------------------------------------------------------------- supports


def top_supported(entries: DataFrame, totals: DataFrame, least: float, count: int | None) -> DataFrame:
    """Values with at least ``least`` of the series' total weight, heaviest first, at most ``count``.

    ``entries``: series, value, weight, one row per signal that names the value; ``totals``: series,
    total.  At most 1 / least values per series can pass, so the ranking sees few rows.
    """
    sums = entries.filter(F.col("value") != "unknown").groupBy(KEY, "value").agg(F.sum("weight").alias("weight"))
    kept = sums.join(totals, KEY).filter((F.col("total") > 0) & (F.col("weight") / F.col("total") >= least))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("weight"), "value")))
    ranked = ranked.filter(F.col("rank") <= count) if count else ranked
    return ranked.select(KEY, "value", (F.col("weight") / F.col("total")).alias("support"), F.col("rank").cast("bigint").alias("rank"))


def top_capabilities(signals: DataFrame, count: int = 5) -> DataFrame:
    """Heaviest preferred capabilities of each series."""
    rows = weighted(signals).select(KEY, "domain_weight", F.explode("preferred_capabilities").alias("capability"))
    sums = rows.filter(X.strip(F.col("capability")) != "").groupBy(KEY, "capability").agg(F.sum("domain_weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("weight"), "capability"))
    return sums.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= count)


def family_statements(signals: DataFrame) -> DataFrame:
    """(series, ord, family label, positive, negative): weighted statements for and against families.

    Labels are canonical where known; blank ones say nothing and are left out.
    """
    rows = weighted(signals)
    pref = rows.select(KEY, "ord", "domain_weight", F.explode("preferred_families").alias("p")).select(
        KEY, "ord", F.col("p.family").alias("label"), (F.col("domain_weight") * X.priority_weight(F.col("p.priority"), 2.0)).alias("positive"), F.lit(0.0).alias("negative")
    )
    against = rows.select(KEY, "ord", "domain_weight", F.explode("deprioritized_families").alias("p")).select(
        KEY, "ord", F.col("p.family").alias("label"), F.lit(0.0).alias("positive"), F.col("domain_weight").alias("negative")
    )
    both = pref.unionByName(against).withColumn("family", X.canonical_family(F.col("label")))
    return both.filter(F.col("family") != "")


def family_support(signals: DataFrame) -> DataFrame:
    """Positive, negative, raw and max-normalised support of the six families, with the verdict."""
    said = family_statements(signals).groupBy(KEY, "family").agg(
        F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.lit(True).alias("evidence_available")
    )
    names = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(i).cast("bigint").alias("family_no")) for i, f in enumerate(X.FAMILIES)])
    grid = signals.select(KEY).distinct().select(KEY, F.explode(names).alias("f")).select(KEY, "f.*")
    rows = grid.join(said, [KEY, "family"], "left").fillna({"positive": 0.0, "negative": 0.0, "evidence_available": False})
    raw = F.col("positive") - F.col("negative")
    # six rows per series
    top = F.max(F.greatest(F.col("raw_support"), F.lit(0.0))).over(Window.partitionBy(KEY))
    rows = rows.withColumn("raw_support", raw).withColumn("_top", top)
    rows = rows.withColumn("normalized_support", F.when(F.col("_top") > 0, F.greatest(F.col("raw_support"), F.lit(0.0)) / F.col("_top")).otherwise(0.0))
    verdict = (
        F.when(~F.col("evidence_available"), "none")
        .when(F.col("normalized_support") >= 0.25, "prefer")
        .when(F.col("raw_support") < 0, "deprioritize")
        .otherwise("conflict")
    )
    return rows.withColumn("verdict", verdict).drop("_top")


def discriminability(support: DataFrame) -> DataFrame:
    spread = F.least(F.lit(1.0), F.stddev_pop("normalized_support") / 0.5)
    return support.groupBy(KEY).agg(F.when(F.count(F.lit(1)) > 1, spread).otherwise(0.0).alias("discriminability"))


def preprocessing_prior(signals: DataFrame) -> DataFrame:
    """Weighted support per canonical transformation, relative to all observations of the series."""
    rows = weighted(signals)
    norm = rows.groupBy(KEY).agg(F.sum("obs").alias("_obs"))
    said = rows.select(KEY, "domain_weight", F.explode("preprocessing_prior").alias("p")).filter(F.col("p.transformation") != "")
    value = X.priority_weight(F.coalesce(F.col("p.priority"), F.lit("medium"))) * F.col("domain_weight")
    sums = said.groupBy(KEY, X.canonical_transformation(F.col("p.transformation")).alias("transformation")).agg(F.sum(value).alias("_w"))
    out = sums.join(norm, KEY).withColumn("weight", F.col("_w") / F.col("_obs")).filter(F.col("weight") > 0)
    return out.select(KEY, "transformation", "weight", X.weight_priority(F.col("weight")).alias("priority"))


def coverage(counts: DataFrame) -> DataFrame:
    """Share of available and of selected documents that were seen."""
    ratio = lambda total: F.when(F.col(total) > 0, F.least(F.lit(1.0), F.col("documents_seen") / F.col(total))).otherwise(0.0)
    return counts.withColumn("evidence_coverage", ratio("documents_available")).withColumn("selection_coverage", ratio("documents_selected"))


def prior_strength(summary: DataFrame) -> DataFrame:
    """Reliability of the aggregated prior and its strength label.

    ``summary``: domain_confidence, domain_agreement, evidence_coverage, entity_agreement,
    n_preferred, n_conflicts, n_families, documents_seen.
    """
    conflict = F.when(F.col("n_families") > 0, F.col("n_conflicts") / F.col("n_families")).otherwise(0.0)
    base = 0.5 * F.col("domain_confidence") + 0.3 * F.col("domain_agreement") + 0.2 * F.col("evidence_coverage")
    base = F.when(conflict > 0.5, base * 0.5).otherwise(base)
    usable = (F.col("n_preferred") > 0) & (F.col("documents_seen") > 0)
    out = summary.withColumn("family_conflict_ratio", conflict)
    out = out.withColumn("reliability_score", F.when(usable, base * F.col("domain_confidence")).otherwise(0.0))
    r = F.col("reliability_score")
    none = ~usable | (F.col("domain_confidence") == 0) | (F.col("evidence_coverage") == 0) | (F.col("entity_agreement") < 0.3)
    strength = F.when(none, "none").when(r >= 0.7, "high").when(r >= 0.4, "medium").when(r > 0, "low").otherwise("none")
    out = out.withColumn("prior_strength", strength)
    return out.withColumn("domain_prior_reliability", F.when(r >= 0.7, "high").when(r >= 0.4, "medium").otherwise("low"))


def distinct_findings(signals: DataFrame, column: str = "textual_findings") -> DataFrame:
    """Distinct findings of each series in first-seen order: (series, finding, first_ord, first_no)."""
    rows = signals.select(KEY, "ord", F.posexplode(column).alias("no", "finding"))
    first = F.min(F.struct("ord", "no")).alias("_f")
    return rows.groupBy(KEY, "finding").agg(first).select(KEY, "finding", F.col("_f.ord").alias("first_ord"), F.col("_f.no").cast("bigint").alias("first_no"))


def evidence_span(signals: DataFrame) -> DataFrame:
    """First and last source date of each series, and the validation counters summed up."""
    return signals.groupBy(KEY).agg(
        F.min(F.nullif("source_date_start", F.lit(""))).alias("source_date_start"),
        F.max(F.nullif("source_date_end", F.lit(""))).alias("source_date_end"),
        F.sum(F.greatest(F.lit(0), F.col("excluded_claims"))).cast("bigint").alias("excluded_claims"),
        F.count(F.lit(1)).alias("signals"),
    )


# ---------------------------------------------------------------- target resolution

# fixed values: support, margin, agreement, reliability and conflict limits of the resolution levels
RESOLUTION = {
    "material_alternative": 0.15,
    "resolved": {"support": 0.75, "margin": 0.40, "agreement": 0.70, "reliability": 0.55, "conflict": 0.20, "alternatives": 0.20},
    "alternatives": {"support": 0.65, "margin": 0.30, "agreement": 0.55, "reliability": 0.40, "conflict": 0.35, "alternatives": 0.35},
    "weak": {"support": 0.50, "margin": 0.15, "conflict": 0.60},
    "least_agreement": 0.35,
}
RESOLUTION_SCORES = {"resolved": 1.00, "resolved_with_material_alternatives": 0.70, "weakly_resolved": 0.40, "unresolved": 0.10, "unavailable": 0.00}


def quantity_candidates(signals: DataFrame) -> DataFrame:
    """One row per (series, chunk, distinct quantity): the chunk's mean confidence shared among its quantities."""
    confidences = F.array_compact(F.array(F.col("domain_confidence"), F.col("target_confidence")))
    known = X.normalize_label(F.col("physical_quantity"))
    known = F.when(~known.isin("unknown", "none", "null"), known)
    chunk = signals.groupBy(KEY, "chunk_index").agg(
        F.sum(F.aggregate(confidences, F.lit(0.0), lambda a, c: a + clamp(c))).alias("_s"),
        F.sum(F.size(confidences)).alias("_c"),
        F.min("ord").alias("_o"),
    )
    named = signals.withColumn("norm", known).filter(F.col("norm").isNotNull()).groupBy(KEY, "chunk_index", "norm").agg(
        F.min_by(X.strip(F.col("physical_quantity")), "ord").alias("label")
    )
    share = named.groupBy(KEY, "chunk_index").agg(F.count(F.lit(1)).alias("_q"))
    out = named.join(share, [KEY, "chunk_index"]).join(chunk, [KEY, "chunk_index"])
    mean = F.when(F.col("_c") > 0, F.col("_s") / F.col("_c")).otherwise(0.0)
    return out.select(KEY, "chunk_index", "norm", "label", (mean / F.col("_q")).alias("weight"))


def quantity_hypotheses(candidates: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Support and rank of each quantity: exact labels, or clusters (series, norm, component, label)."""
    if clusters is None:
        rows = candidates.withColumn("component", F.col("norm"))
        named = rows.groupBy(KEY, "component").agg(F.min("label").alias("quantity"), F.sum("weight").alias("_w"), F.countDistinct("chunk_index").alias("chunks"))
    else:
        rows = candidates.drop("label").join(clusters, [KEY, "norm"])
        named = rows.groupBy(KEY, "component").agg(F.min("label").alias("quantity"), F.sum("weight").alias("_w"), F.countDistinct("chunk_index").alias("chunks"))
    total = named.groupBy(KEY).agg(F.sum("_w").alias("_t"))
    out = named.join(total, KEY).withColumn("support", F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(0.0))
    return out.select(KEY, "quantity", "support", "chunks")


def resolution_status(hypotheses: DataFrame, targets: DataFrame) -> DataFrame:
    """Classify how well the target quantity is resolved.

    ``targets``: series, target_confidence, target_agreement.  Everything is an aggregate; the
    runner-up is the second largest support, found without ranking the hypotheses.
    """
    valid = hypotheses.filter(F.col("support") > 0)
    first = F.struct((-F.col("support")).alias("s"), F.col("quantity").alias("q"))
    agg = valid.groupBy(KEY).agg(
        F.min(first).alias("_p"), F.sum("support").alias("_all"), F.count(F.lit(1)).alias("_n"),
        F.sum((F.col("support") >= RESOLUTION["material_alternative"]).cast("bigint")).alias("_m"),
    )
    second = valid.join(agg.select(KEY, "_p"), KEY).filter(F.col("quantity") != F.col("_p.q")).groupBy(KEY).agg(F.max("support").alias("second"))
    t = targets.join(agg, KEY, "left").join(second, KEY, "left")
    t = t.withColumn("primary", F.coalesce(-F.col("_p.s"), F.lit(0.0))).withColumn("second", F.coalesce("second", F.lit(0.0)))
    t = t.withColumn("alternative_total", F.coalesce(F.col("_all") - F.col("primary"), F.lit(0.0)))
    t = t.withColumn("margin", F.col("primary") - F.col("second"))
    least = RESOLUTION["material_alternative"]
    t = t.withColumn("material", (F.coalesce("_m", F.lit(0)) - (F.col("primary") >= least).cast("bigint")).cast("bigint"))
    t = t.withColumn("conflict", F.when(F.col("_n") > 0, clamp(1.0 - F.col("primary"))).otherwise(0.0))
    t = t.withColumn("reliability", clamp(clamp(F.col("target_confidence")) * clamp(F.col("target_agreement"))))

    def meets(level: dict) -> Column:
        ok = (F.col("primary") >= level["support"]) & (F.col("margin") >= level["margin"])
        ok = ok & (clamp(F.col("target_agreement")) >= level["agreement"]) & (F.col("reliability") >= level["reliability"])
        # sums of supports carry rounding noise, the limits are two decimals
        return ok & (F.round("conflict", 12) <= level["conflict"]) & (F.round("alternative_total", 12) <= level["alternatives"])

    weak = RESOLUTION["weak"]
    unresolved = (
        (F.col("primary") < weak["support"]) | (F.col("margin") < weak["margin"]) | (F.col("conflict") >= weak["conflict"])
        | (clamp(F.col("target_agreement")) < RESOLUTION["least_agreement"])
    )
    status = (
        F.when(F.col("_n").isNull(), "unavailable")
        .when(unresolved, "unresolved")
        .when(meets(RESOLUTION["resolved"]) & (F.col("material") == 0), "resolved")
        .when(meets(RESOLUTION["alternatives"]) & (F.col("material") >= 1), "resolved_with_material_alternatives")
        .otherwise("weakly_resolved")
    )
    t = t.withColumn("status", status)
    score = F.lit(0.0)
    for name, value in RESOLUTION_SCORES.items():
        score = F.when(F.col("status") == name, value).otherwise(score)
    ambiguity = F.when(F.col("status") == "resolved", "low").when(F.col("status") == "resolved_with_material_alternatives", "medium").otherwise("high")
    return t.select(
        KEY, F.col("_p.q").alias("quantity"), "primary", "second", "alternative_total", "margin", "material", "conflict",
        "reliability", "status", score.alias("score"), ambiguity.alias("ambiguity"),
    )


def corrected_ambiguity(resolution: DataFrame, claimed: Column) -> DataFrame:
    """Ambiguity follows the status; ``corrected`` marks where the claimed one differed."""
    return resolution.withColumn("previous_ambiguity", claimed).withColumn("corrected", claimed != F.col("ambiguity"))


# ---------------------------------------------------------------- chunk quality and filters


def is_operational(signals: DataFrame) -> Column:
    """Does a signal say anything: a confidence, a finding or a named family?"""
    named = lambda c: F.exists(F.coalesce(F.col(c), F.array()), lambda e: X.strip(e["family"]) != "")
    return (
        (F.coalesce("domain_confidence", F.lit(0.0)) > 0)
        | (F.coalesce("target_confidence", F.lit(0.0)) > 0)
        | (F.size(F.coalesce("textual_findings", F.array())) > 0)
        | named("preferred_families")
        | named("deprioritized_families")
    )


def chunk_quality(signals: DataFrame) -> DataFrame:
    """Source reliability, specificity, coherence and entity consistency per chunk.

    ``source_reliability`` defaults to 0.5 where a chunk has none; entities are compared with the
    series the chunk belongs to.
    """
    known = lambda c: (~F.lower(X.strip(F.col(c))).isin("", "unknown")).cast("int")
    specific = known("primary_entity") + known("measure") + known("physical_quantity") + known("temporal_granularity")
    coherent = known("inferred_domain") + known("primary_entity") + known("physical_quantity")
    entity = F.lower(X.strip(F.col("primary_entity")))
    resolved = F.when(~entity.isin("", "unknown"), entity)
    rows = signals.select(
        KEY, "chunk_index", clamp(F.col("source_reliability")).alias("_r"), F.col("source_reliability").alias("_raw"),
        (specific / 4.0).alias("_s"), (coherent / 3.0).alias("_c"), resolved.alias("_e"), F.lower(F.col("expected_entity")).alias("_x"),
    )
    agg = rows.groupBy(KEY, "chunk_index").agg(
        F.coalesce(F.avg(F.when(F.col("_raw").isNotNull(), F.col("_r"))), F.lit(0.5)).alias("source_reliability"),
        F.avg("_s").alias("specificity"),
        F.avg("_c").alias("coherence"),
        F.max((F.col("_e") == F.col("_x")).cast("int")).alias("_hit"),
        F.count("_x").alias("_expected"),
    )
    entities = rows.filter(F.col("_e").isNotNull()).groupBy(KEY, "chunk_index", "_e").agg(F.lit(1).alias("_1"))
    entities = entities.groupBy(KEY, "chunk_index").agg(F.count(F.lit(1)).alias("_entities"))
    out = agg.join(entities, [KEY, "chunk_index"], "left")
    consistency = (
        F.when((F.col("_expected") > 0) & (F.col("_entities") > 0), F.coalesce("_hit", F.lit(0)).cast("double"))
        .when(F.col("_entities") > 1, 1.0 / F.col("_entities"))
        .otherwise(0.5)
    )
    return out.select(KEY, "chunk_index", "source_reliability", "specificity", consistency.alias("entity_consistency"), "coherence")


def target_labels(votes: DataFrame) -> DataFrame:
    """Readable target label of each series from its voted entity, measure and granularity."""
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = votes.groupBy(KEY).agg(pick("primary_entity").alias("e"), pick("measure").alias("m"), pick("temporal_granularity").alias("g"))
    return wide.select(KEY, X.target_label(F.col("e"), F.col("m"), F.col("g")).alias("target_label"))


def winning_signals(rows: DataFrame, clusters: DataFrame, votes: DataFrame, labels: DataFrame, field: str) -> DataFrame:
    """Signals (series, ord) that belong to the winning cluster of one voted field."""
    won = votes.filter(F.col("field") == field).select(KEY, F.col("value").alias("label"))
    comp = labels.filter(F.col("field") == field).join(won, [KEY, "label"]).select("grp", "component")
    member = clusters.join(comp, ["grp", "component"], "left_semi")
    mine = rows.filter(F.col("field") == field).withColumn("grp", F.concat_ws("\u0001", KEY, "field"))
    return mine.join(member.select("grp", "norm"), ["grp", "norm"], "left_semi").select(KEY, "ord", "weight")
