"""Fuzzy reliability, evidence fusion and rule-based control as expressions over (run) or (series, family) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fuzzy import ALWAYS, DOMINANT, GROUPS, LEVELS, clamp, combine, rules, weighted

KEY = "series_id"


# ---------------------------------------------------------------- reliability


def reliability_inputs(context: DataFrame) -> DataFrame:
    """Five inputs in [0, 1] from an aggregated context, each with its fallbacks.

    ``context``: raw_aggregation_reliability, reliability_score, chunk_agreement, domain_agreement,
    evidence_coverage, four quality fields (any may be null) and cross_modal_conflict.
    """
    quality = clamp(F.coalesce("raw_aggregation_reliability", "reliability_score", F.lit(0.0)))
    # least and greatest skip nulls, so a missing field must be kept out by hand
    fields = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), clamp(F.col(c))) for c in ("source_reliability", "specificity", "entity_consistency", "coherence")]))
    mean = F.aggregate(fields, F.lit(0.0), lambda a, v: a + v) / F.size(fields)
    return (
        context.withColumn("semantic_quality", quality)
        .withColumn("agreement", clamp(F.coalesce("chunk_agreement", "domain_agreement", F.lit(0.0))))
        .withColumn("coverage", clamp(F.coalesce("evidence_coverage", F.lit(0.0))))
        .withColumn("conflict", clamp(F.coalesce("cross_modal_conflict", F.lit(0.5))))
        .withColumn("source_quality", F.when(F.size(fields) > 0, clamp(mean)).otherwise(F.col("semantic_quality")))
    )


# fixed values: trust rules over quality, agreement, coverage, conflict and source, and the mixing weights
TRUST = """
0.92: quality high, agreement high, conflict low
0.75: quality high, agreement medium, conflict low or conflict medium
0.58: quality medium, agreement medium or agreement high, coverage medium or coverage high
0.68: source high, quality medium or quality high, coverage medium or coverage high
0.22: coverage low
0.18: agreement low
0.16: conflict high
0.12: quality low or source low
"""
TRUST_DEFAULT = 0.25
UNCERTAINTY = {"quality": 0.24, "agreement": 0.22, "coverage": 0.16, "conflict": 0.24, "source": 0.14}


def semantic_trust(inputs: DataFrame) -> DataFrame:
    """Add ``semantic_trust`` and ``uncertainty`` from the five reliability inputs."""
    names = {"quality": "semantic_quality", "agreement": "agreement", "coverage": "coverage", "conflict": "conflict", "source": "source_quality"}

    def degree(term: str) -> Column:
        name, level = term.split()
        return LEVELS[level](F.col(names[name]))

    pairs = [(combine(cond, degree, F.least, F.greatest), float(v)) for v, cond in rules(TRUST)]
    fired = weighted(pairs, TRUST_DEFAULT)
    doubt = sum((w * (F.col(names[n]) if n == "conflict" else 1.0 - F.col(names[n])) for n, w in UNCERTAINTY.items()), F.lit(0.0))
    out = inputs.withColumn("_fired", fired).withColumn("_doubt", clamp(doubt))
    return (
        out.withColumn("uncertainty", clamp(0.55 * (1.0 - F.col("_fired")) + 0.45 * F.col("_doubt")))
        .withColumn("semantic_trust", clamp(0.80 * F.col("_fired") + 0.20 * (1.0 - F.col("_doubt"))))
        .drop("_fired", "_doubt")
    )


# ---------------------------------------------------------------- compatibility and fusion


def analytical_compatibility(diagnostics: DataFrame, horizon: int, registry_known: bool = False) -> DataFrame:
    """Compatibility of each model family with the measured diagnostics: (series, family, score, reliability, status).

    ``diagnostics``: n_obs, trend_strength, seasonality_acf, volatility_cv, max_abs_acf, freq,
    suggested_lag, confidence; unknown measurements are null and count as missing.
    """
    unit = lambda c: F.when(c.isNotNull(), clamp(c))
    n = F.col("n_obs").cast("double")
    trend, season = unit(F.col("trend_strength") / 3.0), unit(F.col("seasonality_acf"))
    acf, confidence = unit(F.col("max_abs_acf")), unit(F.col("confidence"))
    regular = F.when(F.coalesce(F.col("freq"), F.lit("unknown")) != "unknown", 1.0)
    history = unit(n / F.lit(max(30.0, 4.0 * horizon)))
    lag_ready = unit((n - F.greatest(F.lit(1.0), F.coalesce(F.col("suggested_lag"), F.lit(1)).cast("double"))) / 60.0)
    ratio = F.when(n > 0, clamp(F.lit(float(horizon)) / n))
    measured = [n, trend, season, acf, confidence, regular]
    d = diagnostics.withColumn("_valid", sum((m.isNotNull().cast("int") for m in measured), F.lit(0)))
    coverage = F.col("_valid") / 6.0
    quality = F.coalesce(confidence, coverage)
    reliability = clamp(0.50 * coverage + 0.25 * quality + 0.25 * (F.col("_valid") > 0).cast("double"))

    def mean(*values: Column) -> Column:
        known = F.array_compact(F.array(*values))
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)).otherwise(0.5)

    known = lambda *cs: sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    spare = 1.0 - ratio
    lag = F.col("suggested_lag")
    scores = {
        "Statistical": (mean(acf, season, trend, regular, history), known(acf, season, trend, regular, n), 1),
        "Additive": (mean(trend, season, regular), known(trend, season, regular), 1),
        "Tree-based": (F.least(F.lit(0.65), 0.45 + 0.20 * mean(lag_ready, regular)), known(n, lag, regular), 1),
        "Classical ML": (F.least(F.lit(0.75), 0.45 + 0.30 * mean(lag_ready, history)), known(n, lag) + 1, 1),
        "Neural": (F.least(F.lit(0.80), 0.50 + 0.30 * mean(history, spare)), known(n, ratio), 2),
        "Transformer/Foundation": (mean(history, spare) if registry_known else F.lit(0.5), known(n, ratio) if registry_known else F.lit(0), 2),
    }
    rows = [
        F.struct(
            F.lit(f).alias("family"), F.lit(X.FAMILIES.index(f)).cast("bigint").alias("family_no"),
            F.when(used < need, 0.5).otherwise(clamp(score)).alias("analytical_compatibility"),
            F.when(used < need, "uncertain").otherwise("ready").alias("status"),
        )
        for f, (score, used, need) in scores.items()
    ]
    return d.select(KEY, reliability.alias("analytical_reliability"), F.explode(F.array(*rows)).alias("r")).select(KEY, "analytical_reliability", "r.*")


def cross_modal_conflict(families: DataFrame) -> DataFrame:
    """Reliability-weighted distance of the two sources over the families both speak about.

    ``families``: series, family, analytical_compatibility, analytical_reliability,
    semantic_support, evidence_available.
    """
    pair = F.least(F.col("analytical_reliability"), F.col("evidence_available").cast("double"))
    apart = pair * F.abs(F.col("semantic_support") - F.col("analytical_compatibility"))
    total = F.sum(pair)
    return families.groupBy(KEY).agg(
        F.when(total > 1e-12, clamp(F.sum(apart) / total)).otherwise(0.5).alias("cross_modal_conflict"),
        (F.sum((pair > 0).cast("double")) / len(X.FAMILIES)).alias("cross_modal_coverage"),
    )


def fuse(families: DataFrame, trust: DataFrame) -> DataFrame:
    """Combined compatibility and rank of every family: (series, family, combined, rank, ...).

    ``trust``: series, semantic_trust.
    """
    rows = families.join(trust.select(KEY, "semantic_trust"), KEY)
    semantic = F.col("semantic_trust") * F.col("evidence_available").cast("double")
    total = F.col("analytical_reliability") + semantic
    mixed = (F.col("analytical_reliability") * F.col("analytical_compatibility") + semantic * F.col("semantic_support")) / total
    rows = rows.withColumn("semantic_reliability", semantic).withColumn("combined", F.when(total > 1e-12, clamp(mixed)).otherwise(0.5))
    # six families per series
    order = Window.partitionBy(KEY).orderBy(F.desc(F.round("combined", 12)), "family_no")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint"))


def fusion_summary(fused: DataFrame, trust: DataFrame, conflict: DataFrame) -> DataFrame:
    """Fusion reliability, alignment, margin and discriminability of each series."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("combined")))
    per = fused.groupBy(KEY).agg(
        clamp(F.avg("analytical_reliability")).alias("analytical_trust"),
        F.max(F.when(F.col("rank") == 1, F.col("family"))).alias("top_family"),
        (at(1) - at(2)).alias("top_margin"),
        F.least(F.lit(1.0), F.stddev_pop("semantic_support") / 0.5).alias("discriminability"),
    )
    out = per.join(trust.select(KEY, "semantic_trust", "uncertainty"), KEY).join(conflict, KEY)
    out = out.withColumn("alignment", clamp(1.0 - F.col("cross_modal_conflict")))
    reliability = 0.40 * F.col("semantic_trust") + 0.35 * F.col("analytical_trust") + 0.15 * F.col("alignment") + 0.10 * F.col("cross_modal_coverage")
    return out.withColumn("fusion_reliability", clamp(reliability))


# ---------------------------------------------------------------- control

# inputs of the control rules; two more (in_family, escape) are derived from them
CONTROL_INPUTS = [
    "reliability", "conflict", "discriminability", "empirical", "plateau", "completeness", "unexplored", "stability", "stagnation",
    "global_gain", "global_stagnation", "saturation", "maturity", "quality", "absolute_quality", "coverage", "misalignment", "improvement",
    "challenger", "challenger_maturity", "responsiveness", "capacity", "unresolved", "urgency", "information", "intra_coverage", "residual",
    "model_residual", "preprocessing", "dominance", "supported_dominance", "exhaustion", "expected", "in_family_potential", "breakthrough", "remaining",
]
EVIDENCE = """
uncertain: reliability low or conflict high or discriminability low
confident: reliability high, conflict low, discriminability high
"""
MODERATE = """
m1: reliability medium, conflict low or conflict medium, discriminability medium or discriminability high
m2: reliability high, discriminability medium
m3: reliability high, conflict medium, discriminability high
"""


def derived_strengths(inputs: DataFrame) -> DataFrame:
    """Add ``in_family`` (another model of the family) and ``escape`` (a new family)."""
    c = F.col
    in_family = clamp(c("in_family_potential") * (0.35 + 0.35 * c("stagnation") + 0.30 * (1.0 - c("information"))))
    pull = 0.20 + 0.25 * c("global_stagnation") + 0.20 * F.greatest("saturation", "maturity") + 0.20 * (1.0 - c("coverage")) + 0.15 * c("remaining")
    escape = clamp(c("residual") * pull * (0.65 + 0.35 * (1.0 - c("global_gain"))) * (1.0 - 0.30 * c("quality")))
    return inputs.withColumn("in_family", in_family).withColumn("escape", escape)


FUZZY_INPUTS = [c for c in CONTROL_INPUTS if c != "in_family_potential"] + ["in_family", "escape"]
PLAIN = ["uncertain", "moderate", "confident", "always"]
# where a degree lies in the array of degrees
PLACE = {f"{c} {level}": 3 * i + j for i, c in enumerate(FUZZY_INPUTS) for j, level in enumerate(LEVELS)}
PLACE |= {name: 3 * len(FUZZY_INPUTS) + i for i, name in enumerate(PLAIN)}


def _table(parsed: list) -> Column:
    """Rules as a constant: an array of conditions of alternatives of places."""
    number = lambda t: F.lit(PLACE[t])
    return F.array(*[F.array(*[F.array(*[F.array(*[number(t) for t in alt]) for alt in cond]) for cond in conds]) for _, conds in parsed])


def _fire(table: Column, levels: Column) -> Column:
    """Degree of every rule of a table: least over conditions, greatest over alternatives, least within."""
    alternative = lambda alt: F.array_min(F.transform(alt, lambda i: F.get(levels, i)))
    condition = lambda cond: F.array_max(F.transform(cond, alternative))
    return F.transform(table, lambda conds: F.array_min(F.transform(conds, condition)))


def memberships(inputs: DataFrame, keep: list[str]) -> DataFrame:
    """(keys, levels): all membership degrees of a run in one array, the three evidence degrees at its end.

    The rules below are constants applied to this array, so that the generated code stays small
    however many rules there are.
    """
    rows = inputs.select(*keep, *[clamp(F.col(c)).alias(c) for c in CONTROL_INPUTS])
    rows = derived_strengths(rows)
    levels = F.flatten(F.transform(F.array(*FUZZY_INPUTS), lambda x: F.array(*[fn(x) for fn in LEVELS.values()])))
    rows = rows.select(*keep, levels.alias("levels"))
    given = [_fire(_table(rules(t)), F.col("levels")) for t in (EVIDENCE, MODERATE)]
    rows = rows.select("*", given[0].alias("_e"), given[1].alias("_m"))
    plain = F.array(F.get("_e", F.lit(0)), F.array_max("_m"), F.get("_e", F.lit(1)), F.lit(ALWAYS))
    return rows.select(*keep, F.concat("levels", plain).alias("levels"))


def control_strengths(inputs: DataFrame, keep: list[str]) -> DataFrame:
    """Strength of guidance, breadth, explore, refine and stop per row, with the dominant rule of each action.

    Everything is projection: nothing is shuffled, whatever the number of runs.
    """
    rows = memberships(inputs, keep)
    for group, (text, default) in GROUPS.items():
        parsed = rules(text)
        values = F.array(*[F.lit(float(v)) for v, _ in parsed])
        pairs = F.zip_with(_fire(_table(parsed), F.col("levels")), values, lambda d, v: F.struct(d.alias("d"), (d * v).alias("n")))
        sums = F.aggregate(
            pairs, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n")), lambda a, p: F.struct((a["d"] + p["d"]).alias("d"), (a["n"] + p["n"]).alias("n"))
        )
        rows = rows.withColumn(f"_{group}", sums)
        mean = clamp(F.col(f"_{group}.n") / F.col(f"_{group}.d"))
        rows = rows.withColumn(group, F.when(F.col(f"_{group}.d") <= 1e-12, default).otherwise(mean)).drop(f"_{group}")
    for action, text in DOMINANT.items():
        parsed = rules(text)
        names = F.array(*[F.lit(n) for n, _ in parsed])
        rows = rows.withColumn("_d", _fire(_table(parsed), F.col("levels")))
        rows = rows.withColumn(f"{action}_rule", F.element_at(names, F.array_position("_d", F.array_max("_d")).cast("int"))).drop("_d")
    return rows.drop("levels")


def inference_trace(inputs: DataFrame, keep: list[str]) -> DataFrame:
    """Long form of the inference: (keys, rule, group, degree, conclusion, contribution) for every rule."""
    rows = memberships(inputs, keep)
    named = [(f"{g}.rule_{i:03d}", g, float(v)) for g, (t, _) in GROUPS.items() for i, (v, _) in enumerate(rules(t), start=1)]
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(g).alias("rule_group"), F.lit(v).alias("conclusion")) for r, g, v in named])
    fired = _fire(_table([r for t, _ in GROUPS.values() for r in rules(t)]), F.col("levels"))
    out = rows.select(*keep, F.explode(F.arrays_zip(table.alias("r"), fired.alias("degree"))).alias("x"))
    return out.select(*keep, "x.r.*", "x.degree").withColumn("contribution", F.col("degree") * F.col("conclusion"))
