"""How a search is going: continuous signals per run, derived from its ledger of valid trials.

Everything that runs along a whole run is a block-wise running value or a partial aggregate; the
only collected lists are bounded by the model catalogue (24) or by the last four trials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fuzzy import clamp, gap_potential, relative_gain, smoothstep
from . import ledger as L
from .lineage import cut, stored
from .ordered import attach
from .quantiles import exact_median

RUN = "run_id"
T = L.THRESHOLD
LABEL_CONFIDENCE = {"low": 0.35, "medium": 0.65, "high": 0.95}


def information_gain(gains: DataFrame, keys: list[str], threshold: float = T) -> DataFrame:
    """Information in the last four trials of every sequence (1 while there is only one)."""
    last = gains.filter(F.col("pos") >= F.col("n") - 4)
    s = last.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "mase", "signature"))).alias("_t"), F.count(F.lit(1)).alias("k")
    )
    values = F.transform("_t", lambda t: t["mase"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    steps = F.zip_with(F.slice(F.col("_v"), F.lit(1), F.col("k") - 1), F.slice(F.col("_v"), 2, 4), lambda a, b: F.abs(b - a) / (F.abs(a) + 1e-12))
    s = s.withColumn("_v", values).withColumn("k", F.col("k").cast("int"))
    mean = total(F.col("_v")) / F.col("k")
    s = s.withColumn("_change", F.when(F.col("k") > 1, total(steps) / (F.col("k") - 1))).withColumn("_mean", mean)
    spread = F.sqrt(total(F.transform("_v", lambda v: (v - F.col("_mean")) * (v - F.col("_mean")))) / F.col("k")) / (F.abs("_mean") + 1e-12)
    # gains inside the four trials only: each over the best of those before it
    after = F.transform(F.when(F.col("k") > 1, F.sequence(F.lit(2), F.col("k"))), lambda i: relative_gain(F.array_min(F.slice(F.col("_v"), F.lit(1), i - 1)), F.element_at(F.col("_v"), i)))
    s = s.withColumn("_spread", spread).withColumn("_best", F.array_max(after))
    diversity = F.size(F.array_distinct(F.transform("_t", lambda t: t["signature"]))) / F.col("k")
    change = smoothstep(F.col("_change"), threshold * 0.25, 0.05)
    dispersion = smoothstep(F.col("_spread"), threshold * 0.20, 0.03)
    improvement = smoothstep(F.col("_best"), threshold * 0.50, 0.10)
    s = s.withColumn("_c", change).withColumn("_d", dispersion).withColumn("_i", improvement)
    direction = 0.20 + 0.80 * F.col("_i")
    raw = clamp(0.25 * F.col("_c") * direction + 0.20 * F.col("_d") * direction + 0.50 * F.col("_i") + 0.05 * diversity)
    numeric = F.greatest(F.col("_c") * direction, F.col("_d") * direction, F.col("_i"))
    redundancy = smoothstep((F.col("k") - 1).cast("double"), 1.0, 3.0) * (1.0 - numeric)
    return s.select(*keys, F.when(F.col("k") <= 1, 1.0).otherwise(clamp(raw * (1.0 - 0.70 * redundancy))).alias("information_gain"))


def responsiveness(gains: DataFrame, keys: list[str], threshold: float = T) -> DataFrame:
    """How well refinements pay: size, frequency and recency of meaningful gains."""
    event = F.col("pos") > 0
    hit = event & (F.col("gain") >= threshold)
    s = gains.groupBy(*keys).agg(
        F.sum(event.cast("bigint")).alias("_events"), F.sum(hit.cast("bigint")).alias("_hits"),
        F.max(F.when(hit, F.col("gain"))).alias("_best"), F.sum(F.when(hit, F.col("gain"))).alias("_sum"),
        F.max(F.when(hit, F.col("pos") - 1)).alias("_last"),
    )
    some = F.col("_hits") > 0
    value = (
        0.45 * smoothstep(F.coalesce("_best", F.lit(0.0)), threshold, 0.10)
        + 0.25 * F.when(F.col("_events") > 0, F.col("_hits") / F.col("_events")).otherwise(0.0)
        + 0.20 * F.when(some, 1.0 / (F.col("_events") - F.col("_last"))).otherwise(0.0)
        + 0.10 * smoothstep(F.coalesce("_sum", F.lit(0.0)), threshold, 0.15)
    )
    return s.select(*keys, clamp(value).alias("responsiveness"))


def search_exhaustion(c: dict[str, Column]) -> Column:
    """Evidence that another trial has little value: maturity times the absence of blockers."""
    grown = (
        0.18 * c["global_stagnation"] + 0.16 * (1.0 - c["global_gain"]) + 0.18 * c["family_coverage"] + 0.18 * c["model_coverage"]
        + 0.18 * c["empirical"] + 0.07 * c["stability"] + 0.05 * (1.0 - c["challenger"])
    )
    blocker = F.greatest(c["challenger"], c["residual"], c["model_residual"], c["urgency"])
    return clamp(clamp(grown) * (1.0 - 0.80 * blocker))


def empirical_strength(n: Column, family_coverage: Column, model_coverage: Column, diversity: Column, stability: Column, recent: Column, full: int = 6) -> Column:
    """Weight of the trials so far as evidence."""
    target = max(6, full)
    x = clamp((n - 2.0) / (target + 2.0))
    settled = 1.0 - clamp(recent / 0.05)
    quality = 0.65 * clamp(stability) + 0.35 * settled
    return clamp(0.35 * x * x * (3.0 - 2.0 * x) + 0.25 * family_coverage + 0.15 * model_coverage + 0.15 * diversity + 0.10 * quality)


# ---------------------------------------------------------------- analytical signals


def signal_strengths(analytics: DataFrame) -> DataFrame:
    """Relevant analytical signals of each run (strength at least 0.6): (run, signal, strength).

    ``analytics``: run, seasonality_detected, seasonality_acf, seasonality_confidence, max_abs_acf,
    trend_strength, nonlinearity_score, scale_sensitive.
    """
    confidence = F.lit(0.35)
    for label, value in LABEL_CONFIDENCE.items():
        confidence = F.when(F.lower("seasonality_confidence") == label, value).otherwise(confidence)
    acf = F.col("max_abs_acf")
    season = clamp(0.55 * F.greatest(F.coalesce("seasonality_acf", F.lit(0.0)), F.coalesce(acf, F.lit(0.0))) + 0.45 * confidence)
    trend = F.abs("trend_strength")
    strengths = {
        "seasonality": F.when(F.col("seasonality_detected"), season),
        "trend": F.when(trend > 0, smoothstep(trend, 0.75, 3.0)),
        "autocorrelation": F.when(acf.isNotNull(), smoothstep(acf, 0.35, 0.85)),
        "nonlinearity": F.when(F.col("nonlinearity_score") >= 0, clamp(F.col("nonlinearity_score"))),
        "scale_sensitivity": F.when(F.col("scale_sensitive"), F.lit(0.8)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("strength")) for k, v in strengths.items()])
    out = analytics.select(RUN, F.explode(rows).alias("s")).select(RUN, "s.*")
    return out.filter(F.col("strength") >= 0.60)


def resolved_signals(trials: DataFrame, analytics: DataFrame) -> DataFrame:
    """(run, signal): signals some valid trial's configuration can express.

    ``trials`` carry seasonal (text), yearly (boolean), difference_order, steps (names) and lags.
    """
    wanted = analytics.select(RUN, "seasonal_periods", F.coalesce("suggested_lag", "seasonal_periods").alias("_lag"))
    model = F.col("model")
    has = lambda *names: F.arrays_overlap("steps", F.array(*[F.lit(n) for n in names]))
    season = (model == "SARIMA") | ((model == "Prophet") & F.col("yearly"))
    trend = (model == "Prophet") | (model.isin("ARIMA", "SARIMA") & (F.col("difference_order") > 0)) | has("calendar_features")
    curved = F.col("family").isin("Tree-based", "Neural", "Transformer/Foundation") | model.isin("KNN", "SVR")
    scaled = has("standard_scaler", "minmax_scaler", "log_transform", "boxcox_transform")
    flags = {
        "seasonality": season, "_periodic": (model == "ETS") & F.col("seasonal").isin("add", "mul"), "trend": trend,
        "autocorrelation": model.isin("ARIMA", "SARIMA"), "nonlinearity": curved, "scale_sensitivity": scaled,
    }
    any_of = lambda columns: [F.bool_or(F.coalesce(c, F.lit(False))).alias(k) for k, c in columns.items()]
    # what depends on the run's analytics is decided per run, not per trial
    lags = trials.filter(has("lag_features")).select(RUN, F.explode("lags").alias("_lag")).distinct()
    lagged = lags.join(wanted.select(RUN, "_lag"), [RUN, "_lag"]).select(RUN).distinct().withColumn("_lagged", F.lit(True))
    s = trials.groupBy(RUN).agg(*any_of(flags)).join(wanted, RUN).join(lagged, RUN, "left")
    flags = {k: F.col(k) for k in flags if k != "_periodic"}
    flags["seasonality"] = flags["seasonality"] | (F.col("_periodic") & (F.col("seasonal_periods") > 0))
    flags["autocorrelation"] = flags["autocorrelation"] | F.coalesce("_lagged", F.lit(False))
    s = s.groupBy(RUN).agg(*any_of(flags))
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).alias("ok")) for k in flags]))
    return s.select(RUN, long.alias("x")).select(RUN, "x.*").filter("ok").select(RUN, "signal")


def unresolved_evidence(trials: DataFrame, analytics: DataFrame) -> DataFrame:
    """Strength of the analytical signals no trial has addressed, and their names."""
    relevant = signal_strengths(analytics)
    done = resolved_signals(trials, analytics).withColumn("_done", F.lit(True))
    rows = relevant.join(done, [RUN, "signal"], "left").withColumn("_open", F.col("_done").isNull())
    s = rows.groupBy(RUN).agg(
        F.max(F.when(F.col("_open"), F.col("strength"))).alias("_m"), F.avg(F.when(F.col("_open"), F.col("strength"))).alias("_a"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_open"), F.col("signal")))), ",").alias("unresolved_signals"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("_open"), F.col("signal")))), ",").alias("resolved_signals"),
    )
    out = analytics.select(RUN).join(s, RUN, "left")
    return out.select(
        RUN, F.when(F.col("_m").isNull(), 0.0).otherwise(clamp(0.75 * F.col("_m") + 0.25 * F.col("_a"))).alias("unresolved_evidence"),
        F.coalesce("unresolved_signals", F.lit("")).alias("unresolved_signals"), F.coalesce("resolved_signals", F.lit("")).alias("resolved_signals"),
    )


# ---------------------------------------------------------------- the whole picture


def search_dynamics(
    trials: DataFrame, analytics: DataFrame, priorities: DataFrame | None = None, *, maximum: int = 30, max_refinements: int = 4, window: int = 3
) -> DataFrame:
    """One row of search signals per run with at least one valid trial.

    ``trials``: ledger rows with model, mase, step, signature, uses_log and the columns
    ``resolved_signals`` needs; ``priorities``: (run, family, priority), 0.5 where absent.  All 24
    models count as available.
    """
    c = F.col
    n_models, n_families = len(X.MODEL_FAMILY), len(X.FAMILIES)
    # only what is read below is written, column by column: it is the one table as long as the ledger
    used = [RUN, "step", "model", "family", "mase", "signature", "uses_log", "seasonal", "yearly", "difference_order", "steps", "lags"]
    rows = stored(L.with_gains(L.valid(trials).select(*used), before="before"))
    score, last = F.struct("mase", "step"), c("pos") == c("n") - 1

    # run level
    run = rows.groupBy(RUN).agg(
        F.max("n").alias("n"), F.min("mase").alias("incumbent"), F.min_by("model", score).alias("incumbent_model"),
        F.min_by("family", score).alias("incumbent_family"), F.max_by("model", "step").alias("current_model"), F.max_by("family", "step").alias("current_family"),
        F.max(F.when(last, c("mase"))).alias("latest"), F.max(F.when(last, c("gain"))).alias("last_gain"),
        F.avg(F.when(c("pos") >= c("n") - 3, c("gain"))).alias("recent_relative_improvement"),
        F.bool_or("uses_log").alias("_any_log"),
        # a score and the best before it: the greater of the two is the second at that point
        F.min(F.when(c("pos") > 0, F.greatest("mase", "before"))).alias("_second"),
    )
    median = exact_median(rows, RUN, c("mase"), "_median", upper=True)
    moving = L.progress(rows, [RUN], window).select(RUN, c("recent_information_gain").alias("global_gain"), c("stagnation").alias("global_stagnation"), "since")
    run = run.join(median, RUN).join(moving, RUN)
    lead = clamp(relative_gain(F.coalesce("_second", "incumbent"), c("incumbent")) / (10.0 * T))
    run = run.withColumn("incumbent_stability", clamp(clamp(c("since") / 3.0) * (0.75 + 0.25 * lead)))
    run = run.withColumn("absolute_incumbent_quality", clamp((1.35 - c("incumbent")) / 0.70))
    run = run.withColumn("relative_incumbent_quality", F.when(c("n") == 1, 0.5).otherwise(clamp(relative_gain(c("_median"), c("incumbent")) / 0.05)))
    run = run.withColumn("incumbent_quality", clamp(0.70 * c("absolute_incumbent_quality") + 0.30 * c("relative_incumbent_quality")))
    run = cut(run)

    # the model tried last
    now = run.select(RUN, c("current_model").alias("model"))
    mine = attach(rows.select(RUN, "model", "step", "mase", "signature", "uses_log"), now, [RUN, "model"], "step")
    own = stored(L.with_gains(mine))
    of_model = own.groupBy(RUN).agg(
        F.max("n").alias("model_trials"), F.avg(F.when(c("pos") >= c("n") - 2, c("gain"))).alias("_recent_model"),
        F.max(F.when(last, c("mase"))).alias("_latest_model"),
        (F.max(F.col("uses_log").cast("int")) - F.min(F.col("uses_log").cast("int")) + 1).alias("_treatments"),
    )
    forms = own.select(RUN, "signature").distinct().groupBy(RUN).agg(F.count(F.lit(1)).alias("_forms"))
    of_model = of_model.join(forms, RUN).join(responsiveness(own, [RUN]), RUN).join(information_gain(own, [RUN]), RUN)
    of_model = of_model.join(L.tail_refinements(rows.select(RUN, "step", "model")).drop("current_model"), RUN)
    run = run.join(of_model, RUN)
    run = run.withColumn("refinements", F.greatest(F.lit(0), c("model_trials") - 1))
    gap_now = clamp(F.greatest(F.lit(0.0), (c("_latest_model") - c("incumbent")) / (F.abs("incumbent") + 1e-12)) / (10.0 * T))
    stuck = 0.55 * (1.0 - clamp(c("_recent_model") / T)) + 0.20 * gap_now + 0.25 * clamp(c("consecutive_refinements") / 2.0)
    run = run.withColumn("model_stagnation", clamp(clamp(c("refinements") / 2.0) * stuck))
    target = max(2, max_refinements - 1)
    run = run.withColumn("_covered", clamp(c("refinements") / float(target)))
    maturity = 0.55 * c("_covered") + 0.25 * clamp(F.greatest(F.lit(0), c("_forms") - 1) / 2.0) + 0.20 * c("model_stagnation") * c("_covered")
    run = run.withColumn("model_refinement_maturity", clamp(maturity))
    run = run.withColumn("remaining_refinement_capacity", clamp((max_refinements - c("refinements")) / float(max(1, max_refinements))))

    # families: one sequence per family, six at most; models: 24 at most
    models = cut(rows.groupBy(RUN, "model", "family").agg(F.min("mase").alias("_b")))
    fam = L.with_gains(rows.select(RUN, "family", "step", "mase"), [RUN, "family"])
    stats = fam.groupBy(RUN, "family").agg(
        F.max("n").alias("attempts"), F.min("mase").alias("family_best"),
        F.avg(F.when(c("pos") >= c("n") - 3, c("gain"))).alias("_recent"),
        F.sum(((c("pos") > 0) & (c("gain") < T)).cast("bigint")).alias("_idle"),
    ).join(models.groupBy(RUN, "family").agg(F.count(F.lit(1)).alias("models_tried")), [RUN, "family"]).join(L.progress(fam, [RUN, "family"], window).select(RUN, "family", c("stagnation").alias("family_stagnation")), [RUN, "family"])
    catalog = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(i).alias("family_no"), F.lit(sum(v == f for v in X.MODEL_FAMILY.values())).alias("models")) for i, f in enumerate(X.FAMILIES)])
    grid = run.select(RUN, F.explode(catalog).alias("f")).select(RUN, "f.*").join(stats, [RUN, "family"], "left")
    if priorities is not None:
        grid = grid.join(priorities.select(RUN, "family", "priority"), [RUN, "family"], "left")
    else:
        grid = grid.withColumn("priority", F.lit(None).cast("double"))
    grid = cut(grid.fillna({"attempts": 0, "models_tried": 0, "family_stagnation": 0.0}))
    seen = c("attempts") > 0
    share = c("attempts") / F.sum("attempts").over(Window.partitionBy(RUN))
    spread = grid.withColumn("_p", share).groupBy(RUN).agg(
        F.sum(seen.cast("int")).alias("_families"), F.sum("models_tried").alias("_models"),
        (-F.sum(F.when(seen, c("_p") * F.log("_p"))) / F.log(F.lit(float(n_families)))).alias("_entropy"),
        F.max(F.when(~seen, clamp(F.coalesce("priority", F.lit(0.5))))).alias("_unseen"),
    )
    run = run.join(spread, RUN)
    run = run.withColumn("family_coverage", clamp(c("_families") / float(n_families))).withColumn("distinct_model_coverage", c("_models") / float(n_models))
    run = run.withColumn("cross_family_diversity", F.when(c("_families") > 1, clamp(c("_entropy"))).otherwise(0.0))
    mine_now = grid.join(run.select(RUN, c("current_family").alias("family"), "model_stagnation"), [RUN, "family"])
    idle = c("_idle") / F.greatest(F.lit(1), c("attempts") - 1)
    full = clamp(F.greatest(F.lit(0), c("attempts") - 1) / 4.0)
    saturated = clamp(full * (0.50 * (1.0 - clamp(c("_recent") / T)) + 0.30 * idle + 0.20 * c("model_stagnation")))
    current = mine_now.select(RUN, saturated.alias("family_saturation"), c("attempts").alias("current_family_attempts"), (c("models_tried") / c("models")).alias("intra_family_model_coverage"))
    run = run.join(current, RUN)

    # a challenger is the latest trial if it is of another model than the incumbent
    rival = (c("current_model") != c("incumbent_model")) & (c("latest") >= c("incumbent"))
    rival_gap = F.greatest(F.lit(0.0), (c("latest") - c("incumbent")) / (F.abs("incumbent") + 1e-12))
    rival_maturity = clamp(0.65 * clamp(c("refinements") / float(target)) + 0.35 * clamp(F.greatest(F.lit(0), c("_forms") - 1) / float(target)))
    run = run.withColumn("challenger_model", F.when(rival, c("current_model"))).withColumn("challenger_gap", F.when(rival, rival_gap))
    run = run.withColumn("challenger_maturity", F.when(rival, rival_maturity).otherwise(0.0))
    young = 1.0 - clamp(c("current_family_attempts") / 4.0)
    raw = gap_potential(c("challenger_gap")) * (0.55 + 0.20 * (1.0 - c("challenger_maturity")) + 0.15 * young + 0.10 * c("remaining_refinement_capacity"))
    run = run.withColumn("raw_challenger_potential", F.when(rival, clamp(raw)).otherwise(0.0))
    lively = F.greatest(c("responsiveness"), 1.0 - c("challenger_maturity"))
    effective = c("raw_challenger_potential") * (0.35 + 0.65 * lively) * (1.0 - 0.75 * c("challenger_maturity")) * (0.25 + 0.75 * c("information_gain"))
    run = run.withColumn("effective_challenger_potential", F.when(rival, clamp(effective)).otherwise(0.0))

    # evidence
    run = run.join(unresolved_evidence(rows, analytics), RUN, "left")
    run = run.withColumn("_urgency", clamp(F.coalesce("unresolved_evidence", F.lit(0.0)) * (1.0 - 0.55 * c("incumbent_quality"))))
    settled = 1.0 - clamp(c("recent_relative_improvement") / 0.05)
    strength = (
        0.30 * smoothstep(c("n").cast("double"), 3.0, 10.0) + 0.25 * c("family_coverage") + 0.15 * c("distinct_model_coverage")
        + 0.15 * c("cross_family_diversity") + 0.10 * c("incumbent_stability") + 0.05 * settled
    )
    run = cut(run.withColumn("empirical_evidence_strength", clamp(strength)))

    # what is left in each family
    basis = run.select(RUN, "incumbent", "incumbent_quality", "_urgency", (0.5 * c("family_coverage") + 0.5 * c("distinct_model_coverage")).alias("_searched"))
    left = grid.join(basis, RUN)
    unknown = clamp(0.70 * (1.0 - 0.70 * clamp(c("_searched")) * c("incumbent_quality")) + 0.20 * c("_urgency"))
    relevant = F.when(seen, gap_potential((c("family_best") - c("incumbent")) / (F.abs("incumbent") + 1e-12))).otherwise(unknown)
    covered = c("models_tried") / c("models")
    residual = (1.0 - covered) * clamp(F.coalesce("priority", F.lit(0.5))) * (0.45 + 0.40 * relevant + 0.15 * (1.0 - c("family_stagnation")))
    left = left.withColumn("residual", clamp(residual)).withColumn("covered", covered)
    per_run = left.groupBy(RUN).agg(
        F.max("residual").alias("global_model_residual_potential"),
        F.min_by(F.struct("family", "residual", "covered"), F.struct(F.when(seen, 0).otherwise(1), -c("residual"), "family_no")).alias("_s"),
    )
    run = run.join(per_run, RUN)
    run = run.withColumn("strongest_residual_family", c("_s.family"))
    unseen = F.coalesce("_unseen", F.lit(0.0))
    run = run.withColumn("family_residual_potential", F.greatest(c("global_model_residual_potential"), unseen))

    # preprocessing
    wanted = analytics.select(RUN, (c("scale_sensitive").cast("int") + (c("suggested_lag").isNotNull() | c("seasonal_periods").isNotNull()).cast("int")).alias("_wanted"))
    run = run.join(wanted, RUN, "left").fillna({"_wanted": 0})
    plausible = 1 + c("_any_log").cast("int") + c("_wanted")
    treated = clamp(c("_treatments") / plausible)
    run = run.withColumn("preprocessing_refinement_potential", clamp((1.0 - treated) * (0.65 + 0.35 * clamp(c("_wanted") / 2.0))))

    # dominance over the other models (23 at most)
    rivals = models.join(run.select(RUN, "incumbent", "incumbent_model"), RUN).filter(c("model") != c("incumbent_model"))
    gaps = rivals.groupBy(RUN).agg(
        F.sort_array(F.collect_list(F.greatest(F.lit(0.0), (c("_b") - c("incumbent")) / (F.abs("incumbent") + 1e-12)))).alias("_g"),
        F.size(F.collect_set("family")).alias("_rf"),
    )
    run = run.join(gaps, RUN, "left")
    k = F.size("_g")
    dominance = (
        0.35 * smoothstep(F.get("_g", F.floor(k / 2).cast("int")), 0.05, 0.50) + 0.25 * smoothstep(F.get("_g", F.lit(0)), 0.03, 0.30)
        + 0.15 * clamp(c("_rf") / float(min(3, n_families))) + 0.15 * clamp(k / float(min(4, n_models - 1))) + 0.10 * c("incumbent_stability")
    )
    run = run.withColumn("incumbent_dominance", F.when(c("_g").isNotNull(), clamp(dominance)).otherwise(0.0))
    confidence = 0.10 + 0.25 * c("family_coverage") + 0.20 * c("distinct_model_coverage") + 0.20 * c("cross_family_diversity") + 0.25 * c("empirical_evidence_strength")
    run = run.withColumn("dominance_confidence", clamp(confidence))
    run = run.withColumn("evidence_supported_dominance", clamp(c("incumbent_dominance") * c("dominance_confidence")))

    # budget, breakthrough, value of searching on
    run = run.withColumn("remaining_budget", F.greatest(F.lit(0), maximum - c("n")).cast("bigint"))
    run = run.withColumn("remaining_budget_ratio", clamp(c("remaining_budget") / float(maximum)))
    late = 0.50 + 0.25 * (1.0 - c("remaining_budget_ratio")) + 0.20 * c("responsiveness") + 0.05 * (1.0 - c("model_refinement_maturity"))
    run = run.withColumn("late_breakthrough", clamp(smoothstep(c("last_gain"), max(T, 0.01), 0.20) * late))
    run = run.withColumn("analytical_evidence_urgency", clamp(c("_urgency") * (1.0 - 0.45 * c("incumbent_quality") * c("evidence_supported_dominance"))))
    opening = F.greatest(c("effective_challenger_potential"), 1.0 - c("evidence_supported_dominance"))
    value = (
        0.22 * c("family_residual_potential") + 0.28 * c("global_model_residual_potential") + 0.14 * unseen + 0.12 * c("analytical_evidence_urgency")
        + 0.10 * opening + 0.07 * c("global_gain") + 0.07 * (1.0 - c("incumbent_quality"))
    )
    pressure = c("incumbent_quality") * c("evidence_supported_dominance") * c("global_stagnation") * (1.0 - c("global_gain"))
    guard = (1.0 - c("incumbent_quality")) * F.greatest(c("family_residual_potential"), c("global_model_residual_potential"), unseen, c("analytical_evidence_urgency"))
    run = run.withColumn("residual_search_value", F.greatest(clamp(clamp(value) * (1.0 - 0.75 * clamp(pressure))), clamp(0.85 * clamp(guard))))
    in_family = (1.0 - c("_s.covered")) * c("_s.residual") * (0.45 + 0.35 * c("model_stagnation") + 0.20 * (1.0 - c("information_gain"))) * (0.50 + 0.50 * clamp(c("residual_search_value") / 0.50))
    run = run.withColumn("explore_model_in_family_potential", clamp(in_family))
    worth = F.greatest(
        c("effective_challenger_potential"), c("residual_search_value"), c("analytical_evidence_urgency"), c("responsiveness") * c("information_gain"), c("explore_model_in_family_potential")
    )
    run = run.withColumn("expected_search_value", F.greatest(clamp(worth * (0.75 + 0.25 * c("remaining_budget_ratio"))), clamp(c("late_breakthrough") * c("responsiveness"))))
    parts = {
        "global_stagnation": c("global_stagnation"), "global_gain": c("global_gain"), "family_coverage": c("family_coverage"), "model_coverage": c("distinct_model_coverage"),
        "empirical": c("empirical_evidence_strength"), "stability": c("incumbent_stability"), "challenger": c("effective_challenger_potential"),
        "residual": c("residual_search_value"), "model_residual": c("global_model_residual_potential"), "urgency": c("analytical_evidence_urgency"),
    }
    run = run.withColumn("search_exhaustion", search_exhaustion(parts))

    # does the family the text prefers disappoint?
    if priorities is None:
        run = run.withColumn("semantic_empirical_misalignment", F.lit(0.0))
    else:
        top = grid.filter(c("priority").isNotNull()).groupBy(RUN).agg(
            F.min_by(F.struct("family", "attempts", "family_best"), F.struct(-c("priority"), "family_no")).alias("_t")
        )
        run = run.join(top, RUN, "left")
        behind = clamp(F.greatest(F.lit(0.0), (c("_t.family_best") - c("incumbent")) / (F.abs("incumbent") + 1e-12)) / (10.0 * T))
        held = F.when(c("_t.family") == c("incumbent_family"), c("family_saturation")).otherwise(1.0)
        off = clamp(clamp((c("_t.attempts") - 1) / 3.0) * (0.60 * behind + 0.40 * held))
        run = run.withColumn("semantic_empirical_misalignment", F.when(c("_t.attempts") > 0, off).otherwise(0.0))
    return run.select(RUN, "n", *DYNAMICS)


DYNAMICS = [
    "incumbent_model", "incumbent_family", "incumbent", "current_model", "current_family", "incumbent_stability", "model_stagnation", "global_gain",
    "global_stagnation", "since", "family_saturation", "model_refinement_maturity", "incumbent_quality", "absolute_incumbent_quality", "relative_incumbent_quality",
    "family_coverage", "distinct_model_coverage", "cross_family_diversity", "empirical_evidence_strength", "semantic_empirical_misalignment",
    "current_family_attempts", "refinements", "recent_relative_improvement", "challenger_model", "challenger_gap", "challenger_maturity", "raw_challenger_potential",
    "effective_challenger_potential", "responsiveness", "information_gain", "remaining_refinement_capacity", "unresolved_evidence", "unresolved_signals",
    "resolved_signals", "analytical_evidence_urgency", "intra_family_model_coverage", "global_model_residual_potential", "strongest_residual_family",
    "family_residual_potential", "residual_search_value", "preprocessing_refinement_potential", "incumbent_dominance", "dominance_confidence",
    "evidence_supported_dominance", "search_exhaustion", "expected_search_value", "explore_model_in_family_potential", "late_breakthrough",
    "remaining_budget", "remaining_budget_ratio",
]


def control_inputs(dynamics: DataFrame, fusion: DataFrame, stops: DataFrame, plateaus: DataFrame) -> DataFrame:
    """Inputs of the control rules from the pieces above, one row per run.

    ``fusion``: run, reliability, conflict, discriminability.
    """
    rows = dynamics.join(fusion, RUN).join(stops.select(RUN, "refinement_completeness"), RUN).join(plateaus.select(RUN, "plateau_strength"), RUN)
    c = F.col
    names = {
        "reliability": c("reliability"), "conflict": c("conflict"), "discriminability": c("discriminability"),
        "empirical": empirical_strength(c("n"), c("family_coverage"), c("distinct_model_coverage"), c("cross_family_diversity"), c("incumbent_stability"), c("recent_relative_improvement")),
        "plateau": c("plateau_strength"), "completeness": c("refinement_completeness"),
        "unexplored": clamp(F.greatest(c("family_residual_potential"), c("global_model_residual_potential"))),
        "stability": c("incumbent_stability"), "stagnation": c("model_stagnation"), "global_gain": c("global_gain"), "global_stagnation": c("global_stagnation"),
        "saturation": c("family_saturation"), "maturity": c("model_refinement_maturity"), "quality": c("incumbent_quality"), "absolute_quality": c("absolute_incumbent_quality"),
        "coverage": c("family_coverage"), "misalignment": c("semantic_empirical_misalignment"), "improvement": c("recent_relative_improvement"),
        "challenger": c("effective_challenger_potential"), "challenger_maturity": c("challenger_maturity"), "responsiveness": c("responsiveness"),
        "capacity": c("remaining_refinement_capacity"), "unresolved": F.coalesce(c("unresolved_evidence"), F.lit(0.0)), "urgency": c("analytical_evidence_urgency"),
        "information": c("information_gain"), "intra_coverage": c("intra_family_model_coverage"), "residual": c("residual_search_value"),
        "model_residual": c("global_model_residual_potential"), "preprocessing": c("preprocessing_refinement_potential"), "dominance": c("incumbent_dominance"),
        "supported_dominance": c("evidence_supported_dominance"), "exhaustion": c("search_exhaustion"), "expected": c("expected_search_value"),
        "in_family_potential": c("explore_model_in_family_potential"), "breakthrough": c("late_breakthrough"), "remaining": c("remaining_budget_ratio"),
    }
    return rows.select(RUN, *[v.alias(k) for k, v in names.items()])
