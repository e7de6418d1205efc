"""Analytics over a ledger of model trials.

A trial has run_id, step (unique inside a run), model, mase (null if it failed) and a
configuration signature.  Running quantities use the block-wise forms of ``ordered``, so one run
may hold any share of the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fuzzy import clamp, relative_gain, smoothstep
from .ordered import BLOCK_ROWS, attach, by_size, running, with_position

RUN = "run_id"
THRESHOLD = 0.002
EPS = 1e-12


def usable(mase: Column) -> Column:
    return mase.isNotNull() & ~F.isnan(mase) & (F.abs(mase) != float("inf"))


def valid(trials: DataFrame) -> DataFrame:
    """Completed trials of known models with a finite score, with their family."""
    rows = trials.withColumn("family", X.model_family(F.col("model")))
    return rows.filter(usable(F.col("mase")) & ~F.col("family").isin("", "Other"))


def with_gains(trials: DataFrame, keys: str | list[str] = RUN, threshold: float = THRESHOLD, most: int = BLOCK_ROWS, before: str | None = None) -> DataFrame:
    """Add ``pos``, ``n``, ``gain`` over the best before (``before``: under that name too), ``best`` so far and trials ``since`` a meaningful gain.

    Runs of up to ``most`` trials take one shuffle, longer ones go block by block.
    """
    short, long = by_size(trials, keys, most)
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys))
    steps = w.orderBy("step")
    rows = short.withColumn("pos", (F.row_number().over(steps) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    rows = rows.filter(F.col("step").isNotNull())
    rows = rows.withColumn("_before", F.min("mase").over(steps.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("gain", _gain()).withColumn("best", F.least("_before", "mase"))
    rows = rows.withColumn("_last", F.max(_mark(threshold)).over(steps.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("since", F.col("pos") - F.col("_last"))
    rows = rows if long is None else rows.unionByName(_long_gains(long, keys, threshold))
    rows = rows.drop("_last")
    return rows.withColumnRenamed("_before", before) if before else rows.drop("_before")


def _gain() -> Column:
    return F.when(F.col("pos") == 0, 0.0).otherwise(relative_gain(F.col("_before"), F.col("mase")))


def _mark(threshold: float) -> Column:
    return F.when((F.col("pos") == 0) | (F.col("gain") >= max(threshold, EPS)), F.col("pos"))


def _long_gains(trials: DataFrame, keys: str | list[str], threshold: float) -> DataFrame:
    """``with_gains`` block by block, for runs of any length."""
    rows = with_position(trials, keys, "step")
    rows = running(rows, keys, {"_before": ("min", F.col("mase"), False)})
    rows = rows.withColumn("gain", _gain()).withColumn("best", F.least("_before", "mase"))
    rows = running(rows, keys, {"_last": ("max", _mark(threshold), True)})
    return rows.withColumn("since", F.col("pos") - F.col("_last"))


def recent_gains(gains: DataFrame, window: int = 5) -> DataFrame:
    """The last gains of every run and their sum."""
    rows = gains.filter(F.col("pos") >= F.col("n") - window)
    return rows.groupBy(RUN).agg(F.count(F.lit(1)).alias("trials"), F.sum("gain").alias("recent_gain"), F.max("gain").alias("largest_gain"))


def progress(gains: DataFrame, keys: list[str], window: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """Recent information gain and stagnation of every sequence, and trials since the last meaningful gain."""
    size = max(2, window)
    top = max(0.05, 10.0 * threshold)
    k = F.least(F.lit(size), F.col("n"))
    weight = F.when(F.col("pos") >= F.col("n") - k, F.col("pos") - (F.col("n") - k) + 1)
    start = F.col("n") - F.least(F.col("n"), F.lit(size + 1))
    s = gains.groupBy(*keys).agg(
        F.max("n").alias("n"),
        (F.sum(weight * smoothstep(F.col("gain"), threshold, top)) / F.sum(weight)).alias("_gain"),
        F.min(F.when(F.col("pos") <= start, F.col("mase"))).alias("_from"),
        F.min("mase").alias("_to"),
        F.max(F.when(F.col("pos") == F.col("n") - 1, F.col("since"))).alias("since"),
    )
    flat = 1.0 - smoothstep(relative_gain(F.col("_from"), F.col("_to")), threshold, top)
    waiting = smoothstep(F.col("since").cast("double"), max(1.0, size / 3.0), float(size + 1))
    grown = smoothstep(F.col("n").cast("double"), 1.0, float(size + 1))
    s = s.withColumn("recent_information_gain", F.when(F.col("n") < 2, 1.0).otherwise(clamp(F.col("_gain"))))
    stale = clamp(grown * (0.55 * waiting + 0.25 * (1.0 - F.col("recent_information_gain")) + 0.20 * flat))
    return s.withColumn("stagnation", F.when(F.col("n") < 2, 0.0).otherwise(stale)).drop("_gain", "_from", "_to")


def plateau(gains: DataFrame, patience: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Plateau strength: time since a meaningful gain times the lack of gain over the patience window."""
    cut_at = F.col("n") - F.least(F.lit(patience), F.col("n") - 1)
    s = gains.groupBy(RUN).agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("pos") < cut_at, F.col("mase"))).alias("_previous"),
        F.min("mase").alias("_best"),
        F.max(F.when(F.col("pos") == F.col("n") - 1, F.col("since"))).alias("since"),
    )
    gained = relative_gain(F.col("_previous"), F.col("_best"))
    strength = clamp(F.least(F.lit(1.0), F.col("since") / float(patience)) * (1.0 - F.least(F.lit(1.0), gained / max(threshold, EPS))))
    s = s.withColumn("window_gain", F.when(F.col("n") >= 2, gained))
    s = s.withColumn("plateau_strength", F.when(F.col("n") >= 2, strength).otherwise(0.0))
    return s.select(RUN, "n", "since", "window_gain", "plateau_strength", (F.col("plateau_strength") >= 0.8).alias("plateau"))


def last_model(trials: DataFrame) -> DataFrame:
    return trials.groupBy(RUN).agg(F.max_by("model", "step").alias("current_model"))


def tail_refinements(trials: DataFrame) -> DataFrame:
    """How many trials at the end of a run refine the model tried last.

    The tail starts after the last trial of another model; its first trial counts only if the model
    was tried before.
    """
    per_model = trials.groupBy(RUN, "model").agg(F.min("step").alias("_first"), F.max("step").alias("_to"))
    now = F.max_by(F.struct("model", "_first"), "_to")
    s = per_model.groupBy(RUN).agg(now.alias("_now")).select(RUN, F.col("_now.model").alias("current_model"), "_now._first")
    others = per_model.join(s.select(RUN, "current_model"), RUN).filter(F.col("model") != F.col("current_model"))
    s = s.join(others.groupBy(RUN).agg(F.max("_to").alias("_other")), RUN, "left")
    # behind the last trial of another model there are only trials of this one
    tail = attach(trials.select(RUN, "step"), s, RUN, "step").filter(F.col("_other").isNull() | (F.col("step") > F.col("_other")))
    return tail.groupBy(RUN, "current_model").agg(F.sum((F.col("step") > F.col("_first")).cast("bigint")).alias("consecutive_refinements"))


def model_summary(trials: DataFrame) -> DataFrame:
    """Per run and model: trials, failures, best score, first step, raw and log coverage."""
    ok = usable(F.col("mase"))
    return trials.withColumn("family", X.model_family(F.col("model"))).groupBy(RUN, "model", "family").agg(
        F.sum(ok.cast("bigint")).alias("trials"),
        F.sum((~ok).cast("bigint")).alias("failures"),
        F.min(F.when(ok, F.col("mase"))).alias("best"),
        F.min("step").alias("first_step"),
        F.bool_or(~F.col("uses_log")).alias("raw_evaluated"),
        F.bool_or(F.col("uses_log")).alias("log_evaluated"),
    )


def families_explored(trials: DataFrame) -> DataFrame:
    """Families of each run in first-seen order."""
    first = trials.withColumn("family", X.model_family(F.col("model"))).groupBy(RUN, "family").agg(F.min("step").alias("first_step"))
    # as many rows per run as there are families
    return first.withColumn("explored_no", F.row_number().over(Window.partitionBy(RUN).orderBy("first_step")).cast("bigint"))


def winner_rows(trials: DataFrame, winners: DataFrame) -> DataFrame:
    """The ledger row of each winner, by training id where the winner names one, else by signature (first match)."""
    by_id = winners.join(trials.select(RUN, "training_id", F.col("step").alias("_by_id")), [RUN, "training_id"], "left")
    sig = trials.join(winners.select(RUN, "signature"), [RUN, "signature"], "left_semi").groupBy(RUN, "signature").agg(F.min("step").alias("_by_sig"))
    found = by_id.join(sig, [RUN, "signature"], "left").withColumn("step", F.coalesce("_by_id", "_by_sig"))
    return found.select(RUN, "step").join(trials, [RUN, "step"], "left")


def novel(candidates: DataFrame, *ledgers: DataFrame) -> DataFrame:
    """Candidates whose signature was never completed, failed or rejected in the same run."""
    seen = ledgers[0].select(RUN, "signature")
    for other in ledgers[1:]:
        seen = seen.unionByName(other.select(RUN, "signature"))
    return candidates.join(seen.distinct(), [RUN, "signature"], "left_anti")


def budget(trials: DataFrame, maximum: int = 30, minimum: int = 5) -> DataFrame:
    """Valid trainings, failures by class and what is left of the budget."""
    ok = usable(F.col("mase"))
    count = lambda c: F.sum(c.cast("bigint"))
    s = trials.groupBy(RUN).agg(
        count(ok).alias("valid_trainings"),
        *[F.coalesce(count(F.col("error_type") == e), F.lit(0)).cast("bigint").alias(e) for e in ERROR_TYPES],
    )
    return s.withColumn("remaining", F.greatest(F.lit(0), maximum - F.col("valid_trainings"))).withColumn(
        "minimum_reached", F.col("valid_trainings") >= minimum
    )


# fixed values: outcome classes of a candidate
ERROR_TYPES = ["invalid_configuration", "duplicate_candidate", "execution_failure", "finite_underperformance"]


def terminal_status(error: Column) -> Column:
    return (
        F.when(error == "duplicate_candidate", "duplicate")
        .when(error == "invalid_configuration", "rejected")
        .when(error == "execution_failure", "failed")
        .otherwise("completed")
    )


def commit(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Ledger with every candidate exactly once: what it holds already wins, then the earliest record."""
    both = ledger.withColumn("_new", F.lit(0)).unionByName(records.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("_new", "candidate_id")]
    kept = both.groupBy("candidate_id").agg(F.min_by(F.struct(*cols), F.struct("_new", "step")).alias("_r"))
    return kept.select("candidate_id", "_r.*").withColumn("status", terminal_status(F.col("error_type")))


def failures(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("error_type") == "execution_failure")


def successes(ledger: DataFrame, goal: float = 0.85) -> DataFrame:
    return ledger.filter((F.col("status") == "completed") & (F.col("mase") <= goal))


def failed_combinations(trials: DataFrame) -> DataFrame:
    """Distinct failed configurations: how often, first and last step, distinct reasons."""
    reasons = trials.groupBy(RUN, "signature", "reason").agg(F.count(F.lit(1)).alias("_c"), F.min("step").alias("_a"), F.max("step").alias("_b"))
    return reasons.groupBy(RUN, "signature").agg(
        F.sum("_c").alias("occurrences"), F.min("_a").alias("first_step"), F.max("_b").alias("last_step"),
        F.array_join(F.sort_array(F.collect_list("reason")), ",").alias("reasons"),
    )


# fixed values: search cost of a family and the policy weights
FAMILY_COST = {"Statistical": 0.30, "Additive": 0.35, "Tree-based": 0.45, "Classical ML": 0.25, "Neural": 0.75, "Transformer/Foundation": 1.00}
EXPLORATION, GUIDANCE, COST, FAILURE = 0.12, 0.10, 0.06, 0.16


def rank_candidates(summary: DataFrame, runs: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Score of every available model of every run: empirical + exploration + guidance - cost - failures.

    ``summary``: ``model_summary``; ``runs``: run, guidance_weight and one priority per family as
    a map.  As many rows per run as there are models.
    """
    names = models or list(X.MODEL_FAMILY)
    catalog = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("model_no"), F.lit(X.MODEL_FAMILY[m]).alias("family")) for i, m in enumerate(names)])
    grid = runs.select(RUN, "guidance_weight", "priorities", F.explode(catalog).alias("c")).select(RUN, "guidance_weight", "priorities", "c.*")
    rows = grid.join(summary.select(RUN, "model", "trials", "failures", "best"), [RUN, "model"], "left").fillna({"trials": 0, "failures": 0})
    per_run = Window.partitionBy(RUN)
    rows = rows.withColumn("priority", F.coalesce(F.try_element_at("priorities", F.col("family")), F.lit(0.5)))
    rows = rows.withColumn("_low", F.min("best").over(per_run)).withColumn("_high", F.max("best").over(per_run))
    rows = rows.withColumn("_mean", F.avg("priority").over(per_run))
    flat = F.col("best").isNull() | (F.col("_high") <= F.col("_low"))
    empirical = clamp(F.when(flat, 0.5).otherwise(1.0 - (F.col("best") - F.col("_low")) / (F.col("_high") - F.col("_low"))))
    centred = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * (F.col("priority") - F.col("_mean"))))
    guidance = F.when(F.col("trials") == 0, F.greatest(F.lit(0.0), centred) * F.col("guidance_weight") * GUIDANCE).otherwise(0.0)
    cost = F.lit(0.0)
    for family, value in FAMILY_COST.items():
        cost = F.when(F.col("family") == family, COST * value).otherwise(cost)
    failure = FAILURE * F.col("failures") / F.greatest(F.lit(1), F.col("failures") + F.col("trials"))
    score = empirical + EXPLORATION / F.sqrt(1.0 + F.col("trials")) + guidance - cost - failure
    order = Window.partitionBy(RUN).orderBy(F.desc(F.round("score", 12)), "model_no")
    return rows.withColumn("score", score).select(
        RUN, "model", "family", "trials", empirical.alias("empirical"), "score", F.row_number().over(order).cast("bigint").alias("rank")
    )


def family_target(breadth: Column, available: Column | int) -> Column:
    """How many families a search of this breadth should cover."""
    count = available if isinstance(available, Column) else F.lit(available)
    b = clamp(breadth)
    target = F.when(b < 0.30, 1).when(b < 0.60, 2).when(b < 0.80, 4).otherwise(count)
    return F.least(count, target).cast("bigint")


def available_models(trials: DataFrame, disabled: DataFrame, exhausted: DataFrame, failure_limit: int = 3) -> DataFrame:
    """Models each run may still try: enabled, not failed too often, not exhausted."""
    runs = trials.select(RUN).distinct()
    every = runs.select(RUN, F.explode(F.array(*[F.lit(m) for m in X.MODEL_FAMILY])).alias("model"))
    failed = model_summary(trials).filter((F.col("failures") >= failure_limit) & (F.col("trials") == 0)).select(RUN, "model")
    out = every.join(disabled.select("model"), "model", "left_anti").join(failed, [RUN, "model"], "left_anti")
    return out.join(exhausted.select(RUN, "model"), [RUN, "model"], "left_anti").select(RUN, "model")


def grid_exhaustion(attempts: DataFrame, grids: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Per run and model with a finite grid: allowed combinations, attempted ones, exhausted or not.

    ``attempts``: run, model, hyperparameters as map<string,string>.  Only the count of a grid is
    needed, so its combinations are never spelled out.
    """
    inside, total = F.lit(False), F.lit(None).cast("bigint")
    for model, grid in grids.items():
        hit = F.col("model") == model
        size = 1
        ok = F.size("hyperparameters") == len(grid)
        for key, values in grid.items():
            size *= len(values)
            ok = ok & F.coalesce(F.try_element_at("hyperparameters", F.lit(key)).isin(values), F.lit(False))
        inside = F.when(hit, ok).otherwise(inside)
        total = F.when(hit, size).otherwise(total)
    rows = attempts.filter(F.col("model").isin(list(grids))).withColumn("_ok", inside).withColumn("total", total.cast("bigint"))
    form = F.array_join(F.array_sort(F.transform(F.map_entries("hyperparameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    distinct = rows.filter("_ok").select(RUN, "model", form.alias("_f")).distinct()
    counts = distinct.groupBy(RUN, "model").agg(F.count(F.lit(1)).alias("attempted"))
    every = rows.select(RUN, "model", "total").distinct()
    out = every.join(counts, [RUN, "model"], "left").fillna({"attempted": 0})
    return out.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("attempted"))).withColumn(
        "exhausted", F.col("attempted") >= F.col("total")
    )


def log_coverage(trials: DataFrame) -> DataFrame:
    """Raw and log trials per run, and what is still to be tried."""
    s = trials.groupBy(RUN).agg(
        F.sum((~F.col("uses_log")).cast("bigint")).alias("raw_trials"), F.sum(F.col("uses_log").cast("bigint")).alias("log_trials")
    )
    return s.withColumn("raw_pending", F.col("raw_trials") == 0).withColumn("log_pending", F.col("log_trials") == 0)


def _best_by_groups(trials: DataFrame) -> DataFrame:
    """Of every run its valid trainings, its best model and what was tried of it, for runs of any length."""
    # forms of a model, models of a run: groups of groups, so that trials meet their run's best model without a join
    raw, log = F.bool_or(~F.col("uses_log")).alias("_r"), F.bool_or("uses_log").alias("_l")
    first = F.min(F.struct("mase", "step")).alias("_k")
    forms = trials.groupBy(RUN, "model", "hyperparameters").agg(F.count(F.lit(1)).alias("_c"), log, raw, first)
    models = forms.groupBy(RUN, "model").agg(
        F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_f"), F.bool_or("_l").alias("_l"), F.bool_or("_r").alias("_r"), F.min("_k").alias("_k")
    )
    best = models.groupBy(RUN).agg(
        F.sum("_c").alias("valid_trainings"), F.bool_or("_r").alias("any_raw"), F.min_by(F.struct("model", "_c", "_f", "_l", "_r"), "_k").alias("_b")
    )
    return best.select(
        RUN, "valid_trainings", "any_raw", F.col("_b.model").alias("best_model"), F.col("_b._c").alias("best_trials"),
        F.col("_b._f").alias("distinct_hyperparameters"), F.col("_b._l").alias("log_evaluated"), F.col("_b._r").alias("raw_evaluated"),
    )


def _best_of_short(trials: DataFrame) -> DataFrame:
    """``_best_by_groups`` in one shuffle: a run is sorted once, its best model stands first."""
    own = F.col("model").eqNullSafe(F.col("best_model"))
    rows = trials.select(RUN, "mase", "step", "model", "hyperparameters", "uses_log")
    ordered = Window.partitionBy(RUN).orderBy("mase", "step").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("best_model", F.first("model").over(ordered))
    forms = rows.groupBy(RUN, "best_model", "hyperparameters").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(own.cast("bigint")).alias("_o"), F.bool_or(~F.col("uses_log")).alias("_a"),
        F.bool_or(F.when(own, F.col("uses_log"))).alias("_l"), F.bool_or(F.when(own, ~F.col("uses_log"))).alias("_r"),
    )
    return forms.groupBy(RUN, "best_model").agg(
        F.sum("_c").alias("valid_trainings"), F.bool_or("_a").alias("any_raw"), F.sum("_o").alias("best_trials"),
        F.sum((F.col("_o") > 0).cast("bigint")).alias("distinct_hyperparameters"), F.bool_or("_l").alias("log_evaluated"), F.bool_or("_r").alias("raw_evaluated"),
    )


def stop_eligibility(
    trials: DataFrame, settings: DataFrame, *, maximum: int = 30, minimum: int = 5, max_refinements: int = 4, counted: DataFrame | None = None, most: int = BLOCK_ROWS
) -> DataFrame:
    """May a run stop, and if not, why.

    ``trials`` are valid ones with uses_log and hyperparameters (text); ``settings``: run,
    log_recommended, log_supported.  ``counted``: a table with at least as many rows of each run,
    cheap to count; with it, runs of up to ``most`` rows take one shuffle.
    """
    if counted is None:
        best = _best_by_groups(trials)
    else:
        short, long = by_size(trials, RUN, most, counted)
        best = _best_of_short(short)
        best = best if long is None else best.unionByName(_best_by_groups(long))
    s = settings.join(best, RUN, "left").fillna(
        {"valid_trainings": 0, "best_trials": 0, "distinct_hyperparameters": 0, "log_evaluated": False, "raw_evaluated": False, "any_raw": False}
    )
    some = F.col("best_model").isNotNull()
    wants_log = F.col("log_recommended") & F.col("log_supported")
    refined = ~some | F.lit(max_refinements <= 1) | (F.col("best_trials") >= max_refinements) | (F.col("distinct_hyperparameters") >= 2)
    hard = F.col("valid_trainings") >= maximum
    enough = F.col("valid_trainings") >= minimum
    no_raw = some & ~F.col("any_raw")
    no_log = some & wants_log & ~(F.col("raw_evaluated") & F.col("log_evaluated"))
    unrefined = some & enough & F.lit(max_refinements > 1) & ~refined
    blockers = F.array_compact(
        F.array(
            F.when(~enough, "minimum_valid_trainings_not_reached"),
            F.when(no_raw, "required_raw_candidate_pending"),
            F.when(no_log, "required_log_refinement_pending"),
            F.when(unrefined, "current_best_refinement_incomplete"),
        )
    )
    treated = F.when(wants_log, (F.col("raw_evaluated").cast("int") + F.col("log_evaluated").cast("int")) / 2.0).otherwise(1.0)
    complete = F.when(some, (refined.cast("double") + treated) / 2.0).otherwise(0.0)
    return s.select(
        RUN, "valid_trainings", "best_model", "best_trials", "distinct_hyperparameters",
        (hard | (enough & ~no_raw & ~no_log & ~unrefined)).alias("eligible"),
        hard.alias("hard_stop"),
        F.when(hard, "").otherwise(F.array_join(blockers, ",")).alias("blockers"),
        complete.alias("refinement_completeness"),
    )


def arbitration(strengths: DataFrame) -> DataFrame:
    """Raw and effective choice of action (refine before explore before stop on ties) and why they differ.

    ``strengths``: run, explore, refine, stop, stop_eligible, hard_stop; stopping has no effective
    strength while it is not allowed, and is forced by a hard stop.
    """
    ties = {"explore": 2, "refine": 3, "stop": 1}

    def choose(cols: dict[str, Column]) -> Column:
        ranked = F.array(*[F.struct(cols[a].alias("s"), F.lit(t).alias("t"), F.lit(a).alias("a")) for a, t in ties.items()])
        return F.array_max(ranked)["a"]

    raw = choose({a: F.col(a) for a in ties})
    effective = choose({"explore": F.col("explore"), "refine": F.col("refine"), "stop": F.when(F.col("stop_eligible"), F.col("stop")).otherwise(0.0)})
    out = strengths.withColumn("raw_action", raw).withColumn("effective_action", effective)
    out = out.withColumn("executed_action", F.when(F.col("hard_stop"), "stop").otherwise(F.col("effective_action")))
    changed = F.col("executed_action") != F.col("raw_action")
    reason = F.when(changed & F.col("hard_stop"), "hard_budget_stop").when(changed & ~F.col("stop_eligible"), "stop_not_eligible").when(changed, "effective_strength")
    return out.withColumn("override", changed).withColumn("override_reason", reason)
