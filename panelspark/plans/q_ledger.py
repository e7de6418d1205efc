"""Analytics over a ledger of trials: one run per supplier, one trial per line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dynamics as Y
from ..operators import fusion as N
from ..operators import ledger as L
from ..operators import metrics as V
from ..operators.ordered import numbered
from .panels import table, with_sql
from .q_fusion import unit
from .q_panel import rounded
from .registry import query

RUN = "run_id"
MODELS = list(X.MODEL_FAMILY)


def trials(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", RUN)
    rows = numbered(li, RUN, "l_orderkey", ties=["l_linenumber", "l_partkey", "l_extendedprice"], n=None)
    pct = lambda c: F.round(F.col(c) * 100).cast("bigint")
    mase = (50 + 5 * pct("l_discount") + pct("l_tax") + F.col("l_partkey") % 7) / F.lit(100.0)
    value = F.col("l_quantity").cast("bigint")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return rows.select(
        RUN,
        F.col("l_orderkey").alias("order_id"),
        (F.col("pos") + 1).alias("step"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("l_partkey") % 24 + 1).cast("int")).alias("model"),
        F.when(value > 1, mase).alias("mase"),
        (flag == "A").alias("uses_log"),
        value.cast("string").alias("hyperparameters"),
        F.concat_ws("|", F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("l_partkey") % 24 + 1).cast("int")), value.cast("string"), flag).alias("signature"),
        F.when(value == 1, "execution_failure").when(value == 50, "duplicate_candidate").when(value == 49, "invalid_configuration").when(mase > 1, "finite_underperformance").alias("error_type"),
        F.when(F.col("l_linestatus") == "F", "add").alias("seasonal"),
        (line == 1).alias("yearly"),
        (line % 2).alias("difference_order"),
        F.array(F.when(flag == "A", "log_transform").when(flag == "R", "lag_features").otherwise("calendar_features")).alias("steps"),
        F.array(F.lit(1), line).alias("lags"),
        F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))).alias("training_id"),
    )


TRIALS = f"""trials AS (SELECT l_suppkey AS run_id, l_orderkey AS order_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS step,
  {MODELS}[l_partkey % 24 + 1] AS model, CASE WHEN l_quantity > 1 THEN (50 + 5 * CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT) + l_partkey % 7) / 100e0 END AS mase,
  l_returnflag = 'A' AS uses_log, CAST(l_quantity AS BIGINT)::VARCHAR AS hyperparameters, {MODELS}[l_partkey % 24 + 1] || '|' || CAST(l_quantity AS BIGINT) || '|' || l_returnflag AS signature,
  CASE WHEN l_quantity = 1 THEN 'execution_failure' WHEN l_quantity = 50 THEN 'duplicate_candidate' WHEN l_quantity = 49 THEN 'invalid_configuration'
    WHEN (50 + 5 * CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT) + l_partkey % 7) / 100e0 > 1 THEN 'finite_underperformance' END AS error_type,
  l_linestatus, l_linenumber, l_returnflag, md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || CAST(round(l_extendedprice * 100) AS BIGINT)) AS training_id FROM lineitem),
fam AS (SELECT unnest({MODELS}) AS model, unnest({[X.MODEL_FAMILY[m] for m in MODELS]}) AS family),
ok AS (SELECT t.*, family, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM trials t JOIN fam USING (model) WHERE mase IS NOT NULL)"""
GAINS = """bf AS (SELECT *, min(mase) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
gn AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE greatest(0, (before - mase) / (abs(before) + 1e-12)) END AS gain, least(coalesce(before, mase), mase) AS best FROM bf),
gs AS (SELECT *, pos - max(CASE WHEN pos = 0 OR gain >= 2e-3 THEN pos END) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS since FROM gn)"""


def smooth(x, lo, hi):
    t = f"greatest(0e0, least(1e0, (({x}) - {lo}) / ({hi} - {lo})))"
    return f"({t} * {t} * (3 - 2 * {t}))"


def rel(before, now):
    return f"greatest(0e0, ({before} - {now}) / (abs({before}) + 1e-12))"


def _gains(spark, sf):
    return L.with_gains(L.valid(trials(spark, sf)))


@query(
    "best_so_far",
    with_sql(TRIALS, GAINS, tail="SELECT run_id, step, best, round(gain, 6) AS gain, since FROM gs"),
)
def best_so_far(spark, sf):
    return rounded(_gains(spark, sf).select(RUN, "step", "best", "gain", "since"), ["gain"])


@query(
    "recent_gains",
    with_sql(TRIALS, GAINS, tail="SELECT run_id, count(*) AS trials, round(sum(gain), 6) AS recent_gain, round(max(gain), 6) AS largest_gain FROM gs WHERE pos >= n - 5 GROUP BY 1"),
)
def recent_gains(spark, sf):
    return rounded(L.recent_gains(_gains(spark, sf)), ["recent_gain", "largest_gain"])


PROGRESS = f"""pg AS (SELECT run_id, max(n) AS n, sum((pos - (n - least(3, n)) + 1) * {smooth('gain', '2e-3', '5e-2')}) FILTER (pos >= n - least(3, n)) / sum(pos - (n - least(3, n)) + 1) FILTER (pos >= n - least(3, n)) AS g,
  min(mase) FILTER (pos <= n - least(n, 4)) AS fr, min(mase) AS tb, max(since) FILTER (pos = n - 1) AS since FROM gs GROUP BY 1),
pr AS (SELECT *, CASE WHEN n < 2 THEN 1 ELSE greatest(0, least(1, g)) END AS gg FROM pg),
ps AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE greatest(0, least(1, {smooth('n', '1e0', '4e0')} * (55e-2 * {smooth('since', '1e0', '4e0')} + 25e-2 * (1 - gg) + 2e-1 * (1 - {smooth(rel('fr', 'tb'), '2e-3', '5e-2')})))) END AS st FROM pr)"""


@query(
    "search_progress",
    with_sql(TRIALS, GAINS, PROGRESS, tail="SELECT run_id, n, since, round(gg, 6) AS recent_information_gain, round(st, 6) AS stagnation FROM ps"),
)
def search_progress(spark, sf):
    out = L.progress(_gains(spark, sf), [RUN])
    return rounded(out.select(RUN, "n", "since", "recent_information_gain", "stagnation"), ["recent_information_gain", "stagnation"])


PLATEAU = f"""pl AS (SELECT run_id, max(n) AS n, min(mase) FILTER (pos < n - least(5, n - 1)) AS pb, min(mase) AS cb, max(since) FILTER (pos = n - 1) AS since FROM gs GROUP BY 1),
pt AS (SELECT *, {rel('pb', 'cb')} AS wg, greatest(0e0, least(1e0, least(1, since / 5e0) * (1 - least(1, {rel('pb', 'cb')} / 2e-3)))) AS ps FROM pl)"""


@query(
    "plateau_strength",
    with_sql(TRIALS, GAINS, PLATEAU, tail="SELECT run_id, n, since, CASE WHEN n >= 2 THEN round(wg, 6) END AS window_gain, CASE WHEN n >= 2 THEN round(ps, 6) ELSE 0 END AS plateau_strength, n >= 2 AND ps >= 8e-1 AS plateau FROM pt"),
)
def plateau_strength(spark, sf):
    return rounded(L.plateau(_gains(spark, sf)), ["window_gain", "plateau_strength"])


LASTM = "lm AS (SELECT run_id, arg_max(model, step) AS current_model FROM ok GROUP BY 1)"


@query(
    "tail_refinements",
    with_sql(TRIALS, LASTM, "sm AS (SELECT ok.run_id, step, model = current_model AS same, current_model FROM ok JOIN lm USING (run_id)),"
             "lim AS (SELECT run_id, max(step) FILTER (NOT same) AS other, min(step) FILTER (same) AS first FROM sm GROUP BY 1)",
             tail="SELECT run_id, current_model, count(*) FILTER (step > first) AS consecutive_refinements FROM sm JOIN lim USING (run_id) WHERE other IS NULL OR step > other GROUP BY 1, 2"),
)
def tail_refinements(spark, sf):
    return L.tail_refinements(L.valid(trials(spark, sf)))


@query(
    "validation_winner",
    with_sql(TRIALS, tail="SELECT run_id, arg_min(step, (mase, step)) AS best_step, arg_min(model, (mase, step)) AS best_model, min(mase) AS best_mase FROM trials WHERE mase IS NOT NULL GROUP BY 1"),
)
def validation_winner(spark, sf):
    return V.winner(trials(spark, sf))


@query(
    "training_budget",
    with_sql(TRIALS, tail="""SELECT run_id, count(mase) AS valid_trainings, count(*) FILTER (error_type = 'invalid_configuration') AS invalid_configuration, count(*) FILTER (error_type = 'duplicate_candidate') AS duplicate_candidate,
      count(*) FILTER (error_type = 'execution_failure') AS execution_failure, count(*) FILTER (error_type = 'finite_underperformance') AS finite_underperformance,
      greatest(0, 30 - count(mase)) AS remaining, count(mase) >= 5 AS minimum_reached FROM trials GROUP BY 1"""),
)
def training_budget(spark, sf):
    return L.budget(trials(spark, sf))


SUMMARY = """ms AS (SELECT run_id, model, family, count(mase) AS trials, count(*) - count(mase) AS failures, min(mase) AS best, min(step) AS first_step, bool_or(NOT uses_log) AS raw_evaluated, bool_or(uses_log) AS log_evaluated
  FROM trials JOIN fam USING (model) GROUP BY 1, 2, 3)"""


@query("model_families", with_sql(TRIALS, SUMMARY, tail="SELECT * FROM ms"))
def model_families(spark, sf):
    return L.model_summary(trials(spark, sf))


@query(
    "families_explored",
    with_sql(TRIALS, tail="SELECT run_id, family, min(step) AS first_step, row_number() OVER (PARTITION BY run_id ORDER BY min(step)) AS explored_no FROM trials JOIN fam USING (model) GROUP BY 1, 2"),
)
def families_explored(spark, sf):
    return L.families_explored(trials(spark, sf))


@query(
    "raw_log_coverage",
    with_sql(TRIALS, tail="SELECT run_id, count(*) FILTER (NOT uses_log) AS raw_trials, count(*) FILTER (uses_log) AS log_trials, count(*) FILTER (NOT uses_log) = 0 AS raw_pending, count(*) FILTER (uses_log) = 0 AS log_pending FROM trials GROUP BY 1"),
)
def raw_log_coverage(spark, sf):
    return L.log_coverage(trials(spark, sf))


@query(
    "winner_ledger_rows",
    with_sql(TRIALS, """w AS (SELECT run_id, arg_min(signature, (mase, step)) AS signature, CASE WHEN run_id % 2 = 0 THEN arg_min(training_id, (mase, step)) ELSE 'none' END AS training_id FROM trials WHERE mase IS NOT NULL GROUP BY 1)""",
             tail="""SELECT w.run_id, coalesce(min(t.step) FILTER (t.training_id = w.training_id), min(t.step) FILTER (t.signature = w.signature)) AS step, w.signature FROM w JOIN trials t USING (run_id) GROUP BY w.run_id, w.signature"""),
)
def winner_ledger_rows(spark, sf):
    rows = trials(spark, sf)
    best = rows.filter(L.usable(F.col("mase"))).groupBy(RUN).agg(F.min_by(F.struct("signature", "training_id"), F.struct("mase", "step")).alias("w"))
    winners = best.select(RUN, "w.signature", F.when(F.col(RUN) % 2 == 0, F.col("w.training_id")).otherwise("none").alias("training_id"))
    return L.winner_rows(rows, winners).select(RUN, "step", "signature")


@query(
    "novel_candidates",
    with_sql(TRIALS, "old AS (SELECT DISTINCT run_id, signature FROM trials WHERE step <= 300), c AS (SELECT * FROM trials WHERE step > 300)",
             tail="SELECT run_id, count(*) AS novel, min(step) AS first_novel FROM c WHERE (run_id, signature) NOT IN (SELECT (run_id, signature) FROM old) GROUP BY 1"),
)
def novel_candidates(spark, sf):
    rows = trials(spark, sf)
    done, asked = rows.filter("step <= 300"), rows.filter("step > 300")
    out = L.novel(asked, done.filter(F.col("error_type").isNull()), done.filter(F.col("error_type").isNotNull()))
    return out.groupBy(RUN).agg(F.count(F.lit(1)).alias("novel"), F.min("step").alias("first_novel"))


@query(
    "available_models",
    with_sql(TRIALS, SUMMARY, tail="""SELECT r.run_id, f.model FROM (SELECT DISTINCT run_id FROM trials) r CROSS JOIN fam f LEFT JOIN ms ON ms.run_id = r.run_id AND ms.model = f.model
      WHERE f.model NOT IN ('Chronos', 'SVR') AND NOT coalesce(failures >= 3 AND trials = 0, false) AND NOT coalesce(trials >= 30, false)"""),
)
def available_models(spark, sf):
    rows = trials(spark, sf)
    disabled = table(spark, sf, "region").select(F.explode(F.array(F.lit("Chronos"), F.lit("SVR"))).alias("model")).distinct()
    exhausted = L.model_summary(rows).filter("trials >= 30").select(RUN, "model")
    return L.available_models(rows, disabled, exhausted)


GRIDS = {"KNN": {"n_neighbors": ["3", "5", "10"], "weights": ["uniform", "distance"]}, "ETS": {"seasonal_periods": ["4", "14", "12"], "trend": ["add", "mul"]}, "Chronos": {"model_size": ["tiny", "mini", "small"]}}


@query(
    "grid_exhaustion",
    with_sql(TRIALS, """a AS (SELECT run_id, model, CASE model WHEN 'KNN' THEN [['3', '5', '10', '7'][step % 4 + 1], ['uniform', 'distance'][l_linenumber % 2 + 1]] WHEN 'ETS' THEN [['4', '14', '12', '9'][step % 4 + 1], ['add', 'mul'][l_linenumber % 2 + 1]]
        WHEN 'Chronos' THEN [['tiny', 'mini', 'small', 'base'][step % 4 + 1]] END AS v FROM trials WHERE model IN ('KNN', 'ETS', 'Chronos'))""",
             tail="""SELECT run_id, model, CASE model WHEN 'Chronos' THEN 3 ELSE 6 END::BIGINT AS total, count(DISTINCT v) FILTER (v[1] NOT IN ('7', '9', 'base')) AS attempted,
        CASE model WHEN 'Chronos' THEN 3 ELSE 6 END - count(DISTINCT v) FILTER (v[1] NOT IN ('7', '9', 'base')) AS remaining, count(DISTINCT v) FILTER (v[1] NOT IN ('7', '9', 'base')) >= CASE model WHEN 'Chronos' THEN 3 ELSE 6 END AS exhausted FROM a GROUP BY 1, 2"""),
)
def grid_exhaustion(spark, sf):
    def pick(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    rows = trials(spark, sf)
    line = F.element_at("lags", 2)
    hp = (
        F.when(F.col("model") == "KNN", F.create_map(F.lit("n_neighbors"), pick(["3", "5", "10", "7"], F.col("step")), F.lit("weights"), pick(["uniform", "distance"], line)))
        .when(F.col("model") == "ETS", F.create_map(F.lit("seasonal_periods"), pick(["4", "14", "12", "9"], F.col("step")), F.lit("trend"), pick(["add", "mul"], line)))
        .otherwise(F.create_map(F.lit("model_size"), pick(["tiny", "mini", "small", "base"], F.col("step"))))
    )
    return L.grid_exhaustion(rows.select(RUN, "model", hp.alias("hyperparameters")), GRIDS)


@query(
    "failed_combinations",
    with_sql(TRIALS, tail="""SELECT run_id, signature, sum(c)::BIGINT AS occurrences, min(a) AS first_step, max(b) AS last_step, string_agg(error_type, ',' ORDER BY error_type) AS reasons FROM
      (SELECT run_id, signature, error_type, count(*) AS c, min(step) AS a, max(step) AS b FROM trials WHERE error_type IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
)
def failed_combinations(spark, sf):
    rows = trials(spark, sf).filter(F.col("error_type").isNotNull()).withColumn("reason", F.col("error_type"))
    return L.failed_combinations(rows)


COMMIT = """rec AS (SELECT md5(run_id || '#' || signature) AS candidate_id, * FROM trials), cm AS (SELECT candidate_id, arg_min(step, (step > 300, step)) AS step, any_value(run_id) AS run_id,
  arg_min(coalesce(error_type, ''), (step > 300, step)) AS e, arg_min(coalesce(mase, -1), (step > 300, step)) AS m FROM rec GROUP BY 1),
st AS (SELECT *, CASE e WHEN 'duplicate_candidate' THEN 'duplicate' WHEN 'invalid_configuration' THEN 'rejected' WHEN 'execution_failure' THEN 'failed' ELSE 'completed' END AS status FROM cm)"""


def _committed(spark, sf):
    rows = trials(spark, sf).select(F.md5(F.concat(F.col(RUN).cast("string"), F.lit("#"), "signature")).alias("candidate_id"), RUN, "step", "mase", "error_type")
    # what was committed before is the first 300 steps, deduplicated the same way
    old = rows.filter("step <= 300").groupBy("candidate_id").agg(F.min_by(F.struct(RUN, "step", "mase", "error_type"), "step").alias("r")).select("candidate_id", "r.*")
    return L.commit(old, rows.filter("step > 300"))


@query("ledger_commit", with_sql(TRIALS, COMMIT, tail="SELECT run_id, status, count(*) AS candidates, min(step) AS first_step, max(step) AS last_step FROM st GROUP BY 1, 2"))
def ledger_commit(spark, sf):
    return _committed(spark, sf).groupBy(RUN, "status").agg(F.count(F.lit(1)).alias("candidates"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query(
    "ledger_outcomes",
    with_sql(TRIALS, COMMIT, tail="SELECT run_id, count(*) FILTER (status = 'completed' AND m >= 0 AND m <= 85e-2) AS successes, count(*) FILTER (e = 'execution_failure') AS failures FROM st GROUP BY 1"),
)
def ledger_outcomes(spark, sf):
    both = _committed(spark, sf)
    good = L.successes(both).groupBy(RUN).agg(F.count(F.lit(1)).alias("successes"))
    bad = L.failures(both).groupBy(RUN).agg(F.count(F.lit(1)).alias("failures"))
    return both.select(RUN).distinct().join(good, RUN, "left").join(bad, RUN, "left").fillna(0)


# ------------------------------------------------------------------ ranking


def _priorities(spark, sf):
    """Per run a priority of each family, from its line items."""
    li = table(spark, sf, "lineitem")
    shares = [F.avg(((F.col("l_orderkey") + i) % 6 < 3).cast("double")) for i in range(6)]
    named = [x for f, s in zip(X.FAMILIES, shares) for x in (F.lit(f), s)]
    return li.groupBy(F.col("l_suppkey").alias(RUN)).agg(F.create_map(*named).alias("priorities"), F.avg((F.col("l_linenumber") > 3).cast("double")).alias("guidance_weight"))


PRIO = "pr AS (SELECT l_suppkey AS run_id, avg((l_linenumber > 3)::INT) AS gw, " + ", ".join(f"avg(((l_orderkey + {i}) % 6 < 3)::INT) AS p{i}" for i in range(6)) + " FROM lineitem GROUP BY 1)"
COSTS = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in L.FAMILY_COST.items()) + "}"


@query(
    "candidate_ranking",
    with_sql(TRIALS, SUMMARY, PRIO, f"""fx AS (SELECT unnest({MODELS}) AS model, unnest(range(24)) AS model_no, unnest({[X.MODEL_FAMILY[m] for m in MODELS]}) AS family),
      g AS (SELECT pr.run_id, gw, fx.model, model_no, fx.family, CASE fx.family {' '.join(f"WHEN '{f}' THEN p{i}" for i, f in enumerate(X.FAMILIES))} END AS prio, coalesce(trials, 0) AS trials, coalesce(failures, 0) AS failures, best
        FROM pr CROSS JOIN fx LEFT JOIN ms ON ms.run_id = pr.run_id AND ms.model = fx.model),
      h AS (SELECT *, min(best) OVER w AS lo, max(best) OVER w AS hi, avg(prio) OVER w AS mp FROM g WINDOW w AS (PARTITION BY run_id)),
      s AS (SELECT *, CASE WHEN best IS NULL OR hi <= lo THEN 5e-1 ELSE greatest(0, least(1, 1 - (best - lo) / (hi - lo))) END AS em FROM h),
      t AS (SELECT *, em + 12e-2 / sqrt(1 + trials) + CASE WHEN trials = 0 THEN greatest(0, greatest(-1, least(1, 2 * (prio - mp)))) * gw * 1e-1 ELSE 0 END - 6e-2 * {COSTS}[family]
        - 16e-2 * failures / greatest(1, failures + trials) AS sc FROM s)""",
             tail="SELECT run_id, model, family, trials, round(em, 6) AS empirical, round(sc, 6) AS score, row_number() OVER (PARTITION BY run_id ORDER BY round(sc, 12) DESC, model_no) AS rank FROM t"),
)
def candidate_ranking(spark, sf):
    out = L.rank_candidates(L.model_summary(trials(spark, sf)), _priorities(spark, sf))
    return rounded(out, ["empirical", "score"])


@query(
    "family_coverage_target",
    with_sql(PRIO, tail="SELECT run_id, round(gw, 6) AS breadth, least(6, CASE WHEN gw < 3e-1 THEN 1 WHEN gw < 6e-1 THEN 2 WHEN gw < 8e-1 THEN 4 ELSE 6 END)::BIGINT AS families FROM pr"),
)
def family_coverage_target(spark, sf):
    rows = _priorities(spark, sf)
    return rows.select(RUN, F.round("guidance_weight", 6).alias("breadth"), L.family_target(F.col("guidance_weight"), 6).alias("families"))


# ------------------------------------------------------------------ dynamics

OWN = """mine AS (SELECT ok.run_id, step, mase, signature, row_number() OVER (PARTITION BY ok.run_id ORDER BY step) - 1 AS pos, count(*) OVER (PARTITION BY ok.run_id) AS n FROM ok JOIN lm USING (run_id) WHERE model = current_model),
ob AS (SELECT *, min(mase) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mine),
og AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE greatest(0, (before - mase) / (abs(before) + 1e-12)) END AS gain FROM ob)"""
INFO = f"""l4 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY run_id) AS k, lag(mase) OVER (PARTITION BY run_id ORDER BY pos) AS pv,
   min(mase) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM mine WHERE pos >= n - 4),
ig AS (SELECT run_id, max(k) AS k, avg(abs(mase - pv) / (abs(pv) + 1e-12)) AS ch, stddev_pop(mase) / (abs(avg(mase)) + 1e-12) AS dp, max({rel('bb', 'mase')}) FILTER (i > 1) AS im, count(DISTINCT signature) / max(k)::DOUBLE AS dv FROM l4 GROUP BY 1),
is1 AS (SELECT *, {smooth('ch', '5e-4', '5e-2')} AS c, {smooth('dp', '4e-4', '3e-2')} AS d, {smooth('im', '1e-3', '1e-1')} AS i FROM ig),
is2 AS (SELECT *, greatest(0e0, least(1e0, 25e-2 * c * (2e-1 + 8e-1 * i) + 2e-1 * d * (2e-1 + 8e-1 * i) + 5e-1 * i + 5e-2 * dv)) AS raw, greatest(c * (2e-1 + 8e-1 * i), d * (2e-1 + 8e-1 * i), i) AS num FROM is1),
inf AS (SELECT run_id, CASE WHEN k <= 1 THEN 1 ELSE greatest(0e0, least(1e0, raw * (1 - 7e-1 * {smooth('k - 1', '1e0', '3e0')} * (1 - num)))) END AS information_gain FROM is2)"""


@query("refinement_information_gain", with_sql(TRIALS, LASTM, OWN, INFO, tail="SELECT run_id, round(information_gain, 6) AS information_gain FROM inf"))
def refinement_information_gain(spark, sf):
    rows = L.valid(trials(spark, sf))
    own = rows.join(L.last_model(rows), RUN).filter(F.col("model") == F.col("current_model"))
    return rounded(Y.information_gain(L.with_gains(own), [RUN]), ["information_gain"])


@query(
    "refinement_responsiveness",
    with_sql(TRIALS, LASTM, OWN, """ev AS (SELECT run_id, count(*) FILTER (pos > 0) AS e, count(*) FILTER (pos > 0 AND gain >= 2e-3) AS h, max(gain) FILTER (pos > 0 AND gain >= 2e-3) AS b, sum(gain) FILTER (pos > 0 AND gain >= 2e-3) AS s,
      max(pos - 1) FILTER (pos > 0 AND gain >= 2e-3) AS l FROM og GROUP BY 1)""",
             tail=f"""SELECT run_id, round(greatest(0e0, least(1e0, 45e-2 * {smooth('coalesce(b, 0)', '2e-3', '1e-1')} + 25e-2 * CASE WHEN e > 0 THEN h / e::DOUBLE ELSE 0 END + 2e-1 * CASE WHEN h > 0 THEN 1e0 / (e - l) ELSE 0 END
               + 1e-1 * {smooth('coalesce(s, 0)', '2e-3', '15e-2')})), 6) AS responsiveness FROM ev"""),
)
def refinement_responsiveness(spark, sf):
    rows = L.valid(trials(spark, sf))
    own = rows.join(L.last_model(rows), RUN).filter(F.col("model") == F.col("current_model"))
    return rounded(Y.responsiveness(L.with_gains(own), [RUN]), ["responsiveness"])


def by_order(rows):
    """The same trials as many short runs: one run per order."""
    return rows.withColumn("step", F.col(RUN) * 1000000 + F.col("step")).withColumn(RUN, F.col("order_id"))


BY_ORDER = "few AS (SELECT * REPLACE (order_id AS run_id, run_id * 1000000 + step AS step) FROM ok)"


def analytics(spark, sf, key="l_suppkey"):
    """Diagnostics of the series each run works on."""
    s = F.col(RUN)
    return table(spark, sf, "lineitem").select(F.col(key).alias(RUN)).distinct().select(
        RUN, (s % 2 == 0).alias("seasonality_detected"), ((s % 11) / F.lit(10.0)).alias("seasonality_acf"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (s % 3 + 1).cast("int")).alias("seasonality_confidence"),
        F.when(s % 5 > 0, (s % 13) / F.lit(12.0)).alias("max_abs_acf"), ((s % 17) / F.lit(4.0)).alias("trend_strength"),
        F.when(s % 7 == 0, F.lit(0.7)).otherwise(-1.0).alias("nonlinearity_score"), (s % 4 == 1).alias("scale_sensitive"),
        F.when(s % 3 > 0, (s % 9 + 2).cast("int")).alias("suggested_lag"), F.when(s % 2 == 0, F.lit(12)).alias("seasonal_periods"),
    )


ANA = f"""an AS (SELECT DISTINCT l_suppkey AS run_id FROM lineitem),
sg AS (SELECT run_id, unnest(['seasonality', 'trend', 'autocorrelation', 'nonlinearity', 'scale_sensitivity']) AS signal, unnest([
  CASE WHEN run_id % 2 = 0 THEN greatest(0e0, least(1e0, 55e-2 * greatest((run_id % 11) / 10e0, CASE WHEN run_id % 5 > 0 THEN (run_id % 13) / 12e0 ELSE 0 END) + 45e-2 * [35e-2, 65e-2, 95e-2][run_id % 3 + 1])) END,
  CASE WHEN run_id % 17 > 0 THEN {smooth('(run_id % 17) / 4e0', '75e-2', '3e0')} END,
  CASE WHEN run_id % 5 > 0 THEN {smooth('(run_id % 13) / 12e0', '35e-2', '85e-2')} END,
  CASE WHEN run_id % 7 = 0 THEN 7e-1 END, CASE WHEN run_id % 4 = 1 THEN 8e-1 END]) AS strength FROM an),
rs AS (SELECT run_id, bool_or(model = 'SARIMA' OR (model = 'ETS' AND l_linestatus = 'F' AND run_id % 2 = 0) OR (model = 'Prophet' AND l_linenumber = 1)) AS s1,
  bool_or(model = 'Prophet' OR (model IN ('ARIMA', 'SARIMA') AND l_linenumber % 2 > 0) OR l_returnflag = 'N') AS s2,
  bool_or(model IN ('ARIMA', 'SARIMA') OR (l_returnflag = 'R' AND coalesce(CASE WHEN run_id % 3 > 0 THEN run_id % 9 + 2 WHEN run_id % 2 = 0 THEN 12 END IN (1, l_linenumber), false))) AS s3,
  bool_or(family IN ('Tree-based', 'Neural', 'Transformer/Foundation') OR model IN ('KNN', 'SVR')) AS s4, bool_or(l_returnflag = 'A') AS s5 FROM ok GROUP BY 1),
op AS (SELECT run_id, signal, strength, NOT CASE signal WHEN 'seasonality' THEN s1 WHEN 'trend' THEN s2 WHEN 'autocorrelation' THEN s3 WHEN 'nonlinearity' THEN s4 ELSE s5 END AS opened FROM sg JOIN rs USING (run_id) WHERE strength >= 6e-1)"""


@query(
    "unresolved_signals",
    with_sql(TRIALS, ANA, tail="""SELECT an.run_id, round(CASE WHEN bool_or(opened) THEN greatest(0e0, least(1e0, 75e-2 * max(strength) FILTER (opened) + 25e-2 * avg(strength) FILTER (opened))) ELSE 0 END, 6) AS unresolved_evidence,
      coalesce(string_agg(signal, ',' ORDER BY signal) FILTER (opened), '') AS unresolved_signals, coalesce(string_agg(signal, ',' ORDER BY signal) FILTER (NOT opened), '') AS resolved_signals FROM an LEFT JOIN op USING (run_id) GROUP BY 1"""),
)
def unresolved_signals(spark, sf):
    return rounded(Y.unresolved_evidence(L.valid(trials(spark, sf)), analytics(spark, sf)), ["unresolved_evidence"])


@query(
    "unresolved_signals_of_short_runs",
    with_sql(TRIALS, BY_ORDER, ANA.replace("FROM ok GROUP BY 1)", "FROM few GROUP BY 1)").replace("DISTINCT l_suppkey AS run_id", "DISTINCT l_orderkey AS run_id"),
             tail="SELECT run_id, string_agg(signal, ',' ORDER BY signal) FILTER (opened) AS unresolved_signals FROM op GROUP BY 1"),
)
def unresolved_signals_of_short_runs(spark, sf):
    rows = by_order(L.valid(trials(spark, sf)))
    out = Y.unresolved_evidence(rows, analytics(spark, sf, "l_orderkey").join(rows.select(RUN).distinct(), RUN, "left_semi"))
    kept = out.filter((F.col("unresolved_signals") != "") | (F.col("resolved_signals") != ""))
    return kept.select(RUN, F.nullif("unresolved_signals", F.lit("")).alias("unresolved_signals"))


def _family_priorities(spark, sf):
    return _priorities(spark, sf).select(RUN, F.explode("priorities").alias("family", "priority"))


@query("search_dynamics")
def search_dynamics(spark, sf):
    out = Y.search_dynamics(trials(spark, sf), analytics(spark, sf), _family_priorities(spark, sf))
    return rounded(out, [f.name for f in out.schema.fields if f.dataType.typeName() == "double"])


INCUMBENT = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY mase, step) AS r FROM ok),
ib AS (SELECT run_id, max(n) AS n, max(mase) FILTER (r = 1) AS inc, max(model) FILTER (r = 1) AS im, max(mase) FILTER (r <= 2) AS sec, max(mase) FILTER (r = n // 2 + 1) AS med FROM rk GROUP BY 1),
iq AS (SELECT ib.*, since, gg, st, {unit('(135e-2 - inc) / 7e-1')} AS aq, CASE WHEN ib.n = 1 THEN 5e-1 ELSE {unit(rel('med', 'inc') + ' / 5e-2')} END AS rq,
  {unit(f"least(1, since / 3e0) * (75e-2 + 25e-2 * least(1, {rel('sec', 'inc')} / 2e-2))")} AS stab FROM ib JOIN ps USING (run_id)),
fc AS (SELECT run_id, family, count(*) AS c, count(DISTINCT model) AS m FROM ok GROUP BY 1, 2),
fv AS (SELECT run_id, count(*) AS f, sum(m) AS m, CASE WHEN count(*) > 1 THEN -sum(c / t * ln(c / t)) / ln(6e0) ELSE 0 END AS dv FROM (SELECT *, sum(c) OVER (PARTITION BY run_id)::DOUBLE AS t FROM fc) GROUP BY 1),
rc AS (SELECT run_id, avg(gain) AS rri FROM gs WHERE pos >= n - 3 GROUP BY 1)"""


@query(
    "incumbent_signals",
    with_sql(TRIALS, GAINS, PROGRESS, INCUMBENT, tail=f"""SELECT run_id, n, im AS incumbent_model, inc AS incumbent, since, round(stab, 6) AS incumbent_stability, round(aq, 6) AS absolute_incumbent_quality, round(rq, 6) AS relative_incumbent_quality,
      round({unit('7e-1 * aq + 3e-1 * rq')}, 6) AS incumbent_quality, round(gg, 6) AS global_gain, round(st, 6) AS global_stagnation, round(f / 6e0, 6) AS family_coverage, round(m / 24e0, 6) AS distinct_model_coverage,
      round(dv, 6) AS cross_family_diversity, round(rri, 6) AS recent_relative_improvement,
      round({unit(f"3e-1 * {smooth('n', '3e0', '1e1')} + 25e-2 * f / 6e0 + 15e-2 * m / 24e0 + 15e-2 * dv + 1e-1 * stab + 5e-2 * (1 - least(1, rri / 5e-2))")}, 6) AS empirical_evidence_strength
      FROM iq JOIN fv USING (run_id) JOIN rc USING (run_id)"""),
)
def incumbent_signals(spark, sf):
    cols = ["incumbent_stability", "absolute_incumbent_quality", "relative_incumbent_quality", "incumbent_quality", "global_gain", "global_stagnation", "family_coverage",
            "distinct_model_coverage", "cross_family_diversity", "recent_relative_improvement", "empirical_evidence_strength"]
    out = Y.search_dynamics(trials(spark, sf), analytics(spark, sf))
    return rounded(out.select(RUN, "n", "incumbent_model", "incumbent", "since", *cols), cols)


@query(
    "empirical_strength",
    with_sql(TRIALS, GAINS, PROGRESS, INCUMBENT, tail=f"""SELECT run_id, round({unit(f"35e-2 * {smooth('(n - 2e0) / 8e0', '0e0', '1e0')} + 25e-2 * f / 6e0 + 15e-2 * m / 24e0 + 15e-2 * dv + 1e-1 * (65e-2 * stab + 35e-2 * (1 - least(1, rri / 5e-2)))")}, 6) AS empirical_strength
      FROM iq JOIN fv USING (run_id) JOIN rc USING (run_id)"""),
)
def empirical_strength(spark, sf):
    d = Y.search_dynamics(trials(spark, sf), analytics(spark, sf))
    value = Y.empirical_strength(F.col("n"), F.col("family_coverage"), F.col("distinct_model_coverage"), F.col("cross_family_diversity"), F.col("incumbent_stability"), F.col("recent_relative_improvement"))
    return rounded(d.select(RUN, value.alias("empirical_strength")), ["empirical_strength"])


EXIN = ["global_stagnation", "global_gain", "family_coverage", "model_coverage", "empirical", "stability", "challenger", "residual", "model_residual", "urgency"]


@query(
    "search_exhaustion",
    with_sql("inp AS (SELECT l_partkey AS run_id, " + ", ".join(f"avg(((l_orderkey * {3 + 2 * i} + l_suppkey) % 100 < {(i * 17 + 5) % 90 + 5})::INT) AS {c}" for i, c in enumerate(EXIN)) + " FROM lineitem GROUP BY 1)",
             tail=f"""SELECT run_id, round({unit(unit('18e-2 * global_stagnation + 16e-2 * (1 - global_gain) + 18e-2 * family_coverage + 18e-2 * model_coverage + 18e-2 * empirical + 7e-2 * stability + 5e-2 * (1 - challenger)') + ' * (1 - 8e-1 * greatest(challenger, residual, model_residual, urgency))')}, 6) AS search_exhaustion FROM inp"""),
)
def search_exhaustion(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = [F.avg(((F.col("l_orderkey") * (3 + 2 * i) + F.col("l_suppkey")) % 100 < (i * 17 + 5) % 90 + 5).cast("double")).alias(c) for i, c in enumerate(EXIN)]
    rows = li.groupBy(F.col("l_partkey").alias(RUN)).agg(*cols)
    return rounded(rows.select(RUN, Y.search_exhaustion({c: F.col(c) for c in EXIN}).alias("search_exhaustion")), ["search_exhaustion"])


def _settings(spark, sf, key="l_suppkey"):
    s = F.col(RUN)
    return table(spark, sf, "lineitem").select(F.col(key).alias(RUN)).distinct().select(RUN, (s % 2 == 0).alias("log_recommended"), (s % 3 > 0).alias("log_supported"))


# runs are orders here: short enough to be blocked for every reason
STOPS = """b AS (SELECT run_id, count(*) AS v, arg_min(model, (mase, step)) AS bm, bool_or(NOT uses_log) AS ar FROM few GROUP BY 1),
m AS (SELECT few.run_id, count(*) AS bt, count(DISTINCT hyperparameters) AS dh, bool_or(uses_log) AS le, bool_or(NOT uses_log) AS re FROM few JOIN b USING (run_id) WHERE model = bm GROUP BY 1),
s AS (SELECT DISTINCT l_orderkey AS run_id, l_orderkey % 2 = 0 AND l_orderkey % 3 > 0 AS wl FROM lineitem),
z AS (SELECT s.run_id, wl, coalesce(v, 0) AS v, bm, coalesce(bt, 0) AS bt, coalesce(dh, 0) AS dh, coalesce(le, false) AS le, coalesce(re, false) AS re, coalesce(ar, false) AS ar FROM s LEFT JOIN b USING (run_id) LEFT JOIN m USING (run_id)),
y AS (SELECT *, v >= 30 AS hard, v >= 5 AS enough, bm IS NOT NULL AND NOT ar AS nr, bm IS NOT NULL AND wl AND NOT (re AND le) AS nl, bm IS NOT NULL AND v >= 5 AND NOT (bt >= 4 OR dh >= 2) AS un FROM z)"""


@query(
    "stop_eligibility",
    with_sql(TRIALS, BY_ORDER, STOPS, tail="""SELECT run_id, v AS valid_trainings, bm AS best_model, bt AS best_trials, dh AS distinct_hyperparameters, hard OR (enough AND NOT nr AND NOT nl AND NOT un) AS eligible, hard AS hard_stop,
      CASE WHEN hard THEN '' ELSE concat_ws(',', CASE WHEN NOT enough THEN 'minimum_valid_trainings_not_reached' END, CASE WHEN nr THEN 'required_raw_candidate_pending' END,
        CASE WHEN nl THEN 'required_log_refinement_pending' END, CASE WHEN un THEN 'current_best_refinement_incomplete' END) END AS blockers,
      CASE WHEN bm IS NULL THEN 0 ELSE ((bt >= 4 OR dh >= 2)::INT + CASE WHEN wl THEN (re::INT + le::INT) / 2e0 ELSE 1 END) / 2e0 END AS refinement_completeness FROM y"""),
)
def stop_eligibility(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias(RUN))
    return L.stop_eligibility(by_order(L.valid(trials(spark, sf))), _settings(spark, sf, "l_orderkey"), counted=lines)


ARB = """a AS (SELECT l_partkey AS run_id, count(*) AS c, round(avg((l_linenumber > 3)::INT), 1) AS explore, round(avg((l_returnflag = 'A')::INT), 1) AS refine, round(avg((l_linestatus = 'F')::INT), 1) AS stop FROM lineitem GROUP BY 1),
b AS (SELECT *, run_id % 3 > 0 AS ok, run_id % 11 = 0 AS hard FROM a),
d AS (SELECT *, CASE WHEN refine >= explore AND refine >= stop THEN 'refine' WHEN explore >= stop THEN 'explore' ELSE 'stop' END AS raw_action,
  CASE WHEN refine >= explore AND refine >= CASE WHEN ok THEN stop ELSE 0 END THEN 'refine' WHEN explore >= CASE WHEN ok THEN stop ELSE 0 END THEN 'explore' ELSE 'stop' END AS effective_action FROM b),
e AS (SELECT *, CASE WHEN hard THEN 'stop' ELSE effective_action END AS executed_action FROM d)"""


@query(
    "action_arbitration",
    with_sql(ARB, tail="""SELECT run_id, raw_action, effective_action, executed_action, executed_action <> raw_action AS override, CASE WHEN executed_action <> raw_action THEN CASE WHEN hard THEN 'hard_budget_stop'
      WHEN NOT ok THEN 'stop_not_eligible' ELSE 'effective_strength' END END AS override_reason FROM e"""),
)
def action_arbitration(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("double")), 1)
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias(RUN)).agg(
        share(F.col("l_linenumber") > 3).alias("explore"), share(F.col("l_returnflag") == "A").alias("refine"), share(F.col("l_linestatus") == "F").alias("stop")
    )
    rows = rows.withColumn("stop_eligible", F.col(RUN) % 3 > 0).withColumn("hard_stop", F.col(RUN) % 11 == 0)
    return L.arbitration(rows).select(RUN, "raw_action", "effective_action", "executed_action", "override", "override_reason")


@query("search_control")
def search_control(spark, sf):
    rows = trials(spark, sf)
    dynamics = Y.search_dynamics(rows, analytics(spark, sf), _family_priorities(spark, sf))
    gains = L.with_gains(L.valid(rows))
    fusion = _priorities(spark, sf).select(RUN, F.col("guidance_weight").alias("reliability"), F.lit(0.3).alias("conflict"), F.lit(0.5).alias("discriminability"))
    inputs = Y.control_inputs(dynamics, fusion, L.stop_eligibility(L.valid(rows), _settings(spark, sf)), L.plateau(gains))
    return rounded(N.control_strengths(inputs, [RUN]), ["guidance", "breadth", "explore", "refine", "stop"])
