"""Fuzzy memberships, reliability, fusion and control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as Z
from ..functions import text as X
from ..operators import diagnostics as D
from ..operators import evidence as M
from ..operators import fusion as N
from .panels import MONTHLY, POS, SPLIT, monthly, table, with_sql
from .q_evidence import FAMS, SIG, SUPPORT, signals
from .q_panel import BASE, TRAIN, rounded, train_of
from .registry import query

KEY = "series_id"


def low(x):
    return f"(CASE WHEN {x} < 0 OR {x} > 4e-1 THEN 0 WHEN {x} < 2e-1 THEN 1 ELSE (4e-1 - {x}) / (4e-1 - 2e-1) END)"


def medium(x):
    return f"(CASE WHEN {x} < 2e-1 OR {x} > 8e-1 THEN 0 WHEN {x} <= 5e-1 THEN ({x} - 2e-1) / (5e-1 - 2e-1) ELSE (8e-1 - {x}) / (8e-1 - 5e-1) END)"


def high(x):
    return f"(CASE WHEN {x} < 6e-1 OR {x} > 1 THEN 0 WHEN {x} <= 8e-1 THEN ({x} - 6e-1) / (8e-1 - 6e-1) ELSE 1 END)"


SQL_LEVELS = {"low": low, "medium": medium, "high": high}


def unit(x):
    return f"greatest(0e0, least(1e0, {x}))"


@query(
    "fuzzy_memberships",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 101)::DOUBLE / 100 AS x, (l_suppkey % 31)::DOUBLE / 100 AS gap FROM lineitem)
    SELECT x, gap, count(*) AS rows, round({low('x')}, 6) AS low, round({medium('x')}, 6) AS medium, round({high('x')}, 6) AS high,
      round(CASE WHEN x <= 1e-1 THEN 0 WHEN x >= 7e-1 THEN 1 ELSE ((x - 1e-1) / 6e-1) * ((x - 1e-1) / 6e-1) * (3 - 2 * ((x - 1e-1) / 6e-1)) END, 6) AS smooth,
      round(CASE WHEN gap <= 3e-2 THEN 1 - 1e-1 * gap / 3e-2 WHEN gap <= 8e-2 THEN 9e-1 - 4e-1 * (gap - 3e-2) / 5e-2 ELSE greatest(0, least(1, 5e-1 * (2e-1 - gap) / 12e-2)) END, 6) AS potential
    FROM t GROUP BY x, gap""",
)
def fuzzy_memberships(spark, sf):
    x, gap = (F.col("l_partkey") % 101) / F.lit(100.0), (F.col("l_suppkey") % 31) / F.lit(100.0)
    rows = table(spark, sf, "lineitem").groupBy(x.alias("x"), gap.alias("gap")).agg(F.count(F.lit(1)).alias("rows"))
    levels = [fn(F.col("x")).alias(name) for name, fn in Z.LEVELS.items()]
    out = rows.select("x", "gap", "rows", *levels, Z.smoothstep(F.col("x"), 0.1, 0.7).alias("smooth"), Z.gap_potential(F.col("gap")).alias("potential"))
    return rounded(out, ["low", "medium", "high", "smooth", "potential"])


# ------------------------------------------------------------------ reliability

RELIN = {"semantic_quality": "l_partkey", "agreement": "l_suppkey * 7", "coverage": "l_orderkey * 3", "conflict": "l_partkey * 5", "source_quality": "l_orderkey * 11"}
FIELDS = [("raw_aggregation_reliability", "l_partkey", 5), ("reliability_score", "l_partkey * 3", 0), ("chunk_agreement", "l_suppkey * 7", 7), ("domain_agreement", "l_suppkey", 0),
          ("evidence_coverage", "l_orderkey * 3", 0), ("cross_modal_conflict", "l_partkey * 5", 11), ("source_reliability", "l_orderkey * 11", 3), ("specificity", "l_orderkey * 13", 3),
          ("entity_consistency", "l_partkey * 17", 2), ("coherence", "l_partkey * 19", 0)]


def _context(spark, sf):
    cols = []
    for i, (name, expr, gap) in enumerate(FIELDS):
        value = F.expr(f"({expr}) % 101") / F.lit(100.0)
        if name in ("source_reliability", "specificity", "entity_consistency", "coherence"):
            cols.append(F.when(F.expr(f"(l_partkey + {i}) % 4 != 0 AND l_linenumber != 7"), value).alias(name))
        else:
            cols.append((F.when(F.expr(f"l_partkey % {gap} != 0"), value) if gap else value).alias(name))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cols)


def _context_sql():
    cols = []
    for i, (name, expr, gap) in enumerate(FIELDS):
        value = f"(({expr}) % 101)::DOUBLE / 100"
        if name in ("source_reliability", "specificity", "entity_consistency", "coherence"):
            cols.append(f"CASE WHEN (l_partkey + {i}) % 4 <> 0 AND l_linenumber <> 7 THEN {value} END AS {name}")
        else:
            cols.append(f"{f'CASE WHEN l_partkey % {gap} <> 0 THEN {value} END' if gap else value} AS {name}")
    return "ctx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(cols) + " FROM lineitem)"


INP = f"""inp AS (SELECT *, {unit('coalesce(raw_aggregation_reliability, reliability_score, 0)')} AS q, {unit('coalesce(chunk_agreement, domain_agreement, 0)')} AS a,
  {unit('coalesce(evidence_coverage, 0)')} AS c, {unit('coalesce(cross_modal_conflict, 5e-1)')} AS x,
  coalesce((coalesce(source_reliability, 0) + coalesce(specificity, 0) + coalesce(entity_consistency, 0) + coalesce(coherence, 0))
    / nullif((source_reliability IS NOT NULL)::INT + (specificity IS NOT NULL)::INT + (entity_consistency IS NOT NULL)::INT + (coherence IS NOT NULL)::INT, 0),
    {unit('coalesce(raw_aggregation_reliability, reliability_score, 0)')}) AS s FROM ctx)"""


def _sql_rules(text, degree):
    least = lambda *xs: f"least({', '.join(xs)})"
    greatest = lambda *xs: f"greatest({', '.join(xs)})"
    return [(Z.combine(cond, degree, least, greatest), v) for v, cond in Z.rules(text)]


_SHORT = {"quality": "q", "agreement": "a", "coverage": "c", "conflict": "x", "source": "s"}
_TR = _sql_rules(N.TRUST, lambda t: SQL_LEVELS[t.split()[1]](_SHORT[t.split()[0]]))
TRUSTED = f"""rl AS (SELECT *, {" + ".join(d for d, _ in _TR)} AS den, {" + ".join(f"{d} * {float(v)}::DOUBLE" for d, v in _TR)} AS num,
  {unit('24e-2 * (1 - q) + 22e-2 * (1 - a) + 16e-2 * (1 - c) + 24e-2 * x + 14e-2 * (1 - s)')} AS u FROM inp),
tr AS (SELECT *, CASE WHEN den <= 1e-12 THEN 25e-2 ELSE {unit('num / den')} END AS t FROM rl)"""


@query(
    "reliability_inputs",
    with_sql(_context_sql(), INP, tail="SELECT l_partkey, l_linenumber, round(avg(q), 6) AS semantic_quality, round(avg(a), 6) AS agreement, round(avg(c), 6) AS coverage, round(avg(x), 6) AS conflict, round(avg(s), 6) AS source_quality FROM inp GROUP BY 1, 2"),
)
def reliability_inputs(spark, sf):
    cols = ["semantic_quality", "agreement", "coverage", "conflict", "source_quality"]
    out = N.reliability_inputs(_context(spark, sf)).groupBy("l_partkey", "l_linenumber").agg(*[F.avg(c).alias(c) for c in cols])
    return rounded(out, cols)


@query(
    "semantic_trust",
    with_sql(_context_sql(), INP, TRUSTED, tail=f"SELECT l_partkey, l_linenumber, round(avg({unit('8e-1 * t + 2e-1 * (1 - u)')}), 10) AS semantic_trust, round(avg({unit('55e-2 * (1 - t) + 45e-2 * u')}), 10) AS uncertainty FROM tr GROUP BY 1, 2"),
)
def semantic_trust(spark, sf):
    out = N.semantic_trust(N.reliability_inputs(_context(spark, sf)))
    return rounded(out.groupBy("l_partkey", "l_linenumber").agg(F.avg("semantic_trust").alias("semantic_trust"), F.avg("uncertainty").alias("uncertainty")), ["semantic_trust", "uncertainty"], 10)


# ------------------------------------------------------------------ compatibility and fusion

HORIZON = 3


def _diagnostics(spark, sf):
    train = train_of(monthly(spark, sf))
    stats = D.base_stats(train)
    acf = D.autocorrelation(D.detrended(train), [1, 12])
    strongest = acf.groupBy(KEY).agg(
        F.max(F.abs("acf")).alias("max_abs_acf"), F.max(F.when(F.col("lag") == 12, F.col("acf"))).alias("seasonality_acf")
    )
    return stats.join(strongest, KEY, "left").select(
        KEY, "n_obs", "trend_strength", "volatility_cv", "max_abs_acf", "seasonality_acf", F.lit("MS").alias("freq"),
        F.lit(2).alias("suggested_lag"), F.lit(None).cast("double").alias("confidence"),
    )


DIAG = """ac AS (SELECT t.series_id, lag, corr(a.r, b.r) AS acf FROM (SELECT DISTINCT series_id FROM res) t CROSS JOIN (VALUES (1), (12)) l(lag)
    JOIN res a ON a.series_id = t.series_id JOIN res b ON b.series_id = a.series_id AND b.pos = a.pos - lag GROUP BY 1, 2),
dg AS (SELECT b.series_id, n_obs, trend_strength, ma, sa FROM base b LEFT JOIN (SELECT series_id, max(abs(acf)) AS ma, max(acf) FILTER (lag = 12) AS sa FROM ac GROUP BY 1) USING (series_id)),
mt AS (SELECT series_id, n_obs, least(1, trend_strength / 3) AS tr, CASE WHEN sa IS NOT NULL THEN greatest(0, least(1, sa)) END AS se, CASE WHEN ma IS NOT NULL THEN greatest(0, least(1, ma)) END AS au,
  least(1, n_obs / 30e0) AS hi, greatest(0, least(1, (n_obs - 2) / 60e0)) AS lr, least(1, 3e0 / n_obs) AS ra FROM dg),
rb AS (SELECT *, (1 + 1 + (se IS NOT NULL)::INT + (au IS NOT NULL)::INT + 0 + 1) / 6e0 AS cv FROM mt),
fam AS (SELECT series_id, greatest(0, least(1, 5e-1 * cv + 25e-2 * cv + 25e-2)) AS ar, unnest(['Statistical', 'Additive', 'Tree-based', 'Classical ML', 'Neural', 'Transformer/Foundation']) AS family, unnest(range(6)) AS family_no,
  unnest([(coalesce(au, 0) + coalesce(se, 0) + tr + 1 + hi) / (3 + (au IS NOT NULL)::INT + (se IS NOT NULL)::INT), (tr + coalesce(se, 0) + 1) / (2 + (se IS NOT NULL)::INT),
    least(65e-2, 45e-2 + 2e-1 * (lr + 1) / 2), least(75e-2, 45e-2 + 3e-1 * (lr + hi) / 2), least(8e-1, 5e-1 + 3e-1 * (hi + 1 - ra) / 2), 5e-1]) AS sc FROM rb)"""
DIAG_PARTS = [MONTHLY, POS, SPLIT, TRAIN, """st AS (SELECT series_id, stddev_pop(target) AS sd, regr_slope(target, pos) AS b, regr_intercept(target, pos) AS a FROM train GROUP BY 1),
res AS (SELECT t.series_id, t.pos, CASE WHEN sd <= 1e-12 THEN target ELSE target - (b * t.pos + a) END AS r FROM train t JOIN st USING (series_id))""",
              f"base AS ({BASE.format(rows='train')})", DIAG]


@query(
    "analytical_compatibility",
    with_sql(*DIAG_PARTS, tail="SELECT series_id, family, family_no, round(sc, 6) AS analytical_compatibility, round(ar, 6) AS analytical_reliability, CASE WHEN family_no = 5 THEN 'uncertain' ELSE 'ready' END AS status FROM fam"),
)
def analytical_compatibility(spark, sf):
    return rounded(N.analytical_compatibility(_diagnostics(spark, sf), HORIZON), ["analytical_compatibility", "analytical_reliability"])


def _families(spark, sf):
    support = M.family_support(signals(spark, sf)).select(KEY, "family", F.col("normalized_support").alias("semantic_support"), "evidence_available")
    return N.analytical_compatibility(_diagnostics(spark, sf), HORIZON).join(support, [KEY, "family"])


PAIR = """fm AS (SELECT fam.series_id, fam.family, fam.family_no, sc, ar, normalized_support AS ss, evidence_available AS ev FROM fam JOIN nrm USING (series_id, family)),
cf AS (SELECT series_id, CASE WHEN sum(least(ar, ev::INT)) > 1e-12 THEN greatest(0, least(1, sum(least(ar, ev::INT) * abs(ss - sc)) / sum(least(ar, ev::INT)))) ELSE 5e-1 END AS x,
  sum((least(ar, ev::INT) > 0)::INT) / 6e0 AS cc FROM fm GROUP BY 1)"""


@query(
    "cross_modal_conflict",
    with_sql(*DIAG_PARTS, SIG, FAMS, SUPPORT, PAIR, tail="SELECT series_id, round(x, 6) AS cross_modal_conflict, round(cc, 6) AS cross_modal_coverage FROM cf"),
)
def cross_modal_conflict(spark, sf):
    return rounded(N.cross_modal_conflict(_families(spark, sf)), ["cross_modal_conflict", "cross_modal_coverage"])


def _trusted(spark, sf, conflict):
    sig = signals(spark, sf)
    context = sig.groupBy(KEY).agg(
        F.avg("domain_confidence").alias("raw_aggregation_reliability"), F.lit(None).cast("double").alias("reliability_score"),
        F.avg("target_confidence").alias("chunk_agreement"), F.lit(None).cast("double").alias("domain_agreement"),
        F.avg((F.col("domain_confidence") > 0).cast("double")).alias("evidence_coverage"),
        *[F.lit(None).cast("double").alias(c) for c in ("source_reliability", "specificity", "entity_consistency", "coherence")],
    )
    return N.semantic_trust(N.reliability_inputs(context.join(conflict.select(KEY, "cross_modal_conflict"), KEY)))


FUSED = [*DIAG_PARTS, SIG, FAMS, SUPPORT, PAIR,
         "inp AS (SELECT s.series_id, avg(dc) AS q, avg(tc) AS a, avg((dc > 0)::INT) AS c, any_value(cf.x) AS x, avg(dc) AS s FROM sig s JOIN cf USING (series_id) GROUP BY 1)",
         TRUSTED, f"ts AS (SELECT series_id, {unit('8e-1 * t + 2e-1 * (1 - u)')} AS trust, {unit('55e-2 * (1 - t) + 45e-2 * u')} AS unc FROM tr)",
         "fu AS (SELECT fm.*, trust * ev::INT AS sr, CASE WHEN ar + trust * ev::INT > 1e-12 THEN greatest(0, least(1, (ar * sc + trust * ev::INT * ss) / (ar + trust * ev::INT))) ELSE 5e-1 END AS cb FROM fm JOIN ts USING (series_id)),"
         "fr AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(cb, 12) DESC, family_no) AS rk FROM fu)"]


@query(
    "evidence_fusion",
    with_sql(*FUSED, tail="SELECT series_id, family, round(cb, 6) AS combined, round(sr, 6) AS semantic_reliability, rk AS rank FROM fr"),
)
def evidence_fusion(spark, sf):
    families = _families(spark, sf)
    out = N.fuse(families, _trusted(spark, sf, N.cross_modal_conflict(families)))
    return rounded(out.select(KEY, "family", "combined", "semantic_reliability", "rank"), ["combined", "semantic_reliability"])


@query(
    "fusion_summary",
    with_sql(*FUSED, f"sm AS (SELECT series_id, avg(ar) AS att, max(family) FILTER (rk = 1) AS top_family, max(cb) FILTER (rk = 1) - max(cb) FILTER (rk = 2) AS mg, least(1, stddev_pop(ss) / 5e-1) AS di FROM fr GROUP BY 1)",
             tail=f"""SELECT series_id, round(att, 6) AS analytical_trust, top_family, round(mg, 6) AS top_margin, round(di, 6) AS discriminability, round(trust, 6) AS semantic_trust, round(unc, 6) AS uncertainty,
               round(1 - x, 6) AS alignment, round({unit('4e-1 * trust + 35e-2 * att + 15e-2 * (1 - x) + 1e-1 * cc')}, 6) AS fusion_reliability FROM sm JOIN ts USING (series_id) JOIN cf USING (series_id)"""),
)
def fusion_summary(spark, sf):
    families = _families(spark, sf)
    conflict = N.cross_modal_conflict(families)
    trust = _trusted(spark, sf, conflict)
    cols = ["analytical_trust", "top_margin", "discriminability", "semantic_trust", "uncertainty", "alignment", "fusion_reliability"]
    return rounded(N.fusion_summary(N.fuse(families, trust), trust, conflict).drop("cross_modal_conflict", "cross_modal_coverage"), cols)


# ------------------------------------------------------------------ control rules

# one run per part: every input is an average over its line items
_MIX = {name: (3 + 2 * i, 7 * i + 1) for i, name in enumerate(N.CONTROL_INPUTS)}


def _control_inputs(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = [F.avg(((F.col("l_orderkey") * a + F.col("l_suppkey") * b + F.col("l_partkey")) % 100 >= (i * 13 + 7) % 100).cast("double")).alias(name) for i, (name, (a, b)) in enumerate(_MIX.items())]
    # rows of a part meet before they are averaged: a task that sees all parts would hold all their sums
    return li.select("l_orderkey", "l_suppkey", "l_partkey").repartition("l_partkey").groupBy(F.col("l_partkey").alias("run_id")).agg(*cols)


CTRL = "inp AS (SELECT l_partkey AS run_id, " + ", ".join(
    f"avg(((l_orderkey * {a} + l_suppkey * {b} + l_partkey) % 100 >= {(i * 13 + 7) % 100})::INT) AS {name}" for i, (name, (a, b)) in enumerate(_MIX.items())
) + " FROM lineitem GROUP BY 1)"
DERIVED = f"""dv AS (SELECT *, {unit('in_family_potential * (35e-2 + 35e-2 * stagnation + 3e-1 * (1 - information))')} AS in_family,
  {unit('residual * (2e-1 + 25e-2 * global_stagnation + 2e-1 * greatest(saturation, maturity) + 2e-1 * (1 - coverage) + 15e-2 * remaining) * (65e-2 + 35e-2 * (1 - global_gain)) * (1 - 3e-1 * quality)')} AS escape FROM inp)"""
_FUZZY = [c for c in N.CONTROL_INPUTS if c != "in_family_potential"] + ["in_family", "escape"]
LEVELED = "lv AS (SELECT run_id, " + ", ".join(f"{fn(c)} AS {c}_{lv}" for c in _FUZZY for lv, fn in SQL_LEVELS.items()) + " FROM dv)"


def _deg(t):
    return "35e-2" if t == "always" else t.replace(" ", "_")


_EV = {name: d for d, name in _sql_rules(N.EVIDENCE, _deg)}
_MO = [d for d, _ in _sql_rules(N.MODERATE, _deg)]
EVD = f"ev AS (SELECT *, {_EV['uncertain']} AS uncertain, greatest({', '.join(_MO)}) AS moderate, {_EV['confident']} AS confident FROM lv)"


def _group_sql(text, default):
    pairs = _sql_rules(text, _deg)
    den, num = " + ".join(d for d, _ in pairs), " + ".join(f"{d} * {v}::DOUBLE" for d, v in pairs)
    return f"CASE WHEN {den} <= 1e-12 THEN {default}::DOUBLE ELSE {unit(f'({num}) / ({den})')} END"


def _dominant_sql(text):
    pairs = _sql_rules(text, _deg)
    top = "greatest(" + ", ".join(d for d, _ in pairs) + ")"
    return "CASE " + " ".join(f"WHEN {d} = {top} THEN '{n}'" for d, n in pairs) + " END"


CONTROL = [CTRL, DERIVED, LEVELED, EVD]


@query(
    "control_strengths",
    with_sql(*CONTROL, tail="SELECT run_id, " + ", ".join(f"round({_group_sql(t, d)}, 6) AS {g}" for g, (t, d) in Z.GROUPS.items()) + " FROM ev"),
)
def control_strengths(spark, sf):
    out = N.control_strengths(_control_inputs(spark, sf), ["run_id"])
    return rounded(out.select("run_id", *Z.GROUPS), list(Z.GROUPS))


@query(
    "dominant_rules",
    with_sql(*CONTROL, tail="SELECT run_id, " + ", ".join(f"{_dominant_sql(t)} AS {a}_rule" for a, t in Z.DOMINANT.items()) + " FROM ev"),
)
def dominant_rules(spark, sf):
    out = N.control_strengths(_control_inputs(spark, sf), ["run_id"])
    return out.select("run_id", *[f"{a}_rule" for a in Z.DOMINANT])


_TRACE = [(f"{g}.rule_{i:03d}", g, d, v) for g, (t, _) in Z.GROUPS.items() for i, (d, v) in enumerate(_sql_rules(t, _deg), start=1)]


@query(
    "inference_trace",
    with_sql(*CONTROL, "tr AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{g}' AS rule_group, {d} AS degree, {v}::DOUBLE AS conclusion FROM ev" for r, g, d, v in _TRACE) + ")",
             tail="SELECT rule, rule_group, conclusion, count(*) FILTER (degree > 0) AS fired, round(avg(degree), 6) AS mean_degree, round(sum(degree * conclusion), 4) AS contribution FROM tr GROUP BY 1, 2, 3"),
)
def inference_trace(spark, sf):
    rows = N.inference_trace(_control_inputs(spark, sf), ["run_id"])
    out = rows.groupBy("rule", "rule_group", "conclusion").agg(
        F.sum((F.col("degree") > 0).cast("bigint")).alias("fired"), F.avg("degree").alias("mean_degree"), F.sum("contribution").alias("contribution")
    )
    return rounded(rounded(out, ["mean_degree"]), ["contribution"], 4)
