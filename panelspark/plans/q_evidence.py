"""Textual evidence: signals, votes, label clusters, family support, target resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as M
from ..operators import signals as S
from ..operators.similarity import similar_edges
from .panels import table, with_sql
from .q_documents import LABEL, SERIES
from .q_panel import rounded
from .registry import query

KEY = "series_id"

# texts a signal may carry, chosen by document number
PICKS = {
    "domain_label": ["energy demand", "energy demands", "Energy-Demand", "retail sales", "retail sale", "unknown", "weather"],
    "domain_parent": ["energy", "retail", "unknown"],
    "primary_entity": ["national electricity grid operator", "national electricity grid operators", "National_Electricity Grid-Operator", "city utility", "unknown"],
    "spatial_scope": ["north region", "north regions", "south coast", "unknown"],
    "measure": ["total amount", "average value", "seasonally adjusted index", "seasonally adjusted indexes", "unknown"],
    "physical_quantity": ["electric energy consumption", "electric energy consumptions", "sales volume", "unknown", "None"],
    "temporal_granularity": ["monthly", "Monthly", "weekly", "unknown"],
    "value_type": ["continuous value", "count", "numeric-continuous", "other"],
    "task_type": ["forecasting", "forecasting", "classification"],
    "family": ["ARIMA models", "additive", "Gradient Boosting", "linear_models", "deep learning", "foundation", "Quantum", " "],
    "against": ["Statistical", "Additive", "Tree-based", "Classical ML", "Neural", "Transformer/Foundation"],
    "priority": ["high", "medium", "low", "someday"],
    "transformation": ["log", "Log-Transform", "normalise", "difference", "seasonal differencing"],
    "reason": [
        "steady growth of demand",
        "the time series is rather short and prices rose",
        "the series is nonstationary",
        "dataset shows strong trend; exports grew",
    ],
}
# step and offset of the choice, so that fields vary independently
STEP = {"domain_label": 3, "primary_entity": 7, "measure": 5, "physical_quantity": 11, "spatial_scope": 3, "reason": 3, "task_type": 5}


def _pick(name):
    values = PICKS[name]
    at = (F.col("doc_id") * STEP.get(name, 1) % (len(values) + 6) % len(values) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


def _sql_pick(name):
    values = PICKS[name]
    return f"{values}[doc_id * {STEP.get(name, 1)} % {len(values) + 6} % {len(values)} + 1]"


def signals(spark, sf):
    d = table(spark, sf, "documents")
    doc = F.col("doc_id")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (doc % 2400).cast("int"))
    text_fields = ["domain_label", "domain_parent", *M.CLUSTER_FIELDS, "temporal_granularity", "value_type", "task_type"]
    return d.select(
        F.element_at(F.array(*[F.lit(s) for s in SERIES]), (doc % 5 + 1).cast("int")).alias(KEY),
        doc.alias("ord"),
        F.floor(doc / 100).cast("bigint").alias("chunk_index"),
        (doc % 3 + 1).alias("text_obs"),
        ((F.col("n_chars") % 100) / F.lit(100.0)).alias("domain_confidence"),
        ((doc % 90) / F.lit(100.0)).alias("target_confidence"),
        *[_pick(f).alias(f) for f in text_fields],
        F.col("lang").alias("inferred_domain"),
        F.array(F.col("lang"), _pick("domain_parent"), F.when(doc % 2 == 0, "load").otherwise("unknown")).alias("domain_concepts"),
        F.array(F.struct(_pick("family").alias("family"), _pick("priority").alias("priority"), _pick("reason").alias("reason"))).alias("preferred_families"),
        F.when(doc % 4 == 0, F.array(F.struct(_pick("against").alias("family"), _pick("reason").alias("reason")))).otherwise(F.array()).alias("deprioritized_families"),
        F.array(F.concat(F.lit("handles "), F.col("lang")), F.col("source")).alias("preferred_capabilities"),
        F.array(F.struct(_pick("transformation").alias("transformation"), _pick("priority").alias("priority"))).alias("preprocessing_prior"),
        F.array(F.concat(F.col("lang"), F.lit(" demand grows")), F.concat(F.lit("report of "), F.col("source"))).alias("textual_findings"),
        F.date_format(day, "yyyy-MM-dd").alias("source_date_start"),
        F.when(doc % 6 == 0, "").otherwise(F.date_format(F.date_add(day, 9), "yyyy-MM-dd")).alias("source_date_end"),
        (doc % 3).alias("excluded_claims"),
        F.when(doc % 5 != 0, (doc % 13) / F.lit(10.0)).alias("source_reliability"),
        F.when(doc % 200 < 100, "national electricity grid operator").alias("expected_entity"),
    )


SIG = f"""sig AS (SELECT {SERIES}[doc_id % 5 + 1] AS series_id, doc_id AS ord, doc_id // 100 AS chunk_index, doc_id, lang, source,
  greatest(1, doc_id % 3 + 1)::DOUBLE AS obs, (n_chars % 100)::DOUBLE / 100 AS dc, (doc_id % 90)::DOUBLE / 100 AS tc,
  {", ".join(f"{_sql_pick(f)} AS {f}" for f in PICKS)},
  (n_chars % 100)::DOUBLE / 100 * (doc_id % 3 + 1) AS dw, (doc_id % 90)::DOUBLE / 100 * (doc_id % 3 + 1) AS tw FROM documents)"""


def _long_sql(fields):
    parts = [
        f"SELECT series_id, '{f}' AS field, ord, {f} AS value, {'dw' if k == 'domain' else 'tw'} AS weight, obs, {LABEL.replace('lower(s)', f'lower({f})').replace('s IS NULL', f'{f} IS NULL')} AS norm FROM sig"
        for f, k in fields.items()
    ]
    return "lng AS (" + " UNION ALL ".join(parts) + ")"


VOTE = """tot AS (SELECT series_id, field, sum(total_weight) AS t, arg_max(first_ord, (weight, -first_ord)) AS w FROM cand GROUP BY 1, 2),
res AS (SELECT series_id, field, CASE WHEN t > 0 THEN max(label) FILTER (first_ord = w) ELSE 'unknown' END AS value,
  CASE WHEN t > 0 THEN max(weight) FILTER (first_ord = w) / t ELSE 0 END AS agreement,
  CASE WHEN t > 0 THEN max(weight / obs) FILTER (first_ord = w) ELSE 0 END AS confidence,
  coalesce(string_agg(label || ':' || printf('%.4f', weight / t) , ';' ORDER BY weight / t DESC, label) FILTER (first_ord <> w AND t > 0 AND weight / t >= {thr} AND label <> 'unknown'), '') AS alternatives
  FROM cand JOIN tot USING (series_id, field) GROUP BY series_id, field, t)"""
VOTED = "SELECT series_id, field, value, round(agreement, 6) AS agreement, round(confidence, 6) AS confidence, alternatives FROM res"


def _voted(df):
    alts = F.transform("alternatives", lambda a: F.concat(a["label"], F.lit(":"), F.format_string("%.4f", a["support"])))
    return rounded(df.withColumn("alternatives", F.array_join(alts, ";")), ["agreement", "confidence"])


@query(
    "exact_field_votes",
    with_sql(SIG, _long_sql(M.EXACT_FIELDS),
             "cand AS (SELECT series_id, field, norm AS label, sum(weight) AS weight, sum(weight) AS total_weight, sum(obs) AS obs, min(ord) AS first_ord FROM lng GROUP BY 1, 2, 3)",
             VOTE.format(thr="2e-1"), tail=VOTED),
)
def exact_field_votes(spark, sf):
    return _voted(M.exact_vote(M.long_fields(signals(spark, sf), M.EXACT_FIELDS)))


# n-gram weights, similarities and clusters of the distinct labels of every (series, field)
NGRAMS = """itm AS (SELECT series_id, field, norm, count(*) AS copies, sum(weight) AS weight, sum(obs) AS obs, min(ord) AS first_ord FROM lng GROUP BY 1, 2, 3),
wrd AS (SELECT series_id, field, norm, copies, unnest(string_split(norm, ' ')) AS w FROM itm),
pos AS (SELECT *, unnest(range(1, greatest(1, length(w) + 3 - k) + 1)) AS i FROM wrd, (VALUES (2), (3), (4)) s(k) WHERE k = 2 OR length(w) + 2 >= k),
tf AS (SELECT series_id, field, norm, any_value(copies) AS copies, substr(' ' || w || ' ', i::BIGINT, k::BIGINT) AS gram, count(*) AS tf FROM pos GROUP BY series_id, field, norm, gram),
nn AS (SELECT series_id, field, sum(copies) AS n FROM itm GROUP BY 1, 2),
dfs AS (SELECT series_id, field, gram, sum(copies) AS df FROM tf GROUP BY 1, 2, 3),
rw AS (SELECT tf.*, tf.tf * (ln((1 + n::DOUBLE) / (1 + df)) + 1) AS x FROM tf JOIN dfs USING (series_id, field, gram) JOIN nn USING (series_id, field)),
vec AS (SELECT series_id, field, norm, gram, x / sqrt(sum(x * x) OVER (PARTITION BY series_id, field, norm)) AS w FROM rw)"""
LINKS = """sims AS (SELECT a.series_id, a.field, a.norm AS a, b.norm AS b, sum(a.w * b.w) AS sim FROM vec a JOIN vec b USING (series_id, field, gram)
  WHERE a.norm <> 'unknown' AND b.norm <> 'unknown' GROUP BY 1, 2, 3, 4),
reach(series_id, field, a, b) AS (SELECT series_id, field, a, b FROM sims WHERE sim >= 8e-1 - 1e-12 UNION
  SELECT r.series_id, r.field, r.a, s.b FROM reach r JOIN sims s ON s.series_id = r.series_id AND s.field = r.field AND s.a = r.b AND s.sim >= 8e-1 - 1e-12),
comp AS (SELECT series_id, field, a AS norm, min(b) AS component FROM reach GROUP BY 1, 2, 3)"""
MEDOID = """lab AS (SELECT series_id, field, norm, value, sum(weight) AS lw FROM lng WHERE norm <> 'unknown' GROUP BY 1, 2, 3, 4),
sco AS (SELECT s.series_id, s.field, c.component, s.a AS norm, round(sum(s.sim * i.weight), 9) AS score FROM sims s JOIN comp c ON c.series_id = s.series_id AND c.field = s.field AND c.norm = s.a
  JOIN comp d ON d.series_id = s.series_id AND d.field = s.field AND d.norm = s.b AND d.component = c.component
  JOIN itm i ON i.series_id = s.series_id AND i.field = s.field AND i.norm = s.b GROUP BY 1, 2, 3, 4),
med AS (SELECT series_id, field, component, arg_min(value, (-score, -lw, value)) AS label FROM sco JOIN lab USING (series_id, field, norm) GROUP BY 1, 2, 3)"""
CAND = """cand AS (SELECT series_id, field, label, sum(weight) AS weight, sum(weight) AS total_weight, sum(obs) AS obs, min(first_ord) AS first_ord
    FROM itm JOIN comp USING (series_id, field, norm) JOIN med USING (series_id, field, component) GROUP BY series_id, field, component, label
  UNION ALL SELECT series_id, field, 'unknown', max(weight), sum(weight), arg_max(obs, (weight, -ord)), arg_max(ord, (weight, -ord)) FROM lng WHERE norm = 'unknown' GROUP BY 1, 2)"""
CLUSTERED = [SIG, _long_sql(M.CLUSTER_FIELDS), NGRAMS]


def _recursive(*parts, tail):
    return with_sql(*parts, tail=tail).replace("WITH ", "WITH RECURSIVE ", 1)


def _long(spark, sf):
    return M.long_fields(signals(spark, sf), M.CLUSTER_FIELDS)


@query(
    "label_ngram_weights",
    with_sql(*CLUSTERED, tail="SELECT series_id, field, norm, count(*) AS grams, round(sum(w), 6) AS total, round(max(w), 6) AS largest FROM vec GROUP BY 1, 2, 3"),
)
def label_ngram_weights(spark, sf):
    w = M.label_weights(_long(spark, sf))
    out = w.groupBy("grp", "norm").agg(F.count(F.lit(1)).alias("grams"), F.sum("w").alias("total"), F.max("w").alias("largest"))
    parts = F.split("grp", "\u0001")
    return rounded(out.select(parts[0].alias(KEY), parts[1].alias("field"), "norm", "grams", "total", "largest"), ["total", "largest"])


@query(
    "label_similarity",
    with_sql(*CLUSTERED, LINKS.split("reach(")[0].rstrip().rstrip(","), tail="SELECT series_id, field, a, b, round(sim, 6) AS cosine FROM sims WHERE a < b AND sim >= 8e-1"),
)
def label_similarity(spark, sf):
    rows = _long(spark, sf)
    weights = M.label_weights(rows).filter(F.col("norm") != "unknown")
    edges = similar_edges(M.label_items(rows), weights, "grp", "norm", threshold=M.SIMILARITY)
    parts = F.split("grp", "\u0001")
    return rounded(edges.select(parts[0].alias(KEY), parts[1].alias("field"), "a", "b", "cosine"), ["cosine"])


@query("label_clusters", _recursive(*CLUSTERED, LINKS, tail="SELECT series_id, field, norm, component FROM comp"))
def label_clusters(spark, sf):
    parts = F.split("grp", "\u0001")
    return M.label_clusters(_long(spark, sf)).select(parts[0].alias(KEY), parts[1].alias("field"), "norm", "component")


@query("cluster_medoids", _recursive(*CLUSTERED, LINKS, MEDOID, tail="SELECT series_id, field, component, label FROM med"))
def cluster_medoids(spark, sf):
    rows = _long(spark, sf)
    return M.medoids(rows, M.label_clusters(rows)).drop("grp")


@query("cluster_field_votes", _recursive(*CLUSTERED, LINKS, MEDOID, CAND, VOTE.format(thr="2e-1"), tail=VOTED))
def cluster_field_votes(spark, sf):
    return _voted(M.cluster_vote(_long(spark, sf)))


@query(
    "signal_weights",
    with_sql(SIG, tail="SELECT series_id, ord, obs, round(dw, 6) AS domain_weight, round(tw, 6) AS target_weight FROM sig"),
)
def signal_weights(spark, sf):
    return rounded(M.weighted(signals(spark, sf)).select(KEY, "ord", "obs", "domain_weight", "target_weight"), ["domain_weight", "target_weight"])


@query("domain_label_similarity")
def domain_label_similarity(spark, sf):
    edges = M.domain_edges(M.domain_items(signals(spark, sf)))
    return rounded(edges, ["label_sim", "context_sim", "overlap", "sim"])


@query("domain_votes")
def domain_votes(spark, sf):
    result, _ = M.domain_vote(signals(spark, sf))
    return _voted(result)


@query("concept_support")
def concept_support(spark, sf):
    result, items = M.domain_vote(signals(spark, sf))
    won = items.join(result.select(KEY, F.col("value").alias("label")), KEY).filter(X.normalize_label(F.col("label")) == F.col("norm"))
    inside = items.join(won.select(KEY, "component").distinct(), [KEY, "component"], "left_semi")
    totals = inside.groupBy(KEY).agg(F.sum("weight").alias("total"))
    entries = inside.select(KEY, "weight", F.explode("concepts").alias("value"))
    return rounded(M.top_supported(entries, totals, 0.30, 8), ["support"])


@query(
    "alternative_support",
    with_sql(SIG, """u AS (SELECT series_id, tw, unnest([source, lang]) AS value FROM sig), t AS (SELECT series_id, sum(tw) AS total FROM sig GROUP BY 1)""",
             tail="""SELECT series_id, value, round(w / total, 6) AS support, row_number() OVER (PARTITION BY series_id ORDER BY w DESC, value) AS rank
               FROM (SELECT series_id, value, sum(tw) AS w FROM u GROUP BY 1, 2) JOIN t USING (series_id) WHERE w / total >= 2e-1 QUALIFY rank <= 5"""),
)
def alternative_support(spark, sf):
    rows = M.weighted(signals(spark, sf))
    named = F.concat(F.array(F.regexp_replace(F.element_at("preferred_capabilities", 1), "^handles ", "")), F.slice("preferred_capabilities", 2, 1))
    entries = rows.select(KEY, F.col("target_weight").alias("weight"), F.explode(named).alias("value"))
    totals = rows.groupBy(KEY).agg(F.sum("target_weight").alias("total"))
    return rounded(M.top_supported(entries, totals, 0.20, 5), ["support"])


@query(
    "capability_prior",
    with_sql(SIG, "u AS (SELECT series_id, dw, unnest(['handles ' || lang, source]) AS capability FROM sig)",
             tail="""SELECT series_id, capability, round(sum(dw), 6) AS weight, row_number() OVER (PARTITION BY series_id ORDER BY sum(dw) DESC, capability) AS rank
               FROM u GROUP BY 1, 2 QUALIFY rank <= 5"""),
)
def capability_prior(spark, sf):
    return rounded(M.top_capabilities(signals(spark, sf)), ["weight"])


# ------------------------------------------------------------------ families

_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.FAMILY_ALIASES.items()) + "}"
_FRAG = " ".join("WHEN " + " OR ".join(f"contains(lower(trim({{0}})), '{w}')" for w in words) + f" THEN '{fam}'" for words, fam in X.FAMILY_FRAGMENTS)


def _family_sql(col):
    return f"coalesce({_ALIAS}[lower(trim({col}))], CASE WHEN trim({col}) = '' THEN '' {_FRAG.format(col)} ELSE trim({col}) END)"


@query(
    "family_labels",
    with_sql(SIG, tail=f"SELECT series_id, family AS label, {_family_sql('family')} AS family, count(*) AS signals FROM sig GROUP BY ALL"),
)
def family_labels(spark, sf):
    rows = signals(spark, sf).select(KEY, F.explode("preferred_families").alias("p")).select(KEY, F.col("p.family").alias("label"))
    return rows.groupBy(KEY, "label", X.canonical_family(F.col("label")).alias("family")).agg(F.count(F.lit(1)).alias("signals"))


FAMS = "fams AS (SELECT unnest(" + str(X.FAMILIES) + ") AS family, unnest(range(6)) AS family_no)"
SUPPORT = f"""said AS (SELECT series_id, family, sum(p) AS positive, sum(q) AS negative FROM (
    SELECT series_id, {_family_sql('family')} AS family, dw * CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 2 END AS p, 0::DOUBLE AS q FROM sig
    UNION ALL SELECT series_id, against, 0, dw FROM sig WHERE doc_id % 4 = 0) WHERE family <> '' GROUP BY 1, 2),
grid AS (SELECT DISTINCT series_id, f.family, f.family_no FROM sig CROSS JOIN fams f),
sup AS (SELECT series_id, family, family_no, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(positive, 0) - coalesce(negative, 0) AS raw_support,
  positive IS NOT NULL AS evidence_available FROM grid LEFT JOIN said USING (series_id, family)),
nrm AS (SELECT *, CASE WHEN max(greatest(raw_support, 0)) OVER s > 0 THEN greatest(raw_support, 0) / max(greatest(raw_support, 0)) OVER s ELSE 0 END AS normalized_support FROM sup WINDOW s AS (PARTITION BY series_id))"""


@query(
    "family_support",
    with_sql(SIG, FAMS, SUPPORT, tail="""SELECT series_id, family, family_no, round(positive, 6) AS positive, round(negative, 6) AS negative, round(raw_support, 6) AS raw_support,
      round(normalized_support, 6) AS normalized_support, evidence_available, CASE WHEN NOT evidence_available THEN 'none' WHEN normalized_support >= 25e-2 THEN 'prefer'
       WHEN raw_support < 0 THEN 'deprioritize' ELSE 'conflict' END AS verdict FROM nrm"""),
)
def family_support(spark, sf):
    return rounded(M.family_support(signals(spark, sf)), ["positive", "negative", "raw_support", "normalized_support"])


@query(
    "family_discriminability",
    with_sql(SIG, FAMS, SUPPORT, tail="SELECT series_id, round(least(1, stddev_pop(normalized_support) / 5e-1), 6) AS discriminability FROM nrm GROUP BY 1"),
)
def family_discriminability(spark, sf):
    return rounded(M.discriminability(M.family_support(signals(spark, sf))), ["discriminability"])


@query(
    "preprocessing_prior",
    with_sql(SIG, """p AS (SELECT series_id, CASE lower(replace(transformation, '-', ' ')) WHEN 'log' THEN 'log_transform' WHEN 'log transform' THEN 'log_transform' WHEN 'difference' THEN 'differencing'
        WHEN 'seasonal differencing' THEN 'seasonal_differencing' ELSE transformation END AS transformation, CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END * dw AS w FROM sig),
      o AS (SELECT series_id, sum(obs) AS o FROM sig GROUP BY 1)""",
             tail="""SELECT series_id, transformation, round(w, 6) AS weight, CASE WHEN w >= 25e-1 THEN 'high' WHEN w >= 15e-1 THEN 'medium' ELSE 'low' END AS priority
               FROM (SELECT series_id, transformation, sum(w) / any_value(o) AS w FROM p JOIN o USING (series_id) GROUP BY 1, 2) WHERE w > 0"""),
)
def preprocessing_prior(spark, sf):
    return rounded(M.preprocessing_prior(signals(spark, sf)), ["weight"])


# ------------------------------------------------------------------ reliability, findings, spans

COUNTS = """cnt AS (SELECT series_id, count(*) AS documents_available, count(*) FILTER (doc_id % 10 <> 9) AS documents_selected,
  count(*) FILTER (doc_id % 10 <> 9 AND dc > 0) AS documents_seen FROM sig GROUP BY 1),
cov AS (SELECT *, CASE WHEN documents_available > 0 THEN least(1, documents_seen / documents_available::DOUBLE) ELSE 0 END AS evidence_coverage,
  CASE WHEN documents_selected > 0 THEN least(1, documents_seen / documents_selected::DOUBLE) ELSE 0 END AS selection_coverage FROM cnt)"""


def _counts(spark, sf):
    chosen = F.col("ord") % 10 != 9
    return signals(spark, sf).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("documents_available"),
        F.sum(chosen.cast("bigint")).alias("documents_selected"),
        F.sum((chosen & (F.col("domain_confidence") > 0)).cast("bigint")).alias("documents_seen"),
    )


@query(
    "evidence_coverage",
    with_sql(SIG, COUNTS, tail="SELECT series_id, documents_available, documents_selected, documents_seen, round(evidence_coverage, 6) AS evidence_coverage, round(selection_coverage, 6) AS selection_coverage FROM cov"),
)
def evidence_coverage(spark, sf):
    return rounded(M.coverage(_counts(spark, sf)), ["evidence_coverage", "selection_coverage"])


_PV = """cand AS (SELECT series_id, 'domain_parent' AS field, norm AS label, sum(weight) AS weight, sum(weight) AS total_weight, sum(obs) AS obs, min(ord) AS first_ord FROM lng WHERE field = 'domain_parent' GROUP BY 1, 2, 3
   UNION ALL SELECT series_id, 'temporal_granularity', norm, sum(weight), sum(weight), sum(obs), min(ord) FROM lng WHERE field = 'temporal_granularity' GROUP BY 1, 2, 3)"""


@query(
    "prior_strength",
    with_sql(SIG, COUNTS, FAMS, SUPPORT, _long_sql(M.EXACT_FIELDS), _PV, VOTE.format(thr="2e-1"), """smr AS (SELECT c.series_id, c.evidence_coverage AS ec, documents_seen, d.confidence AS dc, d.agreement AS da, g.agreement AS ea,
        n_pref, n_conf, n_fam FROM cov c JOIN res d ON d.series_id = c.series_id AND d.field = 'domain_parent' JOIN res g ON g.series_id = c.series_id AND g.field = 'temporal_granularity'
        JOIN (SELECT series_id, count(*) FILTER (evidence_available AND normalized_support >= 25e-2) AS n_pref, count(*) FILTER (evidence_available) AS n_fam,
          count(*) FILTER (evidence_available AND normalized_support < 25e-2 AND raw_support >= 0) AS n_conf FROM nrm GROUP BY 1) f ON f.series_id = c.series_id),
      rel AS (SELECT *, CASE WHEN n_fam > 0 THEN n_conf / n_fam::DOUBLE ELSE 0 END AS cr FROM smr),
      sc AS (SELECT *, CASE WHEN n_pref > 0 AND documents_seen > 0 THEN (5e-1 * dc + 3e-1 * da + 2e-1 * ec) * CASE WHEN cr > 5e-1 THEN 5e-1 ELSE 1 END * dc ELSE 0 END AS r FROM rel)""",
             tail="""SELECT series_id, round(cr, 6) AS family_conflict_ratio, round(r, 6) AS reliability_score, CASE WHEN n_pref = 0 OR documents_seen = 0 OR dc = 0 OR ec = 0 OR ea < 3e-1 THEN 'none'
        WHEN r >= 7e-1 THEN 'high' WHEN r >= 4e-1 THEN 'medium' WHEN r > 0 THEN 'low' ELSE 'none' END AS prior_strength,
        CASE WHEN r >= 7e-1 THEN 'high' WHEN r >= 4e-1 THEN 'medium' ELSE 'low' END AS domain_prior_reliability FROM sc"""),
)
def prior_strength(spark, sf):
    sig = signals(spark, sf)
    votes = M.exact_vote(M.long_fields(sig, {"domain_parent": "domain", "temporal_granularity": "target"}))
    one = lambda f, c, name: F.max(F.when(F.col("field") == f, F.col(c))).alias(name)
    wide = votes.groupBy(KEY).agg(
        one("domain_parent", "confidence", "domain_confidence"), one("domain_parent", "agreement", "domain_agreement"), one("temporal_granularity", "agreement", "entity_agreement")
    )
    verdict = lambda v: F.sum((F.col("verdict") == v).cast("bigint"))
    fams = M.family_support(sig).groupBy(KEY).agg(
        verdict("prefer").alias("n_preferred"), verdict("conflict").alias("n_conflicts"), F.sum(F.col("evidence_available").cast("bigint")).alias("n_families")
    )
    summary = M.coverage(_counts(spark, sf)).join(wide, KEY).join(fams, KEY)
    out = M.prior_strength(summary).select(KEY, "family_conflict_ratio", "reliability_score", "prior_strength", "domain_prior_reliability")
    return rounded(out, ["family_conflict_ratio", "reliability_score"])


@query(
    "distinct_findings",
    with_sql(SIG, "u AS (SELECT series_id, ord, unnest([lang || ' demand grows', 'report of ' || source]) AS finding, unnest([0, 1]) AS no FROM sig)",
             tail="SELECT series_id, finding, arg_min(ord, (ord, no)) AS first_ord, arg_min(no, (ord, no))::BIGINT AS first_no FROM u GROUP BY 1, 2"),
)
def distinct_findings(spark, sf):
    return M.distinct_findings(signals(spark, sf))


@query(
    "evidence_date_span",
    with_sql(SIG, tail="""SELECT series_id, strftime(min(DATE '1995-01-01' + CAST(doc_id % 2400 AS INT)), '%Y-%m-%d') AS source_date_start,
      strftime(max(DATE '1995-01-01' + CAST(doc_id % 2400 AS INT) + 9) FILTER (doc_id % 6 <> 0), '%Y-%m-%d') AS source_date_end, sum(doc_id % 3)::BIGINT AS excluded_claims, count(*) AS signals FROM sig GROUP BY 1"""),
)
def evidence_date_span(spark, sf):
    return M.evidence_span(signals(spark, sf))


@query(
    "chunk_quality",
    with_sql(SIG, """r AS (SELECT series_id, chunk_index, CASE WHEN doc_id % 5 <> 0 THEN greatest(0, least(1, (doc_id % 13)::DOUBLE / 10)) END AS rel,
        ((primary_entity <> 'unknown')::INT + (measure <> 'unknown')::INT + (physical_quantity <> 'unknown')::INT + (temporal_granularity <> 'unknown')::INT) / 4e0 AS s,
        (1 + (primary_entity <> 'unknown')::INT + (physical_quantity <> 'unknown')::INT) / 3e0 AS c,
        CASE WHEN primary_entity <> 'unknown' THEN lower(primary_entity) END AS e, CASE WHEN doc_id % 200 < 100 THEN 'national electricity grid operator' END AS x FROM sig)""",
             tail="""SELECT series_id, chunk_index, round(coalesce(avg(rel), 5e-1), 6) AS source_reliability, round(avg(s), 6) AS specificity,
        round(CASE WHEN count(x) > 0 AND count(e) > 0 THEN max((e = x)::INT) WHEN count(DISTINCT e) > 1 THEN 1e0 / count(DISTINCT e) ELSE 5e-1 END, 6) AS entity_consistency, round(avg(c), 6) AS coherence
        FROM r GROUP BY 1, 2"""),
)
def chunk_quality(spark, sf):
    return rounded(M.chunk_quality(signals(spark, sf)), ["source_reliability", "specificity", "entity_consistency", "coherence"])


@query(
    "operational_signals",
    with_sql(SIG, tail="SELECT series_id, count(*) AS signals, count(*) FILTER (dc > 0 OR tc > 0 OR doc_id % 3 = 0 OR trim(family) <> '' OR doc_id % 4 = 0) AS operational FROM sig GROUP BY 1"),
)
def operational_signals(spark, sf):
    sig = signals(spark, sf).withColumn("textual_findings", F.when(F.col("ord") % 3 == 0, F.col("textual_findings")))
    return sig.groupBy(KEY).agg(F.count(F.lit(1)).alias("signals"), F.sum(M.is_operational(sig).cast("bigint")).alias("operational"))


# ------------------------------------------------------------------ target resolution

CANDQ = f"""q AS (SELECT *, {LABEL.replace('lower(s)', 'lower(physical_quantity)').replace('s IS NULL', 'physical_quantity IS NULL')} AS norm FROM sig),
ck AS (SELECT series_id, chunk_index, (sum(dc) + sum(tc)) / (2 * count(*)) AS mean, count(DISTINCT norm) FILTER (norm NOT IN ('unknown', 'none', 'null')) AS k FROM q GROUP BY 1, 2),
qc AS (SELECT DISTINCT series_id, chunk_index, norm, mean / k AS weight FROM q JOIN ck USING (series_id, chunk_index) WHERE norm NOT IN ('unknown', 'none', 'null')),
hy AS (SELECT series_id, norm AS quantity, sum(weight) / sum(sum(weight)) OVER (PARTITION BY series_id) AS support, count(*) AS chunks FROM qc GROUP BY 1, 2)"""


def _hypotheses(spark, sf):
    return M.quantity_hypotheses(M.quantity_candidates(signals(spark, sf)))


@query("quantity_hypotheses", with_sql(SIG, CANDQ, tail="SELECT series_id, quantity, round(support, 6) AS support, chunks FROM hy"))
def quantity_hypotheses(spark, sf):
    return rounded(_hypotheses(spark, sf), ["support"])


RES = """p AS (SELECT series_id, max(support) AS pr, arg_min(quantity, (-support, quantity)) AS quantity, sum(support) AS al, count(*) FILTER (support >= 15e-2) AS m FROM hy WHERE support > 0 GROUP BY 1),
s2 AS (SELECT hy.series_id, max(support) AS sec FROM hy JOIN p ON p.series_id = hy.series_id AND p.quantity <> hy.quantity WHERE support > 0 GROUP BY 1),
tgt AS (SELECT series_id, avg(tc) AS c, 1 - avg((doc_id % 10 = 0)::INT) AS a FROM sig GROUP BY 1),
st AS (SELECT t.series_id, p.quantity, coalesce(pr, 0) AS pr, coalesce(sec, 0) AS sec, coalesce(al - pr, 0) AS alt, coalesce(pr, 0) - coalesce(sec, 0) AS mg,
  (coalesce(m, 0) - (coalesce(pr, 0) >= 15e-2)::INT)::BIGINT AS mat, CASE WHEN pr IS NULL THEN 0 ELSE 1 - pr END AS cf, c * a AS rl, a FROM tgt t LEFT JOIN p USING (series_id) LEFT JOIN s2 USING (series_id)),
fin AS (SELECT *, CASE WHEN quantity IS NULL THEN 'unavailable' WHEN pr < 5e-1 OR mg < 15e-2 OR cf >= 6e-1 OR a < 35e-2 THEN 'unresolved'
   WHEN pr >= 75e-2 AND mg >= 4e-1 AND a >= 7e-1 AND rl >= 55e-2 AND round(cf, 12) <= 2e-1 AND round(alt, 12) <= 2e-1 AND mat = 0 THEN 'resolved'
   WHEN pr >= 65e-2 AND mg >= 3e-1 AND a >= 55e-2 AND rl >= 4e-1 AND round(cf, 12) <= 35e-2 AND round(alt, 12) <= 35e-2 AND mat >= 1 THEN 'resolved_with_material_alternatives'
   ELSE 'weakly_resolved' END AS status FROM st)"""


@query(
    "target_resolution",
    with_sql(SIG, CANDQ, RES, tail="""SELECT series_id, quantity, round(pr, 6) AS "primary", round(sec, 6) AS second, round(alt, 6) + 0 AS alternative_total, round(mg, 6) AS margin, mat AS material, round(cf, 6) AS conflict,
      round(rl, 6) AS reliability, status, CASE status WHEN 'resolved' THEN 1e0 WHEN 'resolved_with_material_alternatives' THEN 7e-1 WHEN 'weakly_resolved' THEN 4e-1 WHEN 'unresolved' THEN 1e-1 ELSE 0 END AS score,
      CASE status WHEN 'resolved' THEN 'low' WHEN 'resolved_with_material_alternatives' THEN 'medium' ELSE 'high' END AS ambiguity, 'low' AS previous_ambiguity, status <> 'resolved' AS corrected FROM fin"""),
)
def target_resolution(spark, sf):
    sig = signals(spark, sf)
    targets = sig.groupBy(KEY).agg(
        F.avg("target_confidence").alias("target_confidence"), (1 - F.avg((F.col("ord") % 10 == 0).cast("double"))).alias("target_agreement")
    )
    out = M.corrected_ambiguity(M.resolution_status(_hypotheses(spark, sf), targets), F.lit("low"))
    return rounded(out, ["primary", "second", "alternative_total", "margin", "conflict", "reliability"])


@query(
    "target_labels",
    with_sql(SIG, """t AS (SELECT ord, lower(temporal_granularity) AS g, CASE measure WHEN 'total amount' THEN 'total' WHEN 'average value' THEN 'average' ELSE measure END AS m, lower(primary_entity) AS e FROM sig)""",
             tail="""SELECT ord, CASE WHEN l = '' THEN 'unknown' ELSE upper(l[1]) || l[2:] END AS label FROM (SELECT ord, concat_ws(' ', CASE WHEN g <> 'unknown' THEN g END, CASE WHEN m <> 'unknown' THEN m END, CASE WHEN e <> 'unknown' THEN e END) AS l FROM t)"""),
)
def target_labels(spark, sf):
    return signals(spark, sf).select("ord", X.target_label(F.col("primary_entity"), F.col("measure"), F.col("temporal_granularity")).alias("label"))


@query(
    "value_type_names",
    with_sql(SIG, tail="""SELECT value_type, transformation, CASE value_type WHEN 'other' THEN 'unknown' WHEN 'count' THEN 'count' ELSE 'continuous' END AS quantity_type,
      CASE transformation WHEN 'log' THEN 'log_transform' WHEN 'Log-Transform' THEN 'log_transform' WHEN 'normalise' THEN 'normalise' WHEN 'difference' THEN 'differencing' ELSE 'seasonal_differencing' END AS canonical,
      count(*) AS signals FROM sig GROUP BY 1, 2"""),
)
def value_type_names(spark, sf):
    rows = signals(spark, sf).select("value_type", F.explode("preprocessing_prior").alias("p")).select("value_type", "p.transformation")
    out = rows.groupBy("value_type", "transformation").agg(F.count(F.lit(1)).alias("signals"))
    return out.withColumn("quantity_type", X.canonical_value_type(F.col("value_type"))).withColumn("canonical", X.canonical_transformation(F.col("transformation")))


# ------------------------------------------------------------------ raw JSON


def raw_signals(spark, sf):
    """Signals as noisy model output; some rows break the contract on purpose."""
    s = signals(spark, sf)
    prior = lambda pref: F.struct(pref.alias("preferred_model_families"), F.col("deprioritized_families").alias("families_to_deprioritize"))
    target = F.struct("primary_entity", "spatial_scope", "measure", "physical_quantity", "temporal_granularity", "target_confidence")
    domain = F.struct("domain_label", "domain_parent", "domain_concepts")
    fields = [domain.alias("domain_interpretation"), F.col("inferred_domain"), F.col("domain_confidence"), target.alias("target_interpretation"),
              prior(F.col("preferred_families")).alias("model_family_prior"), F.col("textual_findings").alias("textual_evidence_findings")]
    good = F.to_json(F.struct(*fields))
    extra = F.to_json(F.struct(*fields, F.lit(1).alias("confidence_note")))
    lean = F.to_json(F.struct(*fields[:3], F.struct("primary_entity", "measure").alias("target_interpretation"), *fields[4:]))
    k = F.col("ord")
    text = (
        F.when(k % 41 == 0, F.concat(F.lit("no object: "), F.col("inferred_domain")))
        .when(k % 43 == 0, extra)
        .when(k % 47 == 0, lean)
        .when(k % 3 == 0, F.concat(F.lit("Here is the result:\n"), good, F.lit("\nDone.")))
        .otherwise(good)
    )
    return s.select(KEY, "ord", text.alias("json"))


@query(
    "signal_json_contract",
    with_sql(SIG, tail="""SELECT series_id, coalesce(problem, 'ok') AS problem, count(*) AS signals FROM (SELECT series_id, CASE WHEN doc_id % 41 = 0 THEN 'not_json' WHEN doc_id % 43 = 0 THEN 'output'
      WHEN doc_id % 47 = 0 THEN 'target_interpretation' END AS problem FROM sig) GROUP BY 1, 2"""),
)
def signal_json_contract(spark, sf):
    rows = raw_signals(spark, sf)
    problem = S.schema_problem(S.json_object(F.col("json")))
    return rows.groupBy(KEY, F.coalesce(problem, F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("signals"))


@query(
    "signal_json_parse",
    with_sql(SIG, tail="""SELECT series_id, ord, domain_label, measure, round(dc, 6) AS domain_confidence, trim(family) = '' AS blank_family FROM sig
      WHERE doc_id % 41 <> 0 AND doc_id % 43 <> 0 AND doc_id % 47 <> 0"""),
)
def signal_json_parse(spark, sf):
    out = S.parse(raw_signals(spark, sf))
    first = F.element_at("signal.model_family_prior.preferred_model_families", 1)
    return out.select(
        KEY, "ord", "signal.domain_interpretation.domain_label", "signal.target_interpretation.measure",
        F.round("signal.domain_confidence", 6).alias("domain_confidence"), (X.strip(first["family"]) == "").alias("blank_family"),
    )


@query(
    "family_prior_clean_up",
    with_sql(SIG, f"""ok AS (SELECT * FROM sig WHERE doc_id % 41 <> 0 AND doc_id % 43 <> 0 AND doc_id % 47 <> 0),
      e AS (SELECT series_id, 'preferred' AS role, family AS original FROM ok UNION ALL SELECT series_id, 'deprioritized', against FROM ok WHERE doc_id % 4 = 0),
      c AS (SELECT *, {_family_sql("replace(original, '_', ' ')")} AS cf FROM e)""",
             tail=f"""SELECT series_id, role, original, CASE WHEN cf IN {tuple(X.FAMILIES)} THEN cf END AS family,
        CASE WHEN cf NOT IN {tuple(X.FAMILIES)} THEN 'unknown_family_excluded' WHEN cf <> trim(original) THEN 'alias_normalized' ELSE 'canonical' END AS status, count(*) AS statements FROM c GROUP BY ALL"""),
)
def family_prior_clean_up(spark, sf):
    rows = S.family_diagnostics(S.parse(raw_signals(spark, sf)))
    return rows.groupBy(KEY, "role", "original", "family", "status").agg(F.count(F.lit(1)).alias("statements"))


@query("statement_sanitising")
def statement_sanitising(spark, sf):
    rows = S.sanitized_statements(S.parse(raw_signals(spark, sf)))
    return rows.groupBy("role", "reason", "clean_reason", F.array_join("claims", ",").alias("claims"), "operational").agg(F.count(F.lit(1)).alias("statements"))
