"""Raw signal JSON: extraction from noisy text, schema checks and family clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

KEY = "series_id"
# fixed values: the fields of a signal, level by level
TOP_FIELDS = ["domain_confidence", "domain_interpretation", "inferred_domain", "model_family_prior", "target_interpretation", "textual_evidence_findings"]
DOMAIN_FIELDS = ["domain_concepts", "domain_label", "domain_parent"]
TARGET_FIELDS = ["measure", "physical_quantity", "primary_entity", "spatial_scope", "target_confidence", "temporal_granularity"]
PRIOR_FIELDS = ["families_to_deprioritize", "preferred_model_families"]
SIGNAL_SCHEMA = """
    domain_interpretation struct<domain_label string, domain_parent string, domain_concepts array<string>>,
    inferred_domain string, domain_confidence double,
    target_interpretation struct<primary_entity string, spatial_scope string, measure string, physical_quantity string,
        temporal_granularity string, target_confidence double>,
    model_family_prior struct<preferred_model_families array<struct<family string, priority string, reason string>>,
        families_to_deprioritize array<struct<family string, reason string>>>,
    textual_evidence_findings array<string>"""


def json_object(text: Column) -> Column:
    """The JSON object inside model output: the whole text, else from the first to the last brace."""
    whole = X.strip(text)
    inner = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    is_object = lambda t: F.json_object_keys(t).isNotNull()
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def _same(json: Column, fields: list[str]) -> Column:
    keys = F.array_sort(F.json_object_keys(json))
    return F.coalesce(keys == F.array(*[F.lit(f) for f in sorted(fields)]), F.lit(False))


def _is_list(json: Column) -> Column:
    return F.coalesce(json.startswith("["), F.lit(False))


def schema_problem(json: Column) -> Column:
    """First way in which a signal breaks the contract (missing or additional fields, wrong kinds), or null."""
    at = lambda path: F.get_json_object(json, path)
    pref, dep = at("$.model_family_prior.preferred_model_families"), at("$.model_family_prior.families_to_deprioritize")
    found = at("$.textual_evidence_findings")
    entry = lambda raw, fields: F.forall(
        F.from_json(raw, "array<string>"), lambda e: F.coalesce(F.array_sort(F.json_object_keys(e)) == F.array(*[F.lit(f) for f in fields]), F.lit(False))
    )
    return (
        F.when(json.isNull(), "not_json")
        .when(~_same(json, TOP_FIELDS), "output")
        .when(~_same(at("$.domain_interpretation"), DOMAIN_FIELDS), "domain_interpretation")
        .when(~_same(at("$.target_interpretation"), TARGET_FIELDS), "target_interpretation")
        .when(~_same(at("$.model_family_prior"), PRIOR_FIELDS), "model_family_prior")
        .when(~_is_list(pref), "preferred_model_families")
        .when(~_is_list(dep), "families_to_deprioritize")
        .when(~_is_list(found), "textual_evidence_findings")
        .when(~entry(pref, ["family", "priority", "reason"]), "preferred_model_families")
        .when(~entry(dep, ["family", "reason"]), "families_to_deprioritize")
    )


def parse(signals: DataFrame, json: str = "json") -> DataFrame:
    """Typed signal columns of the rows whose JSON keeps the contract."""
    good = signals.withColumn("_j", json_object(F.col(json))).filter(schema_problem(F.col("_j")).isNull())
    return good.withColumn("signal", F.from_json("_j", SIGNAL_SCHEMA)).drop("_j", json)


def family_diagnostics(signals: DataFrame) -> DataFrame:
    """Every family a signal names, its canonical family (null if excluded) and whether it was an alias."""
    prior = F.col("signal.model_family_prior")
    entries = F.concat(
        F.transform(prior["preferred_model_families"], lambda e: F.struct(F.lit("preferred").alias("role"), e["family"].alias("original"))),
        F.transform(prior["families_to_deprioritize"], lambda e: F.struct(F.lit("deprioritized").alias("role"), e["family"].alias("original"))),
    )
    rows = signals.select(KEY, "ord", F.explode(entries).alias("e")).select(KEY, "ord", "e.*")
    family = X.known_family(F.col("original"))
    return rows.withColumn("family", family).withColumn(
        "status",
        F.when(family.isNull(), "unknown_family_excluded").when(family != X.strip(F.col("original")), "alias_normalized").otherwise("canonical"),
    )


def sanitized_statements(signals: DataFrame) -> DataFrame:
    """Family statements whose reason survives the removal of unsupported claims, and the claims found."""
    prior = F.col("signal.model_family_prior")
    entries = F.concat(
        F.transform(prior["preferred_model_families"], lambda e: F.struct(F.lit("preferred").alias("role"), e["family"].alias("family"), e["reason"].alias("reason"))),
        F.transform(prior["families_to_deprioritize"], lambda e: F.struct(F.lit("deprioritized").alias("role"), e["family"].alias("family"), e["reason"].alias("reason"))),
    )
    rows = signals.select(KEY, "ord", F.explode(entries).alias("e")).select(KEY, "ord", "e.*")
    kept, claims = X.sanitize(F.col("reason"))
    return rows.withColumn("clean_reason", kept).withColumn("claims", claims).withColumn("operational", F.col("clean_reason") != "")
