"""Documents: parsing, validation, ranges, selection, chunks, facts and compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as T
from ..functions import text as X
from ..operators import documents as C
from ..operators import split as J
from .panels import MONTHLY, POS, SPLIT, monthly, table, with_sql
from .q_panel import SPEC, rounded
from .registry import query

SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def raw_documents(spark, sf):
    """Every document with a written interval; some rows are broken on purpose."""
    d = table(spark, sf, "documents")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") * 37 % 2400).cast("int"))
    end = F.when(F.col("doc_id") % 29 == 0, F.date_sub(start, 1)).otherwise(F.date_add(start, (F.col("doc_id") % 7).cast("int")))
    names = F.array(*[F.lit(s) for s in SERIES])
    return d.select(
        "doc_id",
        F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("series_id"),
        F.when(F.col("doc_id") % 31 == 0, "n/a").otherwise(F.date_format(start, "yyyy-MM-dd")).alias("start_date"),
        F.date_format(end, "yyyy-MM-dd").alias("end_date"),
        "source",
        F.when(F.col("doc_id") % 37 == 0, "").otherwise(F.col("text")).alias("facts"),
    )


def good_documents(spark, sf):
    return C.accepted(C.validate(raw_documents(spark, sf)))


WS = r"[\s\x0B\x{85}\p{Z}]"
RAW = f"""raw AS (SELECT doc_id, {SERIES}[doc_id % 5 + 1] AS series_id,
  CASE WHEN doc_id % 31 = 0 THEN 'n/a' ELSE strftime(DATE '1995-01-01' + CAST(doc_id * 37 % 2400 AS INT), '%Y-%m-%d') END AS start_text,
  CASE WHEN doc_id % 29 = 0 THEN DATE '1995-01-01' + CAST(doc_id * 37 % 2400 AS INT) - 1
       ELSE DATE '1995-01-01' + CAST(doc_id * 37 % 2400 AS INT) + CAST(doc_id % 7 AS INT) END AS end_date,
  source, regexp_replace(CASE WHEN doc_id % 37 = 0 THEN '' ELSE text END, '^{WS}+|{WS}+$', '', 'g') AS facts FROM documents)"""
VALID = """val AS (SELECT *, try_strptime(start_text, '%Y-%m-%d')::DATE AS start_date, end_date AS date,
  CASE WHEN try_strptime(start_text, '%Y-%m-%d') IS NULL THEN 'invalid_start_date' WHEN try_strptime(start_text, '%Y-%m-%d')::DATE > end_date THEN 'invalid_interval_order'
       WHEN facts = '' THEN 'missing_semantic_text' END AS drop_reason FROM raw),
docs AS (SELECT * FROM val WHERE drop_reason IS NULL)"""

# ------------------------------------------------------------------ parsing


@query(
    "tolerant_date_parse",
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
    SELECT o_orderkey, CASE k WHEN 4 THEN date_trunc('month', d)::DATE WHEN 5 THEN NULL ELSE d END AS date FROM t""",
)
def tolerant_date_parse(spark, sf):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(k == 1, F.concat(F.lit(" "), F.date_format(day, "yyyy/MM/dd"), F.lit(" ")))
        .when(k == 2, F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".0")))
        .when(k == 3, F.date_format(day, "MMM d, yyyy"))
        .when(k == 4, F.date_format(day, "yyyyMM"))
        .otherwise("not a date")
    )
    return table(spark, sf, "orders").select("o_orderkey", T.tolerant_timestamp(text).cast("date").alias("date"))


@query(
    "strict_interval_endpoints",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
      WHEN 2 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' ELSE '1999-02-30' END AS s FROM orders)
    SELECT o_orderkey, try_strptime(trim(s), '%Y-%m-%d')::DATE AS date FROM t""",
)
def strict_interval_endpoints(spark, sf):
    k = F.col("o_orderkey") % 4
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k == 0, iso).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.concat(F.lit(" "), iso, F.lit(" "))).otherwise("1999-02-30")
    return table(spark, sf, "orders").select("o_orderkey", T.strict_date(text).alias("date"))


@query(
    "target_coercion",
    """WITH t AS (SELECT o_orderkey, o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
      CASE WHEN o_orderkey % 50 = 0 THEN 'n.a.' WHEN o_orderkey % 51 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS s FROM orders)
    SELECT series_id, count(*) AS kept, round(sum(TRY_CAST(s AS DOUBLE)), 2) AS total FROM t WHERE TRY_CAST(s AS DOUBLE) IS NOT NULL AND date IS NOT NULL GROUP BY 1""",
)
def target_coercion(spark, sf):
    text = F.when(F.col("o_orderkey") % 50 == 0, "n.a.").when(F.col("o_orderkey") % 51 == 0, None).otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"), T.to_number(text).alias("target")
    )
    rows = rows.dropna(subset=["date", "target"])
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("target"), 2).alias("total"))


# ------------------------------------------------------------------ validation and ranges


@query(
    "document_validation",
    with_sql(RAW, VALID, tail="SELECT doc_id, series_id, start_date, end_date, date, drop_reason, length(facts) AS characters FROM val"),
)
def document_validation(spark, sf):
    out = C.validate(raw_documents(spark, sf))
    return out.select("doc_id", "series_id", "start_date", "end_date", "date", "drop_reason", F.length("facts").cast("bigint").alias("characters"))


@query(
    "document_drop_audit",
    with_sql(RAW, VALID, tail="""SELECT source, count(*) AS input_rows, count(*) FILTER (drop_reason IS NULL) AS accepted_rows,
      count(drop_reason) AS dropped_rows, 0::BIGINT AS missing_temporal_interval_columns, count(*) FILTER (drop_reason = 'invalid_start_date') AS invalid_start_date,
      count(*) FILTER (drop_reason = 'invalid_end_date') AS invalid_end_date, count(*) FILTER (drop_reason = 'invalid_interval_order') AS invalid_interval_order,
      count(*) FILTER (drop_reason = 'missing_semantic_text') AS missing_semantic_text FROM val GROUP BY ROLLUP (source)"""),
)
def document_drop_audit(spark, sf):
    return C.drop_audit(C.validate(raw_documents(spark, sf)))


@query(
    "point_interval_documents",
    with_sql(RAW, tail="""SELECT doc_id, end_date AS date, CASE WHEN facts = '' THEN 'missing_semantic_text' END AS drop_reason FROM raw"""),
)
def point_interval_documents(spark, sf):
    return C.validate(raw_documents(spark, sf).drop("start_date")).select("doc_id", "date", "drop_reason")


@query(
    "semantic_text_join",
    """WITH p AS (SELECT doc_id, trim(coalesce(lang, '')) AS a, CASE WHEN doc_id % 9 = 0 THEN 'NaN' ELSE source END AS b, text AS c FROM documents)
    SELECT doc_id, concat_ws(' | ', CASE WHEN a <> '' THEN 'FACT: ' || a END, CASE WHEN lower(b) <> 'nan' AND b <> '' THEN 'PREDICTION: ' || b END,
      nullif(regexp_replace(c, '^""" + WS + "+|" + WS + """+$', '', 'g'), '')) AS facts FROM p""",
)
def semantic_text_join(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("fact"),
        F.when(F.col("doc_id") % 9 == 0, "NaN").otherwise(F.col("source")).alias("prediction"),
        F.col("text").alias("content"),
    )
    return d.select("doc_id", X.join_text(["fact", "prediction", "content"]).alias("facts"))


@query(
    "documents_in_series_range",
    with_sql(MONTHLY, RAW, VALID, "b AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1)",
             tail="""SELECT series_id, count(*) AS documents, count(*) FILTER (docs.date < lo OR docs.date > hi) AS outside FROM docs JOIN b USING (series_id) GROUP BY 1"""),
)
def documents_in_series_range(spark, sf):
    rows = C.mark_in_range(good_documents(spark, sf), monthly(spark, sf))
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("documents"), F.sum((~F.col("in_range")).cast("bigint")).alias("outside"))


ENDS = """e AS (SELECT series_id, max(date) FILTER (split = 'train') AS te, max(date) FILTER (split = 'validation') AS ve,
  max(date) FILTER (split <> 'test') AS se FROM parts GROUP BY 1)"""


@query(
    "document_partitions",
    with_sql(MONTHLY, POS, SPLIT, RAW, VALID, ENDS,
             tail="""SELECT doc_id, series_id, CASE WHEN docs.date <= te THEN 'train' WHEN docs.date <= ve THEN 'validation' ELSE 'after_validation' END AS partition,
               docs.date <= se AS before_test FROM docs JOIN e USING (series_id)"""),
)
def document_partitions(spark, sf):
    parts = J.chronological(monthly(spark, sf), SPEC)
    return C.assign_partition(good_documents(spark, sf), parts).select("doc_id", "series_id", "partition", "before_test")


@query(
    "document_leakage_guard",
    with_sql(MONTHLY, POS, SPLIT, RAW, VALID, ENDS,
             tail="SELECT series_id, count(*) AS leaking, min(docs.date) AS first_leak FROM docs JOIN e USING (series_id) WHERE docs.date > te GROUP BY 1"),
)
def document_leakage_guard(spark, sf):
    parts = J.chronological(monthly(spark, sf), SPEC)
    return C.leaks(good_documents(spark, sf), parts).groupBy("series_id").agg(F.count(F.lit(1)).alias("leaking"), F.min("date").alias("first_leak"))


@query("undated_documents", with_sql(RAW, VALID, tail="SELECT count(*) AS documents, count(*) - count(date) AS undated FROM docs"))
def undated_documents(spark, sf):
    return C.undated(C.require_dates(good_documents(spark, sf)))


# ------------------------------------------------------------------ selection and chunks

MAX_DOCS = 60


@query(
    "recent_balanced_documents",
    with_sql(RAW, VALID, f"""s AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS total, row_number() OVER (PARTITION BY series_id, source ORDER BY date DESC, doc_id DESC) AS rs FROM docs),
      q AS (SELECT s.*, CASE WHEN k > 1 THEN greatest(1, {MAX_DOCS} // k) ELSE 0 END AS quota FROM s JOIN (SELECT series_id, count(DISTINCT source) AS k FROM docs GROUP BY 1) USING (series_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rs > quota, date DESC, doc_id DESC) AS rk FROM q)""",
             tail=f"SELECT series_id, doc_id, source, date FROM r WHERE rk <= {MAX_DOCS}"),
)
def recent_balanced_documents(spark, sf):
    return C.recent_balanced(good_documents(spark, sf), MAX_DOCS).select("series_id", "doc_id", "source", "date")


for _name, _old in (("newest", False), ("oldest", True)):
    _dir = "" if _old else "DESC"
    query(
        f"{_name}_documents",
        with_sql(RAW, VALID, tail=f"SELECT series_id, doc_id, date FROM docs QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date {_dir}, doc_id {_dir}) <= 25"),
    )(lambda spark, sf, _old=_old: C.newest(good_documents(spark, sf), 25, _old).select("series_id", "doc_id", "date"))


CHUNKS = "ch AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date, doc_id) - 1 AS doc_pos FROM docs), chunked AS (SELECT *, doc_pos // 100 AS chunk FROM ch)"


@query("document_chunks", with_sql(RAW, VALID, CHUNKS, tail="SELECT series_id, chunk, count(*) AS documents, min(date) AS first_date, max(date) AS last_date FROM chunked GROUP BY 1, 2"))
def document_chunks(spark, sf):
    rows = C.chunked(good_documents(spark, sf), 100)
    return rows.groupBy("series_id", "chunk").agg(F.count(F.lit(1)).alias("documents"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(
    "chunk_character_budget",
    with_sql(RAW, VALID, CHUNKS, f"""t AS (SELECT series_id, chunk, doc_pos, date, regexp_replace(replace(facts, '\\n', ' '), '^{WS}+|{WS}+$', '', 'g') AS x FROM chunked),
      c AS (SELECT *, greatest(1, least(2000, 24000 // count(*) OVER (PARTITION BY series_id, chunk))) AS cap FROM t WHERE x <> '')""",
             tail="""SELECT series_id, chunk, count(*) AS documents, max(cap) AS cap, sum(length(x[1:cap]))::BIGINT AS characters,
               md5(string_agg(strftime(date, '%Y-%m-%d') || x[1:cap], '' ORDER BY doc_pos)) AS digest FROM c GROUP BY 1, 2"""),
)
def chunk_character_budget(spark, sf):
    out = C.chunk_payloads(C.chunked(good_documents(spark, sf), 100), 2000, 24000)
    parsed = F.from_json("payload", "array<struct<date:string,text:string>>")
    digest = F.md5(F.array_join(F.transform(parsed, lambda r: F.concat(r["date"], r["text"])), ""))
    return out.select("series_id", "chunk", "documents", "cap", F.col("characters").cast("bigint").alias("characters"), digest.alias("digest"))


# ------------------------------------------------------------------ facts

FACTS = rf"""pieces AS (SELECT series_id, doc_id, date, generate_subscripts(p, 1) - 1 AS fact_no, unnest(p) AS f0 FROM (
    SELECT series_id, doc_id, date, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(facts, '\n', chr(10)), '^{WS}+|{WS}+$', '', 'g'), '\||;|\n'),
      lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g'), '(?i)^available facts are as follows{WS}*:{WS}*', ''), '^[ \-.;]+|[ \-.;]+$', '', 'g')), lambda x: x <> '') AS p FROM docs)),
facts AS (SELECT series_id, doc_id, date, fact_no, f0 AS fact,
    trim(regexp_replace(regexp_replace(lower(f0), '\[source(\s*:[^\]]*)?\]', ' ', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS normalized FROM pieces),
ff AS (SELECT * FROM facts WHERE normalized <> '')"""


@query("document_facts", with_sql(RAW, VALID, FACTS, tail="SELECT series_id, doc_id, fact_no::BIGINT AS fact_no, md5(fact) AS fact, md5(normalized) AS normalized FROM ff"))
def document_facts(spark, sf):
    return C.facts(good_documents(spark, sf)).select(
        "series_id", "doc_id", F.col("fact_no").cast("bigint").alias("fact_no"), F.md5("fact").alias("fact"), F.md5("normalized").alias("normalized")
    )


@query(
    "exact_fact_dedupe",
    with_sql(RAW, VALID, FACTS, tail="""SELECT series_id, md5(normalized) AS normalized, count(*) AS occurrences, arg_min(doc_id, (date, doc_id, fact_no)) AS first_doc,
      md5(arg_min(fact, (date, doc_id, fact_no))) AS fact FROM ff GROUP BY series_id, ff.normalized"""),
)
def exact_fact_dedupe(spark, sf):
    out = C.exact_facts(C.facts(good_documents(spark, sf))).drop("fact_id")
    return out.withColumn("normalized", F.md5("normalized")).withColumn("fact", F.md5("fact"))


REPS = """per AS (SELECT series_id, normalized, doc_id, any_value(date) AS date, min(fact_no) AS fact_no, arg_min(fact, fact_no) AS fact FROM ff GROUP BY 1, 2, 3),
reps AS (SELECT series_id, normalized, arg_min(doc_id, (date, doc_id)) AS doc_id, arg_min(fact_no, (date, doc_id)) AS fact_no,
    arg_min(fact, (date, doc_id)) || CASE WHEN count(*) > 1 THEN ' [represented in ' || count(*) || ' documents; ' || strftime(min(date), '%Y-%m-%d') || ' to '
      || strftime(max(date), '%Y-%m-%d') || ']' ELSE '' END AS fact FROM per GROUP BY 1, 2)"""


@query(
    "exact_document_compression",
    with_sql(RAW, VALID, FACTS, REPS, tail="""SELECT docs.series_id, docs.doc_id, md5(coalesce(t, '')) AS compacted, length(coalesce(t, '')) AS characters FROM docs
      LEFT JOIN (SELECT series_id, doc_id, string_agg(fact, '; ' ORDER BY fact_no) AS t FROM reps GROUP BY 1, 2) USING (series_id, doc_id)"""),
)
def exact_document_compression(spark, sf):
    out = C.compress(good_documents(spark, sf))
    return out.select("series_id", "doc_id", F.md5("compacted").alias("compacted"), F.length("compacted").cast("bigint").alias("characters"))


@query(
    "exact_compression_audit",
    with_sql(RAW, VALID, FACTS, REPS, tail="""SELECT d.*, round(greatest(0, least(1, 1 - compacted_characters / original_characters::DOUBLE)), 6) AS compression_ratio FROM (
      SELECT series_id, documents_input, documents_with_evidence, facts_input, unique_facts, facts_input - unique_facts AS exact_duplicates_removed, 0::BIGINT AS near_duplicates_removed,
        original_characters, compacted_characters
      FROM (SELECT series_id, count(*) AS documents_input, sum(length(facts))::BIGINT AS original_characters FROM docs GROUP BY 1)
      JOIN (SELECT series_id, count(*) AS facts_input, count(DISTINCT normalized) AS unique_facts FROM ff GROUP BY 1) USING (series_id)
      JOIN (SELECT series_id, count(*) AS documents_with_evidence, sum(c)::BIGINT AS compacted_characters FROM
            (SELECT series_id, doc_id, sum(length(fact)) + 2 * (count(*) - 1) AS c FROM reps GROUP BY 1, 2) GROUP BY 1) USING (series_id)) d"""),
)
def exact_compression_audit(spark, sf):
    return rounded(C.compression_audit(good_documents(spark, sf)), ["compression_ratio"])


@query("near_duplicate_facts")
def near_duplicate_facts(spark, sf):
    unique = C.exact_facts(C.facts(good_documents(spark, sf)))
    out = C.fact_components(unique)
    size = out.groupBy("series_id", "component").agg(F.count(F.lit(1)).alias("members"))
    return size.filter(F.col("members") > 1)


@query("near_duplicate_compression_audit")
def near_duplicate_compression_audit(spark, sf):
    return rounded(C.compression_audit(good_documents(spark, sf), 0.90), ["compression_ratio"])


@query(
    "fact_ngram_frequencies",
    with_sql(RAW, VALID, FACTS, """w AS (SELECT DISTINCT series_id, unnest(string_split(normalized, ' ')) AS w FROM ff),
      k AS (SELECT series_id, w, k, unnest(range(1, greatest(1, length(w) + 3 - k) + 1)) AS i FROM w, (VALUES (2), (3), (4)) s(k) WHERE w <> '' AND (k = 2 OR length(w) + 2 >= k)),
      g AS (SELECT series_id, substr(' ' || w || ' ', i::BIGINT, k::BIGINT) AS gram, w FROM k)""",
             tail="SELECT series_id, md5(gram) AS gram, count(DISTINCT w) AS words FROM g GROUP BY series_id, g.gram"),
)
def fact_ngram_frequencies(spark, sf):
    from ..operators.similarity import word_ngrams

    rows = C.facts(good_documents(spark, sf))
    words = rows.select("series_id", F.explode(F.split("normalized", " ")).alias("w")).distinct()
    grams = words.select("series_id", "w", F.explode(F.array_distinct(word_ngrams(F.col("w"), 2, 4))).alias("gram"))
    return grams.groupBy("series_id", F.md5("gram").alias("gram")).agg(F.count(F.lit(1)).alias("words"))


# ------------------------------------------------------------------ text functions

LABEL = f"""CASE WHEN s IS NULL THEN 'unknown' ELSE coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(translate(lower(s), '_-', '  '),
   '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\x{{85}}\\p{{Z}}]', '', 'g'), '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g'), ''), 'unknown') END"""


@query(
    "semantic_label_normalisation",
    f"WITH t AS (SELECT doc_id, text AS s FROM documents), u AS (SELECT p_partkey, p_type || '_' || upper(p_name) || '-' || p_brand || '!!' AS s FROM part) "
    f"SELECT 'text' AS kind, doc_id AS id, md5({LABEL}) AS label FROM t UNION ALL SELECT 'part', p_partkey, md5({LABEL}) FROM u",
)
def semantic_label_normalisation(spark, sf):
    a = table(spark, sf, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.md5(X.normalize_label(F.col("text"))).alias("label"))
    p = F.concat("p_type", F.lit("_"), F.upper("p_name"), F.lit("-"), F.col("p_brand"), F.lit("!!"))
    b = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.md5(X.normalize_label(p)).alias("label"))
    return a.unionByName(b)


CLAIM_TEXTS = [
    "the time series is rather short and prices rose",
    "numerical data has many NA; demand fell",
    "sampling looks irregular and non-regular here",
    "the series is nonstationary; exports and imports grew",
    "dataset shows strong trend and weak trend; nothing else",
    "steady growth of demand",
]


def _claims(spark, sf):
    tail = F.element_at(F.array(*[F.lit(t) for t in CLAIM_TEXTS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("; "), tail).alias("finding"))


_FLAT = f"regexp_replace(regexp_replace(text || '; ' || {CLAIM_TEXTS}[doc_id % 6 + 1], '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


@query(
    "unsupported_claims",
    f"WITH t AS (SELECT doc_id, {_FLAT} AS s FROM documents) SELECT doc_id, "
    + " || ',' || ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{n}' ELSE '' END" for n, p in X.CLAIMS.items())
    + " AS categories FROM t",
)
def unsupported_claims(spark, sf):
    found = X.claim_categories(F.col("finding"))
    names = [F.when(F.array_contains(found, n), n).otherwise("") for n in X.CLAIMS]
    return _claims(spark, sf).select("doc_id", F.concat_ws(",", *names).alias("categories"))


_ANY = " OR ".join(f"regexp_matches(x, '{p}')" for p in X.CLAIMS.values())


@query(
    "claim_sanitising",
    f"""WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array({_FLAT}, '(?i)\\s*;\\s*|\\s+and\\s+'), lambda x: trim(x) <> ''), lambda x: regexp_replace(x, '^[ ,.]+|[ ,.]+$', '', 'g')) AS c FROM documents)
    SELECT doc_id, len(c) AS clauses, md5(array_to_string(list_filter(c, lambda x: NOT ({_ANY})), '; ')) AS kept FROM t""",
)
def claim_sanitising(spark, sf):
    rows = _claims(spark, sf).select("doc_id", X.clauses(F.col("finding")).alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("bigint").alias("clauses"), F.md5(X.unclaimed(F.col("parts"))).alias("kept"))


@query(
    "first_present_text",
    """SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), ''), nullif(trim(source), '')) AS text,
      CASE WHEN doc_id % 3 = 1 THEN source WHEN doc_id % 3 = 2 THEN lang ELSE 'unknown' END AS known FROM documents""",
)
def first_present_text(spark, sf):
    k = F.col("doc_id") % 3
    blank = F.when(k == 0, "  ").otherwise(F.col("lang"))
    first = F.when(k == 0, "NONE").when(k == 1, "Unknown").otherwise(F.col("lang"))
    second = F.when(k == 0, "null").otherwise(F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", X.first_present(blank, F.col("source")).alias("text"), X.first_known(first, second).alias("known")
    )
