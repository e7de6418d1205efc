"""A training corpus from raw documents, in five stages; each works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.decontaminate import contaminated_rows
from panelspark.llm.jaccard import jaccard_groups
from panelspark.llm.packing import pack_documents
from panelspark.llm.queries import read, tokenizer
from panelspark.llm.storage import written
from panelspark.llm.suffixes import without_repeats
from panelspark.llm.toxicity import scored_rows

#: SQL can express neither the toxicity model nor the packing.
ORACLE_SQL = None


def _keep(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone`` (doc_id, row_hash): same doc_id, null or not, and same text."""
    text = F.xxhash64(F.coalesce(F.col("d.text").cast("string"), F.lit("")))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (text == F.col("g.row_hash"))
    return docs.alias("d").join(gone.select("doc_id", "row_hash").distinct().alias("g"), same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't predicted toxic, rows without doc_id and each row of a repeated doc_id by their own text.

    Null texts are empty and stay; no rows give no rows; other columns may have any name.
    """
    judged = scored_rows(docs, read(spark, sf_dir, "labels"))
    return _keep(docs, judged.filter("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id.

    The rows of one doc_id are one document, which stays or goes as a whole.  Rows without doc_id
    are in no group and stay, as do null texts and those without words; no rows give no rows.
    """
    groups = jaccard_groups(docs)
    others = groups.filter("doc_id <> component_id").select("doc_id").distinct().alias("g")
    return docs.alias("d").join(others, F.col("d.doc_id").cast("long") == F.col("g.doc_id"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document has; documents of which nothing is left go.

    Rows of one doc_id, and rows without any, don't cut each other; texts that were null or empty
    before stay as they were; ``n_chars``, where there is one, follows the text; no rows give no rows.
    """
    before = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # a name that no column of this table has
    mark = max(docs.columns, key=len) + "_"
    out = without_repeats(docs.withColumn(mark, before))
    out = out.filter((F.length("text") > 0) | (F.col(f"`{mark}`") == 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, rows without doc_id and each row of a repeated doc_id by their own text.

    Null texts have no words and stay; no rows give no rows; other columns may have any name.
    """
    judged = contaminated_rows(docs, read(spark, sf_dir, "benchmark"))
    return _keep(docs, judged.filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their places in sequences of 2048 tokens.

    A null text is the end id alone; rows without doc_id and repeated rows are packed like others;
    no rows give no rows.
    """
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written to the shared folder and read by the next.

    See the stages for null doc_ids and texts, repeated rows and an empty table (no rows).
    """
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
