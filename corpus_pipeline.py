"""A corpus in five stages: toxic documents go, near-duplicates go, repeated passages go, contaminated documents go, and
what is left is encoded. Each stage takes all that its predecessor kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sidelines.llm.common import cut, read, scratch, text_key
from sidelines.llm.decontam import contamination, report
from sidelines.llm.pieces import encoded
from sidelines.llm.queries import TOKENIZERS
from sidelines.llm.simhash import near_duplicates
from sidelines.llm.substring import remove_repeats
from sidelines.llm.toxicity import toxicity_scores


def _drop(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5, judged by doc_id: all rows of an id go if one is toxic, and rows without one stay.
    Learns from labels of the documents given."""
    scores = toxicity_scores(docs, read(spark, sf_dir, "labels"))
    return _drop(docs, scores.where("score >= 0.5"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, and one row of each doc_id: that of the least
    text key and, of equal texts, the least other columns. Rows without a doc_id stay, null texts count as empty."""
    groups = near_duplicates(docs)
    kept = _drop(docs, groups.where("component_id < doc_id"))
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    first = Window.partitionBy("doc_id", "_own_row").orderBy(text_key(F.col("text")), *(c for c in docs.columns if c not in ("doc_id", "text")))
    return kept.withColumn("_own_row", own).withColumn("_place", F.row_number().over(first)).where("_place = 1").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that smaller doc_ids hold too; a text of which nothing goes stays as it is. n_chars
    follows the text; a document that loses all words stays with an empty text, and rows without a doc_id stay whole."""
    found = remove_repeats(docs).where("n_removed > 0").dropDuplicates(["doc_id", "key"])
    kept = found.select("doc_id", F.col("key").alias("_text_key"), F.col("kept").alias("_kept"))
    rows = docs.withColumn("_text_key", text_key(F.col("text"))).join(kept, ["doc_id", "_text_key"], "left")
    rows = rows.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_kept").cast(docs.schema["n_chars"].dataType)))
    return rows.withColumn("text", F.coalesce("_kept", "text")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows don't contaminate, judged by doc_id: all rows of an id go if one is
    contaminated, and rows without one stay. Repeated rows stay or go together; a null or empty text has no words and
    stays."""
    return _drop(docs, report(contamination(docs, read(spark, sf_dir, "benchmark"))).where("contaminated"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it: a row for each row, with a null doc_id too; null and empty
    texts have no tokens. Columns other than doc_id are left out."""
    return encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents: a row with ids for each document that is left. Each stage's result is
    written and read again, and the tables of finished stages go; nulls, repeated rows and empty tables are as the stages say."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            made += before
            docs = cut(stage(spark, docs, sf_dir), name)
            before = [made.pop()]
    return STAGES[-1][1](spark, docs, sf_dir)
