"""From raw documents to encoded training text: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rehome.llm.language import predict_language
from rehome.llm.mixing import fair_mix
from rehome.llm.pieces import encode_texts, load_model
from rehome.llm.quality import judge_quality
from rehome.llm.queries import PIECE_MODEL
from rehome.llm.shared import free_name, shared_folder, table, with_scores
from rehome.llm.simhash import fingerprint, simhash_groups


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose vote reaches the threshold. The sample is taken of the documents that have come here.

    Texts that are null or empty are judged like any other; extra columns of the table stay.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return judge_quality(docs, labels).filter("predicted = 1").select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, however sure it is; those without a letter go, null and empty texts among them.

    Repeated rows go or stay together; very long texts are read whole; columns of any names are kept. Where no document has a language, nothing can be learnt and all goes.
    """
    return predict_language(docs).filter("lang_pred <> 'und'").select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near fingerprints.

    An id with several texts is several documents: each goes or stays by its own fingerprint, and of rows that share id and
    fingerprint (repeated rows, too) one stays. Rows without an id belong to no group and stay. Whole texts count,
    however long; columns of any names are kept.
    """
    found = simhash_groups(docs, shingle=4, radius=4)
    kept = found.filter("doc_id = component_id").select("doc_id", "fingerprint").distinct()
    # The hash side is ids; texts are moved once and not sorted.
    stay = docs.join(kept.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    several = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not several.isEmpty():
        mark, rank = free_name(docs.columns, "fingerprint"), free_name(docs.columns, "rank")
        again = with_scores(stay.join(several, "doc_id", "left_semi"), "text", docs.columns, f"`{mark}` string", lambda texts: [
            pa.array([f"{fingerprint(t.as_py(), 4):016x}" for t in texts], pa.string())])
        again = again.join(kept.withColumnRenamed("fingerprint", mark), ["doc_id", mark], "left_semi")
        order = Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns]))
        again = again.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(docs.columns)
        stay = stay.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(again)
    return stay.unionByName(docs.filter("doc_id IS NULL"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    Rows with one id (repeated rows, too) are taken as often as the one of them that is taken most. Texts without words
    go; a very long one counts with all its words. Columns of any names are kept.
    """
    own, times, turn = (free_name(docs.columns, n) for n in ("taken_id", "times", "turn"))
    taken = fair_mix(docs).filter("taken > 0").groupBy("doc_id").agg(F.max(F.expr("taken div size")).alias(times))
    taken = taken.withColumnRenamed("doc_id", own).hint("shuffle_hash")
    mixed = docs.join(taken, docs["doc_id"].eqNullSafe(taken[own]))
    return mixed.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, their piece ids, and the text that these decode to.

    Null texts are empty ones; repeated rows encode alike; texts of any length are whole. Columns of the names
    ``ids`` and ``decoded`` give way.
    """
    return encode_texts(docs, load_model(PIECE_MODEL), decoded="decoded")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("simhash", dedup_stage),
    ("mixing", mixing_stage),
    ("pieces", encoding_stage),
]

# No SQL expresses the trained models of the first two stages; tests hold the third and fourth stage to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to all that its predecessor kept, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
