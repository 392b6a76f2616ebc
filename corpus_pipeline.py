"""A corpus pipeline of operators for training data: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Between stages the rows are written as Parquet and read again, so that no stage carries
another's lineage. ORACLE_SQL is None: SQL can't express the language model, MinHash or the BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featureflow.llm.bpe import round_trip
from featureflow.llm.common import materialise, read
from featureflow.llm.langid import predict, train
from featureflow.llm.mixing import mixed
from featureflow.llm.near_dedup import Params, deduplicate
from featureflow.llm.queries import rank_path
from featureflow.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own language column and drops those that are in no language it knows.

    Null and empty texts, and those without a letter, are in none, and go; where nothing can be learned,
    all go. Null doc_ids and repeated rows are rows as any others. Of tied languages the first by name
    counts. Texts are read whole. Other columns stay; lang_pred and score are refused.
    """
    model = train(docs, F.lit(True))
    return predict(docs, model, keep=True, strict=True).filter("lang_pred <> 'und'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: that with the least doc_id.

    Documents without words, or with a null doc_id, are in no group, and stay. Rows that repeat a kept
    doc_id stay with it. Texts are read whole. Other columns stay; _gone is refused.
    """
    return deduplicate(docs, Params(shingle=5, percent=80, bands=32))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mask, and n_chars follows; other documents stay as they are.

    Null texts stay null, with null n_chars. Repeated rows are masked each; spans that overlap become
    one. Texts are read whole. Other columns stay; those that `redact` names are refused.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that meet the target weights: clean ones stay, some twice; low and toxic ones are thinned.

    Null and empty texts have no tokens, and are kept at the rate of their signs. Null doc_ids and
    repeated rows are rows as any others; rows that agree in doc_id and text are rounded alike. Texts are
    read whole. Other columns stay; those that `mixed` names are refused.
    """
    return mixed(docs, read(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, as a digest, and that of the text they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty; null doc_ids and repeated rows are rows as any others. Texts are read whole.
    Other columns go.
    """
    return round_trip(docs, rank_path())


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
