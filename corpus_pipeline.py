"""The corpus pipeline: documents through five operators, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.llm import contamination, jaccard, packing, secrets, toxicity
from signalsift.llm.shipping import ship
from signalsift.session import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The tokenizer of the last stage.
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels does not take for toxic (a score under 0.5)."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fitted(docs, labels)
    return toxicity.marked(docs, model).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles from 80 per cent on: the one with the smallest id.

    Documents without words are no copies of each other; rows without an id stay,
    rows with the same id are one document, of which one row stays.
    """
    ship(spark)
    found = staged(jaccard.joined(docs, jaccard.Similarity(5, 80)), "joined").where("doc_id is not null")
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    firsts = docs.join(copies, "doc_id", "left_anti")
    once = firsts.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return firsts.join(repeated, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (80 per cent of its five-word shingles)."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination.contained(docs, items).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask."""
    ship(spark)
    return secrets.scanned(docs, clean=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    ship(spark)
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: A trained model, a tokenizer and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
