"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared checkpoint folder and reads it back as the next stage's docs.  All
stages but the last return the columns of ``docs``.

1. language_id     documents without a letter (null and empty texts too) go; texts in several
                   learned languages stay
2. ngram_join      of each class of documents that share 0.8 of their five-word
                   shingles, the smallest doc_id stays
3. substring_dedup runs of 50 words or more that a smaller doc_id has go; a document
                   with nothing left goes
4. decontaminate   documents with ten consecutive words of a benchmark item go
5. mix_sources     documents of which the mix takes nothing go; size, source_size, target
                   and taken say how many words it takes

Texts are not null from the second stage on; a null source is a source of its own; an empty table gives
an empty table at every stage, and an empty benchmark lets all documents through.
Rows with a null doc_id name no document to another stage and pass the second and
third one unchanged; of rows with equal doc_id and text, the second keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.llm import decontaminate as leaks
from guestlens.llm import language_id as lang
from guestlens.llm import mixing, ngram_join, substring_dedup
from guestlens.llm.tables import materialize, table

PASSAGE = 50


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns but the text as one, so that no name meets an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"))


def unpacked(columns: list[str], **new) -> list:
    return [new.get(c, F.col("text") if c == "text" else F.col(f"doc.{c}")).alias(c) for c in columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang.train(docs, F.lit(True))
    seen = lang.identify(packed(docs), model, carry=["doc"])
    return seen.where(F.col("lang_pred") != "und").select(unpacked(docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = ngram_join.similarity_classes(docs, k=5, num=4, den=5)
    stay = classes.where("component_id = doc_id").select("doc_id").distinct()
    new = "of_" + max(docs.columns, key=len)            # no column has this name
    kept = docs.join(stay, "doc_id", "left_semi").withColumn(new, F.xxhash64("text")).dropDuplicates(["doc_id", new])
    return kept.select(docs.columns).union(docs.where("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(packed(docs), k=PASSAGE, carry=["doc"])
    cut = cut.where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    changed = F.col("n_removed") > 0
    return cut.select(unpacked(docs.columns, text=F.when(changed, F.col("kept")).otherwise(F.col("text")),
                               n_chars=F.when(changed, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars"))))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    seen = leaks.decontaminate(packed(docs), table(spark, sf_dir, "benchmark"), carry=["doc"])
    return seen.where(~F.col("contaminated")).select(unpacked(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, carry=docs.columns).where("taken > 0")


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontaminate", decontamination_stage),
    ("mix_sources", mixing_stage),
]

# Language ID, similarity classes and hashed order are not expressible in SQL; tests/llm
# runs the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
