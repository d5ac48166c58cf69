"""From raw documents to packed sequences: one operator per stage, each stage's rows stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepress.llm import jaccard, packing, pii, quality, repeats
from pulsepress.llm.common import drop, folders_made, new_folder, numbered, stored, table

#: Passages of so many words are cut where they occur elsewhere too, when they have the bytes of as many
#: words of three letters with their spaces.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 4 * PASSAGE_WORDS - 1


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first row, of every group linked by similar shingle sets."""
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    rows = numbered(whole, new_folder(docs), "rows")
    first = jaccard.jaccard_components(rows.select("row", F.col("doc.text").alias("text")), "row").filter(F.col("row") == F.col("component_id"))
    return rows.hint("merge").join(first.select("row"), "row", "left_semi").select("doc.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long passages that occur elsewhere too; documents that lose everything go."""
    return repeats.cut_repeats(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the names of their kinds in the place of personal data."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their places in sequences."""
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("content", "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No stage can be said in SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each on the stored rows of the one before.

    Once a stage's rows are stored, the tables it kept for itself and the rows of the stage before it are
    removed; the last stage's rows stay.
    """
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(docs)
    for number, (_, stage) in enumerate(STAGES):
        with folders_made() as made:
            docs = stored(stage(spark, docs, sf_dir), folder, f"stage{number}")
        for own in made:
            drop(spark, own)
        if number:
            drop(spark, folder, f"stage{number - 1}")
    return docs
