"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, token ids.

Each stage gets the documents its predecessor kept and gives documents with the same columns; the last
gives token ids. Between stages the documents are written to the shared folder and read again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlens.llm import decontaminate, jaccard, language, pieces, pii
from simlens.llm.common import held_out, read_table, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without any letter go."""
    profiles = language.train_profiles(docs, ~held_out(F.col("doc_id")))
    return language.identify(docs, profiles, docs.columns, ("_lang_pred", "_lang_score")).where("_lang_pred <> 'und'").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that with the smallest id."""
    return jaccard.first_of_components(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), docs.columns, "_")
    return found.where("not _contaminated").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with the checks of the codec."""
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", mask_personal_data), ("sentencepiece", encode_pieces)]

#: SQL cannot express the stages; tests compare the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
