"""A training-data pipeline over documents: toxic ones go, one of each near-duplicate group stays, benchmark leaks go,
personal data is masked, and what is left is encoded to token ids. Each stage takes (spark, docs, sf_dir), reads and
returns the columns of documents only, whatever others docs has, and gives no row for no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is under 0.5; the model learns from the labelled rows of documents. Null and
    empty texts have the score of a text without words; repeated rows are judged alike."""
    from corpuslens.llm.toxicity import score_documents, train_on

    model = train_on(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs.select(*COLUMNS), model).filter(F.col("score") < 0.5).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents linked by 5-word shingles with a similarity of 0.8 or more. Texts
    without words and rows without doc_id are linked with nothing and stay."""
    from corpuslens.llm.neardup import keep_representatives

    return keep_representatives(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item. Null and empty texts hold none."""
    from corpuslens.llm.decontam import drop_contaminated

    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows. Null texts stay null."""
    from corpuslens.llm.pii import mask_pii

    return mask_pii(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of the token sequence; docs is a stored table, as stages read them. Null texts have no tokens."""
    import public_tokenizers

    from corpuslens.llm.bpe import encode_documents

    ids = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, stored=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", keep_one_of_each), ("decontamination", drop_leaks), ("pii", mask_personal_data), ("bpe", encode)]
#: Not expressible in SQL: a trained model and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    from corpuslens.llm.common import Scratch

    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), rows=None)
    return STAGES[-1][1](spark, docs, sf_dir)
