"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
``documents``; the last returns the encoded documents. ``run`` writes every stage's result to the shared
folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, kneser_ney, ngram_join, piece_codec, suffix_dedup
from lodestone.llm.kernel import dropped, read, ship, stored, swept

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Passages of this many bytes that occur twice are removed: about 40 words, so any of over 50 words.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the model of trusted text finds likely enough for their language.

    Null and empty texts have an end only, which is judged like any text; repeated rows are judged alike; a
    null language has the threshold over all; without trusted documents all rows stay.
    """
    judged = kneser_ney.classify(docs, read(spark, sf_dir, "labels"), train_documents=None)
    return judged.where(F.coalesce("keep", F.lit(True))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that with the smallest id, of each component of 0.8 similar 5-word shingle sets.

    A row is an id with a text: rows that share an id but are not linked all stay, and equal rows are reduced
    to one. Rows without an id come last, by a digest of their text. Texts without words link with nothing.
    """
    row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"))
    rows = docs.withColumn("__row", row)
    found = ngram_join.join(rows, key="__row", n=5, share=80)
    others = found.where("__row <> component_id").select("__row").distinct()
    return rows.join(others, "__row", "left_anti").dropDuplicates(["__row"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage that occurs more than once out of the texts; documents stay, their lengths follow.

    A cut inside a character drops what is left of it. Null and empty texts stay as they are; equal rows lose
    their whole texts, as each repeats the other.
    """
    cut = suffix_dedup.deduplicate(docs, length=PASSAGE_BYTES)
    whole = F.try_validate_utf8(F.col("kept").cast("string"))
    text = F.coalesce(whole, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit("")))
    cut = cut.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(text))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that overlap a benchmark item, row by row: an id may be null or have several texts.

    Null and empty texts overlap nothing; equal rows go or stay together.
    """
    rows = docs.withColumn("__row", F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))))
    hit = decontaminate.find(rows, read(spark, sf_dir, "benchmark"), key="__row").select("__row").distinct()
    return rows.join(hit, "__row", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests; a null text counts as empty, equal rows stay."""
    import public_tokenizers

    coded = piece_codec.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(piece_codec.MODEL))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        piece_codec.n_ids(F.col("piece_ids")).alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]

#: SQL has no language model, no shingle hashing at this size and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; a stage's input goes when its result is written."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        done = stored(stage(spark, docs, sf_dir), name.split()[0])
        if i:
            dropped(docs)
        docs = done
        swept(spark)
    return docs
