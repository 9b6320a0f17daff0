"""The corpus pipeline: five stages over ``documents``, each one operator of ``lexispark.llm``.

A stage is a function of (spark, docs, sf_dir). Between stages the rows are written as Parquet and read again, so a lost
executor never costs more than the stage it was lost in. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.bpe import encode
from lexispark.llm.chosen_path import near_groups
from lexispark.llm.langid import UNDETERMINED, identify, train
from lexispark.llm.pfair import in_mixed_order
from lexispark.llm.substring_dedup import remove_repeats
from lexispark.session import settle, with_place

LEAST_SCORE = 0.3       # score of the winning language below which a text is rejected


def beside(docs: DataFrame, names: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` when it adds columns ``names``: columns of ``docs`` that are called so keep their values."""
    clash = [c for c in docs.columns if c in names]
    done = work(docs.withColumnsRenamed({c: f"__own_{c}" for c in clash}))
    return done.select(*[F.col(f"__own_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, in which no language leads, or that cost far more than any language's own.

    Null languages teach nothing; repeated rows are judged alike.
    """
    model = train(docs)
    return beside(docs, ("lang_pred", "score", "bits_per_byte"), lambda rows: identify(rows, model).where(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Null ids come last; of near copies with one id, or all without, one is kept.
    """
    kept = beside(docs, ("n_shingles", "component_id", "kept"), lambda rows: near_groups(
        rows, width=5, percent=80, one_each=True).where("kept"))
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])      # rows that repeat a whole document, key included
    return kept


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every passage of 35 words or more that also stands elsewhere; other texts stay as they are."""
    changed = F.col("n_removed") > 0

    def work(rows: DataFrame) -> DataFrame:
        found = remove_repeats(rows)
        return found.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).withColumn(
            "n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))

    return beside(docs, ("kept_text", "n_words", "n_removed", "repeat_bounds"), work)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows ordered by their place in the mix of sources.

    Null sources are a source of their own; repeated rows have a place each; a null text changes nothing.
    """
    return in_mixed_order(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Position in the mix, token ids of every text, and digests of the ids and of the bytes they decode to.

    A null text counts as empty; repeated rows are encoded each.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(with_place(docs, "position").select("doc_id", "source", "lang", "position", "text"), path, decoded=True).select(
        "doc_id", "source", "lang", "position", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None       # the context trees of the first stage have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
