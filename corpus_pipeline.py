"""From raw documents to token ids: five stages, each over all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir), docs having the columns of documents, and returns a DataFrame; all but the
last return those columns. Between stages the rows are written as Parquet to the shared folder and read again, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, common, decontaminate, near_dedup, substring_dedup, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold; learns from all labels.

    A null or empty text has the base rate's score and stays; without usable labels all stay; repeated rows share their
    score; further columns stay as they are, whatever their names; an empty table gives an empty table.
    """
    name = "toxicity_score"
    while name in map(str.lower, docs.columns):
        name += "_"
    scored = toxicity.score(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"), name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, and all documents in no group.

    A null or empty text is in no group; rows with one doc_id stay or go together; a row with a null doc_id stays; of
    equals the smallest doc_id stays; further columns stay; an empty table gives an empty table.
    """
    kept = near_dedup.groups(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that are repeated anywhere; n_chars follows the text.

    A null text stays null, an empty one empty; repeated rows lose what they share; a text that loses nothing stays as
    it is; further columns stay; an empty table gives an empty table.
    """
    own = {c: f"{c}_of_input" for c in docs.columns if c.lower() in substring_dedup.NEW}  # not to be replaced
    out = substring_dedup.dedup(docs.withColumnsRenamed(own)).drop(*substring_dedup.NEW).withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null or empty text holds none; rows with one doc_id go together; a row with a null doc_id stays, having no id to be
    found by; further columns stay; an empty table of documents or items takes nothing away.
    """
    found = decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit words) of every text, with the digests that prove the round trip.

    A null or empty text has no ids; repeated rows give repeated results; further columns are left out; an empty table
    gives an empty table.
    """
    import public_tokenizers as P

    return bpe.encode(docs.select("doc_id", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("toxicity", without_toxic), ("near_dedup", one_of_each_group), ("substring_dedup", without_repeats), ("decontaminate", without_benchmark), ("byte_bpe", encoded)]

#: No stage but the last two could be said in SQL at all; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stash(docs)
    return docs
