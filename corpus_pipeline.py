"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, further ones included.
``run`` writes each stage's result to the shared folder and reads it again as the next one's input.

Defined cases, for every stage: an empty table gives an empty one. Null and repeated ids are rows of their own; of
repeated rows ``lines`` and ``near`` keep the first, the other stages judge each alike. ``language`` rejects null, empty
and letterless texts; the stages after it keep them where they meet them. Nulls in other columns change nothing.

``lines`` stands before ``near``: a near copy that shares long runs with an earlier document loses these first, and
what is left of it may no longer be a near copy and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.llm import decontam, langid, linededup, minhash, queries, util

#: Documents whose best language has less posterior probability are rejected, and those without letters.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty ones too) or with an unsure language.

    Learns from the rows with a language; without any, no language is sure and all documents go.
    """
    model = langid.train(docs)
    judged = langid.identify(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs, and documents that lose all their lines; null and empty texts stay.

    ``n_chars`` follows the text, if there is such a column.
    """
    out = linededup.deduplicate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each near-duplicate group; texts without words are in no group and stay."""
    return minhash.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items; null texts hold none, and null or wordless items match none."""
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids by byte-level BPE, as digests, with the digest of what they decode to; a null text has no ids."""
    return queries.token_digests(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: Near-duplicate groups, string tiling and BPE merges have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = util.Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
