"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Empty tables pass through as empty; other columns of docs stay as they are, whatever
their names. Null texts count as empty and stay null; rows that share an id are kept or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.bpe import encode
from folioforge.llm.common import column, drop_written, fresh, table, written
from folioforge.llm.decontam import contaminated
from folioforge.llm.neardup import near_duplicates
from folioforge.llm.pii import find_pii, redacted
from folioforge.llm.queries import fit_toxicity, word_vocabulary
from folioforge.llm.toxicity import scored

#: Documents at or over this score go; shingle sets at or over this similarity are one group.
TOXIC = 0.7
SIMILAR = (80, 100)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the model learns from those that have a label."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = fresh("score", docs.columns)
    return scored(docs, model, keep=tuple(docs.columns), score_col=score).where(F.col(score) < TOXIC).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; documents without words or id all stay."""
    found = near_duplicates(docs, num=SIMILAR[0], den=SIMILAR[1])
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(column, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*map(column, docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars follows the text."""
    prefix = "pii_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = find_pii(docs, keep=tuple(c for c in docs.columns if c != "doc_id"), prefix=prefix)
    out = found.withColumn("text", redacted(F.col("text"), F.col(f"{prefix}spans")))
    out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*map(column, docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian unsigned 32-bit integers."""
    out = encode(docs, word_vocabulary())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", bpe),
]
#: No SQL: the first stage is a fitted model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through every stage, each written and read again before the next.

    A stage's table is deleted once the next one is written; the last one stays for the result.
    """
    docs, spent = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
            if spent is not None:
                drop_written(spent)
            spent = docs
    return docs
