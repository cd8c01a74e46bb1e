"""Importance resampling towards a target: hashed n-gram buckets, log ratios, draws by perturbed scores.

Each document becomes an array of feature buckets by higher-order functions and is scored where it
lies, by an aggregate over a literal array of gains. The arrays are written once, as two steps read
them; only totals by bucket are shuffled: a row a bucket and task. Ranks come from a histogram of whole scores, of which there are at most
as many as the range of gains and draws allows, and from row numbers within one score; only drawn
documents are shuffled for that, without their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reachable
from .common import column, drop_written, written

#: Buckets, longest run of words, least words of a document that may be drawn, seed.
BUCKETS = 10000
LEAST_WORDS = 20
SEED = 7
#: Letters that are lower-cased, and what parts words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def feature_words(text: Column) -> Column:
    """Runs of ASCII digits and letters (A-Z as a-z) and of all that is not ASCII; null as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, PARTS), lambda w: w != "")


def feature_buckets(words: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours, repeats included."""
    bucket = lambda s: (F.crc32(s.cast("binary")) % BUCKETS).cast("int")
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    single = F.transform(words, bucket)
    double = F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(single, double)


def with_buckets(df: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """([id,] words, buckets) of each row; words are a column of their own, so that they are made once."""
    keep = [] if id_col is None else [column(id_col).alias("id")]
    worded = df.select(*keep, feature_words(column(text_col)).alias("w"))
    return worded.select(*["id"] * len(keep), F.size("w").alias("words"), feature_buckets(F.col("w")).alias("buckets"))


def bucket_totals(bucketed: DataFrame) -> DataFrame:
    """(bucket, n): features of all rows by bucket. A task adds its rows up; it sends one row a bucket."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    reachable(bucketed.sparkSession)
    return bucketed.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> list[int]:
    """Gain of each bucket from (bucket, n) of the raw and of the target texts, of ``BUCKETS`` rows at most."""
    none = F.lit(0).cast("long")
    both = raw.select("bucket", F.col("n").alias("s"), none.alias("t")).union(target.select("bucket", none, "n"))
    both = both.union(raw.sparkSession.range(BUCKETS).select(F.col("id").cast("int"), none, none))
    by = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = by.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    more = lambda c, k: F.col(c).cast("double") + float(k)
    ratio = (more("t", 1) * more("all_s", BUCKETS)) / (more("s", 1) * more("all_t", BUCKETS))
    rows = by.join(F.broadcast(sums)).select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()
    return [r["gain"] for r in rows]


def _literal(values: list[int]) -> Column:
    """One array literal; the optimiser folds it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", per_cent: int = 25) -> DataFrame:
    """One row per input row: (id, n_features, weight, score, rank).

    weight is the floored mean gain of the row's features, 0 without any; score adds a draw that
    depends on the id alone, so that the highest scores are a sample without replacement with chances
    by exp(weight / 1000). Of the N rows with ``LEAST_WORDS`` words the ``per_cent`` * N // 100
    highest scores have ranks 1, 2, ...; ties go to the smaller id, a null id last, then to fewer
    features and the smaller weight. Null and empty texts have no features; a null id draws as an
    empty one. Rows that share an id are rows of their own with the same draw. An empty table gives
    an empty result, an empty target gains from an empty corpus. Other columns are ignored.
    """
    own_bucketed = written(with_buckets(df, text_col, id_col), "buckets")
    gain = _literal(gains(bucket_totals(own_bucketed), bucket_totals(with_buckets(target, target_text))))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    summed = own_bucketed.select("id", "words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    n = F.col("n_features")
    weight = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    draw = F.floor(-1000.0 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = summed.select("id", "words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + draw)
    rows = written(scored, "scores")
    drop_written(own_bucketed)
    able = F.col("words") >= LEAST_WORDS
    by_score = rows.where(able).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    steps = by_score.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("able"))
    steps = written(steps.withColumn("drawn", F.expr(f"able * {int(per_cent)} div 100")).where("before < drawn"), "score-steps")
    edge = steps.agg(F.min("score")).first()[0]
    open_ = able & (F.col("score") >= edge) if edge is not None else F.lit(False)
    within = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    place = F.col("before") + F.col("at")
    out = ["id", "n_features", "weight", "score"]
    drawn = rows.where(open_).withColumn("at", F.row_number().over(within)).join(steps, "score")
    drawn = drawn.select(*out, F.when(place <= F.col("drawn"), place).alias("rank"))
    return drawn.union(rows.where(~open_).select(*out, F.lit(None).cast("long"))).withColumnRenamed("id", id_col)
