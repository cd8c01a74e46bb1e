"""Scores of structuring runs: token F1, invented headings, cost, the best run of a case, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pytext import col, lines, n_words, named, strip, sub
from ..functions.strings import heading_key, tokens
from ..session import kept

#: List prices in USD per million tokens (input, output), per page, and defaults.
PRICES = {
    "mistral-medium-latest": (0.27, 0.81),
    "mistral-large-latest": (2.0, 6.0),
    "mistral-small-latest": (0.10, 0.30),
    "deepseek-chat": (0.27, 1.10),
    "qwen-plus": (0.39, 1.57),
    "qwen-max": (1.60, 6.40),
}
OTHER_PRICE = (1.0, 3.0)
PAGE_PRICE = 0.001


def gold_headings(markdown) -> Column:
    heads = F.filter(F.transform(lines(markdown), strip), lambda x: x.rlike(r"^#{1,6}\s+.*\S\s*$"))
    return F.transform(heads, lambda x: strip(F.regexp_extract(x, r"^#{1,6}\s+(.*\S)\s*$", 1)))


def gold_tokens(markdown) -> Column:
    return tokens(sub(markdown, r"(?s)\A---.*?---\s*"))


def token_f1(gold, predicted) -> Column:
    """F1 of two token sets, rounded to four places; 0 where nothing is shared."""
    g, p = col(gold), col(predicted)
    shared = F.size(F.array_intersect(g, p))
    precision, recall = shared / F.greatest(F.size(p), F.lit(1)), shared / F.greatest(F.size(g), F.lit(1))
    return F.round(2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9)), 4)


def invented(labels, headings) -> Column:
    """Labels whose key neither equals, holds nor is held by the key of any heading."""

    def bad(keys):
        pairs = F.transform(col(labels), lambda x: F.struct(x.alias("label"), heading_key(x).alias("key")))
        held = lambda p: F.exists(keys, lambda g: g.contains(p["key"]) | p["key"].contains(g))
        wrong = F.filter(pairs, lambda p: ~F.when(F.array_contains(keys, p["key"]), True).otherwise(held(p)))
        return F.transform(wrong, lambda p: p["label"])

    return named(F.transform(col(headings), heading_key), bad)


#: Length of the pieces by which keys are found in one another.
GRAM = 3


def _met(left: DataFrame, right: DataFrame, on: list, how: str = "inner") -> DataFrame:
    """A join by shuffle, never by broadcast: pieces of keys take hundreds of times the room of the compressed files by which Spark would judge them."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _grams(key: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters."""
    most = F.length(key) - size + 1
    return F.when(most < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substring(key, i, F.lit(size)))))


def held_keys(inner: DataFrame, outer: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, inner, outer): keys of ``inner`` that stand within keys of ``outer`` in the same case; each has case and key.

    Inverted lists of pieces of up to ``GRAM`` characters name the candidates: a key looks only into the
    shortest list among its own pieces, and into none if one of them occurs nowhere. What is found
    is compared in full. Empty keys stand in every key and are left to the caller.
    """
    own, other = (d.select(case, "key").where("key is not null and key <> ''").distinct() for d in (inner, outer))
    sizes = range(1, GRAM + 1)
    lists = kept(other.select(case, F.col("key").alias("outer"), F.explode(F.concat(*(_grams(F.col("key"), k) for k in sizes))).alias("gram")), "lists")
    counts = lists.groupBy(case, "gram").agg(F.count("*").alias("n"))
    pieces = F.coalesce(*(F.when(F.length("key") == k, _grams(F.col("key"), k)) for k in sizes[:-1]), _grams(F.col("key"), GRAM))
    asked = _met(own.select(case, F.col("key").alias("inner"), F.explode(pieces).alias("gram")), counts, [case, "gram"], "left")
    probe = asked.groupBy(case, "inner").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    probe = kept(probe.where("missing = 0").select(case, "inner", "gram"), "probes")
    return _met(probe, lists, [case, "gram"]).where(F.col("outer").contains(F.col("inner"))).select(case, "inner", "outer")


def invented_labels(labels: DataFrame, headings: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, label): distinct labels of a whole run matrix that ``invented`` finds, by index.

    ``labels`` has case and label, ``headings`` case and heading. Each distinct key of a case is judged
    once, however many runs have it, and never met with all headings of its case. Labels of a case without
    headings are all invented; one whose key is empty is invented only there, and a heading whose
    key is empty stands in every label. Null labels and headings are passed over.
    """
    said = labels.where("label is not null").select(case, "label", heading_key("label").alias("key")).distinct()
    heads = headings.where("heading is not null").select(case, heading_key("heading").alias("key")).distinct()
    # a label that is a heading is settled; only the others and the headings of their cases are indexed
    said = kept(_met(said, heads, [case, "key"], "left_anti"), "said")
    heads = kept(_met(heads, said.select(case).distinct(), [case], "left_semi"), "headings")
    known = held_keys(said, heads, case).select(case, F.col("inner").alias("key")).union(held_keys(heads, said, case).select(case, F.col("outer")))
    some = heads.select(case).distinct()
    known = known.union(_met(said.where("key = ''").select(case, "key"), some, [case], "left_semi"))
    free = heads.where("key = ''").select(case).distinct()
    rest = _met(said, free, [case], "left_anti")
    return _met(rest, known.distinct(), [case, "key"], "left_anti").select(case, "label")


def scored_runs(runs: DataFrame, gold_col: str = "gold", sections_col: str = "sections") -> DataFrame:
    """Adds the metrics of each run; ``sections_col`` is array<struct<label, content>>."""
    heads = gold_headings(gold_col)
    text = F.array_join(F.transform(sections_col, lambda s: s["content"]), "\n\n")
    named = F.filter(F.transform(sections_col, lambda s: strip(s["label"])), lambda x: x != "")
    rows = runs.withColumns({"_heads": heads, "_named": named})
    rows = rows.withColumn("_bad", invented("_named", "_heads"))  # a column, as two metrics read it
    bad = F.col("_bad")
    return rows.withColumns(
        {
            "gold_token_f1": token_f1(gold_tokens(gold_col), tokens(text)),
            "num_gold_sections": F.size("_heads"),
            "num_pred_sections": F.size(sections_col),
            "num_labeled": F.size("_named"),
            "num_unlabeled": F.size(sections_col) - F.size("_named"),
            "hallucinated_sections": bad,
            "num_hallucinated": F.size(bad),
        }
    ).drop("_heads", "_named", "_bad")


def price_table(spark) -> DataFrame:
    return spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, price_in double, price_out double")


def with_cost(runs: DataFrame, model: str = "model", prompt: str = "prompt_text", output: str = "output_text", pages: str = "ocr_pages") -> DataFrame:
    """Adds cost_usd by list price; unknown models have a default price. The price table is fixed and small."""
    return priced(runs, n_words(prompt), n_words(output), model, pages)


def priced(runs: DataFrame, prompt_words, output_words, model: str = "model", pages: str = "ocr_pages") -> DataFrame:
    """``with_cost`` from numbers of words: runs of one case share their texts, which are best counted once."""
    rows = runs.join(F.broadcast(price_table(runs.sparkSession).withColumnRenamed("model", "_m")), F.col(model) == F.col("_m"), "left").drop("_m")
    million = lambda n: col(n) * F.lit(1.3) / F.lit(1e6)
    cost = million(prompt_words) * F.coalesce("price_in", F.lit(OTHER_PRICE[0])) + million(output_words) * F.coalesce("price_out", F.lit(OTHER_PRICE[1])) + F.col(pages) * F.lit(PAGE_PRICE)
    return rows.withColumn("cost_usd", F.floor(cost * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).drop("price_in", "price_out")


def run_matrix(cases: DataFrame, providers: list, models: list, variants: list) -> DataFrame:
    """One row per case and combination, numbered in nested order. The lists are parameters, so the product is linear in the cases."""
    combos = [(p, m, v) for p in providers for m in models for v in variants]
    named = F.array(*(F.struct(F.lit(p).alias("chat_provider"), F.lit(m).alias("model"), F.lit(v).alias("prompt_variant")) for p, m, v in combos))
    return cases.select("*", F.posexplode(named).alias("ord", "c")).select(*cases.columns, "ord", "c.*")


def best_runs(runs: DataFrame, case: str = "case_id", order: str = "ord") -> DataFrame:
    """The run of each case with fewest invented, then unlabelled sections, then the highest F1; the first in a tie. Failed runs do not count."""
    rank = F.struct(F.coalesce("num_hallucinated", F.lit(99)), F.coalesce("num_unlabeled", F.lit(99)), -F.coalesce("gold_token_f1", F.lit(0.0)), F.col(order))
    ok = runs.where("error is null")
    cols = [c for c in runs.columns if c != case]
    return ok.groupBy(case).agg(F.min_by(F.struct(*cols), rank).alias("b")).select(case, "b.*")


#: What stands before the rows of a report and before its best runs.
REPORT_HEAD = ["# evaluation matrix", "", "## Results", "", "| case | provider | model | prompt | genre | goldF1 | #gold | #pred | #unlab | #halluc | cost$ | sec | error |", "|---|---|---|---|---|---|---|---|---|---|---|---|---|"]
REPORT_BEST = ["", "## Per-case best config", ""]


def report_lines(runs: DataFrame, best: DataFrame) -> DataFrame:
    """(part, case_id, ord, line): the Markdown report of an evaluation, a row a line, in the order of part, case_id, ord.

    Parts: 0 head, 1 a line for each run, 2 head of the best runs, 3 a line for each of them. Lines of
    the heads have a null case.
    """
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    zero = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    cells = ["case_id", "chat_provider", "model", "prompt_variant"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in cells), F.coalesce("genre", F.lit("None")), *(dash(c) for c in ("gold_token_f1", "num_gold_sections", "num_pred_sections", "num_unlabeled", "num_hallucinated")), zero("cost_usd"), zero("latency_s"), dash("error")), F.lit(" |"))
    item = F.concat(F.lit("- **"), F.col("case_id").cast("string"), F.lit("**: `"), F.concat_ws("/", "chat_provider", "model", "prompt_variant"), F.lit("` — hallucinated="), F.col("num_hallucinated").cast("string"), F.lit(", unlabeled="), F.col("num_unlabeled").cast("string"), F.lit(", goldF1="), F.col("gold_token_f1").cast("string"))
    kinds = {c: runs.schema[c].dataType for c in ("case_id", "ord")}
    heads = runs.sparkSession.createDataFrame([(p, k, t) for p, ts in ((0, REPORT_HEAD), (2, REPORT_BEST)) for k, t in enumerate(ts)], "part int, ord int, line string")
    heads = heads.select("part", F.lit(None).cast(kinds["case_id"]).alias("case_id"), F.col("ord").cast(kinds["ord"]).alias("ord"), "line")
    return heads.union(runs.select(F.lit(1), "case_id", "ord", row)).union(best.select(F.lit(3), "case_id", "ord", item))


def write_report(lines: DataFrame, path: str) -> None:
    """Write the lines as text files that hold the report when read in the order of their names.

    The sort is a range sort over all tasks, so neither a task nor a row holds all runs.
    """
    keys = ["part", F.col("case_id").asc_nulls_first(), "ord"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.text(path)


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull()).alias("n_done"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
