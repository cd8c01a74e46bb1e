"""Evaluation cases run over chat providers: survey, plan, sections, scores, cost and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import lines, n_words
from ..functions.strings import file_slug
from ..session import kept
from ..sources import prompts
from ..sources.ledger import Ledger
from ..sources.providers import planned, profile, timed_replies
from . import evaluate, genres, plan
from .lines import page_count

RUN = ["case_id", "ord"]


def run_cases(cases: DataFrame, chats: dict, models: list, variants: list, attempts: int = 3, wait: float = 1.0, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, sections) of every case, provider, model and prompt variant.

    ``cases`` has case_id, text (raw Markdown), gold and error (of reading it, or null). results has
    RUN, chat_provider, model, prompt_variant, genre, error, doc_type, languages,
    structure_pattern, section_labels, the metrics, cost_usd, latency_s and run_at; a run that fails
    has an error and null metrics. sections has RUN, section_ord, label, section_id, content.
    Calls go through ``ledger`` (the application's, if none is given) and are made when this is
    called: one survey and one plan for each distinct request, however often the results are read.
    """
    ledger = ledger or Ledger(cases.sparkSession)
    cases = kept(cases.select("case_id", "text", "gold", "error"), "cases")
    matrix = lambda **made: evaluate.run_matrix(cases.withColumns(made), sorted(chats), models, variants)
    hint = {v: prompts.variant(v) for v in variants}
    pick = lambda k: F.coalesce(*(F.when(F.col("prompt_variant") == v, F.lit(hint[v][k])) for v in variants))
    # prompts and counts are made once a case, below the matrix
    asked = matrix(user=prompts.survey_prompt("text")).where("error is null").select(*RUN, "chat_provider", "model", pick(0).alias("system"), "user")
    survey = timed_replies(asked, chats, RUN, attempts, wait, ledger).select(*RUN, profile("reply").alias("profile"), F.col("error").alias("e1"), F.col("latency_s").alias("s1"))
    planning = matrix(user=prompts.plan_prompt("text")).where("error is null").drop("error").join(survey.where("e1 is null"), RUN)
    asked = planning.select(*RUN, "chat_provider", "model", prompts.plan_system("{}", F.col("profile.doc_type"), F.col("profile.languages")).alias("told"), pick(1).alias("base"), "user")
    asked = asked.withColumn("system", F.replace("told", F.lit("{}"), F.col("base")))
    replies = timed_replies(asked, chats, RUN, attempts, wait, ledger).withColumn("plan", F.when(F.col("error").isNull(), F.sha2("reply", 256)))
    # each distinct plan of a case is cut and scored once, however many runs gave it
    key = F.struct("case_id", "plan")
    own = replies.where("plan is not null").groupBy("case_id", "plan").agg(F.min("reply").alias("reply"))
    found = planned(own.select(key.alias("run"), "reply"), ["run"])
    texts = own.select("case_id", "plan").join(cases.select("case_id", "text", "gold"), "case_id").select(key.alias("run"), "text", "gold")
    totals = texts.select("run", F.size(lines("text")).alias("n_lines"))
    full = plan.gaps_filled(found, totals, "run")
    cut = plan.with_sections(texts, full, "run", keep=("gold",))
    names = ["gold_token_f1", "num_gold_sections", "num_pred_sections", "num_labeled", "num_unlabeled", "hallucinated_sections", "num_hallucinated"]
    scored = evaluate.scored_runs(cut).select("run.*", "sections", *names)
    parts = cut.select("run.*", F.explode("sections").alias("s"))
    sections = replies.select(*RUN, "plan").join(parts, ["case_id", "plan"]).select(*RUN, "s.section_ord", "s.label", "s.section_id", "s.content")
    counts = {"asked": n_words(F.concat_ws("\n", F.substring("text", 1, 2000), "text")), "told": n_words("text"), "ocr_pages": page_count("text")}
    ok = matrix(**counts).where("error is null").drop("error", "gold")
    done = ok.join(survey, RUN).join(replies.select(*RUN, F.col("error").alias("e2"), F.col("latency_s").alias("s2"), "plan"), RUN, "left")
    done = done.join(scored, ["case_id", "plan"], "left").withColumn("sections", F.coalesce("sections", F.array().cast(scored.schema["sections"].dataType)))
    done = evaluate.priced(done.withColumn("error", F.coalesce("e1", "e2")), "asked", "told")
    bad = F.col("error").isNotNull()
    labels = F.transform("sections", lambda s: F.coalesce(F.nullif(s["label"], F.lit("")), s["section_id"]))
    row = [
        *RUN, "chat_provider", "model", "prompt_variant",
        F.when(~bad, genres.routed("profile.doc_type", "text")).alias("genre"), "error",
        *(F.col(f"profile.{c}").alias(c) for c in ("doc_type", "languages", "structure_pattern")), labels.alias("section_labels"),
        *(F.when(~bad, F.col(n)).alias(n) for n in names),
        F.when(bad, 0.0).otherwise(F.col("cost_usd")).alias("cost_usd"),
        F.round(F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0)), 2).alias("latency_s"),
    ]
    done = done.select(*row)
    unread = matrix().where("error is not null").select(*RUN, "chat_provider", "model", "prompt_variant", "error").withColumns({"cost_usd": F.lit(0.0), "latency_s": F.lit(0.0)})
    return done.unionByName(unread, allowMissingColumns=True).withColumn("run_at", F.current_timestamp()), sections


def run_dumps(cases: DataFrame, results: DataFrame, sections: DataFrame) -> DataFrame:
    """(rel_path, content): raw and structured Markdown of every run without error, under paths that name the whole run."""
    ok = results.where("error is null").select(*RUN, "chat_provider", "model", "prompt_variant")
    path = F.concat(F.col("case_id").cast("string"), F.lit("/"), F.concat_ws("_", *(file_slug(c) for c in ("chat_provider", "model", "prompt_variant"))))
    raw = ok.join(cases.select("case_id", "text"), "case_id").select(F.concat(path, F.lit("_raw.md")).alias("rel_path"), F.col("text").alias("content"))
    head = F.concat(F.lit("## "), F.coalesce(F.nullif("label", F.lit("")), F.col("section_id")), F.lit("\n\n"), F.col("content"))
    parts = sections.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("section_ord", head.alias("t")))).alias("ps"))
    whole = F.array_join(F.transform("ps", lambda x: x["t"]), "\n\n")
    return raw.union(ok.join(parts, RUN).select(F.concat(path, F.lit("_structured.md")), whole))

