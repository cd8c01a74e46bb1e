"""Queries on runs that go on: calls paid once, progress counts, keyed state, new sources against finished ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.pytext import n_words
from ..operators import progress
from ..session import kept, work_folder
from ..sources import prompts, providers
from ..sources.ledger import Ledger
from ..streaming import choices, fresh
from .evaluation import duck_nwords
from .registry import registry

QUERIES, ORACLES, query = registry()


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A request as it is digested: each part behind its length in bytes, a missing one as a dash.
_PART = "concat(strlen({0}), ':', {0})"


@query(
    f"""WITH a AS (SELECT doc_id, 'folioforge.sources.providers.RuleChat' AS p, '{prompts.METADATA}' AS s, substr(coalesce(text, ''), 1, 2000) AS u FROM documents),
d AS (SELECT doc_id, sha256(concat({_PART.format('p')}, '-', {_PART.format('s')}, {_PART.format('u')})) AS call, strlen(u) AS bytes FROM a)
SELECT call, count(*) AS n_asked, CAST(1 AS BIGINT) AS n_paid, CAST(sum(bytes) AS BIGINT) AS bytes_asked, CAST(any_value(bytes) AS BIGINT) AS bytes_paid FROM d GROUP BY call"""
)
def paid_calls(spark, sf_dir):
    """What a ledger saves: how often each request is asked by two readers of the same prompts, and how often it is paid for."""
    ledger = Ledger(spark, f"{work_folder(spark)}/calls-{uuid.uuid4().hex}")
    chat = providers.get_chat_provider("rules")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.lit(prompts.METADATA).alias("system"), prompts.metadata_prompt(F.coalesce("text", F.lit(""))).alias("user"))
    for _ in range(2):  # the second reader pays for nothing
        replies = providers.chat_json(docs, chat, "title string", ledger=ledger)
    asked = kept(docs.select("doc_id", providers.request(chat, "system", "user").alias("call"), F.octet_length("user").cast("long").alias("bytes")), "requests")
    answered = asked.join(replies.where("error is null").select("doc_id"), "doc_id", "left_semi")
    per = answered.groupBy("call").agg(F.count("*").alias("n_asked"), F.sum("bytes").alias("bytes_asked"), F.first("bytes").alias("bytes_paid"))
    paid = ledger.replies().groupBy("call").agg(F.count("*").alias("n_paid"))
    return per.join(paid, "call").select("call", "n_asked", "n_paid", "bytes_asked", "bytes_paid")


@query(f"WITH w AS (SELECT {duck_nwords('text')} AS n FROM documents) SELECT 'passages' AS name, count(*) AS total, count(*) FILTER (n >= 50) AS done, count(*) FILTER (n < 50) AS failed, CAST(sum(n) AS BIGINT) AS words FROM w")
def run_progress(spark, sf_dir):
    """Documents too short for a passage fail; the counts are those of the job that writes the results."""
    d = _read(spark, sf_dir, "documents").select("doc_id", n_words("text").alias("n"))
    results = d.withColumn("error", F.when(F.col("n") < 50, "fewer than 50 words"))
    out, counted = progress.run_counted(results, "passages", words=F.sum("n"))
    return progress.as_row(spark, "passages", counted)


CHOICE = "CASE WHEN event_type = 'signup' THEN get_json_object(props, '$.k') END"


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'signup' THEN json_extract_string(props, '$.k') END AS c FROM events),
w AS (SELECT user_id, event_id, ts, last_value(c IGNORE NULLS) OVER x AS c, last_value(CASE WHEN c IS NOT NULL THEN ts END IGNORE NULLS) OVER x AS since FROM e WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CASE WHEN ts - since <= INTERVAL 2 DAY THEN c END AS remembered FROM w""")
def remembered_choices(spark, sf_dir):
    """Events replayed by thirds of the month, the stream ended and started again from its checkpoint after each."""
    events, base = _read(spark, sf_dir, "events"), f"{work_folder(spark)}/choices-{uuid.uuid4().hex}"
    for part in range(3):
        events.where(F.least(F.floor((F.day("ts") - 1) / 11), F.lit(2)) == part).write.mode("append").parquet(f"{base}/events")
        choices.remember_new(spark, f"{base}/events", events.schema, f"{base}/out", f"{base}/checkpoint", CHOICE)
    out = spark.read.schema("user_id long, ord long, at_us long, remembered string").parquet(f"{base}/out")
    return out.select("user_id", F.col("ord").alias("event_id"), "remembered")


FINISHED = "n_chars % 3 = 1"


@query(f"""SELECT doc_id, source FROM (SELECT doc_id, concat(source, '/', lang, '/', n_chars) AS source FROM documents)
WHERE source NOT IN (SELECT concat(source, '/', lang, '/', n_chars) FROM documents WHERE {FINISHED} UNION SELECT concat('elsewhere/', o_orderkey) FROM orders)""")
def pending_by_filter(spark, sf_dir):
    """The finished sources are those of some documents and many that no document has."""
    name = "concat(source, '/', lang, '/', n_chars) AS source"
    d = _read(spark, sf_dir, "documents").selectExpr("doc_id", name, "n_chars")
    done = d.where(FINISHED).select("source").union(_read(spark, sf_dir, "orders").selectExpr("concat('elsewhere/', o_orderkey) AS source"))
    return fresh.pending_filtered(d.select("doc_id", "source"), done)


#: Replies around the JSON of the events: whole, with odd types, nested, cut in the middle, no object at all.
ODD_REPLY = """CASE event_id % 7
 WHEN 0 THEN concat('{"title": "', event_type, '", "year": ', 1990 + event_id % 40, ', "authors": ["A', user_id, '", "B"], "meta": ', props, '}')
 WHEN 1 THEN concat('{"title": ', user_id, ', "year": "', event_type, '", "meta": {"k": "', event_type, '"}}')
 WHEN 2 THEN concat('{"title": "', event_type, '", "year": null, "authors": {"first": "', event_type, '"}, "meta": ', props, '}')
 WHEN 3 THEN concat('{"title": "', event_type, '", "year": ', event_id, ', "meta": ', substr(props, 1, 3))
 WHEN 4 THEN concat('[', props, ']')
 WHEN 5 THEN concat('Here is the JSON: ', props)
 ELSE concat('{"year": ', event_id % 30, ', "meta": {"k": {"deep": ', props, '}}}') END"""


@query(f"""WITH r AS (SELECT event_id, {ODD_REPLY} AS reply FROM events), j AS (SELECT event_id, json_valid(reply) AS ok, CASE WHEN json_valid(reply) THEN reply END AS reply FROM r),
f AS (SELECT event_id, ok, ok AND json_type(reply) = 'OBJECT' AS obj, json_type(reply, '$.title') AS tt, json_type(reply, '$.year') AS ty, json_type(reply, '$.authors') AS ta, json_type(reply, '$.meta.k') AS tk, reply FROM j)
SELECT event_id, CASE WHEN obj AND tt IN ('VARCHAR', 'UBIGINT') THEN json_extract_string(reply, '$.title') END AS title, CASE WHEN obj AND ty = 'UBIGINT' THEN CAST(json_extract_string(reply, '$.year') AS INT) END AS year,
 CASE WHEN obj AND ta = 'ARRAY' THEN CAST(json_extract(reply, '$.authors') AS VARCHAR[]) END AS authors, CASE WHEN obj AND tk = 'UBIGINT' THEN CAST(json_extract_string(reply, '$.meta.k') AS BIGINT) END AS k,
 CASE WHEN NOT ok THEN ['reply'] WHEN NOT obj THEN ['object'] ELSE list_filter([CASE WHEN ty NOT IN ('UBIGINT', 'NULL') THEN 'year' END, CASE WHEN ta NOT IN ('ARRAY', 'NULL') THEN 'authors' END, CASE WHEN tk NOT IN ('UBIGINT', 'NULL') THEN 'k' END], lambda x: x IS NOT NULL) END AS rejected FROM f""")
def variant_replies(spark, sf_dir):
    """Replies of no fixed shape: what fits is read, what does not is named."""
    fields = {"title": ("$.title", "string"), "year": ("$.year", "int"), "authors": ("$.authors", "array<string>"), "k": ("$.meta.k", "bigint")}
    e = _read(spark, sf_dir, "events").selectExpr("event_id", f"{ODD_REPLY} AS reply")
    return e.select("event_id", providers.variant_fields("reply", fields).alias("v")).select("event_id", "v.title", "v.year", "v.authors", "v.k", "v.rejected")
