"""Provider interfaces, registries and the stages that call them.

A provider runs inside an Arrow stage on executors and is the only step that may leave the JVM for
a network. Requests go through a ledger (see ``ledger``): equal ones are called once, and neither a
lost executor nor a second reader repeats a paid call. A failing row yields an error text and spares
the others.
"""

from __future__ import annotations

import json
import random
import re
import time
from abc import ABC, abstractmethod
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class ProviderError(RuntimeError):
    """A provider that gave up."""


class ChatProvider(ABC):
    @abstractmethod
    def complete(self, messages: list[dict], *, model: str | None = None, temperature: float = 0.0) -> str:
        """Reply to messages of {role, content}."""

    def complete_json(self, system: str, user: str, **options) -> dict:
        return json.loads(self.complete([{"role": "system", "content": system}, {"role": "user", "content": user}], **options))


class OcrProvider(ABC):
    @abstractmethod
    def extract(self, filename: str, content: bytes) -> list[str]:
        """Markdown of each page."""


class EchoOcr(OcrProvider):
    """Deterministic stand-in: pages are the form-feed parted parts of the bytes read as text."""

    def extract(self, filename: str, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")


class RuleChat(ChatProvider):
    """Deterministic stand-in: title from the first line, headings of numbered lines as plan, no other knowledge."""

    def complete(self, messages: list[dict], *, model: str | None = None, temperature: float = 0.0) -> str:
        text = messages[-1]["content"]
        numbered = [re.match(r"(\d+): (#{1,6})\s+(.*\S)", x) for x in text.split("\n")]
        heads = [(int(m[1]), len(m[2]), m[3]) for m in numbered if m]
        if heads:
            last = len(numbered)
            ends = [n - 1 for n, _, _ in heads[1:]] + [last]
            return json.dumps({"sections": [{"label": t, "section_id": "", "language": "unknown", "level": k, "start_line": n, "end_line": e} for (n, k, t), e in zip(heads, ends, strict=True)]})
        first = next((x.strip("# ").strip() for x in text.splitlines() if x.strip()), "")
        return json.dumps({"title": first, "authors": [], "year": None, "source": "", "doi": "", "doc_type": "unknown", "languages": [], "structure_pattern": "unknown"})


def retried(attempts: int = 3, wait: float = 1.0, backoff: bool = True):
    """Call again on any exception, at most ``attempts`` times, waiting 2**k times ``wait`` plus jitter."""

    def around(f):
        @wraps(f)
        def call(*args, **kwargs):
            for k in range(attempts):
                try:
                    return f(*args, **kwargs)
                except Exception as e:
                    if k + 1 == attempts:
                        raise ProviderError(str(e) or repr(e)) from e
                    if backoff and wait:
                        time.sleep(wait * (2**k + random.random()))

        return call

    return around


_CHAT: dict[str, tuple] = {}
_OCR: dict[str, tuple] = {}


def register_chat_provider(name: str, cls: type, config: dict | None = None) -> None:
    _CHAT[name] = (cls, config or {})


def register_ocr_provider(name: str, cls: type, config: dict | None = None) -> None:
    _OCR[name] = (cls, config or {})


def list_chat_providers() -> list[str]:
    return sorted(_CHAT)


def list_ocr_providers() -> list[str]:
    return sorted(_OCR)


def _made(registry: dict, kind: str, name: str, **config):
    if name not in registry:
        raise ValueError(f"unknown {kind} provider {name!r}; known: {', '.join(sorted(registry))}")
    cls, given = registry[name]
    return cls(**(given | config))


def get_chat_provider(name: str, **config) -> ChatProvider:
    return _made(_CHAT, "chat", name, **config)


def get_ocr_provider(name: str, **config) -> OcrProvider:
    return _made(_OCR, "OCR", name, **config)


register_chat_provider("rules", RuleChat)
register_ocr_provider("echo", EchoOcr)


def named_class(provider) -> str:
    """What a provider object is called in a ledger: its class."""
    return f"{type(provider).__module__}.{type(provider).__qualname__}"


def request(provider, *parts):
    """The column that names a request of ``parts`` to a provider object without a model, as the ledger has it."""
    from .ledger import digest

    return digest(F.lit(named_class(provider)), F.lit(None).cast("string"), *parts)


def ocr_pages(files: DataFrame, provider: OcrProvider, key: str = "path", attempts: int = 3, wait: float = 1.0, ledger=None) -> DataFrame:
    """(key, page_no from 1, text, error) from (key, filename, content); each file is sent once, at this call."""

    def extract(name, model, parts):
        return json.dumps(provider.extract(parts["filename"], parts["content"] or b""))

    asked = files.select(F.col(key).cast("string").alias(key), F.lit(named_class(provider)).alias("provider"), F.lit(None).cast("string").alias("model"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("content", F.lit("").cast("binary")).alias("content"))
    replies = _ledger(files, ledger).ask(asked, [key], ["filename", "content"], extract, attempts, wait)
    pages = F.from_json("reply", "array<string>")
    good = replies.where("error is null").select(key, F.posexplode(pages).alias("page_no", "text"), "error").withColumn("page_no", F.col("page_no") + 1)
    return good.union(replies.where("error is not null").select(key, F.lit(1), F.lit(None).cast("string"), "error"))


def _ledger(df: DataFrame, ledger):
    """The ledger given, or that of the application."""
    from .ledger import Ledger

    return ledger or Ledger(df.sparkSession)


def chat_json(prompts: DataFrame, provider: ChatProvider, schema: str, key: str = "doc_id", attempts: int = 3, wait: float = 1.0, ledger=None) -> DataFrame:
    """(key, reply as ``schema``, error) from (key, system, user); a reply that is no JSON is retried. Calls are made at this call, once a prompt."""

    def complete(name, model, parts):
        return json.dumps(provider.complete_json(parts["system"], parts["user"]))

    asked = prompts.select(key, F.lit(named_class(provider)).alias("provider"), F.lit(None).cast("string").alias("model"), "system", "user")
    done = _ledger(prompts, ledger).ask(asked, [key], ["system", "user"], complete, attempts, wait)
    return done.select(key, F.from_json("reply", schema).alias("reply"), "error")


def timed_replies(prompts: DataFrame, chats: dict, keys: list, attempts: int = 3, wait: float = 1.0, ledger=None) -> DataFrame:
    """(keys, reply, error, latency_s) from (keys, chat_provider, model, system, user).

    ``chats`` maps names to providers; reply is JSON text. A reply that is no JSON is retried, and a
    row that fails has an error. latency_s is the wall time of the request's calls, waits included.
    Calls are made at this call, once for equal requests.
    """

    def complete(name, model, parts):
        return json.dumps(_known(chats, name).complete_json(parts["system"], parts["user"], model=model))

    asked = prompts.select(*keys, F.col("chat_provider").alias("provider"), "model", "system", "user")
    return _ledger(prompts, ledger).ask(asked, keys, ["system", "user"], complete, attempts, wait)


def _known(chats: dict, name: str) -> ChatProvider:
    if name not in chats:
        raise ProviderError(f"no chat provider {name!r}")
    return chats[name]


#: Fields of a profile and what stands for a missing one.
PROFILE = {"doc_type": ("string", "unknown"), "languages": ("array<string>", []), "structure_pattern": ("string", "unknown"), "structure_notes": ("string", ""), "estimated_sections": ("array<string>", [])}
PLAN = "sections array<struct<label:string,section_id:string,language:string,level:int,start_line:int,end_line:int>>"


def profile(reply):
    """The profile in a JSON reply: a field that is missing has its default, a null stays null."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    have = F.coalesce(F.json_object_keys(reply), F.array().cast("array<string>"))
    parsed = F.from_json(reply, ", ".join(f"{k} {t}" for k, (t, _) in PROFILE.items()))
    default = lambda t, d: F.array().cast(t) if d == [] else F.lit(d)
    return F.struct(*(F.when(F.array_contains(have, k), parsed[k]).otherwise(default(t, d)).alias(k) for k, (t, d) in PROFILE.items()))


def planned(replies: DataFrame, keys: list, reply: str = "reply") -> DataFrame:
    """(keys, ord, label, section_id, language, level, start_line, end_line) of plans in JSON replies."""
    rows = replies.select(*keys, F.posexplode(F.from_json(reply, PLAN)["sections"]).alias("ord", "s"))
    blank = lambda c, d: F.coalesce(F.col(f"s.{c}"), F.lit(d)).alias(c)
    return rows.where("s.start_line is not null and s.end_line is not null").select(*keys, "ord", blank("label", ""), blank("section_id", ""), blank("language", "unknown"), blank("level", 1), "s.start_line", "s.end_line")


def extracted_metadata(docs: DataFrame, provider: ChatProvider, id_col: str = "doc_id", text_col: str = "text", attempts: int = 3, wait: float = 1.0, ledger=None) -> DataFrame:
    """(id, title, authors, year, source, doi, error) read by a chat provider from each text's first 2000 characters."""
    from .prompts import METADATA, metadata_prompt

    asked = docs.select(id_col, F.lit(METADATA).alias("system"), metadata_prompt(F.coalesce(F.col(text_col), F.lit(""))).alias("user"))
    replies = chat_json(asked, provider, "title string, authors array<string>, year int, source string, doi string", id_col, attempts, wait, ledger)
    return replies.select(id_col, clean_metadata("reply").alias("m"), "error").select(id_col, "m.*", "error")


class ScholarProvider(ABC):
    @abstractmethod
    def search(self, query: str, most: int = 3) -> list[dict]:
        """Hits of {publicationInfo, citedBy, link, year}, the best one first."""


def scholar_query(doi, title, authors):
    """The DOI, else the title in quotes and the last word of the first author."""
    from ..functions.pytext import col, words

    first = F.try_element_at(words(F.get(col(authors), F.lit(0))), F.lit(-1))
    by_title = F.concat(F.lit('"'), F.coalesce(col(title), F.lit("")), F.lit('"'), F.coalesce(F.concat(F.lit(" "), first), F.lit("")))
    return F.when(F.coalesce(col(doi), F.lit("")) != "", col(doi)).otherwise(by_title)


def looked_up(queries: DataFrame, provider: ScholarProvider, key: str = "doc_id", ledger=None) -> DataFrame:
    """(key, publication_info, cited_by, url, year) of the first hit of (key, query); nulls without one or on any error. Equal queries are sent once, at this call."""
    from ..functions.strings import recovered_year

    def search(name, model, parts):
        top = (provider.search(parts["query"]) or [{}])[0]
        text = lambda k: None if top.get(k) is None else str(top[k])
        first = lambda k: text(k) if k in top else "" if top else None
        return json.dumps({"publication_info": first("publicationInfo"), "cited_by": None if top.get("citedBy") is None else int(top["citedBy"]), "url": first("link"), "y": text("year")})

    asked = queries.select(key, F.lit(named_class(provider)).alias("provider"), F.lit(None).cast("string").alias("model"), "query")
    found = _ledger(queries, ledger).ask(asked, [key], ["query"], search, 1, 0)
    done = found.select(key, F.from_json("reply", "publication_info string, cited_by long, url string, y string").alias("r")).select(key, "r.*")
    return done.select(key, "publication_info", "cited_by", "url", recovered_year("y", "publication_info").alias("year"))


def variant_fields(reply, fields: dict) -> Column:
    """struct<fields, rest, rejected> of a JSON reply of any shape, read as a VARIANT.

    ``fields`` maps names to (path, type), as in ``{"year": ("$.year", "int")}``. A field that is
    missing or null is null; one whose value is no such type is null and named in ``rejected``. A reply
    that is cut or no JSON at all has only nulls and ``rejected`` = ["reply"]; an object is wanted, so
    other JSON has ["object"]. ``rest`` is the reply as JSON text in one form, so that nothing it
    said is lost.
    """
    text = F.col(reply) if isinstance(reply, str) else reply
    v = F.try_parse_json(text)
    shape = F.schema_of_variant(v)
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    got = {n: F.when(is_object, F.try_variant_get(v, path, kind)) for n, (path, kind) in fields.items()}
    # a JSON null reads as a variant whose schema is VOID
    given = {n: is_object & F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) != "VOID", F.lit(False)) for n, (path, _) in fields.items()}
    bad = F.filter(F.array(*(F.when(given[n] & got[n].isNull(), F.lit(n)) for n in fields)), lambda x: x.isNotNull())
    rejected = F.when(v.isNull(), F.array(F.lit("reply"))).when(~is_object, F.array(F.lit("object"))).otherwise(bad)
    return F.struct(*(got[n].alias(n) for n in fields), F.to_json(v).alias("rest"), rejected.alias("rejected"))


def clean_metadata(reply):
    """Metadata with authors as trimmed non-empty strings."""
    from ..functions.pytext import strip

    r = F.col(reply) if isinstance(reply, str) else reply
    authors = F.filter(F.transform(F.coalesce(r["authors"], F.array().cast("array<string>")), strip), lambda a: a.isNotNull() & (a != ""))
    return F.struct(r["title"].alias("title"), authors.alias("authors"), r["year"].alias("year"), r["source"].alias("source"), r["doi"].alias("doi"))
