"""Personal data: strict base patterns, wider candidates and boosted trees, all as SQL expressions.

Base spans of a kind are the leftmost non-overlapping matches of its pattern that pass a check.
High-recall patterns propose further candidates; boosted trees over format and context features,
fitted on the candidates of all texts, of which one is positive where it is what its kind asks for
(``_is``), whether or not a base pattern finds it, score them. The fit takes each text twice, the
second time with known spans rewritten in other signs and spellings, which are labelled by the same rule.
Candidates at or over a threshold calibrated for precision on held-out documents join the base spans. A kind with too few of either
class, or no threshold, selects by ``_is`` itself. All are Catalyst expressions over the text column.

The patterns are written so that no text makes them recurse or rescan: runs are possessive, and a
run is entered at its start only (or where the last match ended), which finds the same matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import column, drop_written, written


def _again(pattern: str) -> str:
    """The pattern for a second use in one expression: its groups get names of their own."""
    return re.sub(r"(\(\?<|\\k<)([a-z]+)>", r"\1\2b>", pattern)


KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: How cards are printed: groups with one separator throughout, or one run of digits.
_CARD = r"(?:[0-9]{4}(?:(?<sep>[\x20./-])[0-9]{4}(?:\k<sep>[0-9]{4}){2}(?:\k<sep>[0-9]{3})?|(?<gap>[\x20./-])[0-9]{6}\k<gap>[0-9]{4,5})|[0-9]{13,19})(?![0-9])"
#: A national number in groups of 3, 3 and 4.
_LOCAL = r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![.-]?[0-9])"
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f.:])(?:[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3,5}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Fa-f:])",
    "card": rf"(?<![0-9])(?:{_CARD}|[0-9](?:(?![\x20./-]{_again(_CARD)})[\x20./-]?[0-9]){{11,22}}(?![0-9]))",
    "phone": rf"(?<![0-9+])(?:{_LOCAL}|(?:\+|00|\(|[0-9])[0-9]?[\x20().0-9/-]{{6,24}}[0-9](?![0-9]))",
}
#: How known spans are rewritten for the fit, by kind: spelt-out signs, brackets, other separators.
REWRITTEN = (
    (r"([A-Za-z0-9._%+-]++)@([A-Za-z0-9-]++)(?=\.[A-Za-z0-9-])", "$1 (at) $2"),
    (r"(?<![0-9.])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9.])", "$1[.]$2[.]$3[.]$4"),
    (r"(?<![0-9])([0-9]{4})[\x20-]?([0-9]{4})[\x20-]?([0-9]{4})[\x20-]?([0-9]{4})(?![0-9])", "$1.$2.$3.$4"),
    (r"\+([0-9]{1,3})[\x20(-]++([0-9]{2,4})[)\x20-]++([0-9]{3})[\x20-]([0-9]{4})(?![0-9])", "+$1/$2/$3/$4"),
)
NEEDS = {"email": "@|\\(at\\)|\\[at\\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
HINTS = {"email": "mail|contact|write to", "ip": "ip|host|server|addr", "card": "card|visa|credit|debit|account", "phone": r"\b(?:tele|cell)?phone|\btel|\bcall|\bmobile|\bfax|\bwhatsapp"}
#: The precision asked of a threshold.
PRECISION = 0.98
SPAN = "struct<s:bigint,e:bigint,m:string,b:string,a:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(m: Column) -> Column:
    def small(x):
        x = F.regexp_replace(x, "^0+", "")
        return (F.length(x) < 4) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, "\\."), small)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": _octets(m),
        "card": F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def _form(kind: str, m: Column) -> Column:
    """Whether a candidate is written like its kind, spelt-out signs read as the signs."""
    if kind == "email":
        m = F.regexp_replace(F.regexp_replace(m, r"\x20?(?:@|\(at\)|\[at\])\x20?", "@"), r"\x20?(?:\(dot\)|\[dot\])\x20?", ".")
        return m.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})$")
    if kind == "ip":
        m = F.replace(m, F.lit("[.]"), F.lit("."))
        return F.when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), _octets(m)).otherwise(m.contains(":"))
    if kind == "card":
        return m.rlike(f"^{_CARD}$")
    return m.rlike(rf"^(?:\+|00[1-9]|{_LOCAL}$)")


def _hinted(kind: str, c: Column) -> Column:
    return F.lower(c["b"]).rlike(f"(?:{HINTS[kind]})[^a-z]*$")


def _is(kind: str, c: Column) -> Column:
    """Whether a candidate is of its kind, judged without the base patterns."""
    form = _form(kind, c["m"])
    if kind == "card":
        return form & _valid(kind, c["m"])
    if kind == "phone":
        return (form | _hinted(kind, c)) & _valid(kind, c["m"])
    return form


def _matched(df: DataFrame, patterns: dict, tag: str) -> DataFrame:
    """Adds, for each kind, the matches of its pattern and the gaps around them."""
    cols = {}
    for kind, pattern in patterns.items():
        may = F.col("_text").rlike(NEEDS[kind])
        cols[f"_{tag}m_{kind}"] = F.when(may, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        cols[f"_{tag}g_{kind}"] = F.when(may, F.split("_text", pattern, -1)).otherwise(F.array(F.lit("")))
    return df.withColumns(cols)


def _spans(kind: str, tag: str, keep) -> Column:
    """array<SPAN> of the matches that ``keep`` accepts: code point start and end, match, context."""
    m, g = F.col(f"_{tag}m_{kind}"), F.col(f"_{tag}g_{kind}")
    both = F.filter(F.arrays_zip(m.alias("m"), g.alias("g"), F.slice(g, F.lit(2), F.size(g)).alias("h")), lambda x: x["m"].isNotNull())

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        span = F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(24)).alias("b"), F.left(F.coalesce(x["h"], F.lit("")), F.lit(8)).alias("a"))
        out = F.when(keep(x["m"]), F.concat(acc["out"], F.array(span.cast(SPAN)))).otherwise(acc["out"])
        return F.struct(e.cast("long").alias("at"), out.cast(f"array<{SPAN}>").alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _features(kind: str, c: Column) -> list[Column]:
    m, digits = c["m"], _digits(c["m"])
    number = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int").cast("double")
    return [
        flag(_form(kind, m)),  # first: it wins where a small sample parts by other features as well
        F.length(m).cast("double"),
        F.length(digits).cast("double"),
        number("[A-Za-z]"),
        number("\\x20"),
        number("-"),
        number("\\."),
        number("[()/:\\[\\]]"),
        number("[0-9]+"),
        flag(m.startswith("+")),
        flag(m.startswith("0")),
        flag(m.contains("@")),
        flag(F.right(c["b"], F.lit(1)).rlike("[A-Za-z0-9]")),
        flag(F.left(c["a"], F.lit(1)).rlike("[A-Za-z0-9]")),
        flag(_hinted(kind, c)),
        flag(F.lower(c["b"]).rlike("(?:version|release|licen[cs]e|v|no|number|id)[^a-z]*$")),
        flag(F.when(F.length(digits).between(8, 24), _luhn(digits)).otherwise(False)),
        flag(F.when(m.rlike("^[0-9.]+$"), _octets(m)).otherwise(False)),
        F.length(F.regexp_replace(digits, "(.)(?=.*\\1)", "")).cast("double"),
    ]


def _overlaps(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))


def candidates(df: DataFrame) -> DataFrame:
    """(kind, x, y, held, n): the candidates of all texts, as they stand and rewritten, counted by features, label and side.

    One pass over the texts. Outer explodes spare the filters that would match every text once more.
    """
    other = F.col("_text")
    for pattern, by in REWRITTEN:
        other = F.regexp_replace(other, pattern, by)
    texts = df.where(F.col("_text").rlike("[0-9@]")).select("_id", "_text", other.alias("_other"))
    both = F.when(F.col("_other") != F.col("_text"), F.array("_text", "_other")).otherwise(F.array("_text"))
    rows = _matched(texts.select("_id", F.explode_outer(both).alias("_text")), WIDE, "w")
    tagged = lambda k: F.transform(_spans(k, "w", lambda m: F.lit(True)), lambda c: F.struct(F.lit(k).alias("kind"), c.alias("c")))
    spans = F.concat(*map(tagged, KINDS))
    rows = rows.select("_id", F.explode_outer(spans).alias("x")).where("x is not null").select("_id", "x.kind", "x.c")
    by_kind = lambda f: F.coalesce(*(F.when(F.col("kind") == k, f(k)) for k in KINDS))
    data = rows.select("kind", by_kind(lambda k: F.array(*_features(k, F.col("c")))).alias("x"), F.coalesce(by_kind(lambda k: _is(k, F.col("c"))), F.lit(False)).cast("int").alias("y"), (F.pmod(F.xxhash64("_id", F.lit("held")), F.lit(4)) == 0).alias("held"))
    return data.groupBy("kind", "x", "y", "held").agg(F.count("*").alias("n"))


def fitted(df: DataFrame, precision: float = PRECISION) -> dict:
    """kind -> (trees, threshold), from the candidates of all documents; trees are None where ``_is`` selects."""
    # written, so that the documents are read once and not once a kind and round
    data = written(candidates(df), "piifit")
    out = dict.fromkeys(KINDS, (None, None))
    try:
        have = {(r["kind"], r["y"]): r["n"] for r in data.groupBy("kind", "y").agg(F.sum("n").alias("n")).collect()}
        for k in KINDS:
            if min(have.get((k, 0), 0), have.get((k, 1), 0)) < 20:
                continue
            own = data.where(F.col("kind") == k)
            trees = boost.fit(own.where("not held"), rounds=8, depth=3, weight="n")
            if not trees:
                continue
            p = boost.as_sql(trees, [F.col("x")[i] for i in range(len(_features(k, F.struct(F.lit("").alias("m"), F.lit("").alias("b"), F.lit("").alias("a")))))])
            held = own.where("held").select((F.floor(p * 100) / 100).alias("p"), "y", "n").groupBy("p").agg(F.sum(F.col("y") * F.col("n")).alias("pos"), F.sum("n").alias("n")).orderBy(F.desc("p")).collect()
            threshold, pos, n = None, 0, 0
            for r, under in zip(held, [*(r["p"] + 0.01 for r in held[1:]), 0.0], strict=True):
                pos, n = pos + r["pos"], n + r["n"]
                if pos >= precision * n:
                    threshold = (r["p"] + under) / 2  # between it and the next lower one seen
            if threshold is not None:
                out[k] = (trees, max(threshold, 0.5))
    finally:
        drop_written(data)
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), models: dict | None = None, prefix: str = "") -> DataFrame:
    """One row per input row: (id, n_email, n_ip, n_card, n_phone, base, spans) and columns ``keep``.

    ``prefix`` is put before the names of the counts, base and spans.

    base and spans are arrays of (kind, s, e) by kind (email, ip, card, phone), then start; s and e
    are code points, e exclusive. The counts and ``base`` hold the strict matches; ``spans`` also
    holds candidates that the fitted trees select and that overlap no base span of their kind.
    Null and empty texts have none. Ids may be null or repeat; an empty table gives an empty
    result. ``models`` (kind -> trees, threshold) may be passed; by default they are fitted here.
    """
    own = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *(column(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    models = fitted(own) if models is None else models  # trees None: by _is
    rows = _matched(own, BASE, "b")
    if models:
        rows = _matched(rows, {k: WIDE[k] for k in models}, "w")
    rows = rows.withColumns({f"_base_{k}": _spans(k, "b", lambda m, k=k: _valid(k, m)) for k in KINDS})

    def chosen(k):
        trees, threshold = models[k]
        good = lambda c: _is(k, c) if trees is None else boost.as_sql(trees, _features(k, c)) >= threshold
        return F.filter(_spans(k, "w", lambda m: F.lit(True)), good)

    def added(k):
        return F.filter(f"_wide_{k}", lambda c: ~_overlaps(F.col(f"_base_{k}"), c))

    rows = rows.withColumns({f"_wide_{k}": chosen(k) for k in models})
    plain = lambda k, a: F.transform(a, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    base = {k: plain(k, F.col(f"_base_{k}")) for k in KINDS}
    full = {k: F.array_sort(F.array_distinct(F.concat(base[k], plain(k, added(k))))) if k in models else base[k] for k in KINDS}
    return rows.select(
        F.col("_id").alias(id_col),
        *(F.size(f"_base_{k}").cast("long").alias(f"{prefix}n_{k}") for k in KINDS),
        F.concat(*base.values()).alias(f"{prefix}base"),
        F.concat(*full.values()).alias(f"{prefix}spans"),
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by its first kind, as [KIND]."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def step(acc, x):
        gap = F.substring(text, acc["at"].cast("int") + 1, (x["s"] - acc["at"]).cast("int"))
        fresh = x["s"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).cast("long").alias("at"), out.cast("string").alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
