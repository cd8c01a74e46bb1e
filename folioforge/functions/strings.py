"""Scalar functions over titles, names, languages and URLs."""

from __future__ import annotations

from functools import cache
from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import SPACE, col, strip, sub, words

#: Words left out of title keywords.
STOP_WORDS = "a an the and or but of in on at to for with by from is are was were be been as that this it its than how what when where why which who".split()
#: Language names and their short and display forms.
LANGUAGE_SLUGS = {"english": "en", "isixhosa": "xhosa", "xhosa": "xhosa", "french": "fr", "afrikaans": "af", "zulu": "zu", "portuguese": "pt", "spanish": "es", "arabic": "ar"}
LANGUAGE_LABELS = {"en": "EN", "xhosa": "XHO", "fr": "FR", "af": "AF", "zu": "ZU", "pt": "PT", "es": "ES", "ar": "AR"}


def _mapping(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in d.items() for x in pair))


def file_slug(c) -> Column:
    """Name for a file: other characters than word characters and hyphens become one underscore."""
    s = sub(sub(c, r"(?U)[^\w\-]", "_"), "_+", "_")
    s = sub(s, r"\A_+|_+\z")
    return F.when(s == "", "doc").otherwise(s)


def section_slug(c) -> Column:
    s = sub(sub(F.lower(col(c)), rf"(?U)[^\w\-{SPACE}]"), rf"[{SPACE}\-]+", "_")
    s = sub(s, r"\A_+|_+\z")
    return F.when(s == "", "section").otherwise(s)


def book_slug(c) -> Column:
    s = F.substring(sub(sub(F.lower(col(c)), "[^a-zA-Z0-9]+", "_"), r"\A_+|_+\z"), 1, 60)
    return F.when(s == "", "chapter").otherwise(s)


@cache
def accented() -> tuple[str, str]:
    """(signs, letters): every sign whose canonical decomposition holds one ASCII letter or digit, and that one."""
    pairs = []
    for k in range(0x80, 0x110000):
        plain = [x for x in normalize("NFD", chr(k)) if x.isascii() and x.isalnum()] if not 0xD800 <= k < 0xE000 else []
        if len(plain) == 1:
            pairs.append((chr(k), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_title(c) -> Column:
    """ASCII letters and digits only, accents dropped, each run of letters in title case."""
    s = sub(F.translate(col(c), *accented()), "[^a-zA-Z0-9]")
    runs = F.regexp_extract_all(s, F.lit("[a-zA-Z]+|[0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))), "")


def last_name(c) -> Column:
    c = col(c)
    parts = words(strip(c))
    return ascii_title(F.when(c.contains(","), F.split(c, ",")[0]).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), c)))


def title_keywords(c, n: int = 3) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0))
    good = F.slice(F.filter(found, lambda w: ~F.lower(w).isin(STOP_WORDS) & (F.length(w) > 2)), 1, n)
    s = F.array_join(F.transform(good, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))), "")
    return F.when(F.size(good) == 0, "Article").otherwise(s)


def article_slug(authors, year, title) -> Column:
    """Author_Year_TitleKeywords; a year of 0 counts as missing."""
    names = F.transform(F.filter(F.coalesce(col(authors), F.array().cast("array<string>")), lambda a: a.isNotNull() & (strip(a) != "")), last_name)
    n = F.size(names)
    first, second = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    who = F.when(n == 0, "Unknown").when(n == 1, first).when(n == 2, F.concat(first, second)).otherwise(F.concat(first, F.lit("Etal")))
    when = F.when(F.coalesce(col(year), F.lit(0)) == 0, "XXXX").otherwise(col(year).cast("string"))
    return F.concat_ws("_", who, when, title_keywords(title))


def yaml_string(c) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def yaml_list(c) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(col(c), yaml_string), ", "), F.lit("]"))


def author_initials(c) -> Column:
    """Last, F. M."""
    c = col(c)
    parts = words(strip(c))
    firsts = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.left(p, F.lit(1)), F.lit(".")))
    return F.when(F.size(parts) >= 2, F.concat(F.try_element_at(parts, F.lit(-1)), F.lit(", "), F.array_join(firsts, " "))).otherwise(c)


def apa_citation(authors, year, title, journal, doi) -> Column:
    names = F.transform(F.coalesce(col(authors), F.array().cast("array<string>")), author_initials)
    n = F.size(names)
    most = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    who = F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(most, F.lit(", & "), F.try_element_at(names, F.lit(-1))))
    when = F.when(F.coalesce(col(year), F.lit(0)) == 0, "(n.d.)").otherwise(F.concat(F.lit("("), col(year).cast("string"), F.lit(")")))
    journal, doi = F.coalesce(col(journal), F.lit("")), F.coalesce(col(doi), F.lit(""))
    where = F.when(journal == "", "").otherwise(F.concat(F.lit("*"), journal, F.lit("*")))
    parts = F.filter(F.array(who, when, F.concat(col(title), F.lit(".")), where), lambda p: p != "")
    return F.concat(F.array_join(parts, " "), F.when(doi == "", "").otherwise(F.concat(F.lit(" https://doi.org/"), doi)))


def language_slug(c) -> Column:
    s = F.lower(col(c))
    return F.coalesce(F.try_element_at(_mapping(LANGUAGE_SLUGS), s), F.replace(s, F.lit(" "), F.lit("_")))


def language_label(c) -> Column:
    s = language_slug(c)
    return F.coalesce(F.try_element_at(_mapping(LANGUAGE_LABELS), s), F.substring(F.upper(s), 1, 3))


def heading_key(c) -> Column:
    """Lower-case ASCII letters and digits, others as one space: the form in which labels compare."""
    return F.trim(sub(F.lower(col(c)), "[^a-z0-9]+", " "))


def tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-zA-Z0-9']+"), F.lit(0)))


def recovered_year(value, info) -> Column:
    """An integer year in (1500, 2200), else the last year named in either text."""
    pattern = F.lit(r"\b(1[5-9]\d{2}|20\d{2}|21\d{2})\b")
    last = lambda c: F.try_element_at(F.regexp_extract_all(F.coalesce(col(c).cast("string"), F.lit("")), pattern, F.lit(1)), F.lit(-1)).cast("int")
    whole = F.when(col(value).cast("string").rlike(r"^\d{1,9}$"), col(value).cast("int"))
    return F.coalesce(F.when((whole > 1500) & (whole < 2200), whole), last(value), last(info))


def file_url_path(c) -> Column:
    """Path of a file URL: drive letters lose their slash, percent escapes are decoded."""
    path = F.coalesce(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    path = sub(path, "^/([A-Za-z]:)", "$1")
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def url_file_name(c) -> Column:
    name = F.try_element_at(F.split(F.split(col(c), r"\?")[0], "/"), F.lit(-1))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("document"))


def mime_type(c) -> Column:
    h = F.hex(F.substring(col(c), 1, 12))
    return F.when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("89504E47"), "image/png").when(h.startswith("47494638"), "image/gif").when(h.startswith("52494646") & h.endswith("57454250") & (F.length(h) == 24), "image/webp").otherwise("image/png")


def data_uri(c) -> Column:
    return F.concat(F.lit("data:"), mime_type(c), F.lit(";base64,"), sub(F.base64(col(c)), r"[\r\n]"))


def note_html(marker, text) -> Column:
    """Marker and escaped text as a preformatted note."""
    s = F.concat(col(marker), F.lit("\n"), col(text))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit("<pre>"), s, F.lit("</pre>"))


def document_format(path) -> Column:
    ext = F.lower(F.regexp_extract(col(path), r"(\.[^./\\]+)$", 1))
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".docx", ".doc"), "docx").when(ext.isin(".md", ".txt"), "md").when(ext.isin(".png", ".jpg", ".jpeg", ".webp", ".gif"), "image").otherwise("unknown")
