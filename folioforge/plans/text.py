"""Queries on texts and lines: passages, tokens, noise, samples, slugs, citations, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.pytext import lines, n_words
from ..operators import chunks, speech
from ..operators import lines as L
from .fixture import DUCK, decorated, decorated_lines
from .registry import registry

QUERIES, ORACLES, query = registry()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def duck_plain(c: str) -> str:
    steps = [(r"```[\s\S]*?```", " "), (r"`[^`]+`", " "), (r"(?m)^#{1,6}\s+", ""), (r"!\[[^\n]*?\]\([^\n]*?\)", " "), (r"\[([^\]]+)\]\([^\n]*?\)", r"\1"), (r"[*_]{1,3}([^*_]+)[*_]{1,3}", r"\1"), (r"\s+", " ")]
    for a, b in steps:
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return f"trim({c})"


def duck_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


def duck_windows(source: str, window: int, step: int) -> str:
    """Passages of (doc_id, t) rows."""
    return f"""
w AS (SELECT doc_id, {duck_words('t')} AS ws FROM ({source})),
k AS (SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= {window} THEN 1 ELSE CAST(ceil((len(ws) - {window}) / {step}.0) AS INT) + 1 END AS k FROM w),
p AS (SELECT doc_id, ws, unnest(range(0, k)) AS j FROM k),
passages AS (SELECT doc_id, CAST(j AS INT) AS j, array_to_string(ws[j * {step} + 1 : j * {step} + {window}], ' ') AS passage,
  CAST(CASE WHEN j = 0 THEN 0 ELSE length(array_to_string(ws[1 : j * {step}], ' ')) END AS INT) AS char_offset,
  CAST(floor(len(ws[j * {step} + 1 : j * {step} + {window}]) * 13 / 10) AS INT) AS token_count FROM p)"""


@query(f"WITH {duck_windows(f'SELECT doc_id, {duck_plain(chr(116) + chr(101) + chr(120) + chr(116))} AS t FROM documents', 300, 250)} SELECT * FROM passages")
def chunk_passages(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunks.passages(chunks.plain_text("text"), 300, 50)).alias("j", "p"))
    return d.select("doc_id", "j", "p.passage", "p.char_offset", chunks.token_estimate("p.passage").alias("token_count"))


@query(f"SELECT doc_id, CAST(len({duck_words('text')}) AS INT) AS n_words, CAST(floor(len({duck_words('text')}) * 13 / 10) AS INT) AS token_count FROM documents")
def chunk_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", n_words("text").alias("n_words"), chunks.token_estimate("text").alias("token_count"))


@query(f"SELECT doc_id, {duck_plain('text')} AS plain FROM documents")
def plain_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", chunks.plain_text("text").alias("plain"))


DUCK_NOISE = "regexp_matches(trim(line), '(?i)^(?:" + "|".join(p.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"[[\p{L}\p{N}_].-]", r"[\p{L}\p{N}_.-]") for p in L.NOISE) + ")$')"


@query(f"{DUCK} SELECT doc_id, line_no, trim(line) <> '' AND {DUCK_NOISE} AS noise FROM dec")
def noise_flags(spark, sf_dir):
    return decorated_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), L.is_noise("line").alias("noise"))


@query(f"{DUCK} SELECT doc_id, string_agg(CASE WHEN trim(line) <> '' AND {DUCK_NOISE} THEN '' ELSE line END, chr(10) ORDER BY line_no) AS text FROM dec GROUP BY doc_id")
def noise_filtered(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.array_join(L.without_noise("text"), "\n").alias("text"))


@query(f"{DUCK} SELECT doc_id, string_agg(concat(line_no, ': ', line), chr(10) ORDER BY line_no) AS numbered FROM dec GROUP BY doc_id")
def numbered_lines(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", L.numbered(lines("text")).alias("numbered"))


@query(f"{DUCK} SELECT doc_id, string_agg(concat(line_no, ': ', line), chr(10) ORDER BY line_no) AS sample FROM dec WHERE line_no <= 250 GROUP BY doc_id")
def survey_sample(spark, sf_dir):
    """The sample is the feature: a survey sees the first 250 lines of a document."""
    return decorated(spark, sf_dir).select("doc_id", L.numbered(F.slice(lines("text"), 1, 250)).alias("sample"))


@query("SELECT doc_id, substr(text, 1, 2000) AS sample FROM documents")
def metadata_sample(spark, sf_dir):
    """The sample is the feature: metadata is read from the first 2000 characters."""
    return _docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 2000).alias("sample"))


@query(
    r"""SELECT doc_id,
CASE WHEN f = '' THEN 'doc' ELSE f END AS file_slug, CASE WHEN s = '' THEN 'section' ELSE s END AS section_slug, CASE WHEN b = '' THEN 'chapter' ELSE b END AS book_slug
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}_\-]', '_', 'g'), '_+', '_', 'g'), '_') AS f,
  trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}_\s\-]', '', 'g'), '[\s\-]+', '_', 'g'), '_') AS s,
  substr(trim(regexp_replace(lower(t), '[^a-zA-Z0-9]+', '_', 'g'), '_'), 1, 60) AS b
  FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents))"""
)
def slugs(spark, sf_dir):
    """The first line stands for a title."""
    d = _docs(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias("t"))
    return d.select("doc_id", S.file_slug("t").alias("file_slug"), S.section_slug("t").alias("section_slug"), S.book_slug("t").alias("book_slug"))


#: Metadata made from a document's first line and words, and names with marks of many scripts; the same
#: SQL in both engines but for list syntax.
NAMES = {1: "Abū Al-Ḥasan", 6: "Trần Nguyễn", 11: "Đặng, Hữu", 13: "İbrahim Ǧamīl", 19: "Åsa Łukasz"}
NAME = "CASE doc_id % 20 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + " END"
STUB_DUCK = rf"""meta AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(1990 + doc_id % 30 AS INT) END AS year,
  list_transform(range(0, doc_id % 4), lambda j: CASE WHEN j = 0 AND {NAME} IS NOT NULL THEN {NAME} ELSE concat(ws[CAST(2 * j + 1 AS INT)], CASE WHEN j % 2 = 0 THEN ' ' ELSE ', ' END, ws[CAST(2 * j + 2 AS INT)]) END) AS authors, source AS journal, CASE WHEN doc_id % 3 = 0 THEN concat('10.1/', doc_id) ELSE '' END AS doi
  FROM (SELECT doc_id, text, source, list_concat(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'), ['Ann', 'Lee', 'Bo', 'Ray', 'Cy', 'Fox']) AS ws FROM documents))"""


def stub_metadata(spark, sf_dir):
    """(doc_id, title, year, authors, journal, doi, source)."""
    return _docs(spark, sf_dir).selectExpr(
        "doc_id",
        "substring_index(text, chr(10), 1) AS title",
        "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE cast(1990 + doc_id % 30 AS int) END AS year",
        r"concat(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+', 0), array('Ann', 'Lee', 'Bo', 'Ray', 'Cy', 'Fox')) AS ws",
        "source AS journal",
        "CASE WHEN doc_id % 3 = 0 THEN concat('10.1/', doc_id) ELSE '' END AS doi",
        "source",
    ).selectExpr("doc_id", "title", "year", f"CASE WHEN doc_id % 4 = 0 THEN array() ELSE transform(sequence(0, int(doc_id % 4) - 1), j -> CASE WHEN j = 0 AND {NAME} IS NOT NULL THEN {NAME} ELSE concat(ws[2 * j], CASE WHEN j % 2 = 0 THEN ' ' ELSE ', ' END, ws[2 * j + 1]) END) END AS authors", "journal", "doi", "source")


def duck_title(c: str) -> str:
    return f"concat(upper(substr({c}, 1, 1)), lower(substr({c}, 2)))"


def duck_last(a: str) -> str:
    raw = f"CASE WHEN contains({a}, ',') THEN split_part({a}, ',', 1) ELSE string_split({a}, ' ')[-1] END"
    return duck_title(f"regexp_replace(strip_accents({raw}), '[^a-zA-Z0-9]', '', 'g')")


STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
DUCK_SLUG = f"""concat_ws('_', CASE len(authors) WHEN 0 THEN 'Unknown' WHEN 1 THEN {duck_last('authors[1]')} WHEN 2 THEN concat({duck_last('authors[1]')}, {duck_last('authors[2]')}) ELSE concat({duck_last('authors[1]')}, 'Etal') END,
 coalesce(CAST(year AS VARCHAR), 'XXXX'), CASE WHEN len(good) = 0 THEN 'Article' ELSE array_to_string(list_transform(good[1:3], lambda w: {duck_title('w')}), '') END)"""
GOOD = f"list_filter(regexp_extract_all(title, '[a-zA-Z]+'), lambda w: lower(w) NOT IN ({STOPS}) AND length(w) > 2)"


@query(f"WITH {STUB_DUCK} SELECT doc_id, {DUCK_SLUG} AS slug FROM (SELECT *, {GOOD} AS good FROM meta)")
def article_slugs(spark, sf_dir):
    return stub_metadata(spark, sf_dir).select("doc_id", S.article_slug("authors", "year", "title").alias("slug"))


DUCK_INITIALS = "list_transform(authors, lambda a: concat(string_split(a, ' ')[-1], ', ', substr(a, 1, 1), '.'))"
DUCK_APA = """concat(array_to_string(list_filter([CASE len(f) WHEN 0 THEN '' WHEN 1 THEN f[1] ELSE concat(array_to_string(f[1:len(f) - 1], ', '), ', & ', f[-1]) END,
 CASE WHEN year IS NULL THEN '(n.d.)' ELSE concat('(', year, ')') END, concat(title, '.'), concat('*', journal, '*')], lambda p: p <> ''), ' '), CASE WHEN doi = '' THEN '' ELSE concat(' https://doi.org/', doi) END)"""


@query(f"WITH {STUB_DUCK} SELECT doc_id, {DUCK_APA} AS citation FROM (SELECT *, {DUCK_INITIALS} AS f FROM meta)")
def apa_citations(spark, sf_dir):
    return stub_metadata(spark, sf_dir).select("doc_id", S.apa_citation("authors", "year", "title", "journal", "doi").alias("citation"))


def duck_yaml(c: str) -> str:
    return f"concat('\"', replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), '\"')"


@query(f"WITH {STUB_DUCK} SELECT doc_id, {duck_yaml('title')} AS title, concat('[', array_to_string(list_transform(authors, lambda a: {duck_yaml('a')}), ', '), ']') AS authors FROM meta")
def yaml_fields(spark, sf_dir):
    return stub_metadata(spark, sf_dir).select("doc_id", S.yaml_string("title").alias("title"), S.yaml_list("authors").alias("authors"))


LANGUAGES = "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'Low German' ELSE 'isiXhosa' END"


@query(
    f"""SELECT doc_id, CASE l WHEN 'english' THEN 'en' WHEN 'french' THEN 'fr' WHEN 'isixhosa' THEN 'xhosa' ELSE replace(l, ' ', '_') END AS slug,
CASE l WHEN 'english' THEN 'EN' WHEN 'french' THEN 'FR' WHEN 'isixhosa' THEN 'XHO' ELSE substr(upper(replace(l, ' ', '_')), 1, 3) END AS label FROM (SELECT doc_id, lower({LANGUAGES}) AS l FROM documents)"""
)
def language_labels(spark, sf_dir):
    d = _docs(spark, sf_dir).selectExpr("doc_id", f"{LANGUAGES} AS l")
    return d.select("doc_id", S.language_slug("l").alias("slug"), S.language_label("l").alias("label"))


CAP = "A-ZÀ-Ý"
W = r"[\p{L}\p{N}_"


def _re2(p: str) -> str:
    return p.replace("(?U)", "").replace(r"[\w", W).replace("'", "''")


DUCK_CITE = rf"""(s <> '' AND length(s) <= 100 AND regexp_matches(s, '(?:19|20)\d{{2}}') AND (
 lower(first) IN ({", ".join(f"'{x}'" for x in speech.LEAD_INS)}) OR regexp_matches(s, 'p{{1,2}}\.?\s*\d') OR contains(lower(s), 'et al') OR contains(s, ';') OR contains(s, ' & ')
 OR regexp_matches(s, '\b(?:quoted|cited) in\s+[{CAP}]') OR regexp_matches(s, '\bsee\s+(?:[{CAP}]|[a-zà-ÿ]+\s+[{CAP}])') OR regexp_matches(s, '^\d{{4}}(?:/\d{{4}})?,?\s+\d+') OR regexp_matches(first, '^[{CAP}]')))"""
DUCK_CITED = rf"""
c0 AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_re2(speech.NESTED)}', '', 'g'), '\(#\d+\)', '', 'g') AS t FROM doc),
c1 AS (SELECT doc_id, string_split_regex(t, '\([^()]*\)') AS gaps, regexp_extract_all(t, '\(([^()]*)\)', 1) AS inner_ FROM c0),
c2 AS (SELECT doc_id, unnest(gaps) AS gap, unnest(list_concat(inner_, CAST([NULL] AS VARCHAR[]))) AS i, generate_subscripts(gaps, 1) AS k FROM c1),
c3 AS (SELECT *, trim(i) AS s, rtrim(coalesce({duck_words('trim(i)')}[1], ''), ',') AS first, regexp_replace(i, '{_re2(speech.TRAILING)}', '') AS short FROM c2),
c4 AS (SELECT doc_id, string_agg(concat(gap, CASE WHEN i IS NULL OR {DUCK_CITE} THEN '' WHEN short <> i THEN concat('(', short, ')') ELSE concat('(', i, ')') END), '' ORDER BY k) AS t FROM c3 GROUP BY doc_id)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_re2(speech.NARRATIVE)}', '\1', 'g'), '[¹²³⁴⁵⁶⁷⁸⁹⁰]|\[\d{{1,3}}\]', '', 'g'), '\s+([,.;:])', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g'), chr(10) || ' ') AS text FROM c4"""


@query(f"{DUCK}, {DUCK_CITED}")
def citations_removed(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", speech.without_citations("text").alias("text"))


def duck_spoken(c: str) -> str:
    """Markup taken out of ``c`` rule by rule, written for an engine without look-around: what stands between two marks is empty, one sign or begins and ends with one."""
    inner = r"(|[^\s]|[^\s].*?[^\s])"
    marks = "|".join(rf"{m}{inner}{m}" for m in (r"\*\*", "__", r"\*", "_", "`"))
    rules = [
        (r"(?s)<!--.*?-->", ""),
        (r"(?m)^\s*(?:---+|\*\*\*+)\s*$", ""),
        (r"(?m)^\s*\|.*\|\s*$", ""),
        (r"!\[\]\([^)]*\)", "[figure omitted]"),
        (r"!\[([^\]]+)\]\([^)]*\)", r"[figure: \1]"),
        (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"https?://[^\s]+", ""),
        (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+", ""),
        (marks, r"\1\2\3\4\5"),
        (r"(?m)^>\s?", ""),
        (r"(?m)^\s*[-*+]\s+", ""),
        (r"(?m)^\s*\d{1,3}[.)]\s+", ""),
    ]
    for pattern, to in rules:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    for sign, said in (("²", "squared"), ("³", "cubed"), ("≈", "approximately"), ("×", "times"), ("±", "plus or minus"), ("½", "one half"), ("¼", "one quarter"), ("→", "to"), ("⇒", "implies"), ("°C", "degrees Celsius")):
        end = "" if sign in ("²", "³", "°C") else " "
        c = f"replace({c}, '{sign}', ' {said}{end}')"
    return rf"trim(regexp_replace({c}, '[ \t]{{2,}}', ' ', 'g'), chr(10) || chr(9) || ' ')"


@query(f"{DUCK} SELECT doc_id, {duck_spoken('text')} AS text FROM doc")
def markdown_for_speech(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", speech.clean_markdown("text").alias("text"))


#: Marks put around words of the sample texts, so that each rule has work: emphasis of all kinds, links, quotations, items, signs.
MARKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' (\w{4}) ', ' **\1** ', 'g'), ' (\w{6}) (\w+)', ' *\1 \2* and __x `', 'g'), ' (\w{7})\.', ' [\1](u/\1) ![fig](a.png)!!!', 'g'), ', (\w)', ', ≈ 5 °C ** \1', 'g'), '\n(\w{2} )', chr(10) || '> \1- x', 'g'), '\n(\w)', chr(10) || '* \1', 'g')"""


@query(f"WITH m AS (SELECT doc_id, {MARKED} AS text FROM documents) SELECT doc_id, {duck_spoken('text')} AS text FROM m")
def marked_for_speech(spark, sf_dir):
    """The rules of speech on texts that hold marks of every kind."""
    marked = _docs(spark, sf_dir)
    for pattern, to in ((r" (\w{4}) ", " **$1** "), (r" (\w{6}) (\w+)", " *$1 $2* and __x `"), (r" (\w{7})\.", " [$1](u/$1) ![fig](a.png)!!!"), (r", (\w)", ", ≈ 5 °C ** $1"), (r"\n(\w{2} )", "\n> $1- x"), (r"\n(\w)", "\n* $1")):
        marked = marked.withColumn("text", F.regexp_replace("text", pattern, to))
    return marked.select("doc_id", speech.clean_markdown("text").alias("text"))


def duck_nwords(c: str) -> str:
    return f"len({duck_words(c)})"


#: Furniture that the decorated texts can hold, as one pattern of whole lines; written for this twin.
DUCK_FURNITURE = r"(?i)^(?:doi:?\s*10\.\d{4,}/\S+|(?:e-)?issn[:.]?\s*\S+|isbn[- ]?\d[\dx-]{9,}|©\s*\d{4}.*|copyright\s*©\s*\d{4}.*|all rights reserved|\S*https?://\S+|.*https?://\S+\s*|[\w.-]+@[\w.-]+\.\w+|www\.\S+\.\S+|page\s+\d+(?:\s+of\s+\d+)?|p\.\s*\d+|\d{1,4}|\d+\s*/\s*\d+|(?:funding|received|revised|accepted|published online|available online)\b.*|keywords:?\s*.*|abstract\s*:?|springer|[a-z][\w ''-]+ \d{1,2} \(\d{4}\) \d+|[a-zà-ý][\p{L}\p{N}_ ’''&:.,-]{2,60}\s+\d{1,3}|\d{1,3}\s+[a-zà-ý][\p{L}\p{N}_ ’''&:.,-]{2,60}|---\s+.+)$"
_NORM = r"regexp_replace(lower(regexp_replace(trim(regexp_replace({0}, '[*_`]+', '', 'g')), '^[:;]+|[:;]+$', '', 'g')), '\s+', ' ', 'g')"
_CAPITALS = "(upper({0}) = {0} AND lower({0}) <> {0})"
_NAMES = r"^[A-ZÀ-Ý][\p{L}\p{N}_’''.-]*(?:\s+[A-ZÀ-Ý][\p{L}\p{N}_’''.-]*){1,8}$"
DUCK_VOICE = rf"""
l0 AS (SELECT doc_id, line_no, line, regexp_matches(line, '^#{{1,3}}\s+.*$') AS h, length(regexp_extract(line, '^(#{{1,3}})\s+.*$', 1)) AS lvl, trim(regexp_extract(line, '^#{{1,3}}\s+(.*)$', 1)) AS raw FROM dec),
l1 AS (SELECT *, {_NORM.format('raw')} AS norm FROM l0),
l2 AS (SELECT *, norm IN ('references', 'bibliography', 'notes', 'endnotes', 'works cited', 'declarations', 'declaration of competing interest', 'competing interests', 'funding', 'index', 'about the author', 'about the authors') AS back,
 h AND (norm IN ('contents', 'foreword', 'preface', 'acknowledgments', 'acknowledgements', 'dedication', 'references', 'bibliography', 'notes', 'endnotes', 'works cited', 'declarations', 'declaration of competing interest', 'competing interests', 'funding', 'index', 'about the author', 'about the authors')
  OR (length(raw) >= 6 AND NOT regexp_matches(raw, '(?i)^(?:part|chapter|section)\s+[ivxlcdm\d]+') AND {_CAPITALS.format('raw')} AND {duck_nwords('raw')} > 1)) AS gone FROM l1),
l3 AS (SELECT *, coalesce(min(line_no) FILTER (h AND NOT gone AND lvl = 1) OVER (PARTITION BY doc_id), 0) AS anchor FROM l2),
l4 AS (SELECT *, coalesce(bool_or(gone AND back) OVER w, false) AS behind, coalesce(last_value(CASE WHEN h THEN gone END IGNORE NULLS) OVER w, false) AS skip FROM l3 WHERE line_no >= anchor WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
l5 AS (SELECT doc_id, line_no, h, lvl, raw, trim(line) AS s, regexp_replace(trim(line), '[*_`]+', '', 'g') AS c FROM l4 WHERE NOT behind AND NOT skip),
l6 AS (SELECT *, NOT h AND s <> '' AND NOT regexp_matches(s, '^[¹²³⁴⁵⁶⁷⁸⁹⁰]') AND NOT regexp_matches(s, '^\*[^*]{{3,90}}\*\s+\d{{1,3}}$') AND upper(c) <> 'ARTICLE INFO' AS passing FROM l5),
l7 AS (SELECT *, CASE WHEN h OR (passing AND NOT regexp_matches(c, '(?i)^keywords') AND (regexp_matches(c, '[.!?]\s*$') OR length(c) > 120)) THEN 'close' WHEN passing AND regexp_matches(c, '(?i)^keywords') THEN 'open' END AS ev FROM l6),
l8 AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'close') = 'open' AND ev IS NULL AS listed, regexp_matches(lower(c), 'university|school of|institute|department|college') AS place FROM l7),
l9 AS (SELECT *, length(c) BETWEEN 6 AND 130 AND NOT regexp_matches(c, '[.!?;:—]$') AND (NOT regexp_matches(c, '[0-9]') OR place OR regexp_matches(lower(c), 'centre|center')) AND (regexp_matches(replace(replace(c, '·', ''), ',', ''), '{_NAMES}') OR (place AND {duck_nwords('c')} <= 14)) AS names FROM l8),
l10 AS (SELECT doc_id, line_no, CASE WHEN h THEN concat(repeat('#', lvl), ' ', trim(regexp_replace(raw, '[*_`]+', '', 'g'))) WHEN s = '' THEN ''
 WHEN passing AND coalesce(ev, '') <> 'open' AND NOT listed AND NOT regexp_matches(c, '{DUCK_FURNITURE}') AND NOT names THEN
  CASE WHEN regexp_matches(c, '^\d{{1,3}}[.)]\s+[A-ZÀ-Ý][\p{{L}}\p{{N}}_ ’''&:.-]{{1,50}}$') AND length(c) <= 60 THEN concat('## ', regexp_extract(c, '^\d{{1,3}}[.)]\s+(.*)$', 1)) WHEN lower(c) IN ('introduction', 'conclusion', 'conclusions', 'methods', 'methodology', 'results', 'discussion', 'abstract', 'background', 'findings') THEN concat('## ', c) ELSE c END END AS kept FROM l9),
said AS (SELECT doc_id, string_agg(kept, chr(10) ORDER BY line_no) AS text FROM l10 WHERE kept IS NOT NULL GROUP BY doc_id),
told AS (SELECT doc.doc_id, coalesce(said.text, '') AS text FROM doc LEFT JOIN said ON said.doc_id = doc.doc_id)"""


@query(f"{DUCK}, {DUCK_VOICE}, {DUCK_CITED.replace('FROM doc)', 'FROM told)').replace('SELECT doc_id, trim(regexp_replace(regexp_replace', 'cited AS (SELECT doc_id, trim(regexp_replace(regexp_replace').strip()}) SELECT doc_id, concat('# Untitled — for voice', chr(10), '<!-- speech preprocessor; regenerate instead of editing -->', chr(10), '<!-- Headings are cue points for the speech stage. -->', chr(10), {duck_spoken('text')}, chr(10)) AS script FROM cited".replace("GROUP BY doc_id)\ncited AS", "GROUP BY doc_id),\ncited AS"))
def voice_scripts(spark, sf_dir):
    return speech.voice_scripts(decorated(spark, sf_dir))


@query(r"SELECT page_id, coalesce(nullif(string_split(string_split(url, '?')[1], '/')[-1], ''), 'document') AS name FROM pages")
def url_file_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.url_file_name("url").alias("name"))


@query("SELECT conv_id, string_agg(text, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY turn) AS text, CAST(count(*) AS INT) AS pages FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def pages_joined(spark, sf_dir):
    """Turns of a conversation stand for pages."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return L.joined_pages(c, "conv_id", "turn", "text").withColumn("pages", L.page_count("text"))


@query(
    """WITH b AS (SELECT conv_id, turn, text FROM conversations), t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN substr(text, 1, position(chr(10) IN text || chr(10)) - 1) ELSE text END AS text FROM b)
SELECT conv_id, string_agg(trim(text, chr(10) || ' '), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY turn) FILTER (WHERE trim(text, chr(10) || ' ') <> '') AS text FROM t GROUP BY conv_id"""
)
def prompt_leaks_removed(spark, sf_dir):
    """Every third turn has an echoed prompt after its first line; the rest of that page goes."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    leaky = F.when(F.col("turn") % 3 == 1, F.concat(F.substring_index("text", "\n", 1), F.lit("\n## You transcribe document page images into markdown, says it\n"), F.col("text"))).otherwise(F.col("text"))
    pages = L.gathered(c.withColumn("t", leaky), ["conv_id"], "turn", "t", "\n---\n")
    return pages.select("conv_id", L.without_leaks("text").alias("text"))
