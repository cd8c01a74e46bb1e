"""Queries on provider stages and composite runs, with deterministic stand-ins for providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, names, packing, speech, workflow
from ..operators import lines as L
from ..sources import files, prompts, providers, scans, sinks
from .evaluation import duck_nwords
from .fixture import DUCK, decorated, decorated_lines
from .registry import registry
from .structure import DUCK_ARTICLE, DUCK_SECTIONS, DUCK_TRIM, duck_chunks, sections, stub_plan
from .text import DUCK_NOISE, DUCK_SLUG, GOOD, STUB_DUCK, duck_words, stub_metadata

QUERIES, ORACLES, query = registry()


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"SELECT conv_id, string_agg({DUCK_TRIM.format('text')}, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY turn) AS text FROM conversations WHERE {DUCK_TRIM.format('text')} <> '' GROUP BY conv_id")
def pages_transcribed(spark, sf_dir):
    """Turns of a conversation stand for page images: rendered, batched, transcribed, joined."""
    files = L.gathered(_read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "\f")
    files = files.select(F.col("conv_id").cast("string").alias("path"), F.lit("x.pdf").alias("filename"), F.col("text").cast("binary").alias("content"))
    out = scans.transcribed(files, scans.FormFeedPages(), scans.EchoVision(), wait=0)
    return out.where("error is null and text <> ''").select(F.col("path").cast("long").alias("conv_id"), "text")


@query(
    """WITH RECURSIVE p AS (SELECT page_id % 7 AS doc, floor(octet_length(encode(html)) * 4 / 3.0) AS size, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS k FROM pages),
r AS (SELECT doc, k, CAST(0 AS INT) AS batch, 1 AS n, size AS bytes FROM p WHERE k = 1
 UNION ALL SELECT p.doc, p.k, CAST(r.batch + CASE WHEN r.n >= 20 OR r.bytes + p.size > 200000 THEN 1 ELSE 0 END AS INT), CASE WHEN r.n >= 20 OR r.bytes + p.size > 200000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 20 OR r.bytes + p.size > 200000 THEN p.size ELSE r.bytes + p.size END FROM r JOIN p ON p.doc = r.doc AND p.k = r.k + 1)
SELECT doc, list(batch ORDER BY k) AS batches FROM r GROUP BY doc"""
)
def page_batches(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select(F.pmod("page_id", F.lit(7)).alias("doc"), "page_id", F.octet_length("html").alias("size"))
    sizes = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_id", "size"))).alias("p"))
    return sizes.select("doc", L.page_batches(F.transform("p", lambda x: x["size"]), 20, 200_000).alias("batches"))


@query(
    """WITH RECURSIVE p AS (SELECT page_id, CAST(floor(octet_length(encode(html)) * 4 / 3.0) AS BIGINT) AS size, row_number() OVER (ORDER BY page_id) AS k FROM pages),
r AS (SELECT page_id, k, CAST(0 AS INT) AS batch, 1 AS n, size AS bytes FROM p WHERE k = 1
 UNION ALL SELECT p.page_id, p.k, CAST(r.batch + CASE WHEN r.n >= 20 OR r.bytes + p.size > 200000 THEN 1 ELSE 0 END AS INT), CASE WHEN r.n >= 20 OR r.bytes + p.size > 200000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 20 OR r.bytes + p.size > 200000 THEN p.size ELSE r.bytes + p.size END FROM r JOIN p ON p.k = r.k + 1)
SELECT page_id, batch FROM r"""
)
def pages_packed(spark, sf_dir):
    """All pages as one document, packed over blocks of a few dozen pages."""
    pages = _read(spark, sf_dir, "pages").select(F.lit("all").alias("path"), F.col("page_id").alias("page_no"), F.octet_length("html").alias("size"))
    return packing.packed_pages(pages, 20, 200_000, block=64).select(F.col("page_no").alias("page_id"), "batch")


#: The first free name of a stem among those used before it in the folder.
UNIQUE = """d AS (SELECT doc_id, {folder} AS folder, {stem} AS stem, row_number() OVER (PARTITION BY {folder} ORDER BY doc_id) AS k FROM documents),
r AS (SELECT doc_id, folder, k, stem AS name, [stem] AS used FROM d WHERE k = 1
 UNION ALL SELECT doc_id, folder, k, name, list_append(used, name) FROM (
  SELECT d.doc_id, d.folder, d.k, r.used, CASE WHEN NOT list_contains(r.used, d.stem) THEN d.stem
   ELSE concat(d.stem, '_', list_filter(range(2, len(r.used) + 3), lambda i: NOT list_contains(r.used, concat(d.stem, '_', i)))[1]) END AS name
  FROM r JOIN d ON d.folder = r.folder AND d.k = r.k + 1))"""
STEM = "concat(source, CASE WHEN doc_id % 9 = 0 THEN '_2' ELSE '' END)"


@query(f"WITH RECURSIVE {UNIQUE.format(folder='lang', stem=STEM)} SELECT doc_id, lang AS folder, {STEM} AS stem, name FROM documents JOIN r USING (doc_id)")
def unique_file_names(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").selectExpr("doc_id", "lang AS folder", f"{STEM} AS stem")
    return names.unique_names(d, "stem", "doc_id", "folder")


@query(f"""WITH RECURSIVE {UNIQUE.format(folder="'out'", stem="concat('s', printf('%03d', doc_id % 50), 'x')").replace("ORDER BY doc_id) AS k", "ORDER BY concat('/in/', doc_id, '/s', printf('%03d', doc_id % 50), 'x.pdf')) AS k")}
SELECT concat('/in/', doc_id, '/s', printf('%03d', doc_id % 50), 'x.pdf') AS source, concat(name, '.md') AS rel_path, text AS content, CASE WHEN doc_id % 10 = 3 THEN 'failed' END AS error FROM documents JOIN r USING (doc_id)""")
def freeform_files(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.format_string("/in/%d/s%03dx.pdf", "doc_id", F.col("doc_id") % 50).alias("source"), "text", F.expr("CASE WHEN doc_id % 10 = 3 THEN 'failed' END AS error"))
    return workflow.freeform(d)


@query(f"""{DUCK_SECTIONS} SELECT doc_id, concat(printf('%02d_', section_ord), substr(CASE WHEN f = '' THEN 'doc' ELSE f END, 1, 60), '.md') AS rel_path, concat('# ', coalesce(nullif(label, ''), section_id), chr(10), chr(10), content, chr(10)) AS content
FROM (SELECT *, trim(regexp_replace(regexp_replace(section_id, '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g'), '_+', '_', 'g'), '_') AS f FROM sections)""")
def statute_files(spark, sf_dir):
    return workflow.section_files(decorated(spark, sf_dir), sections(spark, sf_dir))


#: JSON replies with fields missing, null or odd.
REPLY = """concat('{', CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"doc_type": null, ' ELSE concat('"doc_type": "', source, '", ') END,
 CASE WHEN doc_id % 2 = 0 THEN concat('"languages": ["', lang, '"], ') ELSE '' END, '"structure_notes": "n', doc_id, '", "title": "T', doc_id, '", "authors": ["  Ann Lee ", null, "", "B', doc_id, '"], "year": ', CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE cast(1990 + doc_id % 30 AS VARCHAR(10)) END, '}')"""


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unknown' WHEN 2 THEN source END AS doc_type, CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE CAST([] AS VARCHAR[]) END AS languages, 'unknown' AS structure_pattern, concat('n', doc_id) AS structure_notes, CAST([] AS VARCHAR[]) AS estimated_sections FROM documents")
def profiles_normalised(spark, sf_dir):
    return _read(spark, sf_dir, "documents").selectExpr("doc_id", f"{REPLY} AS reply").select("doc_id", providers.profile("reply").alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, concat('T', doc_id) AS title, ['Ann Lee', concat('B', doc_id)] AS authors, CASE WHEN doc_id % 4 <> 0 THEN CAST(1990 + doc_id % 30 AS INT) END AS year FROM documents")
def metadata_cleaned(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").selectExpr("doc_id", f"from_json({REPLY}, 'title string, authors array<string>, year int, source string, doi string') AS reply")
    return d.select("doc_id", providers.clean_metadata("reply").alias("m")).select("doc_id", "m.title", "m.authors", "m.year")


@query("SELECT doc_id, trim(coalesce(list_filter(string_split(substr(text, 1, 2000), chr(10)), lambda x: trim(x) <> '')[1], ''), '# ') AS title, CAST([] AS VARCHAR[]) AS authors, CAST(NULL AS INT) AS year, '' AS source, '' AS doi, CAST(NULL AS VARCHAR) AS error FROM documents")
def metadata_extracted(spark, sf_dir):
    return providers.extracted_metadata(_read(spark, sf_dir, "documents"), providers.get_chat_provider("rules"), wait=0)


@query(f"WITH {STUB_DUCK} SELECT doc_id, CASE WHEN doi <> '' THEN doi ELSE concat('\"', title, '\"', coalesce(' ' || {duck_words('authors[1]')}[-1], '')) END AS query FROM meta")
def scholar_queries(spark, sf_dir):
    return stub_metadata(spark, sf_dir).select("doc_id", providers.scholar_query("doi", "title", "authors").alias("query"))


class Shelf(providers.ScholarProvider):
    """Stand-in: hits from the words of the query; some queries fail, some find nothing."""

    def search(self, query, most=3):
        n = len(query.split())
        if n % 5 == 0:
            raise OSError("down")
        return [] if n % 3 == 0 else [{"publicationInfo": f"Shelf {n}, {1990 + n % 30}", "citedBy": n, "link": "u"}, {"publicationInfo": "second"}]


@query(f"""WITH q AS (SELECT doc_id, {duck_nwords('text')} AS n FROM documents), h AS (SELECT *, n % 5 <> 0 AND n % 3 <> 0 AS hit FROM q)
SELECT doc_id, CASE WHEN hit THEN concat('Shelf ', n, ', ', 1990 + n % 30) END AS publication_info, CASE WHEN hit THEN CAST(n AS BIGINT) END AS cited_by, CASE WHEN hit THEN 'u' END AS url,
 CASE WHEN hit THEN CAST(1990 + n % 30 AS INT) END AS year FROM h""")
def scholar_hits(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("query"))
    return providers.looked_up(d, Shelf())


@query("""SELECT doc_id, concat('{', chr(10), '  "doc_id": ', doc_id, ',', chr(10), '  "lang": ', coalesce(CAST(to_json(lang) AS VARCHAR), 'null'), ',', chr(10), '  "parts": [', chr(10), '    "é",', chr(10), '    ', n_chars, chr(10), '  ]', chr(10), '}') AS json FROM documents""".replace("'    ', n_chars", "'    \"', n_chars, '\"'"))
def documents_json(spark, sf_dir):
    return sinks.pretty_json(_read(spark, sf_dir, "documents").select("doc_id", "lang", F.array(F.lit("é"), F.col("n_chars").cast("string")).alias("parts")))


CASE_MODELS, CASE_VARIANTS = ["mistral-large-latest", "other"], ["default", "strict"]


def stub_cases(spark, sf_dir):
    return decorated(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "text", F.col("text").alias("gold"), F.expr("CASE WHEN doc_id % 17 = 5 THEN 'unreadable' END AS error"))


@query(f"""{DUCK},
h AS (SELECT *, count(*) FILTER (WHERE regexp_matches(line, '^#{{1,6}}\\s+.*\\S')) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec, regexp_matches(line, '^#{{1,6}}\\s+.*\\S') AS head FROM dec),
s AS (SELECT doc_id, sec FROM h GROUP BY doc_id, sec HAVING count(*) FILTER (WHERE NOT head AND trim(line) <> '') > 0),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), g AS (SELECT doc_id, count(*) FILTER (WHERE head) AS n FROM h GROUP BY doc_id),
m AS (SELECT doc_id, CAST((a - 1) * 2 + b - 1 AS INT) AS ord, {CASE_MODELS}[a] AS model, {CASE_VARIANTS}[b] AS prompt_variant FROM doc, range(1, 3) x(a), range(1, 3) y(b)),
w AS (SELECT doc_id, {duck_nwords('text')} AS n, {duck_nwords('substr(text, 1, 2000)')} AS p FROM doc)
SELECT m.doc_id AS case_id, ord, 'rules' AS chat_provider, model, prompt_variant, CASE WHEN m.doc_id % 17 = 5 THEN 'unreadable' END AS error,
 CASE WHEN m.doc_id % 17 <> 5 THEN 'unknown' END AS doc_type, CASE WHEN m.doc_id % 17 <> 5 THEN CAST(g.n AS INT) END AS num_gold_sections, CASE WHEN m.doc_id % 17 <> 5 THEN CAST(coalesce(k.n, 0) AS INT) END AS num_pred_sections,
 CASE WHEN m.doc_id % 17 <> 5 THEN 0 END AS num_hallucinated, CASE WHEN m.doc_id % 17 = 5 THEN 0 ELSE floor(CAST((p + w.n) * 1.3e0 / 1e6 * CASE model WHEN 'other' THEN 1.0e0 ELSE 2.0e0 END + w.n * 1.3e0 / 1e6 * CASE model WHEN 'other' THEN 3.0e0 ELSE 6.0e0 END + 0.001e0 AS DOUBLE) * 1e6 + 0.5e0) / 1e6 END AS cost_usd,
 true AS timed, m.doc_id % 17 = 5 AS took_no_time
FROM m JOIN w ON w.doc_id = m.doc_id JOIN g ON g.doc_id = m.doc_id LEFT JOIN k ON k.doc_id = m.doc_id""")
def case_runs(spark, sf_dir):
    """Headings found by rule stand for a chat provider's plan; times are told by what must hold of them."""
    results, _ = cases.run_cases(stub_cases(spark, sf_dir), {"rules": providers.get_chat_provider("rules")}, CASE_MODELS, CASE_VARIANTS, wait=0)
    return results.select("case_id", "ord", "chat_provider", "model", "prompt_variant", "error", "doc_type", "num_gold_sections", "num_pred_sections", "num_hallucinated", "cost_usd", F.expr("latency_s >= 0 AND latency_s < 3600 AND run_at <= current_timestamp()").alias("timed"), (F.col("latency_s").isNull() | (F.col("error") == "unreadable") & (F.col("latency_s") == 0)).alias("took_no_time")).fillna(False, ["took_no_time"])


@query(f"{DUCK} SELECT doc_id, string_agg(concat(line_no, ': ', line), chr(10) ORDER BY line_no) FILTER (WHERE line_no <= 250) AS survey, string_agg(concat(line_no, ': ', line), chr(10) ORDER BY line_no) AS plan, '{prompts.PLAN}' || chr(10) || 'Kind of document: unknown' || chr(10) || 'Languages: en, fr' AS system FROM dec GROUP BY doc_id")
def prompt_texts(spark, sf_dir):
    d = decorated(spark, sf_dir)
    return d.select("doc_id", prompts.survey_prompt("text").alias("survey"), prompts.plan_prompt("text").alias("plan"), prompts.plan_system(prompts.PLAN, F.lit(None).cast("string"), F.array(F.lit("en"), F.lit("fr"))).alias("system"))


@query(duck_chunks(300, 250))
def structured_run(spark, sf_dir):
    """The composite run by a section plan: gaps filled, sections cut, chunks of the standard size."""
    return workflow.structured(decorated(spark, sf_dir), stub_plan(spark, sf_dir))[1]


FAILED, DONE = "doc_id % 7 = 2", "doc_id % 5 = 1"


@query(f"""{DUCK_ARTICLE}, {STUB_DUCK}, m AS (SELECT *, {DUCK_SLUG} AS s FROM (SELECT *, {GOOD} AS good FROM (SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN concat('in', doc_id) ELSE title END AS title) FROM meta)))
SELECT concat('in', doc_id, '.pdf') AS source, CASE WHEN NOT ({FAILED}) THEN s END AS slug, CASE WHEN NOT ({FAILED}) THEN s END AS folder, title, authors, year,
 CASE WHEN NOT ({FAILED}) THEN abstract <> '' END AS has_abstract, CASE WHEN NOT ({FAILED}) THEN "references" <> '' END AS has_references, CASE WHEN {FAILED} THEN 'failed' END AS error
FROM m JOIN split USING (doc_id) WHERE NOT ({DONE})""")
def article_results(spark, sf_dir):
    """The composite run of articles: those done before are left out, failed ones give an error."""
    docs = decorated(spark, sf_dir).selectExpr("doc_id", "concat('in', doc_id, '.pdf') AS source", "text", f"CASE WHEN {FAILED} THEN 'failed' END AS error")
    meta = stub_metadata(spark, sf_dir).drop("source").withColumn("title", F.expr("CASE WHEN doc_id % 4 = 0 THEN '' ELSE title END"))
    return workflow.article_vault(docs, meta, docs.where(DONE).select("source"))[1]


@query(f"{DUCK} SELECT doc_id, line_no, trim(line) <> '' AND ({DUCK_NOISE} OR regexp_matches(trim(line), '(?i)^(?:extra material\\.|#+ section \\d+)$')) AS noise FROM dec")
def noise_by_genre(spark, sf_dir):
    """Furniture of a genre besides that of all."""
    extra = (r"extra material\.", r"#+ section \d+")
    return decorated_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), L.is_noise("line", extra).alias("noise"))


HEADING = "CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('CHAPTER IV ', upper(p_name)) WHEN 2 THEN upper(concat(p_name, ' of the ', p_type)) WHEN 3 THEN upper(p_brand) WHEN 4 THEN concat('**', p_name, '**:') ELSE p_name END"
_CAPS = "(upper({0}) = {0} AND lower({0}) <> {0})"
_CAP = "concat(upper(substr({0}, 1, 1)), lower(substr({0}, 2)))"
_SMALL = ", ".join(f"'{w}'" for w in speech.SHORT_WORDS)
_BARE = "regexp_replace(w, '^[:;,.!?]+|[:;,.!?]+$', '', 'g')"


@query(f"""WITH h AS (SELECT p_partkey, {HEADING} AS h FROM part), w AS (SELECT *, {duck_words('h')} AS ws FROM h)
SELECT p_partkey, CASE WHEN NOT {_CAPS.format('h')} OR length(h) < 6 THEN h WHEN len(ws) = 1 THEN CASE WHEN length(ws[1]) <= 4 THEN h ELSE {_CAP.format('ws[1]')} END
 ELSE array_to_string(list_transform(ws, lambda w, i: CASE WHEN i > 1 AND lower({_BARE}) IN ({_SMALL}) THEN lower({_BARE}) WHEN {_CAPS.format(_BARE)} AND (length({_BARE}) <= 3 OR regexp_matches({_BARE}, '^[IVXLCDM]+$')) THEN {_BARE} ELSE {_CAP.format(_BARE)} END), ' ') END AS title,
 regexp_replace(lower(regexp_replace(trim(regexp_replace(h, '[*_`]+', '', 'g')), '^[:;]+|[:;]+$', '', 'g')), '\\s+', ' ', 'g') AS norm,
 length(trim(h)) >= 6 AND NOT regexp_matches(trim(h), '(?i)^(?:part|chapter|section)\\s+[ivxlcdm\\d]+') AND {_CAPS.format('trim(h)')} AND len(ws) > 1 AS junk FROM w""")
def spoken_headings(spark, sf_dir):
    """Headings as they are said, the form in which they compare, and whether they are a series line."""
    h = _read(spark, sf_dir, "part").selectExpr("p_partkey", f"{HEADING} AS h")
    return h.select("p_partkey", speech.title_case("h").alias("title"), speech.heading_norm("h").alias("norm"), speech.series_junk("h").alias("junk"))


LINE = "CASE p_partkey % 7 WHEN 0 THEN initcap(p_name) WHEN 1 THEN concat('Department of ', p_name) WHEN 2 THEN concat(initcap(p_brand), ' University, ', p_size) WHEN 3 THEN concat(initcap(p_name), '.') WHEN 4 THEN p_brand WHEN 5 THEN concat('the school of ', p_name, ' and of many more words than a line of names would ever have in print, is it') ELSE concat(p_name, ' ', p_size) END"
DUCK_LINE = LINE.replace("initcap(p_name)", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')").replace("initcap(p_brand)", "concat(upper(p_brand[1]), lower(p_brand[2:]))")
_CLEAN = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"


@query(f"""WITH l AS (SELECT p_partkey, trim({DUCK_LINE}) AS s, {_CLEAN.format('p_name')} AS norm, {_CLEAN.format("concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' ', p_type) WHEN 2 THEN ' of old' ELSE '' END)")} AS full_title FROM part),
k AS (SELECT *, CASE WHEN p_partkey % 4 = 3 THEN string_split(full_title, ' ')[1] ELSE full_title END AS title FROM l),
f AS (SELECT *, list_distinct({duck_words('norm')}) AS hs, list_distinct({duck_words('title')}) AS ts, regexp_matches(lower(s), 'university|school of|institute|department|college') AS place FROM k)
SELECT p_partkey, length(s) BETWEEN 6 AND 130 AND NOT regexp_matches(s, '[.!?;:—]$') AND (NOT regexp_matches(s, '[0-9]') OR place OR regexp_matches(lower(s), 'centre|center'))
 AND (regexp_matches(replace(replace(s, '·', ''), ',', ''), '^[A-Z][A-Za-z0-9_’''.-]*(\s+[A-Z][A-Za-z0-9_’''.-]*){{1,8}}$') OR (place AND {duck_nwords('s')} <= 14)) AS byline,
 title <> '' AND (norm = title OR (length(title) >= 8 AND (starts_with(title, norm) OR starts_with(norm, title))) OR (len(hs) > 0 AND len(list_intersect(hs, ts)) >= 0.8 * len(hs))) AS same_title FROM f""")
def spoken_lines(spark, sf_dir):
    """Lines that are authors or affiliations, and headings that repeat a title more or less."""
    p = _read(spark, sf_dir, "part")
    p = p.selectExpr("p_partkey", f"{LINE} AS line", "p_name", "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' ', p_type) WHEN 2 THEN ' of old' ELSE '' END) AS full_title")
    p = p.withColumns({"norm": speech.heading_norm("p_name"), "full_title": speech.heading_norm("full_title")})
    p = p.withColumn("title", F.expr("CASE WHEN p_partkey % 4 = 3 THEN split(full_title, ' ')[0] ELSE full_title END"))
    return p.select("p_partkey", speech.byline("line").alias("byline"), speech.fuzzy_title("norm", "title").alias("same_title"))


def scanned(spark, sf_dir):
    """(path, filename, format, content): turns of a conversation as pages of a file of some kind."""
    c = L.gathered(_read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "\f")
    kind = F.expr("CASE conv_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' ELSE 'unknown' END")
    return c.select(F.concat(F.lit("/in/"), F.col("conv_id").cast("string")).alias("path"), F.lit("f").alias("filename"), kind.alias("format"), F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text")).cast("binary").alias("content"))


@query("SELECT concat('/in/', conv_id) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS page_no, text FROM conversations")
def scanned_pages(spark, sf_dir):
    c = L.gathered(_read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "\f")
    f = c.select(F.concat(F.lit("/in/"), F.col("conv_id").cast("string")).alias("path"), F.lit("f").alias("filename"), F.col("text").cast("binary").alias("content"))
    return providers.ocr_pages(f, providers.get_ocr_provider("echo"), wait=0).where("error is null").select("path", "page_no", "text")


@query("""SELECT concat('/in/', conv_id) AS path, CASE conv_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' ELSE 'unknown' END AS format,
 CASE conv_id % 4 WHEN 0 THEN string_agg(text, chr(12) ORDER BY turn) WHEN 3 THEN NULL ELSE coalesce(string_agg(text, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') END AS text,
 CASE WHEN conv_id % 4 = 3 THEN 'unsupported file type' END AS error FROM conversations GROUP BY conv_id""")
def files_read(spark, sf_dir):
    """Files by their format: text as it is, scans through a provider, others with an error."""
    return files.documents(scanned(spark, sf_dir), providers.get_ocr_provider("echo")).select("path", "format", "text", "error")
