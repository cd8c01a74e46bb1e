"""Queries on structure: plans, sections, chunks, article parts, books, rendering, genres."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pytext import lines, named
from ..operators import article, book, genres, plan, render, workflow
from .fixture import DUCK, DUCK_BOOK, book_texts, decorated, decorated_docs, texts_of
from .registry import registry
from .text import DUCK_APA, DUCK_INITIALS, DUCK_SLUG, GOOD, STUB_DUCK, duck_plain, duck_windows, duck_words, duck_yaml, stub_metadata

QUERIES, ORACLES, query = registry()

#: A section plan from the heading lines of decorated documents: each third is left out, each fifth overlaps.
STUB_PLAN = """
tot AS (SELECT doc_id, CAST(max(line_no) AS INT) AS n_lines FROM dec GROUP BY doc_id),
heads AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ord, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM dec WHERE line LIKE '# %' OR line LIKE '## %' OR line LIKE '### %'),
plan AS (SELECT h.doc_id, CAST(ord AS INT) AS ord, regexp_replace(line, '^#+ *', '') AS label, '' AS section_id,
  CASE ord % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'English' WHEN 2 THEN 'isiXhosa' ELSE 'unknown' END AS language,
  CAST(length(regexp_extract(line, '^#+', 0)) AS INT) AS level, CAST(line_no AS INT) AS start_line,
  CAST(coalesce(nxt - 1, n_lines) + CASE WHEN ord % 5 = 0 THEN 2 ELSE 0 END AS INT) AS end_line
  FROM heads h JOIN tot t ON h.doc_id = t.doc_id WHERE ord % 3 <> 2)
"""
DUCK_GAPS = f"""{DUCK}, {STUB_PLAN},
cur AS (SELECT *, greatest(1, coalesce(max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1)) AS cursor FROM plan),
last AS (SELECT doc_id, greatest(1, max(end_line) + 1) AS cursor FROM plan GROUP BY doc_id),
parts AS (
  SELECT doc_id, start_line AS s, 1 AS k, ord, label, section_id, language, level, start_line, end_line, FALSE AS filler FROM cur
  UNION ALL SELECT doc_id, start_line, 0, ord, '', concat('unlabeled_', cursor), 'unknown', 1, cursor, start_line - 1, TRUE FROM cur WHERE start_line > cursor
  UNION ALL SELECT t.doc_id, 1000000000, 0, 0, '', concat('unlabeled_', cursor), 'unknown', 1, cursor, n_lines, TRUE FROM tot t JOIN last l ON t.doc_id = l.doc_id WHERE cursor <= n_lines),
filled AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, ord, k) AS INT) AS section_ord, label, section_id, language, CAST(level AS INT) AS level, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, filler FROM parts)"""
DUCK_TRIM = "trim({}, chr(10) || chr(9) || chr(13) || ' ')"
DUCK_SECTIONS = f"""{DUCK_GAPS},
sl AS (SELECT f.*, d.line_no, d.line, row_number() OVER (PARTITION BY f.doc_id, section_ord ORDER BY d.line_no) AS r FROM filled f JOIN dec d ON d.doc_id = f.doc_id AND d.line_no BETWEEN f.start_line AND f.end_line),
sections AS (SELECT doc_id, section_ord, label, CASE WHEN section_id = '' THEN coalesce(nullif(trim(regexp_replace(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}_\\s\\-]', '', 'g'), '[\\s\\-]+', '_', 'g'), '_'), ''), 'section') ELSE section_id END AS section_id, language, CAST(least(2, level) AS INT) AS level, content FROM (
  SELECT doc_id, section_ord, label, section_id, language, level, {DUCK_TRIM.format("string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT (r = 1 AND regexp_matches(trim(line), '^#{1,6}\\s+\\S')))")} AS content FROM sl GROUP BY ALL) WHERE content <> '')"""


def plan_of(docs):
    """The rows of STUB_PLAN for (doc_id, lines)."""
    heads = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda h: h["line"].rlike("^#{1,3} "))
    # each head with the line of the next one; the outer form spares the filter that would make the heads twice
    heads = named(heads, lambda hs: F.transform(hs, lambda h, i: h.withField("next", F.get(hs, i + 1)["line_no"])))
    h = docs.select("doc_id", F.size("lines").alias("n_lines"), F.posexplode_outer(heads).alias("k", "h")).where("k is not null").withColumn("ord", F.col("k") + 1)
    end = F.coalesce(F.col("h.next") - 1, F.col("n_lines")) + F.when(F.col("ord") % 5 == 0, 2).otherwise(0)
    tongue = F.element_at(F.array(*map(F.lit, ("both", "English", "isiXhosa", "unknown"))), F.col("ord") % 4 + 1)
    return h.where("ord % 3 <> 2").select(
        "doc_id", "ord", F.regexp_replace("h.line", "^#+ *", "").alias("label"), F.lit("").alias("section_id"), tongue.alias("language"),
        F.length(F.regexp_extract("h.line", "^#+", 0)).alias("level"), F.col("h.line_no").alias("start_line"), end.alias("end_line"),
    )


def stub_plan(spark, sf_dir):
    return plan_of(decorated_docs(spark, sf_dir))


def totals(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.size(lines("text")).alias("n_lines"))


def filled(spark, sf_dir):
    return plan.gaps_filled(stub_plan(spark, sf_dir), totals(spark, sf_dir))


def sections(spark, sf_dir):
    return plan.cut_sections(decorated(spark, sf_dir), filled(spark, sf_dir))


@query(f"{DUCK_GAPS} SELECT * FROM filled")
def gap_fill(spark, sf_dir):
    return filled(spark, sf_dir).select("doc_id", "section_ord", "label", "section_id", "language", "level", "start_line", "end_line", "filler")


@query(f"{DUCK_GAPS}, c AS (SELECT doc_id, unnest(range(start_line, end_line + 1)) AS l FROM filled) SELECT t.doc_id, CAST(t.n_lines AS BIGINT) AS n_lines, count(DISTINCT l) AS n_covered FROM tot t JOIN c ON c.doc_id = t.doc_id AND l BETWEEN 1 AND n_lines GROUP BY ALL")
def plan_coverage(spark, sf_dir):
    """Every line of a document is in some section once its gaps are filled."""
    cover = filled(spark, sf_dir).select("doc_id", F.explode(F.sequence("start_line", "end_line")).alias("l"))
    t = totals(spark, sf_dir)
    return t.join(cover, "doc_id").where("l between 1 and n_lines").groupBy("doc_id", F.col("n_lines").cast("long").alias("n_lines")).agg(F.countDistinct("l").alias("n_covered"))


@query(
    f"""{DUCK_GAPS}, h AS (SELECT f.doc_id, f.section_ord, f.level, f.label FROM filled f),
u AS (SELECT a.doc_id, a.section_ord, a.level AS own, b.level AS lv, b.label, b.section_ord AS o, min(CASE WHEN c.level < b.level THEN 1 ELSE 0 END) OVER () AS z FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.section_ord <= a.section_ord LEFT JOIN (SELECT NULL AS level) c ON TRUE),
v AS (SELECT doc_id, section_ord, own, lv, arg_max(label, o) AS label, max(o) AS o FROM u WHERE lv <= own GROUP BY ALL),
x AS (SELECT v.*, coalesce((SELECT max(u.o) FROM u WHERE u.doc_id = v.doc_id AND u.section_ord = v.section_ord AND u.lv < v.lv), -1) AS above FROM v)
SELECT doc_id, section_ord, coalesce(list(label ORDER BY lv) FILTER (WHERE o > above AND label <> ''), CAST([] AS VARCHAR[])) AS heading_path FROM x GROUP BY ALL"""
)
def heading_paths(spark, sf_dir):
    return plan.heading_paths(filled(spark, sf_dir)).select("doc_id", "section_ord", "heading_path")


@query(f"{DUCK_SECTIONS} SELECT * FROM sections")
def plan_sections(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", "section_ord", "label", "section_id", "language", "level", "content")


def duck_chunks(window: int, step: int) -> str:
    """Chunks of the decorated documents and their sections."""
    return f"""{DUCK_SECTIONS}, {duck_windows(f"SELECT doc_id, {duck_plain('text')} AS t FROM doc", window, step)},
pos AS (SELECT doc_id, section_ord, section_id, label, language, content, coalesce(sum(length({duck_plain('content')}) + 1) OVER (PARTITION BY doc_id ORDER BY section_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sections),
allc AS (SELECT doc_id, 0 AS k, 0 AS o, 'full_doc' AS kind, CAST([] AS VARCHAR[]) AS heading_path, '' AS language, text AS content, CAST(NULL AS INT) AS char_offset FROM doc
  UNION ALL SELECT doc_id, 1, section_ord, 'section', [section_id, label], language, content, NULL FROM sections
  UNION ALL SELECT p.doc_id, 2, j, 'passage', coalesce(arg_max([section_id, label], pos), CAST([] AS VARCHAR[])), coalesce(arg_max(s.language, pos), ''), passage, char_offset FROM passages p LEFT JOIN pos s ON s.doc_id = p.doc_id AND s.pos <= p.char_offset GROUP BY p.doc_id, j, passage, char_offset),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, o) - 1 AS INT) AS position FROM allc)
SELECT doc_id, position, concat(doc_id, '_', printf('%04d', position)) AS chunk_id, kind, heading_path, language, content, CAST(floor(len({duck_words('content')}) * 13 / 10) AS INT) AS token_count, char_offset FROM numbered"""


@query(duck_chunks(60, 48))
def structured_chunks(spark, sf_dir):
    made = decorated_docs(spark, sf_dir)
    return workflow.structured(texts_of(made), plan_of(made), window=60, overlap=12)[1]


DUCK_ARTICLE = f"""{DUCK},
tot AS (SELECT doc_id, max(line_no) AS n FROM dec GROUP BY doc_id),
a AS (SELECT doc_id, min(line_no) AS s FROM dec WHERE regexp_matches(rtrim(line), '(?i)^#{{1,3}}\\s+(?:abstract|résumé|abstrak|summary)\\b') GROUP BY doc_id),
e AS (SELECT a.doc_id, s, coalesce(min(line_no) FILTER (WHERE line_no > s AND (regexp_matches(line, '^#{{1,6}}\\s') OR (length(trim(line)) <= 60 AND regexp_matches(trim(line), '^\\s*\\d+(?:\\.\\d+)*\\.?\\s+[A-Z][A-Za-z]')))), max(line_no) + 1) AS e FROM a JOIN dec d ON d.doc_id = a.doc_id GROUP BY a.doc_id, s),
al AS (SELECT d.doc_id, line_no, trim(line) = '' AS blank, sum(len({duck_words('line')})) OVER (PARTITION BY d.doc_id ORDER BY line_no) AS w, s, e FROM e JOIN dec d ON d.doc_id = e.doc_id AND line_no >= s AND line_no < e),
b AS (SELECT doc_id, s, e, max(w) AS total, min(line_no) FILTER (WHERE blank AND w > 400) AS b1 FROM al GROUP BY ALL),
g AS (SELECT b.doc_id, b.s, b.e, total, b1, max(line_no) FILTER (WHERE blank AND w <= 400 AND (b1 IS NULL OR line_no < b1)) AS prev FROM b JOIN al USING (doc_id) GROUP BY ALL),
ab AS (SELECT doc_id, s, CASE WHEN b1 IS NOT NULL THEN coalesce(prev, b1) WHEN total <= 400 THEN e ELSE coalesce(prev, e) END AS e FROM g),
r AS (SELECT doc_id, max(line_no) AS rs FROM dec WHERE regexp_matches(rtrim(line), '(?i)^#{{1,3}}\\s+(?:references|bibliography|works\\s+cited|bibliographie|références|bibliografía|referências)\\b') GROUP BY doc_id),
rr AS (SELECT r.doc_id, rs, coalesce(min(line_no) FILTER (WHERE line_no > rs AND regexp_matches(rtrim(line), '(?i)^#{{1,3}}\\s*(?:appendix|appendices|annexe?s?|supplementary|supporting\\s+information)\\b')), max(line_no) + 1) AS re FROM r JOIN dec d ON d.doc_id = r.doc_id GROUP BY r.doc_id, rs),
split AS (SELECT d.doc_id,
  coalesce({DUCK_TRIM.format("string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE line_no >= ab.s AND line_no < ab.e)")}, '') AS abstract,
  coalesce({DUCK_TRIM.format("string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT coalesce(line_no >= ab.s AND line_no < ab.e, FALSE) AND NOT coalesce(line_no >= rs AND line_no < re, FALSE))")}, '') AS body,
  coalesce({DUCK_TRIM.format("string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE line_no >= rs AND line_no < re)")}, '') AS "references"
  FROM dec d LEFT JOIN ab ON ab.doc_id = d.doc_id LEFT JOIN rr ON rr.doc_id = d.doc_id GROUP BY d.doc_id)"""


@query(f"{DUCK_ARTICLE} SELECT * FROM split")
def article_parts(spark, sf_dir):
    """The SQL holds the rules that the fixture reaches; the others are tested by hand-worked cases."""
    return article.split_article(decorated(spark, sf_dir)).select("doc_id", "abstract", "body", "references")


@query(f"{DUCK_ARTICLE} SELECT doc_id, abstract <> '' AS has_abstract, \"references\" <> '' AS has_references FROM split")
def article_flags(spark, sf_dir):
    a = article.split_article(decorated(spark, sf_dir))
    return a.select("doc_id", (F.col("abstract") != "").alias("has_abstract"), (F.col("references") != "").alias("has_references"))


DUCK_HEAD = f"concat('title: ', {duck_yaml('title')}, chr(10), 'authors: [', array_to_string(list_transform(authors, lambda a: {duck_yaml('a')}), ', '), ']', chr(10), 'year: ', coalesce(CAST(year AS VARCHAR), 'null'), chr(10), 'journal: ', {duck_yaml('journal')}, chr(10), 'doi: ', {duck_yaml('doi')}, chr(10), 'slug: ', {duck_yaml('slug')}, chr(10), 'source_pdf: ', {duck_yaml('journal')}, chr(10))"


@query(
    f"""{DUCK_ARTICLE}, {STUB_DUCK}, m AS (SELECT *, {DUCK_SLUG} AS slug, {DUCK_INITIALS} AS f FROM (SELECT *, {GOOD} AS good FROM meta)),
x AS (SELECT m.*, doc.text, split.abstract, split.body, split."references" AS refs FROM m JOIN doc ON doc.doc_id = m.doc_id JOIN split ON split.doc_id = m.doc_id)
SELECT doc_id, concat(slug, '/', slug, '.md') AS rel_path, concat('---', chr(10), {DUCK_HEAD}, '---', chr(10), chr(10), text) AS content FROM x
UNION ALL SELECT doc_id, concat(slug, '/abstract.md'), CASE WHEN abstract = '' THEN '' ELSE concat(abstract, chr(10)) END FROM x
UNION ALL SELECT doc_id, concat(slug, '/body.md'), CASE WHEN body = '' THEN '' ELSE concat(body, chr(10)) END FROM x
UNION ALL SELECT doc_id, concat(slug, '/references.md'), CASE WHEN refs = '' THEN '' ELSE concat(refs, chr(10)) END FROM x
UNION ALL SELECT doc_id, concat(slug, '/bibliographic.md'), concat('---', chr(10), {DUCK_HEAD}, 'content_source: "stub"', chr(10), 'publication_info: ""', chr(10), 'cited_by: null', chr(10), '---', chr(10), '## Citation', chr(10), chr(10), {DUCK_APA}, chr(10)) FROM x"""
)
def article_files(spark, sf_dir):
    d = decorated(spark, sf_dir).join(stub_metadata(spark, sf_dir), "doc_id")
    from ..functions.strings import article_slug

    d = d.withColumns({"slug": article_slug("authors", "year", "title"), "content_source": F.lit("stub"), "publication_info": F.lit(""), "cited_by": F.lit(None).cast("int")})
    return render.article_files(d)


def _duck(p: str) -> str:
    return p.replace("(?iuU)", "(?i)").replace("(?U)", "").replace("'", "''")


def _is(p: str, c: str = "line") -> str:
    return f"regexp_matches({c}, '{_duck(p)}')"


DUCK_TOC = f"({_is(book.TOC_NUMBERED)} OR ({_is(book.TOC_LONG)} AND len({duck_words('line')}) > 6))"
DUCK_CLEAN = f"trim(translate(CASE WHEN {_is(book.TITLE_LINE, '{0}')} THEN regexp_extract({{0}}, '{_duck(book.TITLE_LINE)}', 1) ELSE trim(trim({{0}}, '#')) END, '*_', ''))".replace(book.TITLE_LINE.replace("(?U)", ""), book.TITLE_LINE.replace("(?U)", "").replace("{", "{{").replace("}", "}}"))
DUCK_ZONES = f"""{DUCK_BOOK},
y AS (SELECT doc_id, CASE WHEN min(CASE WHEN line_no = 1 THEN trim(line) END) = '---' THEN coalesce(min(line_no) FILTER (WHERE line_no > 1 AND trim(line) = '---'), 0) ELSE 0 END AS skip FROM bookdec GROUP BY doc_id),
ls AS (SELECT b.doc_id, line_no - skip AS line_no, line FROM bookdec b JOIN y ON y.doc_id = b.doc_id WHERE line_no > skip),
c AS (SELECT doc_id, coalesce(min(line_no) FILTER (WHERE {_is(book.CONTENTS_LINE)}), 0) AS c, max(line_no) + 1 AS n FROM ls GROUP BY doc_id),
h AS (SELECT c.doc_id, n, coalesce(min(line_no) FILTER (WHERE line_no > c AND {_is(book.REAL_HEAD)}), n) AS h FROM c JOIN ls ON ls.doc_id = c.doc_id GROUP BY c.doc_id, n),
k AS (SELECT h.doc_id, h, coalesce(min(line_no) FILTER (WHERE line_no >= h AND {_is(book.BACK_LINE)}), n) AS k FROM h JOIN ls ON ls.doc_id = h.doc_id GROUP BY h.doc_id, h, n),
zones AS (SELECT ls.doc_id, line_no, line, CASE WHEN line_no < h THEN 'front' WHEN line_no < k THEN 'body' ELSE 'back' END AS zone FROM ls JOIN k ON k.doc_id = ls.doc_id)"""
DUCK_CHAPTERS = f"""{DUCK_ZONES},
m AS (SELECT doc_id, line_no, line, {_is(book.PART_LINE)} AS is_part, {_is(book.CHAPTER_LINE)} AS is_ch, {_is(book.FRONT_LINE)} AS is_front, {_is(book.TITLE_LINE)} AS is_title, {_is('(?U)^#[ ]')} AS l1, {_is(book.ITALIC_TITLE)} AS italic FROM zones WHERE zone = 'body' AND NOT {DUCK_TOC}),
ev AS (SELECT *, CASE WHEN is_part THEN 'part' WHEN is_ch THEN 'chapter' WHEN is_title AND l1 AND NOT is_front THEN 'title' END AS e,
  CASE WHEN is_title AND NOT is_part AND NOT is_ch AND NOT is_front THEN CASE WHEN italic THEN trim(regexp_extract(line, '{_duck(book.ITALIC_TITLE)}', 1)) ELSE {DUCK_CLEAN.format('line')} END END AS t FROM m),
pv AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev),
op AS (SELECT *, coalesce(e = 'chapter' OR (e = 'title' AND coalesce(prev, '') <> 'chapter'), FALSE) AS opens FROM pv),
ru AS (SELECT *, CAST(sum(CAST(opens AS INT)) OVER w AS INT) AS chapter_no, last_value(CASE WHEN e = 'part' THEN 0 WHEN opens THEN 1 END IGNORE NULLS) OVER w AS is_open,
  coalesce(last_value(CASE WHEN e = 'part' THEN upper({DUCK_CLEAN.format('line')}) END IGNORE NULLS) OVER w, '') AS part FROM op WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chapters AS (SELECT doc_id, chapter_no, arg_min(part, line_no) AS part, coalesce(max(CASE WHEN e = 'chapter' THEN trim(regexp_extract(line, '{_duck(book.CHAPTER_LINE)}', 1)) END), '') AS number,
  coalesce(arg_min(t, line_no) FILTER (WHERE t <> ''), '') AS title,
  {DUCK_TRIM.format("regexp_replace(" + DUCK_TRIM.format("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE coalesce(e, '') <> 'chapter'), '')") + f", '{_duck(book.BOILERPLATE)}', '" + chr(92) + "1', 'g')")} AS text
  FROM ru WHERE is_open = 1 GROUP BY doc_id, chapter_no)"""


@query(f"{DUCK_ZONES} SELECT * FROM zones")
def book_zones(spark, sf_dir):
    return book.book_lines(book_texts(spark, sf_dir))


@query(f"{DUCK_CHAPTERS} SELECT * FROM chapters")
def book_chapters(spark, sf_dir):
    return book.book_chapters(book.book_lines(book_texts(spark, sf_dir)))


@query(f"{DUCK_CHAPTERS}, p AS (SELECT doc_id, upper({DUCK_CLEAN.format('line')}) AS part, min(line_no) AS o FROM m WHERE is_part GROUP BY ALL) SELECT doc_id, list(part ORDER BY o) AS parts FROM p GROUP BY doc_id")
def book_parts(spark, sf_dir):
    return book.book_parts(book.book_lines(book_texts(spark, sf_dir)))


@query(
    f"""{DUCK_CHAPTERS}, l AS (SELECT *, coalesce(nullif(title, ''), nullif(number, ''), concat('chapter_', chapter_no)) AS label,
 last_value(nullif(part, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM chapters)
SELECT doc_id, concat('# Contents', chr(10), chr(10), string_agg(concat(CASE WHEN part <> '' AND part IS DISTINCT FROM before THEN concat(chr(10), '## ', part, chr(10)) ELSE '' END, chapter_no, '. ', label), chr(10) ORDER BY chapter_no), chr(10)) AS content FROM l GROUP BY doc_id"""
)
def book_contents(spark, sf_dir):
    return book.contents_index(book.book_chapters(book.book_lines(book_texts(spark, sf_dir))))


@query(
    f"""{DUCK_ZONES} SELECT doc_id, {DUCK_TRIM.format("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE zone = 'front'), '')")} AS front_matter,
 {DUCK_TRIM.format("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE zone = 'back'), '')")} AS back_matter FROM zones GROUP BY doc_id"""
)
def book_frame(spark, sf_dir):
    return book.book_frame(book.book_lines(book_texts(spark, sf_dir)))


DUCK_BOOK_FILES = f"""{DUCK_CHAPTERS}, l AS (SELECT *, coalesce(nullif(title, ''), nullif(number, ''), concat('chapter_', chapter_no)) AS label,
 last_value(nullif(part, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM chapters),
idx AS (SELECT doc_id, string_agg(concat(CASE WHEN part <> '' AND part IS DISTINCT FROM before THEN concat(chr(10), '## ', part, chr(10)) ELSE '' END, chapter_no, '. ', label), chr(10) ORDER BY chapter_no) AS items FROM l GROUP BY doc_id),
fr AS (SELECT doc_id, {DUCK_TRIM.format("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE zone = 'front'), '')")} AS front, {DUCK_TRIM.format("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE zone = 'back'), '')")} AS back FROM zones GROUP BY doc_id),
bk AS (SELECT doc_id, concat('book_', doc_id) AS stem, string_agg(line, chr(10) ORDER BY line_no) AS text FROM bookdec GROUP BY doc_id)
SELECT doc_id, 'bibliographic.md' AS rel_path, concat('---', chr(10), 'title: ', stem, chr(10), 'source_file: shelf/', stem, '.pdf', chr(10), '---', chr(10), '# ', stem, chr(10)) AS content FROM bk
UNION ALL SELECT doc_id, '00_front_matter.md', front FROM fr WHERE front <> ''
UNION ALL SELECT doc_id, concat(printf('%02d_', chapter_no), coalesce(nullif(substr(trim(regexp_replace(lower(label), '[^a-zA-Z0-9]+', '_', 'g'), '_'), 1, 60), ''), 'chapter'), '.md'), concat('# ', label, CASE WHEN part <> '' THEN concat(chr(10), chr(10), '> ', part) ELSE '' END, chr(10), chr(10), text, chr(10)) FROM l
UNION ALL SELECT bk.doc_id, 'contents.md', concat('# Contents', chr(10), chr(10), coalesce(items || chr(10), '')) FROM bk LEFT JOIN idx ON idx.doc_id = bk.doc_id
UNION ALL SELECT doc_id, 'zz_back_matter.md', back FROM fr WHERE back <> ''
UNION ALL SELECT doc_id, 'raw.md', text FROM bk"""


@query(DUCK_BOOK_FILES)
def book_files(spark, sf_dir):
    return book.book_files(book_texts(spark, sf_dir).withColumn("filename", F.concat(F.lit("shelf/book_"), F.col("doc_id").cast("string"), F.lit(".pdf"))))


PROFILE = "'article' AS doc_type, 'sections' AS structure_pattern, '2024-01-01' AS parsed_at"
DUCK_BLOCK = "concat(repeat('#', level), ' ', coalesce(nullif(label, ''), section_id), {}, chr(10), chr(10), content, chr(10), chr(10), '---', chr(10), chr(10))"
DUCK_TAG = "CASE WHEN language IN ('both', 'unknown', '') THEN '' ELSE concat(' [', CASE lower(language) WHEN 'english' THEN 'EN' ELSE 'XHO' END, ']') END"


def profiles(spark, sf_dir):
    return decorated(spark, sf_dir).selectExpr("doc_id", PROFILE.split(",")[0], *PROFILE.split(", ")[1:], "array('English', 'isiXhosa') AS languages")


@query(
    f"""{DUCK_SECTIONS}, s AS (SELECT doc_id, string_agg({DUCK_BLOCK.format(DUCK_TAG)}, '' ORDER BY section_ord) AS b FROM sections GROUP BY doc_id)
SELECT doc.doc_id, concat(rtrim(concat('---', chr(10), 'document_id: ', doc.doc_id, chr(10), 'doc_type: article', chr(10), 'languages: English, isiXhosa', chr(10), 'structure_pattern: sections', chr(10), 'parsed_at: 2024-01-01', chr(10), '---', chr(10), chr(10), coalesce(b, '')), chr(10) || ' '), chr(10)) AS content FROM doc LEFT JOIN s ON s.doc_id = doc.doc_id"""
)
def combined_markdown(spark, sf_dir):
    return render.combined_markdown(profiles(spark, sf_dir), sections(spark, sf_dir))


@query(
    f"""{DUCK_SECTIONS}, s AS (SELECT doc_id, string_agg({DUCK_BLOCK.format("''")}, '' ORDER BY section_ord) AS b FROM sections WHERE language IN ('English', 'both', 'unknown') GROUP BY doc_id)
SELECT doc.doc_id, CASE WHEN b IS NULL THEN '' ELSE concat(rtrim(concat('---', chr(10), 'document_id: ', doc.doc_id, chr(10), 'language: en', chr(10), 'parsed_at: 2024-01-01', chr(10), '---', chr(10), chr(10), b), chr(10) || ' '), chr(10)) END AS content FROM doc LEFT JOIN s ON s.doc_id = doc.doc_id"""
)
def language_markdown(spark, sf_dir):
    return render.language_markdown(profiles(spark, sf_dir), sections(spark, sf_dir), "en")


@query(f"{DUCK_SECTIONS}, f AS (SELECT doc_id, CASE lower(language) WHEN 'english' THEN 'en' ELSE 'xhosa' END AS l, min(section_ord) AS o FROM sections WHERE language NOT IN ('both', 'unknown', '') GROUP BY ALL) SELECT doc_id, list(l ORDER BY o) AS slugs FROM f GROUP BY doc_id")
def detected_languages(spark, sf_dir):
    return render.detected_languages(sections(spark, sf_dir))


KINDS = "CASE doc_id % 6 WHEN 0 THEN 'Research Paper' WHEN 1 THEN 'Book' WHEN 2 THEN 'Legal act' WHEN 3 THEN 'unknown' WHEN 4 THEN NULL ELSE 'contract' END"
DUCK_SCORES = f"""g AS (SELECT doc_id, lower(coalesce({KINDS}, '')) AS kind, lower(string_agg(line, chr(10) ORDER BY line_no)) AS s FROM bookdec GROUP BY doc_id),
scores AS (SELECT doc_id, CAST(CASE WHEN regexp_matches(kind, 'academic|paper|report|article') THEN 0.9 ELSE 0.5 END AS DOUBLE) AS academic_article,
 CAST(CASE WHEN contains(kind, 'book') THEN 0.95 ELSE least(0.95, CASE WHEN regexp_matches(s, '\\bchapter\\s+[ivxlc\\d]') THEN 0.5 ELSE 0 END + CASE WHEN contains(substr(s, 1, 4000), 'table of contents') OR contains(substr(s, 1, 2000), 'contents') THEN 0.2 ELSE 0 END
   + CASE WHEN contains(substr(s, 1, 2000), 'isbn') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(s, '\\bpart\\s+[ivxlc\\d]') THEN 0.1 ELSE 0 END) END AS DOUBLE) AS book,
 CAST(CASE WHEN contains(kind, 'legal') OR contains(kind, 'act') THEN 0.9 WHEN contains(substr(s, 1, 3000), 'whereas') OR contains(substr(s, 1, 3000), 'enacted by') THEN 0.6 ELSE 0 END AS DOUBLE) AS legal_act FROM g)"""


@query(f"{DUCK_BOOK}, {DUCK_SCORES} SELECT * FROM scores")
def genre_confidence(spark, sf_dir):
    d = book_texts(spark, sf_dir).withColumn("kind", F.expr(KINDS))
    return d.select("doc_id", *(c.alias(g) for g, c in genres.confidences("kind", "text").items()))


@query(f"{DUCK_BOOK}, {DUCK_SCORES} SELECT doc_id, CASE WHEN academic_article >= book AND academic_article >= legal_act THEN 'academic_article' WHEN book >= legal_act THEN 'book' ELSE 'legal_act' END AS genre FROM scores")
def genre_route(spark, sf_dir):
    d = book_texts(spark, sf_dir).withColumn("kind", F.expr(KINDS))
    return d.select("doc_id", genres.routed("kind", "text").alias("genre"))
