"""Cases worked out by hand from the contracts, and invariants."""

import random
import re

import pytest
from folioforge.functions import pytext as P
from folioforge.functions import strings as S
from folioforge.operators import article, book, chunks, evaluate, genres, names, packing, plan, speech, workflow
from folioforge.operators import lines as L
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "a\r\nb\rc\n\n", "a\x0bb\x1cc\x85d\u2028e", "\r\n\r\n", " x \n y"])
def test_lines_and_strip(spark, text):
    assert value(spark, P.lines(F.lit(text))) == text.splitlines()
    assert value(spark, P.strip(F.lit(text))) == text.strip()
    assert value(spark, P.words(F.lit(text + " \x1f z\u3000q"))) == (text + " \x1f z\u3000q").split()


def test_slugs(spark):
    assert value(spark, S.file_slug(F.lit("My Paper (v2)"))) == "My_Paper_v2"
    assert value(spark, S.file_slug(F.lit("!!!"))) == "doc"
    a = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    assert value(spark, S.article_slug(a("Peter M. Haas"), F.lit(1992), F.lit("Introduction: Epistemic Communities and International Policy Coordination"))) == "Haas_1992_IntroductionEpistemicCommunities"
    assert value(spark, S.article_slug(a("X Ala-Pietilä", "Nathalie Smuha"), F.lit(2021), F.lit("A Framework for Global Cooperation on AI"))) == "AlapietilaSmuha_2021_FrameworkGlobalCooperation"
    assert value(spark, S.article_slug(a(), F.lit(0), F.lit("Of the"))) == "Unknown_XXXX_Article"
    assert value(spark, S.apa_citation(a("Peter M. Haas"), F.lit(1992), F.lit("T"), F.lit("J"), F.lit("10.1/x"))) == "Haas, P. M. (1992) T. *J* https://doi.org/10.1/x"
    assert value(spark, S.language_label(F.lit("isiXhosa"))) == "XHO"
    assert value(spark, S.language_label(F.lit("German"))) == "GER"
    assert value(spark, S.file_url_path(F.lit("file:///C:/My%20Docs/a.pdf"))) == "C:/My Docs/a.pdf"
    assert value(spark, S.file_url_path(F.lit("file:///home/a+b.pdf"))) == "/home/a+b.pdf"
    assert value(spark, S.recovered_year(F.lit(None), F.lit("Data, 2021 - 2023"))) == 2023
    assert value(spark, S.data_uri(F.lit(bytearray(b"\xff\xd8\xff\xe0" * 60)))).startswith("data:image/jpeg;base64,/9j/4P")


def test_noise(spark):
    for line, want in [("12", True), ("Page 3 of 10", True), ("draft", True), ("1. Intro", False), ("", False), ("  DOI: 10.1234/x ", True), ("www.a.b", True)]:
        assert value(spark, L.is_noise(F.lit(line))) is want
    assert value(spark, L.without_noise(F.lit("a\n12\nb"))) == ["a", "", "b"]


def test_passages_cover_all_words(spark):
    rnd = random.Random(3)
    for _ in range(12):
        n, w = rnd.randrange(0, 40), rnd.randrange(1, 12)
        o = rnd.randrange(0, w)
        ws = [f"w{i}" for i in range(n)]
        got = value(spark, chunks.passages(F.lit(" ".join(ws)), w, o))
        want, i = [], 0
        while i < n:
            want.append((" ".join(ws[i : i + w]), len(" ".join(ws[:i]))))
            if i + w >= n:
                break
            i += w - o
        assert [tuple(g) for g in got] == want
    with pytest.raises(ValueError):
        chunks.passages(F.lit("a"), 3, 3)
    assert [value(spark, chunks.token_estimate(F.lit(" ".join(["x"] * n)))) for n in (0, 1, 10)] == [0, 1, 13]


def test_gap_fill_and_paths(spark):
    p = spark.createDataFrame([(1, 1, "a", "s", "en", 1, 3, 4), (1, 2, "b", "t", "en", 1, 7, 8)], "doc_id long, ord int, label string, section_id string, language string, level int, start_line int, end_line int")
    t = spark.createDataFrame([(1, 10), (2, 5)], "doc_id long, n_lines int")
    got = [(r.doc_id, r.start_line, r.end_line, r.section_id) for r in plan.gaps_filled(p, t).orderBy("doc_id", "section_ord").collect()]
    assert got == [(1, 1, 2, "unlabeled_1"), (1, 3, 4, "s"), (1, 5, 6, "unlabeled_5"), (1, 7, 8, "t"), (1, 9, 10, "unlabeled_9"), (2, 1, 5, "body")]
    h = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 3, "B"), (1, 3, 2, "C"), (1, 4, 3, ""), (1, 5, 1, "D")], "doc_id long, section_ord int, level int, label string")
    assert [r.heading_path for r in plan.heading_paths(h).orderBy("section_ord").collect()] == [["A"], ["A", "B"], ["A", "C"], ["A", "C"], ["D"]]


def split(spark, text):
    r = article.split_article(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return r.abstract, r.body, r.references


def test_article_rules(spark):
    para = "We study how experts matter in the making of public policy, and we find that they do so in many ways. " * 3
    assert split(spark, "## Abstract\n\n" + "word " * 500 + "\n\n## X\ny") [0] == "## Abstract"
    assert split(spark, "# T\nAbstract\nshort one\nKeywords: a, b\nrest") == ("Abstract\nshort one", "# T\nKeywords: a, b\nrest", "")
    assert split(spark, "**Abstract:** bold one\nmore\n1. Introduction\nrest")[0] == "**Abstract:** bold one\nmore"
    assert split(spark, f"# T\n\n{para}\n\nKeywords: a\nbody")[0] == para.strip()
    assert split(spark, f"# T\n\n{para}\n\n## 1. Introduction\nbody") [0] == para.strip()
    assert split(spark, "a\n## References\nold\n## References\nx\n## Appendix A\nz") == ("", "a\n## References\nold\n## Appendix A\nz", "## References\nx")
    assert split(spark, None) == ("", "", "")
    assert split(spark, "one\r\ntwo") == ("", "one\r\ntwo", "")


def test_book_rules(spark):
    text = "Front\n# Part I\nlost\n# Chapter 1\n# One\ntext\nISBN 12 x\n## Sub\n# Two\nmore\n# Part II\nlost again\nChapter 2 inline\nbody\nNotes\nn1"
    rows = book.book_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = [(r.part, r.number, r.title, r.text) for r in book.book_chapters(rows).orderBy("chapter_no").collect()]
    assert got == [("PART I", "1", "One", "# One\ntext\nISBN 12 x\n## Sub".replace("ISBN 12 x", " x")), ("PART I", "", "Two", "# Two\nmore"), ("PART II", "2", "", "body")]
    frame = book.book_frame(rows).first()
    assert (frame.front_matter, frame.back_matter) == ("Front", "Notes\nn1")
    assert book.book_parts(rows).first().parts == ["PART I", "PART II"]


def test_genres(spark):
    for kind, sample, want in [("report on legal act", "", "academic_article"), ("book", "", "book"), ("", "chapter 1 isbn", "book"), ("contract", "", "legal_act"), (None, "Whereas", "legal_act"), (None, None, "academic_article")]:
        assert value(spark, genres.routed(F.lit(kind).cast("string"), F.lit(sample).cast("string"))) == want
    assert genres.available_genres() == ["academic_article", "book", "legal_act"]
    assert genres.genre("nothing").id == "academic_article"


def test_citations_and_titles(spark):
    for text, want in [
        ("Experts matter (Haas 1992, 3).", "Experts matter."),
        ("Haas (1992) argues", "Haas argues"),
        ("kept (in the year 1992) here", "kept (in the year 1992) here"),
        ("long aside (a point made well elsewhere, see Haas 1992)", "long aside"),
        ("no year (Haas) stays", "no year (Haas) stays"),
        ("note[12] and mark¹ gone", "note and mark gone"),
    ]:
        assert value(spark, speech.without_citations(F.lit(text))) == want
    assert value(spark, speech.title_case(F.lit("POLITICS OF EXPERTISE"))) == "Politics of Expertise"
    assert value(spark, speech.title_case(F.lit("PART II"))) == "Part II"
    assert value(spark, speech.clean_markdown(F.lit("> **bold** and [a](b) x²\n- item"))) == "bold and a x squared\nitem"


def test_voice_script(spark):
    text = '---\ntitle: "My Title"\nauthors: ["A B", "C D"]\nyear: 2020\n---\nJunk line\n# My Title\n## Contents\ndropped\n## 1 Start\nKeywords: x\nmore words\nA sentence (Haas 1992).\n12\nJohn Smith\n## References\ngone\n## After\ngone too'
    got = speech.voice_scripts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().script
    assert got.startswith("# My Title — for voice\n") and '"My Title", by A B, and C D, 2020' in got
    assert "# My Title\n## 1 Start\nA sentence.\n" in got and "gone" not in got and "dropped" not in got and "John" not in got


def test_script_files(spark):
    main = '---\ntitle: "T"\nslug: "S_1"\n---\n# T\nwords here and there, all small.'
    rows = [("v/A", "A.md", main), ("v/A", "abstract.md", "## Abstract\n\nshort text."), ("v/A", "body.md", "# Start\nthe body says so."), ("v/A", "references.md", "r"), ("v/B", "x.md", main), ("v/C", "references.md", "r")]
    got = {r.folder: r for r in speech.case_scripts(spark.createDataFrame(rows, "folder string, name string, content string")).collect()}
    assert set(got) == {"v/A", "v/B"} and got["v/A"].rel_path == "v/A/S_1_for_voice.md"
    assert "<!-- source: abstract.md + body.md -->" in got["v/A"].script and "# Abstract\n\nshort text.\n\n# Start\nthe body says so." in got["v/A"].script
    assert "<!-- source: x.md -->" in got["v/B"].script and got["v/B"].script.startswith("# T — for voice")
    files = spark.createDataFrame([("d/a.md", main), ("d/notes_x.md", "n"), ("d/a_for_voice.md", "n"), ("d/body.md", "n"), ("d/a.txt", "n")], "path string, content string")
    assert [(r.path, r.rel_path) for r in speech.file_scripts(files).collect()] == [("d/a.md", "d/a_for_voice.md")]


def test_evaluation(spark):
    d = spark.createDataFrame([("# A\nalpha beta", [("A", "alpha gamma")])], "gold string, sections array<struct<label:string,content:string>>")
    r = evaluate.scored_runs(d).first()
    assert r.gold_token_f1 == 0.4 and r.num_hallucinated == 0 and r.num_gold_sections == 1
    c = spark.createDataFrame([("qwen-plus", " ".join(["w"] * 1000), "", 0)], "model string, prompt_text string, output_text string, ocr_pages int")
    assert evaluate.with_cost(c).first().cost_usd == 0.000507


def named_in_order(stems):
    used, out = set(), []
    for s in stems:
        name, n = s, 2
        while name in used:
            name, n = f"{s}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("pool", [["a", "a_2", "a_3", "a_5", "a_2_2", "a_2_3", "a_3_2", "b", "b_2", "a_02", "a_1", "a_2_2_2", "", "_2"], ["a"] * 20 + [f"a_{k}" for k in range(2, 30)] + [f"a_{k}_{j}" for k in (2, 3, 4) for j in (2, 3, 4)]])
def test_unique_names(spark, pool):
    rnd = random.Random(len(pool))
    rows = [(g, i, s) for g in ("f", None) for i, s in enumerate([*(["a", "a", "a_2"] if g else []), *(rnd.choice(pool) for _ in range(90))])]
    d = spark.createDataFrame(rows, "g string, i int, s string")
    got = {(r.g, r.i): r.name for r in names.unique_names(d, "s", "i", "g").collect()}
    for g in ("f", None):
        assert [got[g, i] for h, i, _ in rows if h == g] == named_in_order([s for h, _, s in rows if h == g])
    assert [got["f", i] for i in range(3)] == ["a", "a_2", "a_2_2"]
    assert names.unique_names(d.limit(0), "s", "i", "g").count() == 0


def test_one_mixed_root_is_spread(spark):
    """Half the rows have the root as stem, the others are its numbers; no task of the result holds more than its share."""
    n = 30_000
    d = spark.range(n).select(F.lit("f").alias("g"), F.col("id").alias("i"), F.expr("CASE WHEN hash(id) % 2 = 0 THEN 'a' ELSE concat('a_', pmod(xxhash64(id), 20000) + 2) END").alias("s"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = names.unique_names(d, "s", "i", "g")
        per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert [r.name for r in out.orderBy("i").collect()] == named_in_order([r.s for r in d.orderBy("i").collect()])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert max(per) < n * 0.6


def test_page_batches(spark):
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 90) for _ in range(60)]
    batches, cur, n, b = [], 0, 0, 0
    for s in sizes:
        e = s * 4 // 3
        if n >= 5 or (n and b + e > 300):
            cur, n, b = cur + 1, 0, 0
        batches.append(cur)
        n, b = n + 1, b + e
    assert value(spark, L.page_batches(F.array(*(F.lit(s) for s in sizes)), 5, 300)) == batches


def test_packing_over_blocks(spark):
    """Equal to the fold, with blocks as small as a call and with one block."""
    rnd = random.Random(7)
    rows = [(p, k * 3, rnd.choice([None, 0, 5, 90, 300, 1000])) for p, n in (("a", 137), ("b", 1), ("c", 40), (None, 3)) for k in range(n)]
    rows += [("d", k, 10) for k in range(64)]
    d = spark.createDataFrame(rows, "path string, page_no long, size long")

    def fold(sizes):
        out, n, total, batch = [], 0, 0, 0
        for s in (int((s or 0) * 4 / 3) for s in sizes):
            if n >= 8 or n and total + s > 700:
                n, total, batch = 0, 0, batch + 1
            n, total = n + 1, total + s
            out.append(batch)
        return out

    for block in (8, 4096):
        got = {}
        for r in packing.packed_pages(d, 8, 700, block=block).orderBy("page_no").collect():
            got.setdefault(r.path, []).append(r.batch)
        assert got == {p: fold([s for q, _, s in sorted(rows, key=lambda r: r[1]) if q == p]) for p in "abcd"}
    assert packing.packed_pages(d.limit(0)).count() == 0
    many = spark.range(200_000).selectExpr("'x' AS path", "id AS page_no", "pmod(hash(id), 700) AS size")
    out = packing.packed_pages(many, 8, 700, block=4096)
    assert out.agg(F.count("*"), F.max("batch")).first() == (200_000, max(fold([r.size for r in many.orderBy("page_no").collect()])))


def test_leaks(spark):
    text = "good\n## You transcribe document page images into markdown\nbad\n---\nall fine\n---\nSystem preamble: x"
    assert value(spark, L.without_leaks(F.lit(text))) == "good\n\n---\n\nall fine"


def test_workflows(spark):
    docs = spark.createDataFrame([(1, "a.md", "# T\n\n## Abstract\nabc\n\n## R\nx", None), (2, "b.md", None, "broken"), (3, "c.md", "plain", None)], "doc_id long, source string, text string, error string")
    meta = spark.createDataFrame([(1, "The Great Title", ["A Smith"], 2001, "J", "")], "doc_id long, title string, authors array<string>, year int, journal string, doi string")
    done = spark.createDataFrame([("c.md",)], "source string")
    files, results = workflow.article_vault(docs, meta, done)
    assert {r.rel_path for r in files.collect()} == {f"Smith_2001_GreatTitle/{n}" for n in ("Smith_2001_GreatTitle.md", "abstract.md", "body.md", "references.md", "bibliographic.md")}
    assert [(r.source, r.slug, r.has_abstract, r.error) for r in results.orderBy("source").collect()] == [("a.md", "Smith_2001_GreatTitle", True, None), ("b.md", None, None, "broken")]
    assert sorted(r.rel_path for r in workflow.freeform(docs).collect()) == ["a.md", "b.md", "c.md"]
    plans = spark.createDataFrame([(1, 1, "T", "", "en", 1, 1, 2)], "doc_id long, ord int, label string, section_id string, language string, level int, start_line int, end_line int")
    out = workflow.genre_pipeline(docs.withColumn("filename", F.col("source")), docs.select("doc_id", F.lit("paper").alias("doc_type")), plans)
    chunks_ = out["chunks"].where("doc_id = 1").orderBy("position").collect()
    assert [c.position for c in chunks_] == list(range(len(chunks_))) and chunks_[0].kind == "full_doc"
    heads = plans.withColumn("label", F.lit("T"))
    secs, chks = workflow.parse_standard(docs, heads)
    assert secs.count() > 0 and chks.where("doc_id = 2").count() == 1
    assert re.match(r"1_0000$", chks.where("doc_id = 1 and position = 0").first().chunk_id)


def test_null_empty_and_repeated_rows(spark):
    """Null and empty texts, a long one, repeated rows, empty tables and columns with other uses."""
    long_ = "# Chapter 1\n" + "word (Smith 1990) here.\n" * 5000
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (3, "plain", "x"), (4, long_, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, line string")
    for df, n in ((d, 5), (d.limit(0), 0)):
        assert article.split_article(df).count() == n
        assert chunks.chunked(df).where("kind = 'full_doc'").count() == n
        assert speech.voice_scripts(df.dropDuplicates(["doc_id"])).count() == min(n, 4)
        book.book_chapters(book.book_lines(df)).count()
        assert df.select(L.without_noise(F.coalesce("text", F.lit(""))).alias("x"), L.without_leaks("text").alias("y"), genres.routed("line", "text").alias("g")).count() == n
        assert names.first_of(df, ["doc_id"], F.col("line")).count() == min(n, 4)
        totals = df.select("doc_id", F.size(P.lines(F.coalesce("text", F.lit("")))).alias("n_lines")).distinct()
        none = spark.createDataFrame([], "doc_id long, ord int, label string, section_id string, language string, level int, start_line int, end_line int")
        full = plan.gaps_filled(none, totals)
        assert full.count() == min(n, 4)
        assert plan.cut_sections(df.dropDuplicates(["doc_id"]), full).count() == (2 if n else 0)
    assert evaluate.best_runs(spark.createDataFrame([], "case_id long, ord int, error string, num_hallucinated int, num_unlabeled int, gold_token_f1 double")).count() == 0


def test_words_of_a_case_are_counted_once(spark):
    """run_costs carries no text through the run matrix."""
    from __spark_entry__ import queries

    plan = queries()["run_costs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode")
    assert "text" not in above and "text" in below


def test_words_and_lines_of_odd_spaces(spark):
    texts = ["", " ", "\n", "a", " a  b\n\nc ", "a\u2003b\u3000c\u2028d", "\x85a\x1cb\r\nc\r", "\u200b a\tb", "é–x y", "a\r\n\r\nb\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.words("t").alias("w"), P.n_words("t").alias("n"), P.lines("t").alias("l"), P.strip("t").alias("s")).collect()
    for r in rows:
        if r.t is None:
            assert r[1:] == (None, None, None, None)
        else:
            assert (r.w, r.n, r.l, r.s) == (r.t.split(), len(r.t.split()), re.sub("\r\n", "\n", r.t).splitlines(), r.t.strip())


def test_speech_rules_are_guarded(spark):
    """no rule scans a text that cannot match it, and what a rule needs changes no result."""
    rules = speech.CITED_BEFORE | speech.CITED_AFTER | speech.MARKUP
    marks = ["<!-- a -->", "---", "***", "| x |", "![](u)", "![a](u)", "[a](u)", "https://a.b", "a@b.c", "*a* __b__ `c`", "> q", "- i", "1. n", "2) n", "(#3)", "(Ann (1999) b)", "Ann (2001)", "[4]", "x²", "a  b", "a\t\tb", "plain ,"]
    texts = spark.createDataFrame([(f"w {m} v\n{m}\n{n}",) for m in marks for n in marks], "t string").cache()
    for name, rule in rules.items():
        one = F.regexp_replace("t", *map(F.lit, rule))
        assert texts.where(~one.eqNullSafe(speech._by_rules("t", {name: rule}))).isEmpty()
        assert texts.where(one != F.col("t")).count() > 0
    plan = speech.voice_scripts(texts.select(F.lit(1).alias("doc_id"), F.col("t").alias("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert r"^(?:DOI" not in plan  # the furniture pattern is anchored once, not once a kind


def test_only_open_labels_are_indexed(spark, monkeypatch):
    """labels that equal a heading, and cases with no other ones, do not reach the index."""
    labels = spark.createDataFrame([(1, "Same"), (1, "other"), (1, "Par"), (2, "same"), (3, "x"), (4, "")], "case_id int, label string")
    heads = spark.createDataFrame([(1, "SAME"), (1, "Part two"), (2, "Same!"), (2, "More"), (4, "z")], "case_id int, heading string")
    seen = []
    held = evaluate.held_keys

    def told(inner, outer, case):
        seen.append(sorted(tuple(r) for r in inner.select(case, "key").collect()))
        return held(inner, outer, case)

    monkeypatch.setattr(evaluate, "held_keys", told)
    assert sorted(map(tuple, evaluate.invented_labels(labels, heads).collect())) == [(1, "other"), (3, "x")]
    assert seen == [[(1, "other"), (1, "par"), (3, "x"), (4, "")], [(1, "part two"), (1, "same"), (4, "z")]]


def test_index_of_headings_is_not_broadcast(spark, monkeypatch):
    """no table of the index passes through the driver, however small its files are."""
    words = [f"{a}{b}{c}" for a in "abc" for b in "def" for c in "ghi"]
    said = [(i % 3, w) for i, w in enumerate(words)] + [(3, ""), (4, "")]
    heads = [(i % 3, f"part {w}" if i % 2 else w[1:]) for i, w in enumerate(words) if i % 4 == 1 or i % 12 == 2] + [(3, "x")]
    plans = []
    shown = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString())
    kept = evaluate.kept
    monkeypatch.setattr(evaluate, "kept", lambda d, name: (shown(d), kept(d, name))[1])
    found = evaluate.invented_labels(spark.createDataFrame(said, "case_id int, label string"), spark.createDataFrame(heads, "case_id int, heading string"))
    got = sorted(map(tuple, found.collect()))
    shown(found)
    assert got == sorted((c, w) for c, w in said if not any(c == k and (w in h or h in w) for k, h in heads)) and 1 < len(got) < len(said)
    assert len(plans) == 7 and not any("Broadcast" in p for p in plans)


def test_gaps_read_a_plan_once(spark, tmp_path):
    """the plan of a document is made once for its sections, gaps and tail."""
    kinds = "doc_id int, ord int, label string, section_id string, language string, level int, start_line int, end_line int"
    rows = spark.createDataFrame([(1, 1, "a", "", "en", 1, 3, 4), (1, 2, "b", "", "en", 2, 4, 6)], kinds)
    totals = spark.createDataFrame([(1, 9), (2, 5)], "doc_id int, n_lines int")

    def run(batches):
        for b in batches:
            with open(tmp_path / "told", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    got = plan.gaps_filled(rows.mapInArrow(run, kinds), totals).select("doc_id", "section_ord", "section_id", "label", "start_line", "end_line", "filler").collect()
    want = [(1, 1, "unlabeled_1", "", 1, 2, True), (1, 2, "", "a", 3, 4, False), (1, 3, "", "b", 4, 6, False), (1, 4, "unlabeled_7", "", 7, 9, True), (2, 1, "body", "", 1, 5, True)]
    assert sorted(map(tuple, got)) == want
    assert (tmp_path / "told").read_text() == "xx"


def test_book_files_make_chapters_once(spark, tmp_path):
    """chapters and frames are made once, however many files come of them."""
    docs = spark.createDataFrame([(1, "# Preface\nx\n# Chapter 1\n# One\ntext\n# References\ny", "a/b.pdf")], "doc_id int, text string, filename string")

    def run(batches):
        for b in batches:
            with open(tmp_path / "told", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    files = book.book_files(docs.mapInArrow(run, docs.schema))
    before = (tmp_path / "told").read_text()
    assert {r.rel_path for r in files.collect()} == {"bibliographic.md", "00_front_matter.md", "01_one.md", "contents.md", "zz_back_matter.md", "raw.md"}
    assert len((tmp_path / "told").read_text()) <= 5, before


def test_structured_reads_texts_and_lays_chunks_once(spark, tmp_path):
    """no second read of the texts for their numbers of lines, and no filter that lays all chunks to see that there are some."""
    kinds = "doc_id int, ord int, label string, section_id string, language string, level int, start_line int, end_line int"
    plans = spark.createDataFrame([(1, 1, "a", "", "en", 1, 3, 4), (1, 2, "b", "", "en", 2, 4, 6), (4, 1, "c", "c", "en", 1, 1, 9)], kinds)
    texts = spark.createDataFrame([(1, "\n".join("abcdefghi")), (2, "x\n# y\n\ufeffz"), (3, None), (4, "# h\n \n"), (None, "q")], "doc_id int, text string")

    def run(batches):
        for b in batches:
            with open(tmp_path / "told", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    docs = texts.mapInArrow(run, texts.schema)
    secs, chks = workflow.structured(docs, plans, window=3, overlap=1)
    assert chks._jdf.queryExecution().optimizedPlan().toString().count("full_doc") == 1
    chks.collect()
    assert (tmp_path / "told").read_text() == "x" * 5
    totals = texts.select("doc_id", F.size(P.lines(F.coalesce("text", F.lit("")))).alias("n_lines"))
    apart = plan.cut_sections(texts, plan.gaps_filled(plans, totals))
    key = lambda df: sorted(repr(r) for r in df.select("doc_id", "section_ord", "label", "section_id", "language", "level", "start_line", "end_line", "filler", "content").collect())
    assert key(secs) == key(apart) and len(key(apart)) == 5


def test_prefix_sums_and_halving(spark):
    """offsets and marks of long documents against plain Python."""
    for n in (0, 1, 31, 32, 33, 64, 200):
        sizes = [(i * 7) % 11 + 1 for i in range(n)]
        starts = [sum(sizes[:i]) for i in range(n)]
        xs = F.array(*map(F.lit, sizes)).cast("array<int>")
        assert value(spark, chunks.running(xs)) == starts
        ats = [-1, 0, 1, 5, sum(sizes) // 2, sum(sizes)]
        marks = F.array(*map(F.lit, starts)).cast("array<int>")
        assert value(spark, F.array(*(chunks.n_reached(marks, F.lit(a)) for a in ats))) == [sum(s <= a for s in starts) for a in ats]
