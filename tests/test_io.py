"""Files, providers, sinks and streaming on generated inputs."""

import io
import json
import os
import time
import zipfile
from datetime import datetime

import pytest
from folioforge.operators import cases, names, progress
from folioforge.sources import files, prompts, providers, scans, sinks
from folioforge.sources.ledger import Ledger, digest
from folioforge.streaming import choices, fresh, incremental
from pyspark.sql import functions as F

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx():
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Top", "Heading1") + p("") + p("Deep", "Heading5") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>" + p("end")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return buf.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "b.MD").write_bytes(b"\xef\xbb\xbf# B")
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "w.docx").write_bytes(docx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "p.pdf").write_bytes(b"one\fTWO\f \f3")
    (tmp_path / "x.doc").write_text("left out")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.md").write_text("deep")
    listed = files.listed(spark, str(tmp_path))
    assert sorted(r.filename for r in listed.select("filename").collect()) == ["a.txt", "b.MD", "bad.docx", "p.pdf", "w.docx"]
    assert files.listed(spark, str(tmp_path), recursive=True).count() == 6
    got = {r.filename: r for r in files.documents(listed, providers.get_ocr_provider("echo")).collect()}
    assert got["b.MD"].text == "# B" and got["a.txt"].text == "plain"
    assert got["w.docx"].text == "# Top\n\n#### Deep\n\na | b\n--- | ---\nc | d\n\nend"
    assert got["bad.docx"].error and got["bad.docx"].text is None
    assert got["p.pdf"].text == "one\n\n---\n\nTWO\n\n---\n\n3"
    assert {r.filename: r.error for r in files.documents(listed).where("format = 'pdf'").collect()} == {"p.pdf": "no OCR provider"}


def test_providers(spark):
    calls = []

    class Flaky(providers.OcrProvider):
        def extract(self, filename, content):
            raise OSError("down")

    with pytest.raises(providers.ProviderError):
        providers.retried(3, 0)(lambda: calls.append(1) or 1 / 0)()
    assert len(calls) == 3
    f = spark.createDataFrame([("p", "n", bytearray(b"x"))], "path string, filename string, content binary")
    assert providers.ocr_pages(f, Flaky(), wait=0).first().error == "down"
    with pytest.raises(ValueError):
        providers.get_chat_provider("nobody")
    q = spark.createDataFrame([(1, "s", "# Title\nx")], "doc_id long, system string, user string")
    r = providers.chat_json(q, providers.get_chat_provider("rules"), "title string, authors array<string>, year int, source string, doi string").select(providers.clean_metadata("reply").alias("m")).first().m
    assert r.title == "Title" and r.authors == [] and r.year is None
    assert prompts.available_variants() == ["conservative", "default", "strict"]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("S/a.md", "A"), ("S/b/c.md", None)], "rel_path string, content string")
    sinks.write_vault(f, f"file://{tmp_path}")
    assert (tmp_path / "S/a.md").read_text() == "A" and (tmp_path / "S/notes").is_dir() and (tmp_path / "S/b/c.md").read_text() == ""
    with pytest.raises(ValueError):
        sinks.write_vault(f.union(f), f"file://{tmp_path}")
    with pytest.raises(Exception, match="leaves the vault"):
        sinks.write_vault(spark.createDataFrame([("../x", "")], "rel_path string, content string"), f"file://{tmp_path}")
    assert [sinks.vault_folder("/r", "c", o) for o in (None, "named", "/abs", "/abs/c")] == ["/r/c", "/r/named/c", "/abs/c", "/abs/c"]
    z = sinks.zipped(f).first()
    assert zipfile.ZipFile(io.BytesIO(z.archive)).namelist() == ["S/", "S/notes/", "S/a.md", "S/b/c.md"]
    done = f"file://{tmp_path}/done"
    assert sinks.done_sources(spark, done).count() == 0
    sinks.mark_done(spark.createDataFrame([("a", None), ("b", "bad")], "source string, error string"), done)
    assert [r.source for r in sinks.done_sources(spark, done).collect()] == ["a"]
    assert names.pending(spark.createDataFrame([("a",), ("b",)], "source string"), sinks.done_sources(spark, done)).collect()[0].source == "b"
    assert '"é"' in sinks.as_json(spark.createDataFrame([(1, "é")], "doc_id long, t string")).first().json


def test_uploads(spark, tmp_path):
    rows = [("a/b/x.md", bytearray(b"one")), ("y.md", bytearray(b"two")), ("a/x.md", None)]
    up = spark.createDataFrame(rows, "path string, content binary")
    saved = sinks.save_uploads(up, f"file://{tmp_path}")
    assert saved.where("written").count() == saved.where("written").count() == 3  # an action more writes and changes nothing
    first = {r.path: r.written for r in saved.collect()}
    assert first == {"a/b/x.md": True, "y.md": True, "a/x.md": True} and (tmp_path / "a/b/x.md").read_bytes() == b"one"
    more = spark.createDataFrame([("y.md", bytearray(b"TWO")), ("a/b/x.md", bytearray(b"longer"))], "path string, content binary")
    assert {r.path: (r.size, r.written) for r in sinks.save_uploads(more, f"file://{tmp_path}").collect()} == {"y.md": (3, False), "a/b/x.md": (6, True)}
    assert (tmp_path / "y.md").read_bytes() == b"two"
    with pytest.raises(Exception, match="leaves the vault"):
        sinks.save_uploads(spark.createDataFrame([("../x", bytearray(b""))], "path string, content binary"), f"file://{tmp_path}").collect()
    assert [r.filename for r in files.listed(spark, str(tmp_path), recursive=True, with_content=False).collect()] == ["x.md", "y.md"]  # the empty one is left out
    one = sinks.pretty_json(spark.createDataFrame([(1, "é", ["a"])], "doc_id long, t string, l array<string>")).first().json
    assert one == json.dumps({"doc_id": 1, "t": "é", "l": ["a"]}, indent=2, ensure_ascii=False)


def test_scans(spark):
    class Short(scans.EchoVision):
        def transcribe(self, images, prompt):
            if b"bad" in images:
                raise OSError("down")
            assert len(images) <= 2
            return super().transcribe(images, prompt)

    rows = [("a", b"p1\fp2\f \fp4\n# System preamble: x\nrest\fp5"), ("b", b"x\fbad"), ("c", b""), ("d", None)]
    f = spark.createDataFrame([(p, "n.pdf", None if c is None else bytearray(c)) for p, c in rows], "path string, filename string, content binary")
    got = {r.path: r for r in scans.transcribed(f, scans.FormFeedPages(), Short(), pages_per_call=2, wait=0).collect()}
    assert got["a"].text == "p1\n\n---\n\np2\n\n---\n\np4\n\n---\n\np5" and got["a"].error is None
    assert (got["b"].text, got["b"].error) == (None, "down") and "no pages" in got["c"].error and "no pages" in got["d"].error
    s = spark.createDataFrame([("a", "n", "u", None), ("b", "n", None, None), ("c", "n", None, bytearray(b"z"))], "path string, filename string, url string, content binary")
    by = {r.path: r for r in scans.with_bytes(s, lambda url: url.encode() * 2).collect()}
    assert bytes(by["a"].content) == b"uu" and by["b"].error and bytes(by["c"].content) == b"z"
    assert "URL" in {r.path: r for r in scans.with_bytes(s).collect()}["a"].error
    pages = spark.createDataFrame([("a", k, bytearray(n)) for k, n in enumerate([10, 10, 900, 10, 10], 1)], "path string, page_no int, image binary")
    assert [(r.part, r.batch) for r in scans.batched(pages, 4, 20, 1000).orderBy("page_no").collect()] == [(0, 0), (0, 0), (0, 1), (0, 2), (1, 0)]


def test_cases(spark, tmp_path):
    class Broken(providers.RuleChat):
        def complete(self, messages, **options):
            raise OSError("down")

    md = "# One\ntext of it\n## Two\nmore text"
    c = spark.createDataFrame([(1, md, md, None), (2, None, "", "unreadable")], "case_id long, text string, gold string, error string")
    chats = {"rules": providers.RuleChat(), "broken": Broken()}
    results, sections = cases.run_cases(c, chats, ["other"], ["default"], attempts=2, wait=0, ledger=Ledger(spark, f"file://{tmp_path}/calls"))
    got = {(r.case_id, r.chat_provider): r for r in results.collect()}
    ok = got[1, "rules"]
    assert (ok.error, ok.num_pred_sections, ok.num_hallucinated, ok.genre, ok.section_labels) == (None, 2, 0, "academic_article", ["One", "Two"])
    assert ok.cost_usd > 0 and ok.latency_s >= 0 and ok.run_at is not None
    assert got[1, "broken"].error == "down" and got[1, "broken"].gold_token_f1 is None and got[2, "rules"].error == "unreadable"
    dumps = {r.rel_path: r.content for r in cases.run_dumps(c, results, sections).collect()}
    assert dumps == {"1/rules_other_default_raw.md": md, "1/rules_other_default_structured.md": "## One\n\ntext of it\n\n## Two\n\nmore text"}


def told_rows(df, path):
    """``df`` that notes each of its rows whenever it is made."""

    def run(batches):
        for b in batches:
            with open(path, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)


def test_cases_are_read_once(spark, tmp_path):
    """F1: neither prompts nor scores make the texts of the cases again."""
    md = "# One\ntext of it\n## Two\nmore text"
    c = spark.createDataFrame([(1, md, md, None), (2, md, "", None)], "case_id long, text string, gold string, error string")
    results, sections = cases.run_cases(told_rows(c, tmp_path / "told"), {"rules": providers.RuleChat()}, ["m", "n"], ["default", "strict"], wait=0, ledger=Ledger(spark, f"file://{tmp_path}/calls"))
    assert results.where("error is null and num_pred_sections = 2").count() == 8 and sections.count() == 16
    assert (tmp_path / "told").read_text() == "xx"


def test_library_json(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"ord":1,"key":"K","data":{"title":"T","date":"1999-01","creators":[{"lastName":"Ann"},{}]}}')
    (tmp_path / "c.json").write_text('{"ord":1,"parent":"K","key":"c","url":"file:///x/a.pdf","data":{"contentType":"application/pdf"}}\n{"ord":2,"parent":"K","key":"n","data":{"itemType":"note","note":"parsed-md:"}}')
    r = names.library_candidates(*files.library_json(spark, str(tmp_path / "i.json"), str(tmp_path / "c.json"))).first()
    assert (r.item_key, r.pdf_path, r.authors, r.year, r.already_parsed) == ("K", "/x/a.pdf", "Ann", 1999, True)


def test_collections(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"key":"2","data":{"name":"beta"}}\n{"key":"1","data":{"name":"Alpha"}}\n{"key":"3"}')
    c = files.library_collections(spark, str(tmp_path / "c.json"))
    assert [r.name for r in c.collect()] == ["", "Alpha", "beta"]
    assert files.find_collection(c, " ALPHA ").first().key == "1" and files.find_collection(c, "x").count() == 0
    for n in ("b.md", "a.md", "c.md"):
        (tmp_path / n).write_text(n)
    assert [r.filename for r in files.first_files(files.listed(spark, str(tmp_path)), 2).collect()] == ["a.md", "b.md"]


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    one = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    one.write.parquet(str(src))
    for _ in range(2):
        incremental.ingest(spark, str(src), str(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 1
    one.withColumn("doc_id", F.lit(2).cast("long")).write.mode("append").parquet(str(src))
    incremental.ingest(spark, str(src), str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(out)).collect()) == [1, 2]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.event_counts(events).agg(F.sum("n")).first()[0] == events.count()


def recorder(path):
    """(note a line from any process, the lines so far), as closures that workers need no module for."""

    def note(what):
        fd = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT)
        os.write(fd, f"{what}\n".encode())
        os.close(fd)

    def told():
        return path.read_text().split("\n")[:-1] if path.exists() else []

    return note, told


def test_ledger(spark, tmp_path):
    broken, (note, told) = tmp_path / "broken", recorder(tmp_path / "log")
    asked = spark.createDataFrame([(k, "p", "m", None if k == 9 else f"q{k % 4}") for k in range(10)], "id long, provider string, model string, query string").repartition(3)
    broken.touch()

    def call(provider, model, parts):
        q = parts["query"]
        if q == "q3" and broken.exists():
            raise OSError("down")
        note(q)
        return q.upper()

    book = Ledger(spark, f"file://{tmp_path}/calls")
    first = book.ask(asked, ["id"], ["query"], call, attempts=2, wait=0)
    got = {r.id: (r.reply, r.error) for r in first.collect()}
    assert got == {k: (None, None) if k == 9 else (None, "down") if k % 4 == 3 else (f"Q{k % 4}", None) for k in range(10)}
    assert first.count() == 10 and first.where("reply is not null").count() == 7  # further actions
    broken.unlink()
    again = {r.id: r.reply for r in Ledger(spark, f"file://{tmp_path}/calls").ask(asked, ["id"], ["query"], call, wait=0).collect()}
    assert again == {k: None if k == 9 else f"Q{k % 4}" for k in range(10)}
    assert sorted(told()) == ["q0", "q1", "q2", "q3"]
    assert book.replies().count() == 4 and not list((tmp_path / "calls/journal").rglob("*.json"))
    other = asked.withColumn("model", F.lit("n"))
    book.ask(other, ["id"], ["query"], call, wait=0)
    assert len(told()) == 8  # another model is another request
    names = spark.range(1).select(digest(F.lit("a"), F.lit("b"), F.lit("c")).alias("x"), digest(F.lit("ab"), F.lit(""), F.lit("c")).alias("y"), digest(F.lit("a"), F.lit("b"), F.lit(None).cast("string")).alias("z")).first()
    assert len(set(names)) == 3


def test_ledger_after_a_failed_task(spark, tmp_path):
    """A task that dies half way pays for no call again."""
    dead, (note, told) = tmp_path / "dead", recorder(tmp_path / "log")
    asked = spark.createDataFrame([(k, "p", "m", f"q{k}") for k in range(6)], "id long, provider string, model string, query string").coalesce(1)

    def call(provider, model, parts):
        if len(told()) == 4 and not dead.exists():
            dead.touch()
            os._exit(1)
        note(parts["query"])
        return parts["query"]

    book = Ledger(spark, f"file://{tmp_path}/calls")
    with pytest.raises(Exception, match="crashed|exited|EOF"):
        book.ask(asked, ["id"], ["query"], call, wait=0)
    assert len(told()) == 4 and book.replies().count() == 0
    book.ask(asked.where(F.col("query") == told()[0]), ["id"], ["query"], call, wait=0)  # asks for one of them; the others' replies stay in the journal
    assert len(told()) == 4 and book.replies().count() == 1
    assert book.ask(asked, ["id"], ["query"], call, wait=0).where("reply = concat('q', id)").count() == 6
    assert sorted(told()) == [f"q{k}" for k in range(6)]


def test_each_request_is_paid_once(spark, tmp_path):
    note, told = recorder(tmp_path / "log")

    class Pages(scans.FormFeedPages):
        def render(self, filename, content):
            note("render")
            return super().render(filename, content)

    class Vision(scans.EchoVision):
        def transcribe(self, images, prompt):
            note("vision")
            return super().transcribe(images, prompt)

    class Chat(providers.RuleChat):
        def complete(self, messages, **options):
            note("chat")
            return super().complete(messages, **options)

    f = spark.createDataFrame([("a", "n.pdf", bytearray(b"p1\fp2\fp3"))], "path string, filename string, content binary")
    out = scans.transcribed(f, Pages(), Vision(), pages_per_call=2, wait=0, ledger=Ledger(spark, f"file://{tmp_path}/scans"))
    assert out.first().text == "p1\n\n---\n\np2\n\n---\n\np3" and out.where("error is not null").count() == 0
    assert sorted(told()) == ["render", "vision", "vision"]
    md = "# One\ntext of it\n## Two\nmore text"
    c = spark.createDataFrame([(1, md, md, None), (2, md, "", None)], "case_id long, text string, gold string, error string")
    results, sections = cases.run_cases(c, {"rules": Chat()}, ["m"], ["default"], wait=0, ledger=Ledger(spark, f"file://{tmp_path}/cases"))
    assert results.count() == 2 and results.where("error is null").count() == 2 and sections.count() == 4 and cases.run_dumps(c, results, sections).count() == 4
    assert told().count("chat") == 2  # the survey and the plan, which both cases share


def test_progress(spark, tmp_path):
    """Counts of a batch and of a stream come from the jobs that do the work."""
    rows = spark.createDataFrame([(1, None, 2.5), (2, "bad", 0.5), (3, None, None)], "id long, error string, cost double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "one write")
    out, counted = progress.run_counted(rows, "run", cost=F.sum("cost"))
    jobs = len(tracker.getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("plain", "the same write")
    progress.kept(rows, "plain")
    assert jobs == len(tracker.getJobIdsForGroup("plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counted == {"total": 3, "done": 2, "failed": 1, "cost": 3.0} and out.count() == 3
    assert progress.run_counted(rows.limit(0), "none")[1] == {"total": 0, "done": 0, "failed": 0}
    assert progress.as_row(spark, "run", counted).first().asDict() == {"name": "run", **counted}
    listener = progress.StreamCounts("counts")
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")).observe("counts", *progress.counts())
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if listener.ended(q.runId):
                break
            time.sleep(0.1)
        got = listener.of(q.runId)
        assert {k: got[k] for k in ("rows", "total", "done", "failed")} == {"rows": 9, "total": 9, "done": 6, "failed": 3} and got["batches"] >= 2
    finally:
        spark.streams.removeListener(listener)


def test_remembered_choice(spark, tmp_path):
    """A choice holds until its limit, over a restart; ties, late rows, null keys and null times."""
    schema = "user_id long, ts timestamp, event_id long, c string"
    day = lambda d, h=0: datetime(2024, 1, d, h)
    batches = [
        [(1, day(1), 1, "a"), (1, day(2), 2, None), (2, day(1), 3, None), (None, day(1), 4, "n"), (None, day(2), 5, None)],
        [(1, day(3), 6, None), (1, day(3, 1), 7, None), (1, None, 8, "x"), (2, day(4), 10, "q"), (2, day(4), 9, None), (2, day(4), 11, None)],
        [(2, day(3, 23), 12, None), (2, day(6), 13, None), (2, day(6, 1), 14, None), (1, day(9), 15, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        last = choices.remember_new(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), "c", late="3 days")
    got = {r.ord: r.remembered for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: "n", 5: "n", 6: "a", 7: None, 9: None, 10: "q", 11: "q", 12: None, 13: "q", 14: None, 15: None}
    assert last.stateOperators[0].operatorName == "transformWithStateInPySparkExec" or "transformWithState" in last.stateOperators[0].operatorName


def test_filter_of_finished(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', id % 1500) AS source").union(spark.sql("SELECT CAST(-1 AS long), CAST(NULL AS string)"))
    done = spark.range(0, 3000, 3).selectExpr("concat('s', id) AS source").union(spark.sql("SELECT CAST(NULL AS string)"))
    want = docs.join(done.select("source").distinct(), "source", "left_anti").select("doc_id", "source")
    got = fresh.pending_filtered(docs, done)
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    assert sorted(fresh.pending_filtered(docs, done, n_done=1).collect(), key=repr) == sorted(want.collect(), key=repr)  # a full filter
    assert fresh.pending_filtered(docs, done.limit(0)).count() == 4001
    bits = fresh.bits_for(1001)
    maybe = fresh.split_by_filter(docs, fresh.done_filter(done, bits), bits).where("maybe_done")
    n = docs.join(done, "source", "left_semi").count()
    assert n <= maybe.count() < n + 100 and maybe.where("source is null").count() == 0
    plan = got._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "BroadcastHashJoin" in physical.split("SortMergeJoin")[0] or "BroadcastExchange" in physical
    for k in range(2):
        docs.where(f"pmod(doc_id, 2) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        fresh.ingest_pending(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "done"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    first = docs.where("doc_id % 2 = 0")
    second = docs.where("doc_id % 2 <> 0").join(first.select("source").distinct(), "source", "left_anti").select("doc_id", "source")
    assert sorted(out.collect(), key=repr) == sorted(first.union(second).collect(), key=repr)


def test_vault_is_all_or_none(spark, tmp_path):
    from folioforge.sources.vault import registered

    def left():
        return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*"))

    registered(spark)
    root = f"file://{tmp_path}"
    good = spark.range(40).selectExpr("concat('S/', id, '.md') AS rel_path", "encode(concat('é', id), 'utf-8') AS content", "id AS more").repartition(4)
    bad = good.unionByName(spark.sql("SELECT '../x' AS rel_path, X'00' AS content, 1L AS more"))
    with pytest.raises(Exception, match="leaves the vault"):
        bad.write.format("vault").mode("append").save(root)
    assert left() == []  # what other tasks had written is gone
    ends = good.select(F.when(F.col("more") == 39, F.raise_error(F.lit("late"))).otherwise(F.col("rel_path")).alias("rel_path"), "content")
    with pytest.raises(Exception, match="late"):
        ends.write.format("vault").mode("append").save(root)
    with pytest.raises(Exception, match="written twice"):
        good.union(good).write.format("vault").mode("append").save(root)
    with pytest.raises(Exception, match="needs the columns"):
        spark.range(1).write.format("vault").mode("append").save(root)
    with pytest.raises(Exception, match="mode append"):
        good.write.format("vault").mode("overwrite").save(root)
    assert left() == []
    good.write.format("vault").mode("append").option("folders", "notes,z").save(root)
    assert left() == sorted(["S", "S/notes", "S/z", *(f"S/{k}.md" for k in range(40))]) and (tmp_path / "S/7.md").read_text() == "é7"


def test_paged_reader(spark, tmp_path):
    items = [{"key": f"k{k}", "n": k, "data": {"title": f"T{k}", "tags": ["a", None, k]}, "w": k / 2} if k % 3 else {"n": str(k), "data": None, "key": k} for k in range(95)]
    for start in range(0, 95, 10):
        (tmp_path / f"p{start}-10.json").write_text(json.dumps({"total": 95, "results": items[start : start + 10]}))
    (tmp_path / "one.json").write_text("\n".join(json.dumps(x) for x in items))
    schema = "w double, key string, data struct<tags: array<string>, title: string>, n long, none date"
    got = files.paged(spark, f"file://{tmp_path}/p{{start}}-{{limit}}.json", schema, limit=10, tasks=4)
    assert got.rdd.getNumPartitions() == 4
    want = spark.read.schema(schema.replace("n long", "n string")).json(str(tmp_path / "one.json"))
    want = want.withColumn("n", F.when(F.col("data").isNotNull(), F.col("n").cast("long")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    (tmp_path / "q0.json").write_text("[]")
    assert files.paged(spark, f"file://{tmp_path}/q{{start}}.json", schema).count() == 0
    with pytest.raises(Exception, match="schema"):
        spark.read.format("paged_json").option("path", "x").load()


def test_report_files(spark, tmp_path):
    from folioforge.operators import evaluate

    rows = [(c, k, "p", "m", "v", "g" if k else None, None if k == 2 else 0.5, 3, 2, k, c, 0.1, 0.0, "bad" if k == 2 else None) for c in range(40) for k in range(3)]
    schema = "case_id long, ord int, chat_provider string, model string, prompt_variant string, genre string, gold_token_f1 double, num_gold_sections int, num_pred_sections int, num_unlabeled int, num_hallucinated int, cost_usd double, latency_s double, error string"
    runs = spark.createDataFrame(rows, schema)
    evaluate.write_report(evaluate.report_lines(runs, evaluate.best_runs(runs)).repartition(5), str(tmp_path / "r"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))).split("\n")
    assert got[:6] == evaluate.REPORT_HEAD and got[6] == "| 0 | p | m | v | None | 0.5 | 3 | 2 | 0 | 0 | 0.1 | 0.0 | — |"
    assert got[8] == "| 0 | p | m | v | g | — | 3 | 2 | 2 | 0 | 0.1 | 0.0 | bad |"
    assert got[126:129] == evaluate.REPORT_BEST and got[129] == "- **0**: `p/m/v` — hallucinated=0, unlabeled=0, goldF1=0.5" and len(got) == 6 + 120 + 3 + 40 + 1
