"""Corpus operators against brute force, libraries and hand-made cases."""

import base64
import collections
import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import boost, bpe, common, decontam, htmltext, neardup, pii, queries, substrdup, tokencount, toxicity, vecdup, warc
from folioforge.llm.common import new_path
from folioforge.llm.components import components

DATA = "/root/testdata/sf0.001"
LONG = "word " * 30000
TEXTS = [(1, "a b c d e f"), (2, "A b  c d E f"), (3, None), (4, ""), (5, " \n "), (None, "a b c d e f"), (6, "x y"), (7, "X Y"), (7, "X Y"), (8, LONG), (9, "é ü 日本 \x1c z"), (10, "1 " * 400)]


@pytest.fixture(scope="module")
def texts(spark):
    # clashing extra columns are ignored
    return spark.createDataFrame([(i, t, 1, "z", 2) for i, t in TEXTS], "doc_id long, text string, id int, v string, n int")


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    g = Groups()
    for a, b in edges:
        g.join(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {n: g.find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(df.limit(0)).count() == 0


def test_common(spark):
    """Names that are free, settings of the session that stay, tables that go."""
    assert common.fresh("a", ["A", "_a"]) == "__a" and common.fresh("b", ["a"]) == "b"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "77")
    common.bounded_batches(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)
    common.bounded_batches(spark)
    assert spark.conf.get(key) == "500"
    t = common.written(spark.range(3), "three")
    assert t.count() == 3 and t._folioforge_path.startswith(common.own_dir(spark))
    common.drop_written(t)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        spark.read.parquet(t._folioforge_path)


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_brute(rows, num, den):
    g, sets = Groups(), {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                i = len(x & y)
                if i * den >= num * (len(x) + len(y) - i):
                    g.join(a, b)
    return {i: (len(sets[i]), g.find(i)) for i in ids}


def test_near_duplicates(spark, texts):
    rnd = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    for k in range(150):  # a large group of near copies around one text, longer than a whole list
        w = list(base)
        for j in rnd.integers(0, 120, int(rnd.integers(0, 6))):
            w[j] = f"x{rnd.integers(0, 10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (85, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, num=num).collect()}
        assert got == near_brute(rows, num, 100)
    r = {(x.doc_id, x.kept) for x in neardup.near_duplicates(texts).collect()}
    assert {(1, True), (2, False), (3, True), (4, True), (6, True), (7, False), (None, True)} <= r
    assert neardup.near_duplicates(texts.limit(0)).count() == 0


def test_near_templates(spark):
    """Long lists whose members fall just short of the threshold, and some that reach it."""
    rnd = np.random.default_rng(6)
    head = [f"t{i}" for i in range(54)]
    rows = [(i, " ".join([*head, *(f"own{i}x{k}" for k in range(5))])) for i in range(120)]  # 50 of 55 shingles shared
    rows += [(200 + i, " ".join([*head, *(f"some{i}x{k}" for k in range(int(rnd.integers(1, 8))))])) for i in range(60)]
    rows += [(300 + i, " ".join([*(f"pre{rnd.integers(0, 9)}" for _ in range(3)), *head, f"p{rnd.integers(0, 6)}", f"q{rnd.integers(0, 6)}"])) for i in range(80)]
    rows += [(400 + i, rows[130][1]) for i in range(50)]  # exact copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == near_brute(rows, 85, 100)


def repeats_brute(rows, n=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        cover = bytearray(len(w))
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if seen.setdefault(x, (i, k)) != (i, k):
                cover[k : k + n] = b"\1" * n
        out[i] = len(w), sum(cover), b" ".join(x for x, c in zip(w, cover, strict=True) if not c).decode()
    return out


def test_substrings(spark, texts):
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrdup.remove_repeats(docs(spark)).collect()}
    assert got == repeats_brute(rows)
    out = substrdup.remove_repeats(texts).collect()
    assert len(out) == len(TEXTS)
    by = {r.doc_id: r for r in out}
    assert by[8].n_words == 30000 and by[3].n_words == 0
    assert by[8].n_removed == repeats_brute([(8, LONG)])[8][1] and by[10].n_removed == repeats_brute([(10, "1 " * 400)])[10][1]
    for p, d in substrdup.COVERS.items():  # every two offsets meet in the cover
        assert all(any((i + s) % p in d and (j + s) % p in d for s in range(p)) for i in range(p) for j in range(p))
    assert substrdup.remove_repeats(texts.limit(0)).count() == 0


def test_substring_hashes():
    """Windows that agree in one of their hashes only are not equal; those that agree in both are."""
    import pyarrow as pa

    def starts(second):
        texts = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a", "b", "c"])], names=["id", "text"])
        pick = lambda flat, ends, first, _: (np.full(3, 7, np.uint64), np.array(second, np.uint64), np.arange(3), np.zeros(3, int))
        packed = list(substrdup._settled(iter([texts]), pick, 1, False))
        found = list(substrdup._gathered(substrdup._resolved(False, 1)(iter(packed))))
        return sorted(i for b in found for i in b.column(0).to_pylist())

    assert starts([1, 2, 3]) == [] and starts([1, 2, 1]) == [3] and starts([5, 5, 5]) == [2, 3]


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    path = queries.word_vocabulary()
    t = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(50, "Hello  wörld's İst ΣΑΣ é <|endoftext|>foo 123 日本語 ́x\x1c"), (51, "a" * 4000)], "doc_id long, text string")
    df = docs(spark).select("doc_id", "text").union(texts.select("doc_id", "text")).union(odd)
    want = collections.Counter()
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False))] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode(df, path).collect())
    assert got == want
    assert bpe.encode(texts.limit(0), path).count() == 0
    ids = [(1, t.encode("Hello wörld", add_special_tokens=False).ids), (1, []), (2, None), (3, [10**6, 5])]
    back = collections.Counter((r.doc_id, r.decoded) for r in bpe.decode(spark.createDataFrame(ids, "doc_id long, ids array<int>"), path).collect())
    assert back == collections.Counter([(1, t.decode(ids[0][1], skip_special_tokens=False)), (1, ""), (2, ""), (3, t.id_to_token(5))])


def test_vectors(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for k in range(300):
        c = rnd.normal(size=8) if k % 3 != 1 else np.array(rows[-1][1], float) + rnd.normal(size=8) * 0.12
        rows.append((k, [float(np.float32(x)) for x in c], int(k // 3 % 2)))
    rows += [(400, rows[5][1], rows[5][2]), (401, [0.0] * 8, 1), (402, None, 1), (403, [float("nan")] * 8, 0), (404, rows[5][1], None), (None, rows[5][1], 1), (405, [1e30] * 8, 1), (406, [1e-30] * 8, 1), (407, [], 1), (408, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    g, n = Groups(), collections.Counter()
    sound = [(i, np.array(v, float) / max(abs(x) for x in v), y) for i, v, y in rows if i is not None and v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    for k, (a, x, la) in enumerate(sound):
        for b, y, lb in sound[:k]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                g.join(a, b)
                n[a] += 1
                n[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdup.similar_vectors(df).collect()}
    assert got == {r[0]: (n[r[0]], g.find(r[0])) if r[0] is not None else (0, None) for r in rows}
    assert vecdup.similar_vectors(df.limit(0)).count() == 0
    old = vecdup.TILE
    try:
        for tile in (20, 3):  # cells cut along several axes, and tiles of one cell
            vecdup.TILE = tile
            assert {r.vec_id: (r.n_links, r.component_id) for r in vecdup.similar_vectors(df).collect()} == got
    finally:
        vecdup.TILE = old


def test_vector_leaves(spark):
    """A cell is cut no further than to the size of a tile, and what is larger gets more tiles."""
    rows = [(1, 0, c, [0.0]) for c, n in (([0, 0, 0, 0], 2), ([1, 0, 0, 0], vecdup.TILE // 2), ([1, 1, 0, 0], vecdup.TILE), ([2, 0, 0, 0], 2 * vecdup.TILE + 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "label int, d int, cell array<int>, lead array<double>")
    got = {tuple(r.cell): (r.leaf, r.tiles) for r in vecdup._leaves(df).collect()}
    assert got == {(0, 0, 0, 0): ([0], 1), (1, 0, 0, 0): ([1, 0], 1), (1, 1, 0, 0): ([1, 1], 1), (2, 0, 0, 0): ([2, 0, 0, 0], 3)}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_pii(spark, texts):
    hard = ["a@b.c_d@e.f g@h..i x@y.z@w.v", "é +1 (343) 555-6666 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 4111 1111 1111 1111", "1 " * 3000, "+1" + " " * 3000, "a." * 4000 + "@b.c", "1." * 3000, "@" * 1000, "9" * 4000, "😀 4111-1111-1111-1111 foo@bar.com"]
    df = docs(spark).select("doc_id", "text").union(texts.select("doc_id", "text")).union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    for r in pii.find_pii(df, keep=("text",)).withColumn("red", pii.redacted(F.col("text"), F.col("base"))).collect():
        want = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, r.text or "") if pii_ok(k, m.group())]
        assert [tuple(x) for x in r.base] == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in PII]
        assert {tuple(x) for x in r.spans} >= set(want)
        assert not any(r.text[s:e] in r.red for k, s, e in want if k == "email")
    one = spark.createDataFrame([(1, "mail a@b.co, ip 1.2.3.4!")], "doc_id long, text string")
    assert pii.find_pii(one, keep=("text",), models={}).select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).first().t == "mail [EMAIL], ip [IP]!"
    assert pii.find_pii(texts.limit(0)).count() == 0


def test_pii_candidates(spark):
    """Trees add what the strict patterns miss, in a sample where format and context tell."""
    rows = [(i, f"call phone +1 (343) 555-{i:04d} now, version 7.{i}.2") for i in range(200)] + [(1000 + i, f"order number 12 345-{i:04d} of them") for i in range(200)]
    df = spark.createDataFrame([*rows, (5000, "phone +1/343/555/1234 ok")], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.find_pii(df).collect()}
    assert all(len(r[i].base) == 1 for i in range(200)) and not r[1005].spans
    assert not r[5000].base and [tuple(x) for x in r[5000].spans] == [("phone", 6, 21)]
    # on sample tables the method adds spans, and keeps those of the base
    out = pii.find_pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    n = out.agg(F.sum(F.size("base")).alias("base"), F.sum(F.size("spans")).alias("spans"), F.sum(F.size(F.array_except("base", "spans"))).alias("lost")).first()
    assert n.spans > n.base > 0 and n.lost == 0
    print("base", n.base, "added", n.spans - n.base)


def test_pii_added(spark):
    """What no base pattern finds enters the spans, by rule from a few documents and by trees from many."""
    added = [
        ("pay 4111 1111 1111 1111 5500 0000 0000 0004 now", [("card", 4, 23), ("card", 24, 43)]),
        ("pay 4111111111111111 5500000000000004 now", [("card", 4, 20), ("card", 21, 37)]),
        ("card 4111.1111.1111.1111 ok", [("card", 5, 24)]),
        ("write to ann (at) site (dot) org soon", [("email", 9, 32)]),
        ("host 10[.]20[.]30[.]40 up", [("ip", 5, 22)]),
        ("phone +1/343/555/1234 ok", [("phone", 6, 21)]),
        ("at 343-555-1234 daily", [("phone", 3, 15)]),
        ("pay 4111.1111.1111.1112, look @ this. Then 300[.]1[.]1[.]1, order 12 345-0005", []),
    ]
    few = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(added)], "doc_id long, text string")
    plain = [f"card 4111-1111-1111-{i:04d}, mail u{i} (at) site{i}.org, see @ that. Yes, host 10[.]1[.]{i % 400}[.]7, phone +1/343/555/{i:04d}, order 12 345-{i:04d}" for i in range(400)]
    many = few.union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(plain)], "doc_id long, text string"))
    models = pii.fitted(many.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")))
    assert all(trees for trees, _ in models.values()), models
    for df, m in ((few, None), (many, models)):
        got = {r.doc_id: r for r in pii.find_pii(df, models=m).collect()}
        for i, (t, want) in enumerate(added):
            assert not got[i].base and [tuple(x) for x in got[i].spans] == want, (t, got[i], m)


def test_boost(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int")
    trees = boost.fit(df)
    p = boost.as_numpy(trees, x)
    q = [r.p for r in df.select(boost.as_sql(trees, [F.col("x")[i] for i in range(3)]).alias("p")).collect()]
    assert ((p > 0.5) == y).mean() > 0.97 and np.allclose(p, q)
    assert boost.fit(df.where("y = 0")) is None


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=/x>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<p><b>three<br>four</p><script>x('</p>')</script><div class=comments><p>nice</p></div></article><aside>side</aside><footer>&copy; f"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()] + [(900, "u", page), (901, None, None), (902, "u", ""), (None, "u", "<p>x"), (903, "u", "<div>" * 3000 + "deep"), (904, "u", "<p " + "a" * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in htmltext.main_text(df).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows[:-6]:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", h, re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"<[a-zA-Z/][^>]*\Z", "", body))
        want = "\n".join(b for b in (" ".join(html.unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", b))).split()) for b in blocks) if b)
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[900].text == "A & B\none two\nthree four"
    assert got[901].text == got[902].text == "" and got[901].n_chars == 0
    assert htmltext.main_text(df.limit(0)).count() == 0
    p = htmltext.Page(page)
    rnd = np.random.default_rng(0)
    for _ in range(20):  # no kept node under a dropped one
        kept = p.decoded(rnd.random(len(p.tag)).tolist())
        assert all(kept[p.parent[k]] for k in range(1, len(kept)) if kept[k])


def test_html_marks(spark):
    """Attributes are read as attributes, and a head or an element without end tag loses no page."""
    body = "<article><h1>A title of it</h1><p>One long sentence here, with words, and more of them.</p>%s<p>Another long sentence, with words again, and an end.</p></article>"
    want = "A title of it\nOne long sentence here, with words, and more of them.\n%sAnother long sentence, with words again, and an end."
    kept = "<p%s>Some text that is seen by all readers, as it should be.</p>"
    cases = [
        ("<html><head><title>t</title><meta charset=utf-8><body>" + body % "", want % ""),
        ("<head><style>p {}</style><script>x</script></head>" + body % "", want % ""),
        *((body % (kept % a), want % "Some text that is seen by all readers, as it should be.\n") for a in (' aria-hidden="false"', ' class="overflow-hidden"', ' data-title="hidden gems"', " style='color: red; x: hidden'", " title='display: none'")),
        *((body % (kept % a), want % "") for a in (" hidden", ' HIDDEN=""', " aria-hidden=TRUE", " style='color: red; display : none'", " hidden=until-found")),
        (body % "<svg/><svg><text>drawn</text></svg><object>" + "<select>", want % ""),
        (body % "<!-- a comment <p>no</p> --><template><p>no</p></template><SVG><p>no</svg >", want % ""),
    ]
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    trees = htmltext.fit_on(pages)
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(df, trees=trees).collect()}
    for i, (h, t) in enumerate(cases):
        assert got[i] == t, h
    # pages that mark nothing: the article's tags renamed, as trees alone tell it apart
    plain = pages.withColumn("html", F.regexp_replace("html", r"(?i)(</?)(?:article|main)\b", "$1div"))
    assert not plain.where(F.col("html").rlike("(?i)<(article|main)")).count()
    a = {r.page_id: r.text for r in htmltext.main_text(pages, trees=trees).collect()}
    b = {r.page_id: r.text for r in htmltext.main_text(plain, trees=trees).collect()}
    assert sum(a[i] == b[i] for i in a) >= 0.95 * len(a)
    # a page of many megabytes, and many elements without end
    long = "<article>" + "<p>One long sentence here, with words, and more of them.</p>" * 60_000 + "<select><object>" * 20_000
    r = htmltext.main_text(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string"), trees=trees).first()
    assert r.text.count("\n") == 59_999


def test_warc(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    rows += [(700, "u\r\nX: y", rows[3][2]), (701, None, None), (702, "u", ""), (703, "u", "x" * (1 << 24)), (704, "u", "x" * (1 << 24)), (None, "u", "alone"), (705, "é", "ü")]
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    got = {r.row_id: r for r in warc.read_warc(spark, path).collect()}
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        again = i is not None and first[h or ""] != i
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", first[h or ""]) if again else ("response", None))
        assert again or bytes(r.payload) == data
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert sum(1 for f in files for _ in warc.records(f, chunk=100)) == len(rows)
    whole = zlib.decompressobj(31)
    assert whole.decompress(files[0]).startswith(b"WARC/1.1\r\n") and whole.eof
    with pytest.raises(ValueError):
        list(warc.records(files[0][:-30]))
    many = new_path(spark, "warc")  # files are bounded by bytes, large pages in files of their own
    old, warc.FILE_BYTES = warc.FILE_BYTES, 100_000
    try:
        sizes = [10] * 50 + [30_000] * 7 + [200_000]
        warc.write_warc(spark.createDataFrame([(i, "u", str(i) + "x" * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1), many, suffix=True, level=0)
    finally:
        warc.FILE_BYTES = old
    files = [(r.path, [int(h["content-length"]) for h, _ in warc.records(bytes(r.content))]) for r in spark.read.format("binaryFile").load(many).collect()]
    assert all(p.endswith(".warc.gz") and (sum(n) < 110_000 or len(n) == 1) for p, n in files) and sum(len(n) for _, n in files) == len(sizes)
    assert sorted(r.row_id for r in warc.read_warc(spark, many).collect()) == list(range(len(sizes)))
    empty = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_decontamination(spark, texts):
    b = spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = next(r for r in b.collect() if len(r.text.split()) > 30)
    w = item.text.split()
    edited = [x if k % 9 else "changed" for k, x in enumerate(w)]
    extra = spark.createDataFrame([(9000, "lead in " + item.text.upper() + " and out"), (9001, "q " * 50 + " ".join(edited)), (9002, " ".join(w[: len(w) // 6])), (9003, None), (None, item.text)], "doc_id long, text string")
    out = decontam.contaminated(docs(spark).select("doc_id", "text").union(extra), b).collect()
    got = {(r.doc_id, r.item_id): r.score for r in out}
    assert got[(9000, item.item_id)] == 1.0 and 0.5 < got[(9001, item.item_id)] < 1
    assert not any(d in (9002, 9003, None) for d, _ in got)
    for r in docs(spark).collect():
        for x in b.collect():
            t = x.text.lower().split()
            if len(t) > 4 and f" {' '.join(t)} " in f" {' '.join((r.text or '').lower().split())} ":
                assert got[(r.doc_id, x.item_id)] == 1.0
    assert decontam.smith_waterman(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 7, 3, 4, 9]))[0] == 2 * 4 - 1
    assert decontam.contaminated(texts.limit(0), b).count() == 0 and decontam.contaminated(texts, b.limit(0)).count() == 0
    old, decontam.BLOCK_SEEDS = decontam.BLOCK_SEEDS, 300  # items in several blocks
    try:
        assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs(spark).select("doc_id", "text").union(extra), b).collect()} == got
    finally:
        decontam.BLOCK_SEEDS = old


def test_decontamination_brute(spark):
    """Every document against every item, aligned without seeds: recall at least 0.9, and nothing else is found."""
    b = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rnd = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    for k, (_, t) in enumerate(b):  # edited copies: words changed, dropped and added
        w = t.split()
        for share in (0.05, 0.1, 0.2, 0.3):
            x = [y for v in w for y in ([v], [f"new{k}"], [], [v, "more"])[0 if rnd.random() >= share else int(rnd.integers(1, 4))]]
            rows.append((10_000 + len(rows), "lead in text here " + " ".join(x) + " and some end"))
    number: dict = {}
    code = lambda t: np.array([number.setdefault(x, len(number)) for x in (t or "").lower().split()], np.int32)
    items = {i: code(t) for i, t in b}
    want = {}
    for d, t in rows:
        own = code(t)
        for i, x in items.items():
            if len(x) >= 3 and np.isin(x, own).sum() >= 0.5 * len(x):  # else the score cannot reach a half
                score = decontam.smith_waterman(x, own)[0] / (2 * len(x))
                if score >= 0.5:
                    want[d, i] = score
    out = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.score for r in out}
    assert len(want) > 100 and set(got) <= set(want) and all(got[k] <= want[k] for k in got)
    assert len(got) >= 0.9 * len(want), (len(got), len(want))
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)


def test_decontamination_templates(spark):
    """Items and documents of one template: a seed that all of them share costs no join."""
    head = "consider the following question and choose the best of the answers below for the case of"
    items = spark.createDataFrame([(i, f"{head} item{i} alpha{i} beta{i} gamma{i}") for i in range(300)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"{head} item{i} alpha{i} beta{i} gamma{i}") for i in range(0, 300, 10)] + [(1000 + i, "nothing of the kind here") for i in range(50)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, items).collect()}
    assert all(got[i, i] == 1.0 for i in range(0, 300, 10)) and not any(d >= 1000 for d, _ in got)


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = docs(spark).select("doc_id", "text").union(texts.select(F.col("doc_id") + 5000, "text")).union(spark.createDataFrame([(6000, "\n\nü é\n日本 <|endoftext|>\n"), (6001, "no end"), (6002, "a\n" + "\n" * 3000 + "b" + " " * 3000)], "doc_id long, text string"))
    got = collections.defaultdict(list)
    for r in tokencount.count_tokens(df, queries.byte_vocabulary()).collect():
        got[r.doc_id].append((r.section, r.char_start, r.char_end, r.n_tokens))
    for r in df.collect():
        if r.doc_id in (5007, None):
            continue
        at, want = 0, []
        for k, line in enumerate(re.findall(r"[^\n]*\n|[^\n]+$", r.text or "")):
            want.append([k, at, at + len(line), 0])
            at += len(line)
        for a, _ in t.encode(r.text or "", add_special_tokens=False).offsets:
            next(w for w in want if w[1] <= a < w[2])[3] += 1
        assert sorted(got.get(r.doc_id, [])) == [tuple(w) for w in want]
    two = spark.createDataFrame([(1, "ab", "cd ef")], "doc_id long, a string, b string")
    r = tokencount.count_tokens(two, queries.byte_vocabulary(), text_cols=("a", "b")).orderBy("section").collect()
    assert [(x.field, x.char_start, x.char_end) for x in r] == [(0, 0, 2), (1, 2, 7)]
    assert list(tokencount.attributed(np.array([3, 10]), np.array([2, 4, 10]), "most")) == [0, 2]
    assert list(tokencount.attributed(np.array([3, 10]), np.array([2, 4, 10]), "first")) == [0, 1]
    assert tokencount.count_tokens(texts.limit(0), queries.byte_vocabulary()).count() == 0


def test_token_ids():
    """Long runs of one character: the library's ids, and no stack overflow."""
    with open(queries.byte_vocabulary(), "rb") as f:
        encoding, size = tokencount.encoder(f.read())
    rnd = np.random.default_rng(3)
    spaces = [" ", "\n", "\t", "\r", "\x85", "\xa0", "\u2003", "\u3000"]
    for k in range(200):  # short runs through the same cut
        run = "".join(rnd.choice(spaces, int(rnd.integers(tokencount.RUN, tokencount.RUN + 40))))
        text = str(rnd.choice(["", "ab", "1", ".", "ab\x1c", "'s"])) + run + str(rnd.choice(["", "cd", "2 3", "..", "\x1cx", "'s", "é"])) + str(rnd.choice(["", run, " x"]))
        assert tokencount.token_ids(encoding, text) == encoding.encode_ordinary(text)
    for c, n in ((" ", 1), ("\n", 2), ("a", 4), ("é", 1), ("!", 8)):
        for text in (c * 10**6, "x" + c * 10**6 + "y"):
            ids = np.array(tokencount.token_ids(encoding, text))
            assert size[ids].sum() == len(text.encode()) and len(ids) <= 10**6 // n + 3


def test_toxicity(spark, texts):
    path = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = queries.op4_toxicity(spark, path).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and y for p, y in held)
    assert hit / sum(p for p, _ in held) > 0.9 and hit / sum(y for _, y in held) > 0.6
    model = toxicity.fit([b"kind plain words here"] * 3, [0] * 3)
    assert model is None and toxicity.scored(texts, None, keep=("doc_id",)).count() == len(TEXTS)
    good, bad = [f"the day was fine and number {i} came".encode() for i in range(60)], [f"you horrible nitwit number {i} came".encode() for i in range(60)]
    model = toxicity.fit(good + bad, [0] * 60 + [1] * 60)
    assert b"horrible" in model["toxic"] and b"horrible" not in model["ordinary"] and model["toxic"].endswith(model["ordinary"].lstrip(b"\0"))
    s = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame([(1, "the day was fine"), (2, "a horrible nitwit came"), (3, None), (4, "")], "doc_id long, text string"), model, keep=("doc_id",)).collect()}
    assert s[2] > s[1] and s[3] == s[4]


def test_toxicity_counts():
    """All 8000 documents are fitted on; packed counts are those of a Counter, over several merges."""
    assert toxicity.FIT_DOCS == 8000
    texts = [" ".join(f"w{i * j % 9973}xyz" for j in range(600)).encode() for i in range(500)] + [b"", "日本語 text".encode()]
    want = collections.Counter(p for t in texts for p in toxicity._pieces(t))
    keys, n = toxicity._counts(texts)
    assert {k.tobytes()[:6]: int(c) for k, c in zip(keys, n, strict=True)} == want and sum(want.values()) > 1 << 20
    assert toxicity._of((keys, n), toxicity._packed([b"nowhere"[:6]])).tolist() == [0]


def test_toxicity_training():
    """The common part learns from all of a text, its end too, within the bound on bytes."""
    texts = [b" ".join(b"d%dw%d" % (i, j) for j in range(9000)) for i in range(60)]
    got = toxicity._training(texts)
    at = [int(w.split()[0].split(b"w")[1]) for w in got]
    assert 0.9 < sum(map(len, got)) / toxicity.TRAIN_BYTES < 1.1
    assert np.all(np.histogram(at, 10, (0, 9000))[0] > 0.07 * len(at))
    assert toxicity._training(texts[:1]) == toxicity.windows(texts[0])[::2]


def test_pipeline(spark):
    """Every stage against the operator it calls, on its predecessor's rows."""
    d = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, d, DATA).write.parquet(path)
        out = spark.read.parquet(path)
        before, after = {r.doc_id: r.asDict() for r in d.collect()}, {r.doc_id: r.asDict() for r in out.collect()}
        if name != "bpe":
            assert out.dtypes == d.dtypes
        if name == "near_dedup":
            want = near_brute([(i, r["text"]) for i, r in before.items()], 80, 100)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        if name == "decontamination":
            leaks = {r.doc_id for r in decontam.contaminated(d, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - leaks
        if name == "pii":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert not any(re.search(PII["email"], r["text"]) for r in after.values())
        if name == "bpe":
            assert set(after) == set(before) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in after.values())
        d = out
    empty = docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0


def test_pipeline_columns(spark):
    """Columns that stages use inside are kept as they are; null and repeated rows pass."""
    names = ["score", "_score", "spans", "base", "n_email", "text_", "id", "_id", "_text", "pii_spans", "_k0", "v", "kept", "item", "t.x"]
    d = docs(spark).limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names[:-1]}).withColumn("t.x", F.lit("t.x"))
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9002, "mail a@b.co now"), (9002, "mail a@b.co now"), (None, "no id")], "doc_id long, text string")
    d = d.unionByName(odd, allowMissingColumns=True)
    d.write.parquet(path := new_path(spark, "docs"))
    d = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, DATA).write.parquet(path := new_path(spark, "stage"))
        out = spark.read.parquet(path)
        if name == "bpe":
            assert out.count() == d.count()
            break
        assert out.dtypes == d.dtypes
        for r in out.where("doc_id < 9000").collect():
            assert all(r[c] == (c if c == "t.x" else f"{c}{r.doc_id}") for c in names)
        assert out.where("doc_id is null").count() == 1
        d = out
    assert {r.text for r in d.where("doc_id >= 9000").collect()} == {None, "", "mail [EMAIL] now"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    from oracle import connection, same

    same(spark, connection(), queries.QUERIES[name], queries.ORACLES[name])
