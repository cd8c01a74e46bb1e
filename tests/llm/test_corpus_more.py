"""Resampling, conversation trie, suffix arrays and web pages against brute force and hand-made cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from folioforge.llm import boost, convtrie, htmltext, queries, resample, suffixdup, warc

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import connection, same  # noqa: E402

DATA = "/root/testdata/sf0.001"
EDGES = [(1, "a b c d e f"), (2, None), (3, ""), (4, " \n "), (None, "a b c d e f"), (5, "X Y"), (5, "X Y"), (6, "é Ü 日本 \x1c z-9"), (7, "ab " * 30000), (8, "a" * 5000)]


def edge_frame(spark, rows=EDGES):
    # clashing extra columns are ignored
    return spark.createDataFrame([(i, t, 1, "z", 2, 3) for i, t in rows], "doc_id long, text string, id int, score string, rank int, bucket int")


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_conversation_trie", "op13_suffix_array_dedup"])
def test_same_rows_as_sql(spark, name):
    same(spark, connection(), queries.QUERIES[name], queries.ORACLES[name])


def resample_brute(rows, target):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    raw, goal = ([features(t) for _, t in x] for x in (rows, target))
    s, t = (collections.Counter(k for _, f in x for k in f) for x in (raw, goal))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + 10000) / ((s[k] + 1) * (big_t + 10000)))) for k in range(10000)]
    out = []
    for (i, _), (n, f) in zip(rows, raw):
        w = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    ranks = collections.defaultdict(list)
    for r, x in enumerate(able, 1):
        ranks[x].append(r if r <= 25 * len(able) // 100 else None)
    return sorted(((x[0], *x[2:], ranks[x].pop(0) if ranks[x] else None) for x in out), key=repr)


def test_resample(spark):
    rnd = random.Random(5)
    rows = EDGES + [(100 + k, " ".join(rnd.choice(["Red", "blue", "x1", "Ñu", "é"]) for _ in range(rnd.randrange(0, 60)))) for k in range(120)] + [(300, "t " * 25)] * 3
    target = [(1, "blue x1 blue"), (2, None), (3, "É é")]
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = sorted(map(tuple, resample.resampled(edge_frame(spark, rows), goal).collect()), key=repr)
    assert got == resample_brute(rows, target)
    none = goal.limit(0)
    assert sorted(map(tuple, resample.resampled(edge_frame(spark), none).collect()), key=repr) == resample_brute(EDGES, [])
    assert resample.resampled(edge_frame(spark).limit(0), goal).count() == 0


def trie_brute(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest()[:16], r or "", x or ""))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in convs.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    nodes, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(nodes[k]) if len(new[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], ends(k)) for k, m in nodes.items()), key=repr)


def test_trie(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice(["é", "no", None, ""])) for c in range(-12, 60) for t in range(rnd.randrange(0, 6))]
    rows += [(c, None if t == 3 else t, "r", f"same {t}") for c in (70, 75, 80, 81) for t in range(40)]  # a long trunk that several share
    rows += [(90, 1, "r", "x")] * 3 + [(None, 1, "r", "x"), (91, None, None, None), (92, 2, "a", "b"), (92, 2, "b", "a")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string")
    got = sorted(map(tuple, convtrie.prefix_trie(df).collect()), key=repr)
    assert got == trie_brute(rows)
    assert convtrie.prefix_trie(df.limit(0)).count() == 0
    old, convtrie.PIECE = convtrie.PIECE, 3
    try:
        assert sorted(map(tuple, convtrie.prefix_trie(df).collect()), key=repr) == got  # lists of ids in many pieces
    finally:
        convtrie.PIECE = old


def bytes_brute(rows, window):
    starts, out = collections.defaultdict(set), []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            if i is not None:
                starts[b[k : k + window]].add((i, k))
    gone = collections.defaultdict(set)
    for places in starts.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + window))
    for i, t in rows:
        b = (t or "").encode()
        cut = [k in gone[i] for k in range(len(b))] if i is not None else [False] * len(b)
        out.append((i, len(b), sum(cut), sum(c and not (k and cut[k - 1]) for k, c in enumerate(cut)), bytes(x for x, c in zip(b, cut) if not c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdup, "HOT", hot)
    rnd = random.Random(11)
    word = lambda n: " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 9))) for _ in range(n))
    shared = [word(60) for _ in range(3)]
    rows = EDGES + [(20 + k, word(rnd.randrange(0, 80)) + rnd.choice([*shared, ""]) + word(30) + rnd.choice([*shared, ""])) for k in range(60)]
    rows += [(90, word(80)), (91, "x" + shared[0][5:240] + "y"), (92, shared[1][:199]), (93, shared[0] + "|" + shared[0])]
    got = sorted(((*r[:4], bytes(r[4])) for r in suffixdup.remove_repeated_bytes(edge_frame(spark, rows)).collect()), key=repr)
    want = bytes_brute(rows, 200)
    assert got == want
    assert suffixdup.remove_repeated_bytes(edge_frame(spark).limit(0)).count() == 0


def test_suffix_kernels():
    rnd = random.Random(1)
    for _ in range(40):
        texts = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(20, 60))) for _ in range(8)})
        count = collections.Counter(x[i : i + 20] for x in texts for i in range(len(x) - 19))
        assert suffixdup.repeated_starts(texts, 20).tolist() == [count[x[i : i + 20]] > 1 for x in texts for i in range(len(x) - 19)]
        flat = b"".join(texts)
        a = np.frombuffer(flat, np.uint8)
        order = suffixdup.suffix_order(a, 1 << 20)
        assert [flat[i:] for i in order] == sorted(flat[i:] for i in range(len(flat)))
        got = suffixdup.common_prefixes(a, order, np.full(len(a), len(a)))
        lcp = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert got.tolist() == [0, *(lcp(flat[i:], flat[j:]) for i, j in zip(order, order[1:]))]
    for _ in range(20):
        runs = [np.unique(np.array([rnd.randrange(60) for _ in range(20)], np.uint64), return_counts=True) for _ in range(rnd.randint(1, 7))]
        want = collections.Counter()
        for k, n in runs:
            want.update(dict(zip(k.tolist(), n.tolist())))
        keys, n = suffixdup.merged(runs)
        assert keys.tolist() == sorted(want) and dict(zip(keys.tolist(), n.tolist())) == want


@pytest.fixture(scope="module")
def trees(spark):
    return htmltext.fit_on(spark.read.parquet(f"{DATA}/pages.parquet"))


def main_text_of(trees, html):
    page = htmltext.Page(html)
    return page.text(page.decoded(boost.as_numpy(trees, np.array(page.features(), float)).tolist()))


PROSE = "".join(f"<p>Paragraph {k} of the text, with words enough, and commas, to be read as prose by anyone.</p>" for k in range(4))
PLAIN = re.sub("</p><p>", "\n", PROSE)[3:-4]


def page_of(body="<body>", start="<article>", end="</article>", more="", after=""):
    return f"<html>{body}<nav><ul><li><a href=x>Menu</a></li></ul></nav>{start}<h1>Title of it</h1>{PROSE}{more}{end}{after}<footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "extra"),
    [
        (page_of("<body class='home has-sidebar'>"), ""),
        (page_of(start="<article class='post comments-open'>"), ""),
        (page_of(start="<div class='page no-header'>", end="</div>"), ""),
        (page_of("<body class=sidebar-left id=header>"), ""),
        (page_of(more="<p id='search-for-peace'>Kept text, of peace.</p>"), "\nKept text, of peace."),
        (page_of(more="<h2 id='related'>A kept heading</h2>"), "\nA kept heading"),
        (page_of(more="<p>Seen <span hidden>one</span><span style='display:none'>two <span>three</span></span><span class='advert'>four</span>too.</p>"), "\nSeen too."),
        (page_of(more="<p>A <svg><svg><text>x</text></svg><text>tail</text></svg> b.</p>"), "\nA b."),
        (page_of(more="<p>Open <span hidden> stays here.</p>"), "\nOpen stays here."),
        (page_of(more="<div class='ad'>buy</div><div class='share-buttons'>share</div><form>f</form><div id='comments'><p>First, yes, it is.</p></div><aside>as</aside><div class='newsletter-signup'>up</div>"), ""),
        (page_of(after="<div class='sidebar col-md-4'><p>Side text, with words, and more.</p></div><div id='comments' class='comments-area'><p>He said, no, never.</p></div>"), ""),
    ],
)
def test_class_names(trees, html, extra):
    assert main_text_of(trees, html) == f"Title of it\n{PLAIN}{extra}"


def test_states_change_nothing(spark, trees):
    rows = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").limit(100).collect()]
    base = [main_text_of(trees, h) for h in rows]
    assert all(base)
    for name in ("home has-sidebar", "post comments-open", "page no-header", "with-widgets nav-open"):
        other = [main_text_of(trees, h.replace("<body>", f"<body class='{name}'>").replace("<article>", f"<article class='{name}'>")) for h in rows]
        assert sum(a == b for a, b in zip(base, other)) >= 0.95 * len(rows)


def test_decoding_is_the_best_of_all():
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randint(2, 12)
        page = htmltext.Page("")
        page.tag, page.parent = ["#root"] + ["div"] * (n - 1), [-1] + [rnd.randrange(k) for k in range(1, n)]
        page.attr = [(0.0, False, rnd.random() < 0.1 and k > 0) for k in range(n)]
        p = [rnd.uniform(0.05, 0.95) for _ in range(n)]

        def score(kept):
            if any(kept[k] and (not kept[page.parent[k]] or page.attr[k][2]) for k in range(1, n)):
                return -math.inf
            return sum(math.log(p[k] if kept[k] else 1 - p[k]) for k in range(1, n))

        best = max(score((True, *x)) for x in itertools.product([False, True], repeat=n - 1))
        assert math.isclose(score(page.decoded(p)), best)


def test_pages_with_clashing_columns(spark, trees):
    df = spark.createDataFrame([(1, "u", page_of(), "t", 3), (None, None, None, "t", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_text(df, trees=trees).collect()}
    assert got == {1: (f"Title of it\n{PLAIN}", len(PLAIN) + 12), None: ("", 0)}
    assert htmltext.main_text(df.limit(0), trees=trees).count() == 0


def test_archives_are_read_as_streams(spark, tmp_path):
    """One archive of many records, as others write them, in a reader that never sees the whole file."""
    import gzip

    class Narrow:
        def __init__(self, data):
            self.data, self.at, self.most = data, 0, 0

        def read(self, n):
            out, self.at = self.data[self.at : self.at + n], self.at + n
            self.most = max(self.most, len(out))
            return out

    rows = [(k, f"u{k}", "x" * (k * 997 % 5000)) for k in range(300)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), "file://" + path)
    members = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    stream = Narrow(members)
    assert sum(1 for _ in warc.records(stream, 512)) == sum(1 for _ in warc.records(members)) == 300 and stream.most == 512
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a b%20c.warc.gz").write_bytes(members * 20 + gzip.compress(b""))
    got = warc.read_warc(spark, f"file://{tmp_path}/one")
    assert got.count() == 6000 and got.where("record_type = 'response'").selectExpr("sum(length(payload))").first()[0] == 20 * sum(len(x) for x in {h for _, _, h in rows})
    (tmp_path / "one/cut.warc.gz").write_bytes(members[:-20])
    with pytest.raises(Exception, match="ends within"):
        warc.read_warc(spark, f"file://{tmp_path}/one").count()


def test_pii_fit_takes_every_document(spark):
    """F8: candidates that only the documents of the highest hashes hold are fitted on, each with how often it occurs."""
    from folioforge.llm import pii
    from pyspark.sql import functions as F

    ids = [r.i for r in spark.range(3200).select(F.col("id").alias("i")).orderBy(F.xxhash64("id"), "id").collect()]
    late = ids[3050:]
    texts = [(i, "see @ that") for i in ids[:3050]] + [(i, f"call phone +1 (343) 555-{i:04d} now" if k % 2 else f"order number 12 345-{i:04d} of them") for k, i in enumerate(late)]
    df = spark.createDataFrame(texts, "_id long, _text string")
    counts = {(r.kind, r.y): r.n for r in pii.candidates(df).groupBy("kind", "y").agg(F.sum("n").alias("n")).collect()}
    assert counts["phone", 1] == 150 and counts["phone", 0] == 75  # those with a sign to rewrite count twice
    assert pii.fitted(df)["phone"][0]
