"""The registered query of each corpus operator, and its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def held_out():
    """Rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> dict | None:
    from .toxicity import fit_on

    return fit_on(docs, labels.where(~held_out()), "doc_id", "text", "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), byte_vocabulary())


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, listed

    out = find_pii(table(spark, sf_dir, "documents"))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrdup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    out = encode(table(spark, sf_dir, "documents"), word_vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vecdup import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_path
    from .warc import read_warc, write_warc

    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    out = read_warc(spark, path, with_payload=False)
    return out.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .convtrie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdup import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_bpe_encode_decode, op3_embedding_near_dedup, op4_toxicity, op5_token_counts, op6_pii_spans, op7_benchmark_decontamination, op8_minhash_near_dedup, op9_warc_round_trip, op10_substring_dedup, op11_importance_resampling, op12_conversation_trie, op13_suffix_array_dedup)}

#: Unsigned CRC-32 of the bytes of a text in DuckDB; `crc` is a relation of one row with the table of its polynomial, made from its rule.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i)))"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen({0})), lambda k: CAST(concat('0x', substr(hex(encode({0})), CAST(2 * k + 1 AS INT), 2)) AS BIGINT))), lambda c, b: xor(c >> 8, crc.tab[1 + (xor(c, b) & 255)])), 4294967295)"
#: Words of a text as DuckDB lists: runs without ASCII white space.
_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_REACH = """
reach AS (SELECT n AS a, n AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS n, min(b) AS component_id FROM reach GROUP BY a)"""

ORACLES: dict[str, str] = {
    "op3_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.93),
nodes AS (SELECT vec_id AS n FROM v), {_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON n = vec_id""",
    "op8_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[CAST(i AS INT) : CAST(i + 4 AS INT)], ' ')) END) AS s FROM w),
inv AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM inv p JOIN inv q ON p.x = q.x AND p.doc_id <> q.doc_id WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
nodes AS (SELECT doc_id AS n FROM documents), {_REACH}
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp ON n = doc_id""",
    "op9_warc_round_trip": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT page_id, h, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST(concat('0x', substr(d, CAST(1 + 5 * (k // 4) AS INT), 5)) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31), 1)), '') AS payload_digest FROM p),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b JOIN f USING (h)""",
    "op10_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[CAST(i AS INT) : CAST(i + 19 AS INT)], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 20) t(k)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op11_importance_resampling": f"""WITH {_CRC_TABLE},
texts AS (SELECT 0 AS b, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT b, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts),
f AS (SELECT b, doc_id, unnest(w) AS f FROM w UNION ALL SELECT b, doc_id, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM w),
n AS (SELECT b, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT f, {_CRC.format('f')} % 10000 AS k FROM (SELECT DISTINCT f FROM n), crc),
tot AS (SELECT range AS k, coalesce(sum(n) FILTER (b = 0), 0) AS s, coalesce(sum(n) FILTER (b = 1), 0) AS t FROM range(10000) LEFT JOIN (SELECT b, k, sum(n) AS n FROM n JOIN k USING (f) GROUP BY b, k) x ON x.k = range GROUP BY range),
gain AS (SELECT k, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM tot),
doc AS (SELECT doc_id, sum(n) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM n JOIN k USING (f) JOIN gain USING (k) WHERE b = 0 GROUP BY doc_id),
scored AS (SELECT w.doc_id, len(w) AS words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('7:', w.doc_id)), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN doc USING (doc_id) WHERE b = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op12_conversation_trie": f"""WITH {_CRC_TABLE},
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, {_CRC.format('CAST(c AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT c FROM t), crc),
own AS (SELECT convs.c, 0 AS part, t.p, role, text FROM convs JOIN t ON t.c = convs.base AND t.p <= h UNION ALL SELECT convs.c, 1, t.p, role, text FROM convs JOIN t ON t.c = convs.c AND t.p > h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS depth, role, text FROM own),
paths AS (SELECT c, depth, strlen(text) AS bytes, sha256(string_agg(concat(strlen(role), ':', strlen(text), ':', role, text), '') OVER (PARTITION BY c ORDER BY depth)) AS key FROM d),
len AS (SELECT convs.c, count(depth) AS n FROM convs LEFT JOIN d ON d.c = convs.c GROUP BY convs.c),
every AS (SELECT paths.c, depth, bytes, key, lag(key, 1, '') OVER (PARTITION BY paths.c ORDER BY depth) AS up, depth = n AS last FROM paths JOIN len ON len.c = paths.c UNION ALL SELECT c, 0, 0, '', NULL, n = 0 FROM len),
nodes AS (SELECT depth, key, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM every GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.depth = nodes.depth AND kids.key = nodes.key),
under AS (SELECT e.depth, e.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens FROM full_ f JOIN every g ON g.c = f.conv_id AND g.depth = f.depth JOIN every e ON e.c = g.c AND e.depth <= g.depth GROUP BY e.depth, e.key)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256 FROM full_ f JOIN under u ON u.depth = f.depth AND u.key = f.key LEFT JOIN full_ p ON p.depth = f.depth - 1 AND p.key = f.up""",
    "op13_suffix_array_dedup": """WITH b AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, n, s, substr(x, CAST(2 * s + 1 AS INT), 800) AS y FROM (SELECT doc_id, n, x, unnest(range(0, n, 200)) AS s FROM b)),
win AS (SELECT doc_id, i, md5(substr(y, CAST(2 * (i - s) + 1 AS INT), 400)) AS w FROM (SELECT doc_id, s, y, unnest(range(s, least(s + 200, n - 199))) AS i FROM c)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS k FROM win) WHERE k > 1),
each AS (SELECT doc_id, i, substr(y, CAST(2 * (i - s) + 1 AS INT), 2) AS byte FROM (SELECT doc_id, s, y, unnest(range(s, least(s + 200, n))) AS i FROM c)),
cover AS (SELECT e.doc_id, e.i, byte, coalesce(max(h.i) OVER (PARTITION BY e.doc_id ORDER BY e.i) >= e.i - 199, false) AS gone FROM each e LEFT JOIN hits h ON h.doc_id = e.doc_id AND h.i = e.i),
runs AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS starts FROM cover),
out_ AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN out_ USING (doc_id)""",
}
