"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

zstandard trains both dictionaries: the ordinary one on windows of ordinary documents, chosen by
hash; the toxic one on windows of toxic documents, set in front of the ordinary dictionary, so that
ordinary text compresses alike under both. Of a toxic document only few windows are toxic, and the
trainer ranks by frequency alone, so its toxic windows are the words that hold a segment which
recurs in toxic documents far beyond its share in ordinary ones. A text is cut into overlapping
windows of a few words; how many bytes fewer a window takes under the toxic dictionary than under
the ordinary one is its margin. Counts of margins at calibrated thresholds give the score by a
logistic fit on training documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, column, released, tidy

#: Labelled documents used for fitting, those of the lowest hashes, as many as stay within the bytes;
#: bounds the driver's work.
FIT_DOCS = 8000
FIT_BYTES = 64 << 20
WINDOW, STEP = 6, 3
PIECE = 6
ORDINARY_BYTES = 32 << 10
TOXIC_BYTES = 16 << 10
#: Times that a word must occur in the toxic documents to be one of their windows.
RECURS = 2
#: Windows that train the ordinary dictionary: about this many bytes, from anywhere in the texts.
TRAIN_BYTES = 2 << 20
LIKELIHOOD = 30.0
LEVEL = 3


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, max(1, len(words) - STEP), STEP)]


def _compressor(data: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def margins(ordinary, toxic, text: bytes):
    """Bytes that the toxic dictionary saves on each window."""
    import numpy as np

    ws = windows(text)
    if not ws:
        return np.zeros(1, np.int32)
    a, b = ordinary.multi_compress_to_buffer(ws), toxic.multi_compress_to_buffer(ws)
    return np.fromiter((len(x) - len(y) for x, y in zip(a, b, strict=True)), np.int32, len(ws))


def _features(d, thresholds):
    import numpy as np

    top = np.sort(d)[::-1][:3]
    return [float(top[0]), float(top.mean()), *(math.log1p(int((d >= t).sum())) for t in thresholds), *(float((d >= t).mean()) for t in thresholds)]


def _pieces(text: bytes) -> set:
    out: set = set()
    for w in set(text.lower().split()):
        w = b" " + w + b" "
        out.update(w[i : i + PIECE] for i in range(len(w) - PIECE + 1))
    return out


def _counts(texts: list):
    """Sorted pieces, packed into integers, and in how many texts each is; far smaller than a Counter."""
    import numpy as np

    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found: list = []
    size = 0
    for i, t in enumerate(texts):
        x = _pieces(t)
        found.append(_packed(x))
        size += len(x)
        if size >= 1 << 20 or i + 1 == len(texts):
            new, k = np.unique(np.concatenate(found), return_counts=True)
            both = np.concatenate([keys, new])
            keys, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, np.concatenate([n, k]), len(keys)).astype(np.int64)
            found, size = [], 0
    return keys, n


def _packed(pieces):
    import numpy as np

    out = np.zeros((len(pieces), 8), np.uint8)
    out[:, :PIECE] = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, PIECE)
    return out.view("<u8").ravel()


def _of(counts, keys):
    """Counts of the packed pieces ``keys``, 0 where there are none."""
    import numpy as np

    have, n = counts
    if not len(have):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, n[at], 0)


def _likelihood(a: int, n: int, b: int, m: int) -> float:
    t = 0.0
    for x, e in ((a, n * (a + b) / (n + m)), (b, m * (a + b) / (n + m)), (n - a, n * (n + m - a - b) / (n + m)), (m - b, m * (n + m - a - b) / (n + m))):
        if x > 0:
            t += 2 * x * math.log(x / e)
    return t


def _typical(own: list, counts, other, n: int, m: int) -> list[bytes]:
    """Recurring words of the texts ``own`` that hold a piece found in them beyond its share in the others."""
    often = counts[0][counts[1] >= 4]
    pairs = zip(often, _of(counts, often).tolist(), _of(other, often).tolist(), strict=True)
    marked = {x.tobytes()[:PIECE] for x, a, b in pairs if a * m > 3 * b * n and _likelihood(a, n, b, m) >= LIKELIHOOD}
    words = (b" " + w + b" " for text in own for w in text.lower().split())
    words = [w for w in words if any(w[i : i + PIECE] in marked for i in range(len(w) - PIECE + 1))]
    times = Counter(words)
    words = [w for w in words if times[w] >= RECURS]
    # in an order of their hashes: the trainer takes from each stretch of its input
    return [words[i] for i in sorted(range(len(words)), key=lambda i: zlib.crc32(b"%d" % i + words[i]))]


def _trained(size: int, samples: list, k: int) -> bytes:
    """A dictionary that zstandard trains on the samples; their end where they are too few for that."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _training(texts: list) -> list[bytes]:
    """Windows without overlap, all of them or those of the lowest hashes up to about ``TRAIN_BYTES``."""
    total = sum(len(w) for t in texts for w in windows(t)[::2])
    least = (1 << 32) * min(1.0, TRAIN_BYTES / max(total, 1))
    return [w for i, t in enumerate(texts) for j, w in enumerate(windows(t)[::2]) if zlib.crc32(b"%d %d " % (i, j) + w) < least]


def fit(texts: list, toxic: list) -> dict | None:
    """Dictionaries, thresholds and weights from texts (bytes) and labels 0/1; None without both."""
    import numpy as np

    bad = [t for t, y in zip(texts, toxic, strict=True) if y]
    good = [t for t, y in zip(texts, toxic, strict=True) if not y]
    if len(bad) < 5 or len(good) < 5:
        return None
    each_bad, each_good = list(dict.fromkeys(bad)), list(dict.fromkeys(good))  # copies count once
    in_bad, in_good = _counts(each_bad), _counts(each_good)
    toxic_windows = _typical(each_bad, in_bad, in_good, len(each_bad), len(each_good))
    del in_bad, in_good
    ordinary, own = _trained(ORDINARY_BYTES, _training(good), 24), _trained(TOXIC_BYTES, toxic_windows, 24)
    model = {"toxic": own + ordinary, "ordinary": bytes(len(own)) + ordinary}
    a, b = _compressor(model["ordinary"]), _compressor(model["toxic"])
    ds = [margins(a, b, t) for t in texts]
    y = np.array(toxic, float)
    most = np.array([d.max() for d in ds])
    # thresholds: margins whose presence parts the classes, the best one and all that tell half as much
    gain = {t: _likelihood(int((most[y == 1] >= t).sum()), len(bad), int((most[y == 0] >= t).sum()), len(good)) for t in range(1, 13)}
    model["thresholds"] = [t for t, g in gain.items() if g >= 0.4 * max(gain.values())]
    x = np.array([_features(d, model["thresholds"]) for d in ds])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - np.append(w[:-1], 0))
    model |= {"mean": mean, "scale": scale, "weights": w}
    return model


def fit_on(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_docs: int = FIT_DOCS) -> dict | None:
    """``fit`` on the labelled documents of the ``fit_docs`` lowest hashes of their ids.

    Of an id with several labels the highest counts; rows that share an id are documents of their
    own. Null ids and labels are passed over, null texts are empty. Ties of the hash go by id, then by a hash
    of the text. At most ``FIT_BYTES`` of texts leave the documents, whatever their lengths.
    """
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    y = y.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(fit_docs)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the bounds are found on ids and lengths; only texts within them move
    sizes = docs.join(F.broadcast(y), "id").select("id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n"), "y")
    order = [F.xxhash64("id"), "id", "h", "n"]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    few = sizes.orderBy(*order).limit(fit_docs).withColumn("sum", F.sum("n").over(before)).where(F.col("sum") <= FIT_BYTES)
    few = few.groupBy("id", "h").agg(F.first("y").alias("y"), F.count("*").alias("times"))
    chosen = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(few), ["id", "h"])
    # of equal rows as many as the bounds let in: each brings its text once, repeated by its count
    chosen = chosen.groupBy("id", "h").agg(F.first("text").alias("text"), F.first("y").alias("y"), F.first("times").alias("times"))
    rows = chosen.select("id", "text", "y", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("k"))
    rows = rows.orderBy("id", "text").select("text", F.col("y").cast("int").alias("y")).toArrow()
    texts, toxic = rows["text"].cast("binary").to_pylist(), rows["y"].to_pylist()
    del rows
    model = fit(texts, toxic)
    del texts
    released()
    return model


def scored(df: DataFrame, model: dict | None, text_col: str = "text", keep: tuple = (), score_col: str = "score") -> DataFrame:
    """Columns ``keep`` and ``score_col`` (0 to 1) of every row; nulls score as empty texts.

    Without a model (a class had no labelled rows) every score is 0. The whole text is scored,
    whatever its length; an empty table gives an empty result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kept = text_col in keep
    if score_col in keep:
        raise ValueError(f"{score_col} is a column that is kept")
    own = df.select(*map(column, keep)) if kept else df.select(*map(column, keep), column(text_col))
    if model is None:
        return own.select(*map(column, keep), F.lit(0.0).alias(score_col))
    at = own.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .wordhash import text_bytes

        m = shared.value
        a, b = _compressor(m["ordinary"]), _compressor(m["toxic"])
        for batch in batches:
            x = [_features(margins(a, b, t), m["thresholds"]) for t in text_bytes(batch.column(at))]
            if not x:
                continue
            z = np.c_[(np.array(x) - m["mean"]) / m["scale"], np.ones(len(x))] @ m["weights"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*keep, score_col])

    schema = own.select(*map(column, keep), F.lit(0.0).alias(score_col)).schema
    return own.mapInArrow(tidy(run), schema)
