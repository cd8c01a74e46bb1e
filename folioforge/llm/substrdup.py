"""Repeated word windows removed: difference-cover anchors, exact windows where an anchor repeats.

For a period P a difference cover D has, for any two offsets, a shift below P that brings both into
D. So if the same ``window`` words start at i in one document and at j in another, some shift puts
equal words of length ``window - P + 1`` at cover positions of both. Only those anchors are hashed
and shuffled (|D| of P positions); a window is hashed and compared only where it holds an anchor
that occurs elsewhere, and the removal rule is decided on whole windows. Anchors only choose
candidates, so 40 bits of their hash will do. Windows are equal when two independent hashes of
64 bits are: among 1e13 windows two different ones agree with a chance of about 1e-13.

Each Python block settles what repeats within itself, so one very common passage reaches the
shuffle once a block and not once a document. Starts travel packed: one row holds the sorted hashes
of a block that fall into one bucket, with ids and positions, compressed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: Perfect difference sets by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Anchors or windows held by one Python block, and meant for one bucket.
BLOCK_ROWS = 600_000
BUCKET_ROWS = 500_000
PACKED = "bucket int, known boolean, blob binary"


def _planes(x) -> bytes:
    import numpy as np

    x = np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, at: int, n: int, kind: str):
    import numpy as np

    width = np.dtype(kind).itemsize
    x = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return np.ascontiguousarray(x).view(kind).ravel(), at + n * width


def _pack(h, ids, p, w, second, squeeze) -> bytes:
    """Rows sorted by h: hash steps, ids above their least, positions, weights and second hashes (or none) as byte planes."""
    import numpy as np

    least = ids.min()
    head = np.array([len(h), least], "<i8").tobytes()
    steps = np.diff(h, prepend=np.uint64(0))
    return squeeze(head + _planes(steps) + _planes((ids - least).astype("<i8")) + _planes(p.astype("<i4")) + w.astype(np.uint8).tobytes() + (second.tobytes() if len(second) else b""))


def _unpack(raw: bytes):
    import numpy as np

    n, least = np.frombuffer(raw, "<i8", 2)
    steps, at = _unplaned(raw, 16, n, "<u8")
    ids, at = _unplaned(raw, at, n, "<i8")
    p, at = _unplaned(raw, at, n, "<i4")
    w = np.frombuffer(raw, np.uint8, n, at)
    return np.cumsum(steps, dtype=np.uint64), ids + least, p, w, np.frombuffer(raw[at + n :], "<u8")


def _heads(*sorted_keys):
    """Whether each row is the first with its keys."""
    import numpy as np

    new = np.zeros(len(sorted_keys[0]) - 1, bool)
    for k in sorted_keys:
        if len(k):
            new |= k[1:] != k[:-1]
    return np.concatenate([[True], new])


def _settled(batches, pick, buckets: int, by_anchor: bool):
    """Packed rows of a block: the first start of each hash by bucket, and known repeats apart.

    Weight 1: the only start of its hash in the block; 2: the first of several.
    """
    import numpy as np
    import pyarrow as pa
    import zstandard

    from .wordhash import WordHashes, WordPairs, blocks, text_bytes

    cache, squeeze = WordHashes() if by_anchor else WordPairs(), zstandard.ZstdCompressor(level=3).compress

    def out(held):
        h, second, ids, p = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        h = h >> np.uint64(24 if by_anchor else 0)
        order = np.lexsort((p, ids, *([second] if len(second) else []), h, bucket))
        h, ids, p, bucket = h[order], ids[order], p[order], bucket[order]
        second = second[order] if len(second) else second
        head = _heads(h, second, bucket)
        first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
        again = (ids != ids[first]) | (p != p[first])
        several = np.diff(np.concatenate([np.flatnonzero(head), [len(h)]]))[np.cumsum(head) - 1] > 1
        kept = np.flatnonzero(~again)
        rows = []
        edge = np.searchsorted(bucket[kept], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            own = kept[edge[b] : edge[b + 1]]
            rows.append((int(b), False, _pack(h[own], ids[own], p[own], 1 + several[own], second[own] if len(second) else second, squeeze)))
        known = np.flatnonzero(again)
        if len(known):
            own = known[np.lexsort((p[known], ids[known]))]
            rows.append((int(bucket[0]), True, _pack(np.zeros(len(own), np.uint64), ids[own], p[own], np.zeros(len(own)), second[:0], squeeze)))
        b, k, blob = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k), pa.array(blob, pa.binary())], names=["bucket", "known", "blob"])

    held, n = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        extra = batch.column(2) if batch.num_columns > 2 else None
        for first, docs_words in blocks(text_bytes(batch.column(1)), lower=False):
            words = [w for ws in docs_words for w in ws]
            flat = cache.array(words) if by_anchor else cache.arrays(words)
            stops = np.cumsum([len(ws) for ws in docs_words])
            ends = list(zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True))
            got = pick(flat, ends, first, extra)
            if got is not None and len(got[0]):
                h, second, row, p = got
                held.append((h, second, ids[first + row].astype(np.int64), p.astype(np.int32)))
                n += len(h)
            if n >= BLOCK_ROWS:
                yield out(held)
                held, n = [], 0
    if held:
        yield out(held)


def _buckets(batches):
    """(bucket, its rows, its known rows) of packed rows sorted by bucket."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    parts, known, now = [], [], None
    for batch in batches:
        for b, k, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != now and now is not None:
                yield parts, known
                parts, known = [], []
            now = b
            (known if k else parts).append(_unpack(open_(blob)))
    if now is not None:
        yield parts, known


def _resolved(by_anchor: bool, buckets: int):
    """Packed (id, p) of repeated starts, dealt by id, from the packed rows of whole buckets.

    Anchors: every start whose hash has several. Windows: every start with an earlier one.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress

        def hits(parts):
            h, ids, p, w, second = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((p, ids, *([second] if len(second) else []), h))
            h, ids, p, w = h[order], ids[order], p[order], w[order]
            head = _heads(h, second[order] if len(second) else second)
            if by_anchor:
                hit = np.add.reduceat(w.astype(np.int64), np.flatnonzero(head))[np.cumsum(head) - 1] > 1
            else:
                first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
                hit = (ids != ids[first]) | (p != p[first])
            return ids[hit], p[hit]

        def out(held):
            ids, p = (np.concatenate(x) for x in zip(*held, strict=True))
            with np.errstate(over="ignore"):
                own = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
            order = np.lexsort((p, ids, own))
            ids, p, own = ids[order], p[order], own[order].astype(np.int64)
            cut = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
            zero = np.zeros(len(own), np.uint64)
            rows = [_pack(zero[a:b], ids[a:b], p[a:b], zero[a:b], zero[:0], squeeze) for a, b in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(own[cut[:-1]], pa.int32()), pa.array([True] * len(rows)), pa.array(rows, pa.binary())], names=["bucket", "known", "blob"])

        held, n = [], 0
        for parts, known in _buckets(batches):
            for found in [hits(parts)] * bool(parts) + [x[1:3] for x in known]:
                if len(found[0]):
                    held.append(found)
                    n += len(found[0])
            if n >= BLOCK_ROWS:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return run


def _gathered(batches):
    """(id, ps): the starts of each id, from packed rows dealt by id."""
    import numpy as np
    import pyarrow as pa

    for _, known in _buckets(batches):
        ids, p = (np.concatenate(x) for x in zip(*(k[1:3] for k in known), strict=True))
        order = np.lexsort((p, ids))
        ids, p = ids[order], p[order]
        cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        lists = pa.ListArray.from_arrays(np.append(cut, len(ids)).astype(np.int32), pa.array(p.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[cut]), lists], names=["id", "ps"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, period: int = 13) -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept).

    Words are runs without ASCII white space, unchanged. Every word covered by a window of
    ``window`` consecutive words that also starts earlier (a smaller id, or the same id and an
    earlier word) is removed; kept joins the other words by one space. Windows are judged on the
    input. Null and empty texts have no words. A row with a null id is compared with nothing and
    keeps its words; rows that share an id count as one document, so equal starts in them are the
    same start. An empty table gives an empty result; other columns are ignored.
    """
    cover, anchor = COVERS[period], window - period + 1
    bounded_batches(df.sparkSession)
    # both joins below read one shuffle of the texts; the coalesce keeps their plans alike
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = docs.where("id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size / 6 / BUCKET_ROWS))

    def anchors(batches):
        import numpy as np

        from .wordhash import window_hashes

        def pick(flat, ends, first, _):
            grams = window_hashes(flat, anchor)
            at, row = [], []
            for i, (a, b) in enumerate(ends):
                if b - a >= window:
                    p = np.arange(b - a - anchor + 1)
                    p = p[np.isin(p % period, cover)]
                    at.append(p)
                    row.append(np.full(len(p), i))
            if not at:
                return None
            p, row = np.concatenate(at), np.concatenate(row)
            starts = np.array([a for a, _ in ends])
            h = grams[starts[row] + p]
            return h, h[:0], row, p

        return _settled(batches, pick, buckets, True)

    def windows(batches):
        import numpy as np

        from .wordhash import window_pairs

        def pick(flat, ends, first, flags):
            grams, seconds = window_pairs(flat, window)
            at, row = [], []
            for i, (a, b) in enumerate(ends):
                hit = flags[first + i].as_py()
                n = b - a - window + 1
                if hit and n > 0:
                    near = np.zeros(n + 1, np.int32)
                    hit = np.array(hit)
                    np.add.at(near, np.clip(hit + anchor - window, 0, n), 1)
                    np.add.at(near, np.clip(hit + 1, 0, n), -1)
                    p = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                    at.append(p)
                    row.append(np.full(len(p), i))
            if not at:
                return None
            p, row = np.concatenate(at), np.concatenate(row)
            starts = np.array([a for a, _ in ends])
            return grams[starts[row] + p], seconds[starts[row] + p], row, p

        return _settled(batches, pick, buckets, False)

    def kept(batches):
        import numpy as np
        import pyarrow as pa

        from .wordhash import text_bytes

        for batch in batches:
            n, gone, out = [], [], []
            starts = batch.column(2)
            for i, text in enumerate(text_bytes(batch.column(1))):
                words = text.split()
                n.append(len(words))
                at = starts[i].as_py()
                if at:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.array(at)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [words[j] for j in np.flatnonzero(keep)]
                gone.append(n[-1] - len(words))
                out.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    def spread(packed, by_anchor):
        dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
        found = dealt.mapInArrow(tidy(_resolved(by_anchor, buckets)), PACKED).repartition("bucket").sortWithinPartitions("bucket")
        return found.mapInArrow(tidy(_gathered), "id long, ps array<int>")

    by_id = named.repartition("id")
    flags = spread(named.mapInArrow(tidy(anchors), PACKED), True)
    flagged = by_id.join(flags, "id", "left").select("id", "text", "ps")
    starts = spread(flagged.mapInArrow(tidy(windows), PACKED), False)
    done = by_id.join(starts, "id", "left").select("id", "text", "ps")
    nameless = docs.where("id is null").withColumn("ps", F.lit(None).cast("array<int>"))
    out = done.union(nameless).mapInArrow(tidy(kept), "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
