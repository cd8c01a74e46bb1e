"""Repeated byte strings removed: suffix arrays of passages, dealt so that equal strings meet.

A window is ``window`` consecutive bytes of one document. Each window is named by its anchor, the
leftmost of its ``GRAM``-byte pieces with the least hash: equal windows have equal anchors at equal
places, whatever stands around them. Windows next to each other mostly share their anchor, so a
document is a chain of passages, one for each anchor, of ``window`` bytes and the run of starts.

1. Shards of documents send their sorted anchors. Sorted runs of many shards are merged by binary
   search; an anchor that stands in one place only is dropped, and its windows with it.
2. Passages of the other anchors go to shards by anchor. There the suffixes of the distinct passages
   are sorted by Larsson and Sadakane's refinement (ranks of 8, 16, 32 ... bytes; only groups that
   are not yet apart are sorted again), Kasai's rule gives the common prefix of neighbours, and a
   window is repeated when it shares all its bytes with a neighbour. A passage that several places
   hold is sorted once and is repeated as a whole. Texts are compared, not digests.
3. An anchor of more than ``HOT`` places would overload its shard: its windows go out one by one,
   by 128 bits of hash, and equal ones are counted; nothing is dropped.

Starts of repeated windows go back to their documents, where the bytes that they cover are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy
from .substrdup import _planes, _unplaned

#: Bytes of the pieces among which a window's anchor is found.
GRAM = 64
#: Bits of a position in a block; texts are below 2 GB, as Arrow has them.
PLACE_BITS = 31
#: Places of an anchor beyond which its windows are dealt one by one.
HOT = 1000
#: Bytes of documents that a task holds at once, and of distinct passages in one suffix array.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
#: Bytes of documents meant for one bucket.
BUCKET_BYTES = 8 << 20
#: Places held before they are packed by bucket, and bytes of distinct passages.
HELD_ROWS = 600_000
HELD_BYTES = 16 << 20
PACKED = "bucket int, kind int, blob binary"


def _pack(*columns) -> bytes:
    """Equally long integer columns as byte planes, each with its least taken off."""
    import numpy as np

    n = len(columns[0])
    out = [np.array([n], "<i8").tobytes()]
    for c in columns:
        least = c.min() if n else c.dtype.type(0)
        rest = c - least
        width = "<u1" if not n or rest.max() < 1 << 8 else "<u2" if rest.max() < 1 << 16 else "<u4" if rest.max() < 1 << 32 else "<u8"
        out += [np.array([least]).astype("<u8" if c.dtype == np.uint64 else "<i8").tobytes(), width.encode(), _planes(rest.astype(width))]
    return b"".join(out)


def _unpack(raw: bytes, kinds: str) -> tuple:
    """(columns, rest of raw); kinds has a letter for each column: u or i."""
    import numpy as np

    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in kinds:
        least = np.frombuffer(raw, f"<{kind}8", 1, at)
        c, at = _unplaned(raw, at + 11, n, raw[at + 8 : at + 11].decode())
        out.append(c.astype(f"<{kind}8") + least)
    return out, raw[at:]


def gram_hashes(text):
    """64-bit hash of each ``GRAM`` bytes of a uint8 array, by doubling."""
    import numpy as np

    from .wordhash import mixed

    odd = np.random.default_rng(13).integers(0, 1 << 63, 7, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    byte = mixed(np.arange(1, 257, dtype=np.uint64) * odd[0])
    with np.errstate(over="ignore"):
        h, m = byte[text], 1
        while m < GRAM:
            h = h[: len(h) - m] * odd[m.bit_length() % 7] + h[m:]
            m *= 2
        return mixed(h)


def anchors(text, ends, window: int):
    """(anchor position, first window, last window) of each passage of the documents that end at ``ends``, and all hashes.

    Positions count over the whole buffer. A window that would cross an end is none.
    """
    import numpy as np

    h = gram_hashes(text)
    wide = window - GRAM + 1
    n = len(text) - window + 1
    least = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    m, span = least, 1
    while 2 * span <= wide:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    m = np.minimum(m[:n], m[wide - span : wide - span + n])
    p = (m & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    whole = np.ones(n, bool)
    for e in ends[:-1]:
        whole[max(0, e - window + 1) : e] = False
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = (p[1:] != p[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], n) - 1
    own = whole[first]
    return p[first[own]], first[own], last[own], h


def merged(runs: list):
    """Distinct sorted keys of sorted runs of (keys, places), places added up; by binary search, pair by pair."""
    import numpy as np

    while len(runs) > 1:
        nxt = [runs[-1]] if len(runs) % 2 else []
        for (a, x), (b, y) in zip(runs[::2], runs[1::2], strict=False):
            at = np.searchsorted(a, b)
            same = np.zeros(len(b), bool)
            inside = at < len(a)
            same[inside] = a[at[inside]] == b[inside]
            x = x.copy()
            x[at[same]] += y[same]
            b, y, at = b[~same], y[~same], at[~same]
            keys, places = np.empty(len(a) + len(b), a.dtype), np.empty(len(a) + len(b), x.dtype)
            to = at + np.arange(len(b))
            old = np.ones(len(keys), bool)
            old[to] = False
            keys[to], places[to], keys[old], places[old] = b, y, a, x
            nxt.append((keys, places))
        runs = nxt
    return runs[0]


def suffix_order(text, depth: int):
    """Suffixes of a uint8 array sorted by their first ``depth`` bytes at least, by refinement of ranks."""
    import numpy as np

    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : n + k]
    order = np.argsort(key, kind="stable")
    head = np.empty(n, bool)
    head[0] = True
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.flatnonzero(head)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    h = 8
    while h < depth:
        size = np.diff(np.append(np.flatnonzero(head), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        own = order[open_]
        both = rank[own] * (n + 1) + rank[np.minimum(own + h, n)] + 1
        by = np.argsort(both, kind="stable")
        own, both = own[by], both[by]
        order[open_] = own
        new = np.empty(len(own), bool)
        new[0] = True
        new[1:] = both[1:] != both[:-1]
        head[open_] |= new
        start = np.flatnonzero(new)
        rank[own] = np.repeat(open_[start], np.diff(np.append(start, len(own))))
        h *= 2
    return order


def common_prefixes(text, order, ends):
    """Bytes that suffix order[k] shares with order[k - 1], up to the end of either passage; ends by position.

    Kasai's rule: where both neighbours moved on by one byte the prefix is one shorter; only the
    others are compared, eight bytes a step, all at once.
    """
    import numpy as np

    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = np.zeros(n + 8, np.uint64)
    for k in range(8):
        key[:n] = (key[:n] << np.uint64(8)) | wide[k : n + k]
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.sort(order)
    prev = before[at]
    follows = np.zeros(len(at), bool)
    follows[1:] = (at[1:] == at[:-1] + 1) & (prev[1:] == prev[:-1] + 1) & (prev[:-1] >= 0) & (ends[at[1:]] == ends[at[:-1]]) & (ends[prev[1:]] == ends[prev[:-1]])
    fresh = np.flatnonzero(~follows)
    i, j = at[fresh], prev[fresh]
    most = np.where(j >= 0, np.minimum(ends[i] - i, ends[np.maximum(j, 0)] - j), 0)
    got, steps = np.zeros(len(i), np.int64), np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
    go = np.flatnonzero(most > 0)
    while len(go):
        x, y = key[i[go] + got[go]], key[j[go] + got[go]]
        diff = x ^ y
        odd = diff != 0
        got[go] += np.where(odd, 7 - np.searchsorted(steps, diff, side="right"), 8)
        go = go[~odd & (got[go] < most[go])]
    got = np.minimum(got, most)
    run = np.cumsum(~follows) - 1
    each = got[run] - (at - at[fresh[run]])
    out = np.zeros(n, np.int64)
    out[at] = np.maximum(each, 0)
    return out[order]


def repeated_starts(passages: list, window: int):
    """Whether each window start of the distinct ``passages`` (bytes) has the same bytes as another, in one array."""
    import numpy as np

    text = np.frombuffer(b"".join(passages), np.uint8)
    stops = np.cumsum([len(x) for x in passages])
    ends = np.repeat(stops, [len(x) for x in passages])
    place = np.arange(len(text))
    order = suffix_order(text, window)
    order = order[ends[order] - order >= window]
    same = common_prefixes(text, order, ends) >= window
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    return hit[ends - place >= window]


def _blocks(batches):
    """(ids, texts, extra) of at most about ``BLOCK_BYTES`` bytes of texts, or of one text."""
    from .wordhash import text_bytes

    ids, texts, extra, n = [], [], [], 0
    for batch in batches:
        more = batch.column(2) if batch.num_columns > 2 else None
        for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)):
            ids.append(i)
            texts.append(t)
            extra.append(None if more is None else more[k])
            n += len(t)
            if n >= BLOCK_BYTES:
                yield ids, texts, extra
                ids, texts, extra, n = [], [], [], 0
    if ids:
        yield ids, texts, extra


def _pieces(texts, window: int):
    """(row, place, anchor hash, first window, last window, row's base) of all passages, and the buffer that positions count in."""
    import numpy as np

    size = np.array([len(t) for t in texts])
    long = np.flatnonzero(size >= window)
    if not len(long):
        return None
    buffer = b"".join(texts[k] for k in long)
    ends = np.cumsum(size[long])
    p, first, last, h = anchors(np.frombuffer(buffer, np.uint8), ends.tolist(), window)
    at = np.searchsorted(ends, first, side="right")
    row, base = long[at], (ends - size[long])[at]
    return (row, p - base, h[p], first, last, base), buffer


def _batch(rows):
    import pyarrow as pa

    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _held(parts):
    """Lists of some of the (ids, columns) of ``parts``, each of about ``HELD_ROWS`` rows."""
    held, n = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= HELD_ROWS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _note(held: dict, key, i: int, start: int, n: int, again: list, weight: int = 1) -> bool:
    """Count one more place of ``key``; whether it is the first, held as [id, start, windows, weight]. Repeats go to ``again``.

    Weight 1: one place so far; 2: several. A first place is told to ``again`` when a second comes.
    """
    old = held.get(key)
    if old is None:
        held[key] = [i, start, n, weight]
        if weight > 1:
            again.append((i, start, n))
        return True
    if (old[0], old[1]) != (i, start):
        again.append((i, start, n))
        if old[3] == 1:
            again.append(tuple(old[:3]))
            old[3] = 2
    return False


def _single(shard: list, window: int) -> tuple:
    """(ids, starts, counts) of repeated windows in the passages (text, id, start, weight) that stand in one place."""
    import numpy as np

    hit = repeated_starts([x[0] for x in shard], window)
    stops = np.cumsum([len(x[0]) - window + 1 for x in shard])
    base = np.append(0, stops[:-1])
    at = np.flatnonzero(hit)
    which = np.searchsorted(stops, at, side="right")
    single = np.array([x[3] for x in shard])[which] == 1
    at, which = at[single], which[single]
    ids, starts = (np.array([x[c] for x in shard], np.int64) for c in (1, 2))
    return ids[which], starts[which] + at - base[which], np.ones(len(at), np.int64)


def _by_bucket(batches):
    """[(kind, raw)] of each bucket, from packed rows sorted by bucket."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    now, held = None, []
    for batch in batches:
        for b, k, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != now and held:
                yield held
                held = []
            now = b
            held.append((k, open_(blob)))
    if held:
        yield held


def _dealt(ids, columns, buckets: int, squeeze):
    """Packed rows of (id, columns) by the bucket of the id."""
    import numpy as np

    with np.errstate(over="ignore"):
        own = (((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((columns[0], ids, own))
    own, ids, columns = own[order], ids[order], [c[order] for c in columns]
    cut = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
    return [(int(own[a]), 0, squeeze(_pack(ids[a:b], *(c[a:b] for c in columns)))) for a, b in zip(cut, cut[1:], strict=False)]


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept); kept is binary.

    Every byte covered by a ``window``-byte string that also starts anywhere else, in the same or
    another document, is removed, all copies alike; strings may overlap and are judged on the input.
    n_spans counts maximal removed runs. Null and empty texts have no bytes. A row with a null id is
    compared with nothing and keeps its bytes; rows that share an id count as one document, so equal
    starts in them are the same start. An empty table gives an empty result; other columns are
    ignored.
    """
    if window < 2 * GRAM:
        raise ValueError(f"windows of fewer than {2 * GRAM} bytes have too few pieces for an anchor")
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = docs.where("id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / BUCKET_BYTES))

    def sent(batches):
        """Sorted anchors by bucket: (hash, id, place)."""
        import numpy as np
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress

        def packed(parts):
            doc, place, h = (np.concatenate(c) for c in zip(*parts, strict=True))
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((place, doc, h, bucket))
            doc, place, h, bucket = doc[order], place[order], h[order], bucket[order]
            edge = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
            return _batch([(int(bucket[a]), 0, squeeze(_pack(np.diff(h[a:b], prepend=np.uint64(0)), doc[a:b], place[a:b]))) for a, b in zip(edge, edge[1:], strict=False)])

        def found():
            for ids, texts, _ in _blocks(batches):
                got = _pieces(texts, window)
                if got is not None:
                    row, place, h = got[0][:3]
                    yield np.array(ids, np.int64)[row], place, h

        yield from map(packed, _held(found()))

    def shared(batches):
        """(id, place and whether it is hot) of anchors that stand in several places."""
        import numpy as np

        for held in _by_bucket(batches):
            runs, sums = [], []
            for _, raw in held:
                (steps, doc, place), _ = _unpack(raw, "uii")
                h = np.cumsum(steps, dtype=np.uint64)
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])
                runs.append((h, doc, place))
                sums.append(np.unique(h[new], return_counts=True))
            keys, n = merged(sums)
            for h, doc, place in runs:
                k = n[np.searchsorted(keys, h)]
                yield doc[k > 1], 2 * place[k > 1] + (k[k > 1] > HOT)

    def passages(batches):
        """Distinct passages by bucket (kind 1), windows of hot anchors by bucket (2), repeats by id (0).

        What is held more than once is repeated; it goes out once, marked so.
        """
        import numpy as np
        import xxhash
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        wide = np.int64(1 << PLACE_BITS)

        def out(held, again):
            parts = {}
            for (kind, key, text), (i, start, n, weight) in held.items():
                parts.setdefault((int.from_bytes(key[:8], "little") % buckets, kind), []).append((key, i, start, n, weight, text))
            rows = []
            for (bucket, kind), found in parts.items():
                key, *cols, text = zip(*found, strict=True)
                keys = np.frombuffer(b"".join(key), "<u8").reshape(len(key), -1).T
                rows.append((bucket, kind, squeeze(_pack(*keys, *(np.array(c, np.int64) for c in cols)) + b"".join(text))))
            if again:
                i, start, n = (np.array(c, np.int64) for c in zip(*again, strict=True))
                rows += _dealt(i, [start, n], buckets, squeeze)
            return _batch(rows)

        held, again, size = {}, [], 0
        for ids, texts, hits in _blocks(batches):
            own = [k for k, x in enumerate(hits) if x.is_valid]
            got = _pieces([texts[k] for k in own], window) if own else None
            if got is None:
                continue
            (row, place, h, first, last, base), buffer = got
            marks = [np.asarray(hits[k].values) for k in own]
            known = np.concatenate([i * wide + (x >> 1) for i, x in enumerate(marks)])
            at = np.minimum(np.searchsorted(known, row * wide + place), len(known) - 1)
            ours = np.flatnonzero(known[at] == row * wide + place)
            hot = (np.concatenate(marks)[at] & 1).astype(bool)[ours].tolist()
            doc = np.array([ids[k] for k in own], np.int64)[row[ours]].tolist()
            keys, start = h[ours].astype("<u8").tobytes(), (first - base)[ours].tolist()
            for k, (i, a, b, s, many) in enumerate(zip(doc, first[ours].tolist(), last[ours].tolist(), start, hot, strict=True)):
                if many:
                    for w in range(a, b + 1):
                        size += 16 * _note(held, (2, xxhash.xxh3_128_digest(buffer[w : w + window]), b""), i, s + w - a, 1, again)
                else:
                    size += (b - a + window) * _note(held, (1, keys[8 * k : 8 * k + 8], buffer[a : b + window]), i, s, b - a + 1, again)
            if size >= HELD_BYTES or len(again) >= HELD_ROWS:
                yield out(held, again)
                held, again, size = {}, [], 0
        if held:
            yield out(held, again)

    def compared(batches):
        """(id, start, windows) of repeats, from the passages and windows of whole buckets."""
        import numpy as np

        for held in _by_bucket(batches):
            own, once = {}, {}
            for kind, raw in held:
                if kind == 0:
                    yield tuple(_unpack(raw, "iii")[0])
                    continue
                cols, text = _unpack(raw, "u" * kind + "iiii")
                keys, rest = list(zip(*(c.tolist() for c in cols[:kind]), strict=True)), [c.tolist() for c in cols[kind:]]
                again, at = [], 0
                for key, i, start, n, weight in zip(keys, *rest, strict=True):
                    size = (n + window - 1) * (kind == 1)
                    _note(own if kind == 1 else once, (key, text[at : at + size]), i, start, n, again, weight)
                    at += size
                if again:
                    yield tuple(np.array(c, np.int64) for c in zip(*again, strict=True))
            by_key = {}
            for (key, text), (i, start, _, weight) in own.items():
                by_key.setdefault(key, []).append((text, i, start, weight))
            shard, size = [], 0
            for found in by_key.values():
                if len(found) > 1:
                    shard += found
                    size += sum(len(x[0]) for x in found)
                if size >= SHARD_BYTES:
                    yield _single(shard, window)
                    shard, size = [], 0
            if shard:
                yield _single(shard, window)

    def by_document(found):
        """The stage that packs what ``found`` yields, (ids, columns), by the bucket of the id."""

        def run(batches):
            import numpy as np
            import zstandard

            squeeze = zstandard.ZstdCompressor(level=3).compress
            for parts in _held(found(batches)):
                ids, *cols = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield _batch(_dealt(ids, cols, buckets, squeeze))

        return run

    def gathered(names):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for held in _by_bucket(batches):
                ids, *cols = (np.concatenate(x) for x in zip(*(_unpack(raw, "i" + "i" * len(names))[0] for _, raw in held), strict=True))
                order = np.lexsort((cols[0], ids))
                ids = ids[order]
                cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                stops = np.append(cut, len(ids)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[cut]), *(pa.ListArray.from_arrays(stops, pa.array(c[order])) for c in cols)], names=["id", *names])

        return run

    def kept(batches):
        import numpy as np
        import pyarrow as pa

        from .wordhash import text_bytes

        for batch in batches:
            sizes, gone, spans, out = [], [], [], []
            for k, text in enumerate(text_bytes(batch.column(1))):
                sizes.append(len(text))
                if not batch.column(2)[k].is_valid:
                    gone.append(0)
                    spans.append(0)
                    out.append(text)
                    continue
                start, n = (np.asarray(batch.column(c)[k].values) for c in (2, 3))
                edge = np.zeros(len(text) + 1, np.int64)
                inside = start < len(text)  # rows that share an id may be shorter
                np.add.at(edge, start[inside], 1)
                np.add.at(edge, np.minimum(start + n - 1 + window, len(text))[inside], -1)
                cut = np.cumsum(edge[:-1]) > 0
                out.append(np.frombuffer(text, np.uint8)[~cut].tobytes())
                gone.append(int(cut.sum()))
                spans.append(int((cut[1:] & ~cut[:-1]).sum() + cut[:1].sum()))
            counts = (pa.array(c, pa.int64()) for c in (sizes, gone, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(out, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    def dealt(packed):
        return packed.repartition("bucket").sortWithinPartitions("bucket")

    by_id = named.repartition("id")  # both joins read this one shuffle of the texts
    hits = dealt(dealt(named.mapInArrow(tidy(sent), PACKED)).mapInArrow(tidy(by_document(shared)), PACKED)).mapInArrow(tidy(gathered(["ps"])), "id long, ps array<long>")
    flagged = by_id.join(hits, "id", "left").select("id", "text", "ps")
    spans = dealt(dealt(flagged.mapInArrow(tidy(passages), PACKED)).mapInArrow(tidy(by_document(compared)), PACKED)).mapInArrow(tidy(gathered(["ps", "ns"])), "id long, ps array<long>, ns array<long>")
    done = by_id.join(spans, "id", "left").select("id", "text", "ps", "ns")
    none = F.lit(None).cast("array<long>")
    nameless = docs.where("id is null").select("id", "text", none, none)
    out = done.union(nameless).mapInArrow(tidy(kept), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
