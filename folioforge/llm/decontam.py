"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Texts are compared as words (runs without ASCII white space, A-Z lower-cased). Every run of
``GRAM`` words of a test item is a possible seed. One pass over all documents counts the items'
words. A seed is rare if its words' shares of all words make it a chance event below ``CHANCE`` a
position, or at or below the median of its item. (How often a seed itself occurs says nothing: a
leaked item's seeds are frequent.) A second pass finds rare seeds and aligns the words around them
with the item's words locally, in the task that holds the document; the score is the alignment's
share of a perfect one, so edited and partly copied items score below 1 in proportion.

The items are the stated query set: they are taken in blocks of at most ``BLOCK_SEEDS`` seeds (one
item at least), each of which is sent to every executor and meets all documents. No text, and no
list of a document's candidates, is shuffled, so neither a common seed nor a hot document is more
than work for its own task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, tidy, written

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
CHANCE = 1e-6
#: Seeds in one block of items; bounds what is sent to an executor.
BLOCK_SEEDS = 1_000_000


def smith_waterman(a, b) -> tuple[int, int]:
    """(best local score, end position in b) of two integer word arrays."""
    import numpy as np

    n = len(b)
    cols = np.arange(n, dtype=np.int32)
    h, best, end = np.zeros(n + 1, np.int32), 0, 0
    for w in a:
        t = np.maximum(0, np.maximum(h[:-1] + np.where(b == w, MATCH, MISMATCH), h[1:] + GAP))
        row = np.maximum.accumulate(t - GAP * cols) + GAP * cols
        h = np.concatenate([[0], np.maximum(row, 0)]).astype(np.int32)
        k = int(h.argmax())
        if h[k] > best:
            best, end = int(h[k]), k
    return best, end


def aligned(item, own, ps) -> tuple[int, int]:
    """Best (score, end word) of an item around the seed positions ps (sorted) of a document."""
    import numpy as np

    n, best = len(item), (0, 0)
    for stretch in np.split(ps, np.flatnonzero(np.diff(ps) > 2 * n) + 1):
        lo, hi = max(0, int(stretch[0]) - 2 * n), int(stretch[-1]) + 2 * n + GRAM
        score, end = smith_waterman(item, own[lo:hi])
        best = max(best, (score, lo + end))
    return best


class Items:
    """A block of items as word numbers (from 1), and its seeds; ``rare`` chooses those to look for."""

    def __init__(self, ids: list, texts: list):
        import numpy as np

        number: dict = {}
        codes = [np.fromiter((number.setdefault(w, len(number) + 1) for w in ws), np.int32, len(ws)) for ws in texts]
        self.words = list(number)
        self.ids = np.array(ids, np.int64)
        self.size = np.array([len(c) for c in codes])
        self.codes, self.start = np.concatenate(codes), np.cumsum(self.size) - self.size
        each = [np.unique(np.lib.stride_tricks.sliding_window_view(c, GRAM), axis=0) for c in codes]
        self.owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
        self.grams = np.concatenate(each)

    def rare(self, counts) -> None:
        """Keep the rare seeds, by counts of the words (0: any other), as a table of keys."""
        import numpy as np

        share = np.log(np.where(counts > 0, counts, 0.5) / max(1, counts.sum()))
        chance = share[self.grams].sum(1)
        cut = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        middle = np.array([np.median(chance[a:b]) for a, b in zip(cut, cut[1:], strict=False)])
        keep = (chance <= middle[self.owner] + 1e-9) | (chance <= np.log(CHANCE))
        grams, which = np.unique(self.grams[keep], axis=0, return_inverse=True)
        owner, which = self.owner[keep], which.ravel()
        turn = 0
        while True:  # factors under which no two seeds share a key
            turn += 1
            factors = np.array([0x9E3779B97F4A7C15 * (2 * k + 2 * turn + 1) ** 3 & (1 << 64) - 1 for k in range(GRAM)], np.uint64) | np.uint64(1)
            keys = self._key(grams, factors)
            if len(np.unique(keys)) == len(keys):
                break
        order = np.argsort(keys)
        self.factors, self.keys, self.seeds = factors, keys[order], grams[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[which], kind="stable")
        self.of = owner[by]  # items of seed k: of[edge[k] : edge[k + 1]]
        self.edge = np.searchsorted(place[which][by], np.arange(len(order) + 1))
        self.grams = self.owner = None

    @staticmethod
    def _key(grams, factors):
        import numpy as np

        with np.errstate(over="ignore"):
            h = (grams.astype(np.uint64) * factors).sum(axis=-1, dtype=np.uint64)
        return h ^ (h >> np.uint64(29))

    def found(self, flat):
        """(position, seed) of every rare seed in an array of word numbers."""
        import numpy as np

        live = np.flatnonzero((flat[:-2] > 0) & (flat[1:-1] > 0) & (flat[2:] > 0)) if len(flat) >= GRAM else np.empty(0, np.int64)
        if not len(live) or not len(self.keys):
            return live[:0], live[:0]
        grams = np.stack([flat[live + k] for k in range(GRAM)], axis=1)
        at = np.minimum(np.searchsorted(self.keys, self._key(grams, self.factors)), len(self.keys) - 1)
        ok = (self.seeds[at] == grams).all(1)
        return live[ok], at[ok]

    def matches(self, own, ps, seeds, threshold: float):
        """(item, score, end word, seeds) of the items that a document holds.

        An item of which less than ``threshold`` of the words are in the document cannot reach it,
        so it is not aligned.
        """
        import numpy as np

        n = self.edge[seeds + 1] - self.edge[seeds]
        item = self.of[np.repeat(self.edge[seeds] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(ps, n)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        names, cut = np.unique(item, return_index=True)
        if not len(names):
            return
        here = np.zeros(len(self.words) + 1, bool)
        here[own] = True
        here[0] = False
        size = self.size[names]
        words = self.codes[np.repeat(self.start[names] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        present = np.add.reduceat(here[words].astype(np.int64), np.cumsum(size) - size)
        for k, a, b in zip(range(len(names)), cut, [*cut[1:], len(item)], strict=True):
            if present[k] < threshold * size[k]:
                continue
            i, where = names[k], np.unique(at[a:b])
            score, end = aligned(self.codes[self.start[i] : self.start[i] + self.size[i]], own, where)
            share = score / (MATCH * int(self.size[i]))
            if share >= threshold:
                yield int(self.ids[i]), share, end, len(where)


def _numbered(batches, words: list):
    """(ids, first row, [word numbers of a document, ...]) of blocks of documents; 0 is any other word."""
    from itertools import repeat

    import numpy as np

    from .wordhash import blocks, text_bytes

    number = {w: k + 1 for k, w in enumerate(words)}
    for ids, texts in batches:
        for first, docs in blocks(text_bytes(texts), lower=True):
            yield ids, first, [np.fromiter(map(number.get, ws, repeat(0)), np.int32, len(ws)) for ws in docs]


def _nothing():
    return (F.lit(0).cast(t).alias(c) for c, t in (("item", "long"), ("score", "double"), ("at_word", "long"), ("n_seeds", "long")))


def _lower_words(column: str):
    return F.expr(f"filter(split(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\\\t-\\\\r]+'), w -> w <> '')")


def _block_matches(docs: DataFrame, block: DataFrame, threshold: float) -> DataFrame:
    """(id, item, score, at_word, n_seeds) of all documents against one bounded block of items."""
    import numpy as np

    spark = docs.sparkSession
    rows = block.orderBy("item", "words").toArrow()
    if not rows.num_rows:
        return docs.limit(0).select("id", *_nothing())
    items = Items(rows["item"].to_pylist(), [[w.encode() for w in ws] for ws in rows["words"].to_pylist()])
    words = spark.sparkContext.broadcast(items.words)

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(len(words.value) + 1, np.int64)
        for _, _, parts in _numbered(((None, b.column(0)) for b in batches), words.value):
            np.add.at(counts, np.concatenate(parts), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["w", "n"])

    counts = np.zeros(len(items.words) + 1, np.int64)
    # one row for each distinct word of the block: bounded as the block is
    for r in docs.select("text").mapInArrow(tidy(counted), "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():
        counts[r["w"]] = r["n"]
    items.rare(counts)
    table = spark.sparkContext.broadcast(items)

    def matched(batches):
        import numpy as np
        import pyarrow as pa

        items = table.value
        for ids, first, parts in _numbered(((b.column(0).to_numpy(zero_copy_only=False), b.column(1)) for b in batches), items.words):
            # documents are set apart by GRAM zeros
            size = np.array([len(p) + GRAM for p in parts])
            start = np.cumsum(size) - size
            flat = np.zeros(int(size.sum()), np.int32)
            for s, p in zip(start, parts, strict=True):
                flat[s : s + len(p)] = p
            at, seeds = items.found(flat)
            row = np.searchsorted(start, at, side="right") - 1
            out = []
            for k, a, b in zip(*(x.tolist() for x in _runs(row)), strict=True):
                out += [(int(ids[first + k]), *m) for m in items.matches(parts[k], at[a:b] - start[k], seeds[a:b], threshold)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["id", "item", "score", "at_word", "n_seeds"])

    return docs.mapInArrow(tidy(matched), "id long, item long, score double, at_word long, n_seeds long")


def _runs(x):
    """(value, start, end) of the runs of a sorted array."""
    import numpy as np

    names, start = np.unique(x, return_index=True)
    return names, start, np.append(start, len(x))[1:]


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, score, at_word, n_seeds): documents that hold an item, one row per pair.

    score is between ``threshold`` and 1; at_word is the word after the aligned stretch and n_seeds
    counts the rare seed occurrences. Null and empty texts, items of fewer than ``GRAM`` words and
    rows with a null id match nothing. Documents, and items, that share an id are judged each by
    its own text, and the best of them counts. Empty tables give an empty result; other columns
    are ignored. Texts are read whole, whatever their length.
    """
    bounded_batches(df.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), _lower_words(f"coalesce(`{item_text_col}`, '')").alias("words"))
    items = written(items.where(F.col("item").isNotNull() & (F.size("words") >= GRAM)).distinct(), "items")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    n = items.agg(F.sum(F.size("words") - GRAM + 1)).first()[0] or 0
    found = docs.limit(0).select("id", *_nothing())
    blocks = -(-n // BLOCK_SEEDS)
    for b in range(blocks):
        found = found.union(_block_matches(docs, items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b), threshold))
    drop_written(items)
    best = found.groupBy("id", "item").agg(F.max(F.struct("score", "at_word", "n_seeds")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.score", "b.at_word", "b.n_seeds")
