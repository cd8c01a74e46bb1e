"""BPE encoding and decoding over a distinct-word table.

1. Texts are split at ASCII white space, which no token of the vocabulary crosses. Documents are
   gathered in blocks; a block numbers its distinct words. The words, not the texts, are dealt by
   hash to buckets, one row a block and bucket with the words as one text.
2. The task that holds a bucket encodes each of its distinct words once; the ids return to the block
   by the words' numbers, and each text is its row of numbers replaced by the ids at those positions.
3. Decoding joins ids to their pieces: the piece table has one row per vocabulary entry, so its size
   is bounded by the vocabulary file and it is broadcast. ``encode`` joins the ids of a block's
   distinct words, in Arrow columns; ``decode`` joins rows of ids.

The numbers of a text and the ids of words travel as compressed bytes, which keeps the shuffle below
the size of the texts: numbers as plain rows take more disk than the texts themselves. For the same
reason the texts are read twice, for the words and for the numbers, and not written in between. A
block is named by a hash of its rows, so that both readings, and a task that is run again, agree;
input that is not a plain read of files is written first, and a text whose words are missing fails
the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy, written

#: Words of text in one block (one text at least).
BLOCK = 2_000_000
#: Words whose numbers are packed into one row.
PACK = 400_000
#: Distinct words that a task remembers; beyond it a word may be encoded once more.
KNOWN = 2_000_000
#: Plans that give the same rows in the same order each time they are read.
STEADY = {"LogicalRelation", "LocalRelation", "Project", "Filter"}


def _tokenizer(text: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def _pieces(text: str) -> dict:
    """id -> piece of a vocabulary file."""
    import json

    spec = json.loads(text)
    return {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def _packed(numbers) -> bytes:
    """Numbers below 2**32, their low bytes first, then the others: high ones are mostly zero."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(blob: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _steady(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    for node in nodes:
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return plan.deterministic() and all(node.nodeName().split()[0] in STEADY for node in nodes)


def _blocks(batches, distinct: bool):
    """(name, ids, words of each text, distinct words) of blocks of rows (id, text).

    With ``distinct`` only the distinct words, in order of appearance; else also each text's words
    as numbers in that order.
    """
    import numpy as np
    import xxhash

    from .wordhash import text_bytes

    class Numbers(dict):
        def __missing__(self, word):
            n = self[word] = len(self)
            return n

    ids, codes, numbers, name, n = [], [], Numbers(), xxhash.xxh3_64(), 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            words = text.split()
            name.update(f"{i} {len(text)} ".encode())
            name.update(text)
            ids.append(i)
            if distinct:
                numbers.update(dict.fromkeys(words))
            else:
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            n += len(words)
            if n >= BLOCK:
                yield name.intdigest() >> 1, ids, codes, list(numbers)
                ids, codes, numbers, name, n = [], [], Numbers(), xxhash.xxh3_64(), 0
    if ids:
        yield name.intdigest() >> 1, ids, codes, list(numbers)


def _dealt(words: list, buckets: int):
    """(bucket of each word, its place among the block's words of that bucket, words by bucket)."""
    import numpy as np
    import xxhash

    bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words)) - np.searchsorted(bucket[order], bucket[order])
    return bucket, place, order


_WORDS = "blk long, bucket int, words string"
_ROWS = "blk long, bucket int, ids array<long>, ends array<int>, blob binary"


def _word_rows(buckets: int):
    """Rows (blk, bucket, words): the distinct words of a block and bucket, by spaces."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for blk, _, _, words in _blocks(batches, True):
            bucket, _, order = _dealt(words, buckets)
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [int(b) for b in np.flatnonzero(np.diff(edge))]
            texts = [b" ".join([words[k] for k in order[edge[b] : edge[b + 1]].tolist()]) for b in own]
            yield pa.RecordBatch.from_arrays([pa.array([blk] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], names=["blk", "bucket", "words"])

    return run


def _text_rows(buckets: int):
    """Rows (blk, null, ids, ends, numbers) of some texts of a block: number = place * buckets + bucket."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for blk, ids, codes, words in _blocks(batches, False):
            bucket, place, _ = _dealt(words, buckets)
            code = place * buckets + bucket
            first, held = 0, 0
            for k, c in enumerate(codes):
                held += len(c)
                if held >= PACK or k + 1 == len(codes):
                    own = codes[first : k + 1]
                    ends = np.cumsum([len(x) for x in own])
                    cols = [pa.array([blk], pa.int64()), pa.array([None], pa.int32()), pa.array([ids[first : k + 1]], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32())), pa.array([_packed(code[np.concatenate(own)])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["blk", "bucket", "ids", "ends", "blob"])
                    first, held = k + 1, 0

    return run


def _encoded(spec):
    """Rows (blk, bucket, null, ends, ids) from rows of words sorted by bucket."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokenizer = _tokenizer(spec.value)
        many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        known, now = {}, None
        for batch in batches:
            ends, blobs = [], []
            for bucket, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now or len(known) > KNOWN:
                    known, now = {}, bucket
                words = text.split(" ")
                fresh = [w for w in words if w not in known]
                for w, e in zip(fresh, many(fresh, add_special_tokens=False), strict=True):
                    known[w] = e.ids
                found = [known[w] for w in words]
                end = np.cumsum(np.fromiter(map(len, found), np.int32, len(found)))
                ends.append(end)
                blobs.append(_packed(np.fromiter((i for x in found for i in x), np.uint32, int(end[-1]))))
            n = len(blobs)
            cols = [batch.column(0), batch.column(1), pa.array([None] * n, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["blk", "bucket", "ids", "ends", "blob"])

    return run


def _gather(start, size):
    """Positions start, ..., start + size - 1 of every row, one row after another."""
    import numpy as np

    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class _Table:
    """Ids and pieces of a block's distinct words, by number."""

    def __init__(self, parts: list, buckets: int, pieces):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        top = max((b + (len(e) - 1) * buckets for b, e, _ in parts), default=-1) + 1
        self.row = np.full(top, -1, np.int64)  # of a number
        sizes, flat, at = [], [np.zeros(0, np.int64)], 0
        for b, ends, ids in parts:
            self.row[np.arange(len(ends)) * buckets + b] = at + np.arange(len(ends))
            at += len(ends)
            sizes.append(np.diff(ends, prepend=0))
            flat.append(ids)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.ids = np.concatenate(flat)
        joined = pieces["piece"].take(pc.index_in(pa.array(self.ids, pa.int64()), pieces["t"]))  # the id-to-piece join
        ends = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int32)
        self.words = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), joined), " ")

    def texts(self, numbers, ends):
        """(ids, decoded) columns and token counts of texts that end at ``ends`` in ``numbers``."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(numbers) and (numbers.max() >= len(self.row) or (self.row[numbers] < 0).any()):
            raise RuntimeError("texts differ between two readings of the input")
        row = self.row[numbers]
        n = self.size[row]
        tokens = np.concatenate([[0], np.cumsum(n)])
        bounds = tokens[np.concatenate([[0], ends])]
        ids = self.ids[_gather(self.start[row], n)].astype("<u4")
        blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
        some = n > 0  # a word without tokens leaves no piece, and no space
        kept = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], ends])]
        words = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), self.words.take(pa.array(row[some])))
        return blobs, pc.binary_join(words, " "), np.diff(bounds)


def _restored(spec, buckets: int):
    """Rows (id, n_tokens, ids, decoded) from rows sorted by block, those of words first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        by_id = sorted(_pieces(spec.value).items())
        pieces = {"t": pa.array([i for i, _ in by_id], pa.int64()), "piece": pa.array([p for _, p in by_id], pa.string())}
        now, parts, table = None, [], None
        for batch in batches:
            for blk, b, own, ends, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if blk != now:
                    now, parts, table = blk, [], None
                if b is not None:
                    parts.append((b, np.array(ends), _unpacked(blob)))
                    continue
                if table is None:
                    table, parts = _Table(parts, buckets, pieces), []
                ids, decoded, n = table.texts(_unpacked(blob), np.array(ends))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n.astype(np.int64)), ids, decoded], names=["id", "n_tokens", "ids", "decoded"])

    return run


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_tokens, ids, decoded).

    ids holds the token ids as little-endian unsigned 32-bit integers, equal to what the tokenizers
    library gives for the whole text with ``vocabulary`` (a file for that library whose
    pre-tokenizer keeps no white space) without special tokens added, truncation or padding;
    decoded is its decode(ids, skip_special_tokens=False) where the file names no decoder: the
    pieces joined by spaces. Null and empty texts have no tokens and decode to an empty text. Null
    and repeated ids are kept as rows of their own; an empty table gives an empty result; other
    columns are ignored. A text of any length is encoded whole.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not _steady(docs):
        docs = written(docs, "texts")
    words = docs.mapInArrow(tidy(_word_rows(buckets)), _WORDS).repartition("bucket").sortWithinPartitions("bucket")
    both = words.mapInArrow(tidy(_encoded(spec)), _ROWS).union(docs.mapInArrow(tidy(_text_rows(buckets)), _ROWS))
    both = both.repartition("blk").sortWithinPartitions("blk", F.col("bucket").asc_nulls_last())
    return both.mapInArrow(tidy(_restored(spec, buckets)), "id long, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): an array of token ids per row, joined to the piece table by id.

    Ids outside the vocabulary have no piece and are passed over, as the library does; null or
    empty arrays decode to an empty text. Rows are told apart by position, so ids may repeat.
    """
    with open(vocabulary, encoding="utf-8") as f:
        pieces = df.sparkSession.createDataFrame(list(_pieces(f.read()).items()), "t int, piece string")
    own = df.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    own = written(own, "ids")
    named = own.select("r", F.posexplode("ids").alias("p", "t")).join(F.broadcast(pieces), "t")
    ordered = F.array_sort(F.collect_list(F.struct("p", "piece")))
    text = named.groupBy("r").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("decoded"))
    return own.join(text, "r", "left").select(F.col("id").alias(id_col), F.coalesce("decoded", F.lit("")).alias("decoded"))
