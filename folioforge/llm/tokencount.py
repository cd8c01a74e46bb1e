"""Token counts by section: texts are encoded once and token spans are joined to section spans.

A whole document is encoded once by a byte-level vocabulary; the byte lengths of its tokens give
every token's span, as such tokens cover the text without gaps. Sections are spans of the same
bytes, so the interval join is a search of sorted bounds. A token belongs to the section that holds
its first byte (rule ``first``) or, by rule ``most``, to the one that holds most of its bytes, the
earlier one in a tie; every token is counted once, so the sections' counts add up to the document's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: Fixed value: the split pattern of the byte-level vocabulary of 50,257 entries.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: what that pattern takes as white space (the Unicode property).
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are cut out before the pattern sees the text.
RUN = 1000
_RUN = re.compile(rf"[{SPACES}]{{{RUN},}}")
_ENCODERS: dict = {}


def encoder(ranks: bytes):
    """(encoder, byte length of each id) of a file with a base64 piece and its id per line."""
    import base64

    import numpy as np
    import tiktoken

    key = hash(ranks)
    if key not in _ENCODERS:
        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        size = np.zeros(max(pieces.values()) + 1, np.int64)
        for piece, i in pieces.items():
            size[i] = len(piece)
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={}), size
    return _ENCODERS[key]


def token_ids(encoding, text: str) -> list:
    """Ids of a whole text, equal to the library's.

    The pattern engine recurses over long runs of white space until its stack ends. The pattern
    makes one piece of such a run without its last character, or of all of it at the text's end,
    and no piece before it reaches into it; so the run is encoded as that piece, apart.
    """
    at, out = 0, []
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def attributed(ends, section_ends, rule: str):
    """Section of each token: ends are the tokens' end offsets, section_ends the sections'."""
    import numpy as np

    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    own = np.searchsorted(section_ends, starts, side="right")
    if rule == "most":
        last = np.searchsorted(section_ends, ends, side="left")
        for k in np.flatnonzero(last > own):
            best, most = own[k], -1
            for s in range(own[k], last[k] + 1):
                lo = max(starts[k], section_ends[s - 1] if s else 0)
                part = min(ends[k], section_ends[s]) - lo
                if part > most:
                    best, most = s, part
            own[k] = best
    return own


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_cols: tuple = ("text",), rule: str = "first") -> DataFrame:
    """One row per section: (id, section, field, char_start, char_end, n_tokens, n_crossing).

    The document is the columns ``text_cols`` one after another, null as empty; a section is a line
    of a field with its line feed, so the sections cover the document. A document without text has
    no sections. char_start and char_end are code points of the document, end exclusive; n_crossing
    counts the section's tokens that reach into another one. Null and repeated ids are kept as rows
    of their own; an empty table gives an empty result; texts of any length, runs of one character
    and white space among them, are encoded whole; other columns are ignored.
    """
    if rule not in ("first", "most"):
        raise ValueError("rule is 'first' or 'most'")
    spark = df.sparkSession
    bounded_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    own = df.select(F.col(id_col).cast("long").alias("id"), *(F.coalesce(F.col(c), F.lit("")).alias(f"t{k}") for k, c in enumerate(text_cols)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoding, size = encoder(ranks.value)

        def out(rows):
            ids, counts, parts = zip(*rows, strict=True)
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            names = ["section", "field", "char_start", "char_end", "n_tokens", "n_crossing"]
            who = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
            return pa.RecordBatch.from_arrays([who, *(pa.array(c.astype(np.int64)) for c in cols)], names=["id", *names])

        for batch in batches:
            rows = []
            for i, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = "".join(texts)
                if not whole:
                    continue
                raw = np.frombuffer(whole.encode(), np.uint8)
                line_ends = np.flatnonzero(raw == 10) + 1
                field_ends = np.cumsum([len(t.encode()) for t in texts])
                bounds = np.union1d(line_ends, field_ends[field_ends > 0])
                ends = np.cumsum(size[np.array(token_ids(encoding, whole), np.int64)])
                section = attributed(ends, bounds, rule)
                starts = np.concatenate([[0], ends[:-1]])
                first = np.searchsorted(bounds, starts, side="right")
                crossing = np.searchsorted(bounds, ends, side="left") > first
                n = len(bounds)
                points = np.cumsum((raw & 0xC0) != 0x80)[bounds - 1]
                rows.append((i, n, (np.arange(n), np.searchsorted(field_ends, bounds, side="left"), np.concatenate([[0], points[:-1]]), points, np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n))))
            if rows:
                yield out(rows)

    done = own.mapInArrow(tidy(run), "id long, section long, field long, char_start long, char_end long, n_tokens long, n_crossing long")
    return done.withColumnRenamed("id", id_col)
