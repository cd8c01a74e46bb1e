"""Near-duplicate documents: bottom-k sketches from one hash function, inverted lists, exact Jaccard.

Steps:

1. each document becomes its set of hashed word shingles, a fingerprint of the whole set and the
   ``k`` smallest hashes (the sketch); documents with equal sets form one class at once;
2. retained values are inverted. In the order of rising document frequency, two sets of similarity
   t share one of the first ``s - c + 1`` values of a sketch of s values, where c is the number of
   shared values that they reach but for a 5.5 sigma event; only those values make lists;
3. lists of at most ``LIST`` classes give their pairs (a constant a value). Classes on longer lists
   are taken whole: their full sets are inverted with the exact prefix filter of set joins, short
   lists give pairs, and in a long list all members are paired with one hub (the member with the
   most common shingles). Members of a long list that verified links leave in another component
   than most of that list are then paired with those of the list that their sizes and ranks let
   them reach, so no link is lost. Sizes and ranks are compared once for each that occurs, so
   templates whose copies fall short of the threshold cost no pairs;
4. a union-sketch estimate drops pairs far below the threshold, and the exact Jaccard of the full
   sets decides on the rest; links become components.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, tidy, written
from .components import components

#: Hashes kept for each document.
K = 64
#: Longest inverted list of which all pairs are made.
LIST = 40
#: Classes of more than this part of all rows are broadcast when they meet their rows.
HOT_SHARE = 1000
#: Standard deviations that the number of shared sketch values may fall short of its mean.
SIGMAS = 5.5


def shingle_rows(docs: DataFrame, size: int, k: int, full: bool) -> DataFrame:
    """(id, n, fp, sk) or, with ``full``, (id, n, sh): sorted hashes of the distinct shingles."""
    schema = "id long, n long, sh array<long>" if full else "id long, n long, fp binary, sk array<long>"

    def sets(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        from .wordhash import WordHashes, blocks, text_bytes, window_hashes

        cache = WordHashes()
        for batch in batches:
            ids = batch.column(0)
            for first, docs_words in blocks(text_bytes(batch.column(1)), lower=True):
                flat = cache.array([w for ws in docs_words for w in ws])
                grams = window_hashes(flat, size)
                at, n, fps, out = 0, [], [], []
                for ws in docs_words:
                    if len(ws) >= size:
                        h = grams[at : at + len(ws) - size + 1]
                    else:
                        h = window_hashes(flat[at : at + len(ws)], len(ws)) if ws else grams[:0]
                    at += len(ws)
                    h = np.unique(h.view(np.int64))
                    n.append(len(h))
                    if full:
                        out.append(h)
                    else:
                        fps.append(xxhash.xxh3_128_digest(h.tobytes()))
                        out.append(h[:k])
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in out])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
                cols = [ids.slice(first, len(out)), pa.array(n, pa.int64())] + ([] if full else [pa.array(fps, pa.binary())]) + [lists]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "sh"] if full else ["id", "n", "fp", "sk"])

    return docs.mapInArrow(tidy(sets), schema)


def shared_at_least(s, t: float):
    """Of sketches of s values, the shared values that sets of similarity t reach (a Column of s)."""
    loose = F.floor(s * t - SIGMAS * F.sqrt(s * (t * (1 - t))))
    return F.greatest(F.lit(1), F.when(s <= math.floor(K * t), F.ceil(s * t - 1e-9)).otherwise(loose))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, size: int = 5) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept).

    Two documents are linked when den * |A & B| >= num * |A | B| for their sets of ``size``-word
    shingles (words are runs without ASCII white space, A-Z lower-cased; a shorter text is one
    shingle). Null and empty texts have an empty set and are linked with nothing. component_id is
    the smallest id reachable by links, the row's own included; kept marks the row that has it.
    Rows that share an id count as one document; a null id keeps a null component. An empty table
    gives an empty result; other columns are ignored.
    """
    t = num / den
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = written(shingle_rows(docs, size, K, full=False), "sketches")
    classes = sk.where("n > 0 and id is not null").groupBy("fp").agg(F.min("id").alias("cls"), F.count("*").alias("m"))
    reps = sk.join(classes, (sk.fp == classes.fp) & (sk.id == classes.cls)).select("id", "n", "sk").dropDuplicates(["id"])
    values = sk.where("n > 0").join(classes.select(F.col("cls").alias("id")).distinct(), "id", "left_semi").select("id", "n", F.size("sk").alias("s"), F.explode("sk").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    listed = values.join(common, "v").groupBy("id", "n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    room = (F.col("s") - shared_at_least(F.col("s"), t) + 1 - (F.col("s") - F.size("vs"))).cast("int")
    listed = listed.where(room > 0).select("id", "n", F.explode(F.slice("vs", F.lit(1), room)).alias("x")).select("id", "n", "x.v", "x.df")
    listed = written(listed, "lists")
    pairs = _list_pairs(listed.where(F.col("df") <= LIST), t)

    hot = listed.where(F.col("df") > LIST).select("id").distinct()
    hot_sets = written(shingle_rows(docs.join(hot, "id", "left_semi"), size, K, full=True).dropDuplicates(["id"]), "hotsets")
    flat = hot_sets.select("id", "n", F.explode("sh").alias("v"))
    rows = flat.join(flat.groupBy("v").agg(F.count("*").alias("df")), "v")
    per = rows.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.avg("df").alias("mean_df"))
    prefix = (F.col("n") - F.ceil(F.col("n") * num / den - 1e-9) + 1).cast("int")
    prefixes = per.select("id", "n", "mean_df", F.posexplode(F.slice("vs", F.lit(1), prefix)).alias("rank", "x"))
    prefixes = written(prefixes.select("id", "n", "mean_df", "rank", "x.v"), "hotlists")
    length = prefixes.groupBy("v").agg(F.count("*").alias("m"), F.max_by("id", F.struct("mean_df", -F.col("id"))).alias("hub")).where("m > 1")
    hot_lists = prefixes.join(length, "v")
    short = hot_lists.where(F.col("m") <= LIST)
    long_ = hot_lists.where(F.col("m") > LIST)
    spokes = long_.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    pairs = written(pairs.union(_list_pairs(short, t, ranked=True)).union(spokes).distinct(), "pairs")

    spent = [listed, hot_sets, prefixes, pairs]
    links = written(_verified(pairs, reps, docs, size, num, den, t, spent), "links")
    comp = components(links)
    left = long_.select("v", "id", "n", "rank").join(comp.withColumnRenamed("node", "id"), "id", "left")
    left = written(left.select("v", "id", "n", "rank", F.coalesce("component", "id").alias("c")), "left")
    sizes = left.groupBy("v", "c").agg(F.count("*").alias("w"))
    main = sizes.groupBy("v").agg(F.max_by("c", F.struct("w", "c")).alias("main"), F.count("*").alias("cs")).where("cs > 1")
    minor = written(left.join(main, "v").where("c <> main").select("v", F.col("id").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("c").alias("ca")), "minor")
    others = left.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.col("c").alias("cb"))
    shapes = minor.select("v", "na", "ra").distinct().join(others.select("v", "nb", "rb").distinct(), "v").where(_reach(t))
    rest = minor.join(shapes, ["v", "na", "ra"]).join(others, ["v", "nb", "rb"]).where("ca <> cb")
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    if not rest.isEmpty():
        more = _verified(rest, reps, docs, size, num, den, t, spent)
        comp = components(links.union(more))
    comp = written(comp, "components")
    drop_written(*spent, links, left, minor, rest)

    per_class = classes.join(comp, F.col("cls") == F.col("node"), "left").select("fp", "m", F.coalesce("component", "cls").alias("component_id"))
    per_class = written(per_class, "classes")
    # a class of many copies would be one task of the join: there are at most HOT_SHARE such classes, and they are broadcast
    many = F.col("m") * HOT_SHARE > (sk.count() or 1)
    rows = sk.select(F.col("id"), F.col("n").alias("n_shingles"), "fp")
    rows = rows.join(F.broadcast(per_class.where(many).select("fp", F.col("component_id").alias("hot"))), "fp", "left")
    out = rows.where("hot is null").join(per_class.where(~many).drop("m"), "fp", "left").select("id", "n_shingles", "component_id")
    out = out.union(rows.where("hot is not null").select("id", "n_shingles", "hot"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _reach(t: float):
    """Whether sets of na and nb hashes that first share the hashes at ranks ra and rb can reach t.

    Of a pair that reaches t, the row of its first shared hash always passes, so none is lost.
    """
    after = 1 + F.least(F.col("na") - F.col("ra") - 1, F.col("nb") - F.col("rb") - 1)
    return (F.least("na", "nb") >= F.greatest("na", "nb") * t - 1e-9) & (after >= (F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9)


def _list_pairs(lists: DataFrame, t: float, ranked: bool = False) -> DataFrame:
    """Pairs of ids on the same list that their sizes (and ranks) allow; lists have a bounded length."""
    rank = F.col("rank") if ranked else F.lit(0)
    l = lists.select("v", F.col("id").alias("a"), F.col("n").alias("na"), rank.alias("ra"))
    r = lists.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), rank.alias("rb"))
    return l.join(r, "v").where((F.col("a") < F.col("b")) & _reach(t)).select("a", "b").distinct()


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, num: int, den: int, t: float, spent: list) -> DataFrame:
    """Pairs whose sketches may, and whose full sets do, reach the threshold; ``spent`` gets the tables used."""
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sk").alias("ska"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sk").alias("skb"))
    p = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    union = F.slice(F.array_sort(F.array_union("ska", "skb")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("ska", "skb"), F.col("u")))
    p = p.withColumn("u", union).where(shared >= shared_at_least(F.size("u"), t))
    p = written(p.select("a", "b"), "estimated")
    wanted = p.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(shingle_rows(docs.join(wanted, "id", "left_semi"), size, K, full=True), "sets")
    spent += [p, sets]
    sa = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sh").alias("sa"))
    sb = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("sb"))
    both = p.join(sa, "a").join(sb, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("i") * den >= (F.col("na") + F.col("nb") - F.col("i")) * num).select("a", "b")
