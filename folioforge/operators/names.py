"""Names, duplicates, resumption and library items."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import file_url_path
from ..session import dropped, kept


#: Rows of one stem, or numbered stems of one root, counted together when ranks are made.
RUN = 1 << 16


def ranked(rows: DataFrame, keys: list, order: list, out: str, weight=None) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` (1 for each row) over earlier rows of the same keys.

    Rows are sorted over all tasks by a range partition; sums of each key and partition are added up
    first, so that a key with any share of the rows is spread. ``order`` must name each row.
    """
    part, at, sums, before = "_part", "_at", "_sum", "_before"
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = kept(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ranked")
    # runs of RUN rows of one partition, so that no window is longer than that
    run = F.shiftrightunsigned(F.col(at).bitwiseAND(F.lit((1 << 33) - 1)), 16)
    w = F.lit(1) if weight is None else weight
    placed = placed.withColumn("_run", run)
    per = placed.groupBy(*keys, part, "_run").agg(F.sum(w).alias(sums))
    along = Window.partitionBy(*keys).orderBy(part, "_run").rowsBetween(Window.unboundedPreceding, -1)
    per = kept(per.withColumn(before, F.coalesce(F.sum(sums).over(along), F.lit(0))).drop(sums), "runs")
    inner = Window.partitionBy(*keys, part, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn(out, F.coalesce(F.sum(w).over(inner), F.lit(0)))
    match = [own[k].eqNullSafe(per[k]) for k in keys] + [own[part] == per[part], own["_run"] == per["_run"]]
    joined = own.join(per, reduce(and_, match)).select(*(own[c] for c in rows.columns), (own[out] + per[before]).alias(out))
    return joined


def unique_names(df: DataFrame, stem: str, order: str, group: str) -> DataFrame:
    """Adds name: the stem, or the first free of stem_2, stem_3, ... as if rows were named in ``order`` within ``group`` (a target folder).

    A name x can be wanted by rows of stem x, of which only the first can get it, and by rows of its
    root, the stem that x is a number of (a_2 of a). So the n-th row of a stem gets its n-th name
    that is not blocked, and a number is blocked if a row of that very stem came before the row that
    would reach it. How many numbers below are blocked decides which row reaches a number, so the
    blocked ones are found in rounds of ranks: a round takes the blocked numbers of the last, counts
    them below each number and decides anew, until none changes. A stem that is itself a number may
    lose its own name to its root, and then is one name short. ``order`` must differ within a group
    and not be null; a null stem is an empty one. Ranks and counts are made by range sorts, so no
    group, root or stem is one task.
    """
    spark, cols = df.sparkSession, df.columns
    key, own = ["_g", "_s"], r"^(.*)_([1-9][0-9]{0,8})$"
    folder = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("n"))  # null is a folder of its own
    rows = df.withColumns({"_g": folder, "_s": F.coalesce(stem, F.lit("")), "_o": F.col(order)})
    rows = kept(ranked(rows, key, ["_o"], "_rank"), "names")
    stems = rows.groupBy(*key).agg(F.min("_o").alias("_first"), F.count("*").alias("_n"))
    root = F.regexp_extract("_s", own, 1)
    number = F.regexp_extract("_s", own, 2).try_cast("long")
    stems = kept(stems.withColumns({"_root": F.when(number >= 2, root), "_k": F.when(number >= 2, number)}), "stems")
    parents = stems.select(F.col("_g").alias("_pg"), F.col("_s").alias("_ps"), F.col("_n").alias("_pn"))
    # numbers that a row of the root may reach, and where in the root's order their own stem begins
    pairs = stems.join(parents, stems["_g"].eqNullSafe(parents["_pg"]) & (stems["_root"] == parents["_ps"])).select("_g", "_root", "_k", "_first", "_s", "_pn")
    pairs = kept(pairs, "pairs")
    if pairs.isEmpty():
        return rows.select(*cols, _nth(F.col("_s"), F.col("_rank") + 1).alias("name"))
    marks = pairs.select("_g", F.col("_root").alias("_s"), F.col("_first").alias("_o"), F.col("_k"), F.lit(0).alias("_row"))
    lane = rows.join(pairs.select("_g", F.col("_root").alias("_s")).distinct(), key, "left_semi").select("_g", "_s", "_o", F.lit(None).cast("long").alias("_k"), F.lit(1).alias("_row"))
    earlier = ranked(lane.union(marks), key, ["_o", "_row"], "_reach", F.col("_row")).where("_row = 0").select("_g", F.col("_s").alias("_root"), "_k", "_reach")
    pairs = pairs.select("_g", "_root", "_k", "_s", "_pn").join(earlier, ["_g", "_root", "_k"])
    # a stem loses its own name if its root reaches that number first: the number is then not blocked
    state = kept(pairs.withColumns({"_blocked": F.lit(False), "_lost": F.lit(False)}), "blocked")
    while True:
        nxt = _round(state)
        changed = nxt.join(state.select("_g", "_root", "_k", F.col("_blocked").alias("_was"), F.col("_lost").alias("_had")), ["_g", "_root", "_k"]).where("_blocked <> _was or _lost <> _had").limit(1).count()
        dropped(state)
        state = nxt
        if not changed:
            break
    return _named(rows, state, cols)


def _nth(stem, k) -> Column:
    """The k-th name of a stem."""
    return F.when(k == 1, stem).otherwise(F.concat(stem, F.lit("_"), k.cast("string")))


def _losers(state: DataFrame) -> DataFrame:
    """(_g, _root, _lost1): stems that are numbers of a root and lost their own name to it."""
    return state.where("_lost").select("_g", F.col("_s").alias("_root"), F.lit(1).alias("_lost1"))


def _round(state: DataFrame) -> DataFrame:
    """Which numbers are blocked, and which stems lose their name, by the blocked numbers and lost names of ``state``.

    Number k of a root is reached by its row k - 1 - (blocked numbers below k) - (1 if the root lost its own name),
    counted from 0; it is blocked if its own stem begins before that row, or no such row is.
    """
    below = ranked(state, ["_g", "_root"], ["_k"], "_below", F.col("_blocked").cast("long"))
    lost = below.join(_losers(state), ["_g", "_root"], "left")
    # a root that lost its own name is one name short, so each number is reached one row sooner
    reach = F.col("_k") - 1 - F.col("_below") - F.coalesce("_lost1", F.lit(0))
    taken = (reach < F.col("_reach")) & (reach < F.col("_pn"))
    out = lost.select("_g", "_root", "_k", "_s", "_pn", "_reach", (~taken).alias("_blocked"), taken.alias("_lost"))
    return kept(out, "blocked")


def _named(rows: DataFrame, state: DataFrame, cols: list) -> DataFrame:
    """The n-th row of a stem gets its n-th name that is not blocked."""
    blocked = kept(ranked(state.where("_blocked"), ["_g", "_root"], ["_k"], "_below").select("_g", F.col("_root").alias("_s"), (F.col("_k") - 1 - F.col("_below")).alias("_slot")), "slots")
    lost = _losers(state).withColumnRenamed("_root", "_s")
    shifted = rows.join(lost, ["_g", "_s"], "left").withColumn("_slot", F.col("_rank") + F.coalesce("_lost1", F.lit(0)))
    # blocked numbers at or below the one a row would get: those whose slot is not beyond the row's
    events = shifted.select("_g", "_s", "_slot", F.lit(1).alias("_row"), F.col("_o")).union(blocked.select("_g", "_s", "_slot", F.lit(0), F.lit(None).cast(rows.schema["_o"].dataType)))
    counted = ranked(events, ["_g", "_s"], ["_slot", "_row", "_o"], "_skip", 1 - F.col("_row")).where("_row = 1").select("_g", "_s", "_o", "_skip")
    both = shifted.join(counted, shifted["_g"].eqNullSafe(counted["_g"]) & (shifted["_s"] == counted["_s"]) & shifted["_o"].eqNullSafe(counted["_o"]))
    return both.select(*(shifted[c] for c in cols), _nth(shifted["_s"], shifted["_slot"] + counted["_skip"] + 1).alias("name"))


def first_of(df: DataFrame, keys: list, order) -> DataFrame:
    """The first row of each key by ``order``; partial aggregation, so a hot key costs one row a task."""
    cols = F.struct(*df.columns)
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(cols, order).alias("r")).select("r.*")


def pending(docs: DataFrame, done: DataFrame, key: str = "source") -> DataFrame:
    """Documents not yet done."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def library_candidates(items: DataFrame, children: DataFrame, marker: str = "parsed-md:") -> DataFrame:
    """One row per PDF attachment path: (item_key, pdf_path, title, authors, year, already_parsed).

    ``items``: ord, item_key, title, date, creators (array of names); ``children``: item_key, ord,
    item_type, content_type, note, file_url. The first item of a path keeps it; an item counts as
    parsed if one of its notes holds the marker.
    """
    parsed = children.where((F.col("item_type") == "note") & F.col("note").contains(marker)).select("item_key").distinct().withColumn("already_parsed", F.lit(True))
    files = children.where("content_type = 'application/pdf'").select("item_key", F.col("ord").alias("child_ord"), file_url_path("file_url").alias("pdf_path")).where("pdf_path <> ''")
    rows = items.join(files, "item_key").join(parsed, "item_key", "left")
    year = F.when(F.substring("date", 1, 4).rlike("^[0-9]{4}$"), F.substring("date", 1, 4).cast("int"))
    authors = F.array_join(F.filter("creators", lambda a: a.isNotNull() & (a != "")), ", ")
    rows = rows.select("item_key", "pdf_path", F.coalesce("title", F.lit("")).alias("title"), authors.alias("authors"), year.alias("year"), F.coalesce("already_parsed", F.lit(False)).alias("already_parsed"), F.struct("ord", "child_ord").alias("o"))
    return first_of(rows, ["pdf_path"], F.col("o")).drop("o")
