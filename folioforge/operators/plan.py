"""Section plans over lines: gaps filled, heading paths, sections cut out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pytext import lines, named, strip
from ..functions.strings import section_slug


FIELDS = ("label", "section_id", "language", "level", "start_line", "end_line")


def _maker(plan: DataFrame):
    """(piece, blank): a struct of the plan's fields at place ``o``, and an array of the filler of some lines."""
    kinds = [plan.schema[c].dataType for c in FIELDS]
    piece = lambda o, values, filler: F.struct(o.cast("int").alias("o"), *(v.cast(t).alias(c) for c, t, v in zip(FIELDS, kinds, values, strict=True)), F.lit(filler).alias("filler"))
    blank = lambda o, start, end, name: F.array(piece(o, (F.lit(""), name, F.lit("unknown"), F.lit(1), start, end), True))
    return piece, blank


def _at(line: Column) -> Column:
    return F.concat(F.lit("unlabeled_"), line.cast("string"))


def _reached(plan: DataFrame, key: str) -> DataFrame:
    """Plan rows with ``rank``, ``last``, ``own`` (array: the filler before the row, the row) and ``next``, the first line behind them."""
    piece, blank = _maker(plan)
    order = Window.partitionBy(key).orderBy("start_line", "ord")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    p = plan.withColumns({"reach": reach, "rank": F.row_number().over(order), "last": F.lead(F.lit(False), 1, True).over(order)})
    after = lambda c: F.greatest(F.lit(1), F.coalesce(c + 1, F.lit(1)))
    cursor = after(F.col("reach"))
    between = F.when(F.col("start_line") > cursor, blank(2 * F.col("rank") - 1, cursor, F.col("start_line") - 1, _at(cursor)))
    own = F.flatten(F.array_compact(F.array(between, F.array(piece(2 * F.col("rank"), [F.col(c) for c in FIELDS], False)))))
    return p.select(key, "rank", "last", own.alias("own"), after(F.greatest("reach", "end_line")).alias("next"))


def gaps_filled(plan: DataFrame, totals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Plan rows and fillers in order: (key, section_ord, label, section_id, language, level, start_line, end_line, filler).

    ``plan`` has key, ord, label, section_id, language, level, start_line, end_line; ``totals`` has
    key and n_lines, one row per document. Sections are taken by start (ties by ord); a filler takes
    lines that no earlier section has reached, also after the last; overlaps stay. A document
    without plan becomes one section "body".
    """
    _, blank = _maker(plan)
    rows = _reached(plan, key).join(totals.select(key, "n_lines"), key, "full")
    end = F.col("next")
    tail = F.when(F.col("last") & (end <= F.col("n_lines")), blank(F.lit(1 << 30), end, F.col("n_lines"), _at(end)))
    alone = blank(F.lit(0), F.lit(1), F.col("n_lines"), F.lit("body"))
    parts = F.when(F.col("rank").isNull(), alone).otherwise(F.flatten(F.array_compact(F.array(F.col("own"), tail))))
    rows = rows.select(key, F.explode(parts).alias("s")).select(key, "s.*")
    return rows.withColumn("section_ord", F.row_number().over(Window.partitionBy(key).orderBy("o"))).drop("o")


def heading_paths(plan: DataFrame, key: str = "doc_id", order: str = "section_ord", level: str = "level", title: str = "label") -> DataFrame:
    """Adds heading_path: the titles in force at levels 1 to the row's own (clamped to 3), blanks left out."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l, t = F.greatest(F.lit(1), F.least(F.lit(3), F.col(level))), strip(F.col(title))
    rows = plan.withColumns({"_l": l, "_t": t})
    for k in (1, 2, 3):
        rows = rows.withColumn(f"_t{k}", F.last(F.when(F.col("_l") == k, F.col("_t")), True).over(w)).withColumn(f"_p{k}", F.coalesce(F.max(F.when(F.col("_l") == k, F.col(order))).over(w), F.lit(-1)))
    second = F.when((F.col("_l") >= 2) & (F.col("_p2") > F.col("_p1")), F.col("_t2"))
    third = F.when(F.col("_l") == 3, F.col("_t3"))
    path = F.filter(F.array("_t1", second, third), lambda x: x.isNotNull() & (x != ""))
    return rows.withColumn("heading_path", path).drop("_l", "_t", *(f"_{c}{k}" for c in "tp" for k in (1, 2, 3)))


def with_sections(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", deepest: int = 2, out: str = "sections", keep: tuple = (), gaps: bool = False) -> DataFrame:
    """(id, text, ``keep``, ``out``): documents with their cut sections as one array in the order of the plan; blank ones go.

    ``out`` holds structs of the plan's fields and content. The plan travels to the texts as one array
    a document, so texts are shuffled once and sections not at all. Ranges are clamped to the
    document, inverted ones go, a first line that is a heading is left out whatever its text, and byte
    order marks at line starts are dropped. Levels are clamped to 1..``deepest``; a missing
    section_id comes from the label. A document without plan has no sections, a null text is empty.

    With ``gaps`` the plan is one for ``gaps_filled``, and its gaps are filled here by the lines that the
    text is cut into, with no table of totals.
    """
    if gaps:
        fields = ["section_ord", *FIELDS, "filler"]
        plans = _reached(plan, id_col).groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "own"))), lambda x: x["own"])).alias("_ps"), F.max("next").alias("_next"))
        _, blank = _maker(plan)
    else:
        fields = [c for c in plan.columns if c != id_col]
        first = ["section_ord"] if "section_ord" in fields else []
        fields = [*first, *(c for c in fields if c not in first)]
        plans = plan.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_ps"))
    texts = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), *keep).join(plans, id_col, "left")
    if not gaps:
        texts = texts.withColumn("_ps", F.coalesce("_ps", F.array().cast(plans.schema["_ps"].dataType)))

    def planned(ls):
        """The sections to cut from these lines."""
        if not gaps:
            return F.col("_ps")
        n, end = F.size(ls), F.col("_next")
        alone = F.filter(blank(F.lit(0), F.lit(1), n, F.lit("body")), lambda _: F.col(id_col).isNotNull())
        tail = F.when(end <= n, blank(F.lit(1 << 30), end, n, _at(end)))
        full = F.when(F.col("_ps").isNull(), alone).otherwise(F.flatten(F.array_compact(F.array("_ps", tail))))
        return F.transform(full, lambda p, i: p.withField("section_ord", (i + 1).cast("int")))

    def body(part):
        headed = strip(F.get(part, F.lit(0))).rlike(r"^#{1,6}\s+\S")
        rest = F.when(headed, F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0)))).otherwise(part)
        return F.array(strip(F.array_join(rest, "\n")))

    def cut(ls):
        def one(p):
            start, end = F.greatest(F.lit(1), p["start_line"]), F.least(F.size(ls), p["end_line"])
            part = F.transform(F.slice(ls, start.cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int")), lambda x: F.ltrim(x, F.lit("\ufeff")))
            level = F.greatest(F.lit(1), F.least(F.lit(deepest), p["level"]))
            named_id = F.when(F.coalesce(p["section_id"], F.lit("")) == "", section_slug(p["label"])).otherwise(p["section_id"])
            own = {"level": level, "section_id": named_id}
            return F.struct(*(own.get(c, p[c]).alias(c) for c in fields), F.get(named(part, body), F.lit(0)).alias("content"))

        return F.filter(F.transform(planned(ls), one), lambda s: s["content"] != "")

    # the lines are made once a document
    return texts.select(id_col, text_col, *keep, named(lines(text_col), cut).alias(out))


def cut_sections(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", deepest: int = 2) -> DataFrame:
    """The sections of ``with_sections`` as rows: (id, the plan's fields, content)."""
    rows = with_sections(docs, plan, id_col, text_col, deepest, "_sections")
    return rows.select(id_col, F.explode("_sections").alias("_s")).select(id_col, "_s.*")
