"""Prompts of the language-model stages, as columns; variants are looked up by name at plan time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.pytext import lines
from ..operators.lines import numbered

METADATA = "Read the start of a document. Answer with JSON: title, authors (list), year (integer or null), abstract, source, doi."
SURVEY = "Read the numbered first lines of a document. Answer with JSON: doc_type, languages (list), structure_pattern, structure_notes."
HEADINGS = "Read the numbered lines of a document. Answer with JSON: sections, each with level (1 to 3), title, start_line and end_line."
TRANSCRIBE = "Write the page images down as Markdown, in reading order, pages parted by a line of three dashes, nothing added."
PLAN = "Read the numbered lines of a document. Answer with JSON: sections, each with label, section_id, language, level, start_line and end_line; every line belongs to a section."
VARIANTS = {
    "default": (SURVEY, PLAN),
    "strict": (SURVEY, PLAN + " Use headings exactly as printed and never invent one."),
    "conservative": (SURVEY, PLAN + " Leave the label empty where no heading is printed."),
}


def available_variants() -> list[str]:
    return sorted(VARIANTS)


def variant(name: str) -> tuple[str, str]:
    """(survey, plan) of a variant; KeyError for an unknown name."""
    return VARIANTS[name]


def survey_prompt(text) -> Column:
    return numbered(F.slice(lines(text), 1, 250))


def plan_prompt(text) -> Column:
    return numbered(lines(text))


def plan_system(base: str, doc_type, languages, hint: str = "") -> Column:
    return F.concat_ws("\n", F.lit(base), F.concat(F.lit("Kind of document: "), F.coalesce(doc_type, F.lit("unknown"))), F.concat(F.lit("Languages: "), F.array_join(languages, ", ")), *([F.lit(hint)] if hint else []))


def metadata_prompt(text) -> Column:
    return F.substring(text, 1, 2000)
