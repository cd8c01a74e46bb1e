"""Genres: confidences as expressions, the most confident one wins, the earlier one in a tie."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.pytext import col


@dataclass(frozen=True)
class Genre:
    """A genre: its confidence from (doc_type, sample), passage sizes and hints."""

    id: str
    confidence: Callable[[Column, Column], Column]
    window: int = 300
    overlap: int = 50
    extra_noise: tuple = ()
    hint: str = ""
    layout: str = "article"
    meta: dict = field(default_factory=dict)


_GENRES: dict[str, Genre] = {}


def register_genre(genre: Genre) -> None:
    _GENRES[genre.id] = genre


def available_genres() -> list[str]:
    return sorted(_GENRES)


def genre(name: str | None) -> Genre:
    """The named genre; academic_article for an unknown or missing name."""
    return _GENRES.get(name or "", _GENRES["academic_article"])


def _academic(kind: Column, sample: Column) -> Column:
    return F.when(kind.rlike("academic|paper|report|article"), 0.9).otherwise(0.5)


def _book(kind: Column, sample: Column) -> Column:
    s = F.lower(sample)
    has = lambda test, score: F.when(test, score).otherwise(0.0)
    contents = F.left(s, F.lit(4000)).contains("table of contents") | F.left(s, F.lit(2000)).contains("contents")
    total = has(s.rlike(r"\bchapter\s+[ivxlc\d]"), 0.5) + has(contents, 0.2) + has(F.left(s, F.lit(2000)).contains("isbn"), 0.2) + has(s.rlike(r"\bpart\s+[ivxlc\d]"), 0.1)
    return F.when(kind.contains("book"), 0.95).otherwise(F.round(F.least(total, F.lit(0.95)), 6))


def _legal(kind: Column, sample: Column) -> Column:
    s = F.lower(F.left(sample, F.lit(3000)))
    return F.when(kind.contains("legal") | kind.contains("act"), 0.9).when(s.contains("whereas") | s.contains("enacted by"), 0.6).otherwise(0.0)


register_genre(Genre("academic_article", _academic))
register_genre(Genre("book", _book, 150, 30, hint="Chapters are split by rule; do not plan the book as one document.", layout="book"))
register_genre(Genre("legal_act", _legal, 250, 40, (r"Government Gazette.*", r"No\.\s*\d+ of \d{4}"), "Parts, chapters, numbered sections and schedules of a statute; subsections are level 2.", "sections"))


def confidences(doc_type, sample) -> dict[str, Column]:
    kind, text = F.lower(F.coalesce(col(doc_type), F.lit(""))), F.coalesce(col(sample), F.lit(""))
    return {g.id: g.confidence(kind, text).cast("double") for g in _GENRES.values()}


def routed(doc_type, sample, override=None) -> Column:
    """The genre id: an override as given, else the highest confidence, the first in a tie."""
    scores = confidences(doc_type, sample)
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    pick = F.coalesce(*(F.when(s == best, F.lit(g)) for g, s in scores.items()))
    return pick if override is None else F.coalesce(F.nullif(col(override), F.lit("")), pick)
