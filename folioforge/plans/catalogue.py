"""Named queries over the sample tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from . import evaluation, names, streams, structure, text, workflows

QUERIES = text.QUERIES | structure.QUERIES | evaluation.QUERIES | names.QUERIES | workflows.QUERIES | streams.QUERIES
ORACLES = text.ORACLES | structure.ORACLES | evaluation.ORACLES | names.ORACLES | workflows.ORACLES | streams.ORACLES
