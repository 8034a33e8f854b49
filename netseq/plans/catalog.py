"""All registered queries and their SQL."""

from __future__ import annotations

from netseq.plans import evaluation, features, hooks, sequences, tables, trained

_GROUPS = (tables, features, sequences, evaluation, hooks, trained)

QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLE = {name: sql for group in _GROUPS for name, sql in group.ORACLE.items()}
