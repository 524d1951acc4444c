"""Registered queries of the core, each with the SQL that it is checked against where SQL can say it."""

from __future__ import annotations

from trellis.queries import files, graph, plans, positions, records

QUERIES = {**graph.QUERIES, **files.QUERIES, **plans.QUERIES, **positions.QUERIES, **records.QUERIES}
SQL = {**graph.SQL, **files.SQL, **plans.SQL, **positions.SQL, **records.SQL}
