"""Queries of the recording, signal, event and epoch operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from sigframe.plans import catalogue, recordings

QUERIES = {**catalogue.QUERIES, **recordings.QUERIES}
ORACLE = {**catalogue.ORACLE, **recordings.ORACLE}
