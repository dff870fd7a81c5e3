"""Registered queries over the test tables and their SQL."""

from __future__ import annotations

from . import corpus, predictions, registry, storage


def queries():
    return registry.wrapped(corpus.QUERIES | predictions.QUERIES | storage.QUERIES)


def oracle_sql():
    return corpus.SQL | predictions.SQL | storage.SQL
