"""Named queries and their SQL twins."""

from __future__ import annotations


def _modules():
    from quern.plans import data_core, labelling, repositories, scoring, streams

    return [data_core, scoring, repositories, labelling, streams]


def all_queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return all_queries()["file_malicious_score"](spark, sf_dir)
