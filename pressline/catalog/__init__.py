"""All registered queries, by topic."""

from __future__ import annotations

from . import views  # noqa: F401
from . import labelling, modelling, scans, scoring, tracking, turnovers  # noqa: F401
from .bindings import Tables
from .registry import ORACLES, QUERIES, expand


def _bind(build):
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


def queries():
    return {key: _bind(build) for key, build in QUERIES.items()}


def oracle_sql():
    return {key: expand(sql) for key, sql in ORACLES.items()}
