"""Registered queries: every operator run over the driver tables, with its SQL counterpart."""

from checks import registry
from checks import activity, cohorts, contributors, labels, learning, robust, series, statistics, streams  # noqa: F401

queries = registry.queries
oracle_sql = registry.oracle_sql
