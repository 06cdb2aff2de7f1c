"""All queries of the header engine by name, with their SQL."""

from __future__ import annotations

from . import base, headers, models  # noqa: F401  models registers its queries


def flagship(spark, sf_dir):
    return headers.flagship(spark, sf_dir)


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
