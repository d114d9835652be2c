"""All registered queries of the library and the SQL they are checked against."""

from __future__ import annotations

from . import corpus, models, pages, social  # noqa: F401
from .registry import QUERIES, SQL, Query

flagship = corpus.flagship


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
