"""Registered queries, each beside DuckDB SQL for the same rows."""

from . import evaluation, filings  # noqa: F401  (they register)
from .queries import QUERIES, SQL  # noqa: F401
