"""Registered queries, by kind of operator."""

from . import (  # noqa: F401
    aggregates,
    filters,
    learning,
    paging,
    records,
    scalars,
    sources,
    stored,
    streams,
    texts,
)
from .registry import ORACLES, QUERIES  # noqa: F401
