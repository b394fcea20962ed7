"""All checked queries."""

from . import (  # noqa: F401
    board_queries,
    candle_queries,
    decode_queries,
    log_queries,
    metric_queries,
    scalar_queries,
    stream_queries,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
