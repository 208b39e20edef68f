"""Registered queries and the SQL they are checked against."""

from . import chat_queries, eval_queries, flow_queries, io_queries, mix_queries, text_queries, token_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
