"""Registered queries of the retrieval operators, each with its oracle SQL where SQL has one."""

from . import answering, chunks, evaluation, maintenance, search, texts  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
