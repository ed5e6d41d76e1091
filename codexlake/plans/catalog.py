"""All query modules, imported so that they register."""

from . import corpus_queries, structure_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus_queries", "structure_queries", "text_queries"]
