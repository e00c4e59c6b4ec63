"""All named queries; importing the modules registers them."""

from . import queries_answers, queries_files, queries_instruct, queries_jobs, queries_prompts, queries_text, queries_vectors  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
