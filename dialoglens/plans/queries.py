"""All registered queries. Importing a module registers what it defines."""

from dialoglens.plans import alert_queries, evaluation_queries, pipeline_queries, report_queries, stream_queries, text_queries  # noqa: F401
from dialoglens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
