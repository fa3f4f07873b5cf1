"""Imports every module that registers queries."""

from quantloom.plans import q_enforcement, q_market, q_models, q_portfolio, q_reports, q_research, q_sinks, q_sources, q_tuning, q_views  # noqa: F401
from quantloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
