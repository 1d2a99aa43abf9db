"""Dust and soiling analytics for solar plants, expressed as Spark DataFrame operators."""

from dustspark.session import build_session

__all__ = ["build_session"]
