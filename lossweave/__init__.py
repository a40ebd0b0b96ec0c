"""Spark-native cohort-risk and credit-loss analytics."""

from .config import Protocol

__all__ = ["Protocol"]
