"""All registered queries."""

from queries import clean, history, indicators, scores, tables  # noqa: F401
from queries.core import REGISTRY

__all__ = ["REGISTRY"]
