"""All queries and their SQL; importing this module registers them."""

from . import chain, ledgers, market, parsing, relational, reports, rules, textual, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
