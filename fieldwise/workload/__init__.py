"""Queries over the given tables; importing this package registers all of them."""

from . import checks, decisions, evidence, governance, matching, outputs, structure, workbooks  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
