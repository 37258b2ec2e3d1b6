"""All checked queries; importing this package registers them."""

from . import core, evaluate, extras, io, migrate, planning, querylog, search, stats, text  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
