"""Importing this module registers every query."""

from . import q_files, q_layer, q_screens, q_streams, q_tables, q_text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
