"""Importing the package fills the register of queries."""

from . import catalog, corpus, desk, graphs, schedules, search  # noqa: F401
