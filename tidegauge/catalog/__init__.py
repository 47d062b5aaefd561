"""Registered queries over the test tables and their SQL oracles."""

from tidegauge.catalog import features, models, screening, series, tables  # noqa: F401
from tidegauge.catalog.registry import ORACLES, QUERIES  # noqa: F401
