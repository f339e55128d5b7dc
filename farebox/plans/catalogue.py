"""Every registered query of the transit part with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farebox.plans import choice, estimation, matching, network, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = choice.QUERIES | network.QUERIES | matching.QUERIES | estimation.QUERIES | sequences.QUERIES
ORACLES: dict[str, str] = choice.ORACLES | network.ORACLES | matching.ORACLES | estimation.ORACLES | sequences.ORACLES
