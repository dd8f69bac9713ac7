"""Compute-fleet telemetry analytics on Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame. The clock
(``as_of``), the look-back length and the rule limits are arguments.
"""

from fleetlens.config import Thresholds
from fleetlens.sources.tables import Tables

__all__ = ["Tables", "Thresholds"]
