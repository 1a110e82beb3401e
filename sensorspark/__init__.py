"""PySpark-native operators for sensor count time-series.

Every operator takes DataFrames and returns a DataFrame built from Spark SQL expressions.
"""

from sensorspark.schema import Roles

__all__ = ["Roles"]
