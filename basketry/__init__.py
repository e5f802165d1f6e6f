"""basketry: a Spark-native rebuild of a retail billing warehouse.

Every operator is a function ``(DataFrames, params) -> DataFrame``; nothing is
collected to the driver. See README.md for the module map.
"""

__version__ = "0.1.0"
