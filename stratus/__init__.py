"""stratus: telemetry-cost analytics and model-operations on Spark.

Every operator is a plain function that takes DataFrames (and small
parameter values) and returns a DataFrame; nothing runs until an action.
"""

__version__ = "0.1.0"
