"""fieldtally: analytics over crop-protection experiment logs, written for PySpark.

A log holds one row per run, season and field plot (or one row per plot and
day).  Every operator is a function from DataFrame to DataFrame; nothing is
executed until the caller runs an action.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
