"""lakerules: rule-driven file-lifecycle analytics over inventory tables, on Spark.

Inventories (one row per file or directory) are matched against ordered rules and turned into
plan tables; nothing touches storage unless a plan is handed to a sink.
"""

__version__ = "0.1.0"
