"""Sinks: the only place where plans reach storage.

Every function takes an explicit plan or routed table; nothing here runs unless called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .actions import survivors


def write_plan(plan: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a plan table (partitioned by action type, so a consumer reads only its part)."""
    plan.write.mode(mode).partitionBy("action_type").parquet(path)


def write_routed(routed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Data-level move: rows land under ``route=<rule>`` folders (from :func:`actions.route`)."""
    routed.write.mode(mode).partitionBy("route").parquet(path)


def write_survivors(inventory: DataFrame, plan: DataFrame, path: str, execute: bool = False,
                    mode: str = "overwrite") -> DataFrame:
    """Data-level delete: rewrite the table without the rows an executed delete removes.

    ``execute=False`` only returns the survivors; with ``execute=True`` they are written to
    ``path`` (a new location: the input is never overwritten while it is being read).
    """
    kept = survivors(inventory, plan)
    if execute:
        kept.write.mode(mode).parquet(path)
    return kept
