"""Rules: the ordered list a user writes, normalised once on the driver.

A rule set is small configuration (a validated file is at most 10 MB); it is compiled into
Column expressions, never shipped row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    idx: int
    conditions: dict = field(default_factory=dict)
    action_type: str | None = None
    target: str | None = None
    name: str | None = None
    case_sensitive: bool = False
    check_archive: bool = False
    is_directory: bool = False
    delete_unpacked_on_match: bool = False

    def __hash__(self):
        return hash((self.idx, self.name, self.action_type, self.target))


def _flag(v) -> bool:
    return bool(v) if v is not None else False


def to_rules(rules) -> list[Rule]:
    """Accept a list of rule dicts (the user format) or already-built :class:`Rule` objects."""
    out = []
    for i, r in enumerate(rules):
        if isinstance(r, Rule):
            out.append(r)
            continue
        action = r.get("action") or {}
        if not isinstance(action, dict):
            action = {}
        conds = r.get("conditions") or {}
        out.append(Rule(
            idx=i,
            conditions=dict(conds) if isinstance(conds, dict) else {},
            action_type=action.get("type"),
            target=action.get("target"),
            name=r.get("name"),
            case_sensitive=_flag(r.get("case_sensitive")),
            check_archive=_flag(r.get("check_archive")),
            is_directory=_flag(r.get("is_directory")),
            delete_unpacked_on_match=_flag(r.get("delete_unpacked_on_match")),
        ))
    return out


def as_of_micros(as_of) -> int:
    """Reference instant as epoch microseconds; a naive datetime or 'YYYY-MM-DD' string is UTC."""
    if isinstance(as_of, int):
        return as_of
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return int(as_of.timestamp() * 1_000_000)


RULES_SCHEMA = T.StructType([
    T.StructField("rule_idx", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("conditions", T.MapType(T.StringType(), T.StringType())),
    T.StructField("action_type", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("case_sensitive", T.BooleanType()),
    T.StructField("check_archive", T.BooleanType()),
    T.StructField("is_directory", T.BooleanType()),
    T.StructField("delete_unpacked_on_match", T.BooleanType()),
])


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    """The rule list as a (small) table with the documented schema."""
    rows = [(r.idx, r.name, {k: str(v) for k, v in r.conditions.items()}, r.action_type, r.target,
             r.case_sensitive, r.check_archive, r.is_directory, r.delete_unpacked_on_match)
            for r in to_rules(rules)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rules_from_frame(df: DataFrame) -> list[Rule]:
    """The rules of a rules table, as configuration: their number does not grow with the data."""
    out = []
    for r in df.orderBy("rule_idx").collect():
        out.append(Rule(idx=int(r["rule_idx"]), conditions=dict(r["conditions"] or {}),
                        action_type=r["action_type"], target=r["target"], name=r["name"],
                        case_sensitive=_flag(r["case_sensitive"]), check_archive=_flag(r["check_archive"]),
                        is_directory=_flag(r["is_directory"]),
                        delete_unpacked_on_match=_flag(r["delete_unpacked_on_match"])))
    return out
