"""Rule-catalog checks (V1-V22, A10, P13, U3): many rule sets in one table -> one row per error.

Input rows: ``ruleset, rule_idx, name, cond_key, cond_value, action_type, target`` (one row per
condition; a rule without conditions has a single row with NULL ``cond_key``). Checks are column
predicates; only the regex check runs Python (``re.compile``), once per *distinct* pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_duration, parse_size, rule_identifier
from ..functions.conditions import ACTION_TYPES, CONDITION_KEYS

# Length limits and target patterns treated as unsafe.
MAX_NAME_LEN = 200
MAX_DESCRIPTION_LEN = 1000
UNSAFE_TARGET_PREFIX = ".."
UNSAFE_TARGET_PARTS = ["../../../..", "...."]

CHECK_COLS = ["ruleset", "rule_num", "rule_id", "check", "detail"]


@F.pandas_udf(T.StringType())
def _regex_error(p: pd.Series) -> pd.Series:
    def err(x):
        if x is None:
            return None
        try:
            re.compile(x)
            return None
        except re.error as e:
            return str(e)
    return p.map(err)


def rules_flat(rows: DataFrame) -> DataFrame:
    """One row per (ruleset, rule): name, conditions map, action type and target."""
    return (rows.groupBy("ruleset", "rule_idx")
            .agg(F.first("name", ignorenulls=True).alias("name"),
                 F.map_from_entries(F.filter(F.collect_list(F.struct("cond_key", "cond_value")),
                                             lambda e: e["cond_key"].isNotNull())).alias("conditions"),
                 F.first("action_type", ignorenulls=True).alias("action_type"),
                 F.first("target", ignorenulls=True).alias("target")))


def _check(check: str, detail: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), detail.alias("detail")))


def _rule_level(flat: DataFrame) -> DataFrame:
    name, atype, target = F.col("name"), F.col("action_type"), F.col("target")
    n_cond = F.size("conditions")
    suspicious = target.startswith(UNSAFE_TARGET_PREFIX) | F.exists(F.split(target, "/"),
                                                                     lambda p: p.isin(*UNSAFE_TARGET_PARTS))
    checks = F.array(
        _check("V5", F.lit("name cannot be empty"), name.isNotNull() & (F.trim(name) == "")),
        _check("V6", F.concat(F.lit("name too long ("), F.length(name).cast("string"), F.lit(" chars)")),
               F.length(name) > MAX_NAME_LEN),
        _check("V9", F.lit("rule has no condition"), n_cond == 0),
        _check("V15", F.lit("rule has no action"), atype.isNull() & target.isNull()),
        _check("V17", F.lit("action has no type"), (F.coalesce(atype, F.lit("")) == "") & target.isNotNull()),
        _check("V18", F.concat(F.lit("unknown action type '"), atype, F.lit("'")),
               (F.coalesce(atype, F.lit("")) != "") & ~atype.isin(*ACTION_TYPES)),
        _check("V19", F.concat(F.lit("'"), atype, F.lit("' needs a target")),
               atype.isin("move", "compress") & (F.coalesce(target, F.lit("")) == "")),
        _check("V21", F.lit("target path looks unsafe"), F.coalesce(target != "", F.lit(False)) & suspicious),
    )
    return flat.select("ruleset", "rule_idx", "name", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c"))


def _condition_level(rows: DataFrame) -> DataFrame:
    key, val = F.col("cond_key"), F.col("cond_value")
    # one Python call per distinct pattern, joined back
    patterns = (rows.filter(key == "regex").select(val.alias("pattern")).distinct()
                .withColumn("regex_error", _regex_error("pattern")))
    r = rows.filter(key.isNotNull()).join(patterns,
                                          rows.cond_value == patterns.pattern, "left")
    known = key.isin(*CONDITION_KEYS)
    empty = val.isNull() | (val == "")
    checks = F.array(
        _check("V10", F.concat(F.lit("unknown condition '"), key, F.lit("'")), ~known),
        _check("V11", F.concat(F.lit("condition '"), key, F.lit("' is empty")), known & empty),
        _check("V12", F.concat(F.lit("bad size '"), val, F.lit("' for '"), key, F.lit("'")),
               key.isin("larger", "smaller") & ~empty & parse_size(val).isNull()),
        _check("V13", F.concat(F.lit("bad duration '"), val, F.lit("' for '"), key, F.lit("'")),
               key.isin("older", "newer") & ~empty & parse_duration(val).isNull()),
        _check("V14", F.concat(F.lit("bad regex '"), val, F.lit("': "), F.col("regex_error")),
               (key == "regex") & ~empty & F.col("regex_error").isNotNull()),
    )
    return r.select("ruleset", "rule_idx", "name", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c"))


def rule_checks(rows: DataFrame, extra: list[tuple[str, Callable[[DataFrame], Column]]] | None = None) -> DataFrame:
    """Every error of every rule: ``ruleset, rule_num, rule_id, check, detail``.

    ``extra``: user checks ``(name, fn)`` where ``fn(flat_rules) -> Column`` is true for a bad rule.
    """
    flat = rules_flat(rows)
    out = _rule_level(flat).unionByName(_condition_level(rows))
    for name, fn in extra or []:
        out = out.unionByName(flat.filter(F.coalesce(fn(flat), F.lit(False))).select(
            "ruleset", "rule_idx", "name",
            F.struct(F.lit(name).alias("check"), F.lit(f"failed check '{name}'").alias("detail")).alias("c")))
    num = F.col("rule_idx") + 1
    return out.select("ruleset", num.alias("rule_num"), rule_identifier("name", num).alias("rule_id"),
                      F.col("c.check").alias("check"), F.col("c.detail").alias("detail"))


def rule_check_counts(checks: DataFrame, rows: DataFrame) -> DataFrame:
    """Errors per rule set (rule sets without errors report 0)."""
    sets = rows.select("ruleset").distinct()
    n = checks.groupBy("ruleset").agg(F.count(F.lit(1)).alias("n_errors"))
    return sets.join(n, "ruleset", "left").select("ruleset", F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("n_errors"))


def check_flags(flags: dict) -> list[str]:
    """V22 for a rule given as a dict: the four flags must be booleans when present."""
    return [f"'{k}' must be boolean" for k in ("case_sensitive", "check_archive", "is_directory",
                                                "delete_unpacked_on_match")
            if flags.get(k) is not None and not isinstance(flags.get(k), bool)]
