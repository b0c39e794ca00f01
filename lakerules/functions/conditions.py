"""Rule conditions as Spark predicates (F1-F13) and the regex bridge.

A condition never sees Python at run time unless its regex cannot be expressed for Java's
engine; then an Arrow-batched ``pandas_udf`` runs Python's ``re.match`` on that column only.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import _c, py_parse_duration, py_parse_size

# The condition keys and action types a rule may use.
CONDITION_KEYS = ("start", "end", "contain", "regex", "larger", "smaller", "older", "newer")
ACTION_TYPES = ("move", "delete", "compress")
# Evaluation order inside one rule: literal comparisons, then string tests, regex last.
EVAL_ORDER = ("larger", "smaller", "older", "newer", "start", "end", "contain", "regex")


# --- F1-F3: name text --------------------------------------------------------------------------

def _fold(c: Column, value: str, case_sensitive: bool, folded=None):
    """(name, value) as compared: lower-cased on both sides unless case-sensitive. ``folded`` is
    an already lower-cased name column (computed once per row instead of once per rule)."""
    if case_sensitive:
        return c, F.lit(value)
    return (_c(folded) if folded is not None else F.lower(c)), F.lower(F.lit(value))


def cond_start(name, value: str, case_sensitive: bool = False, folded=None) -> Column:
    n, v = _fold(_c(name), value, case_sensitive, folded)
    return F.startswith(n, v)


def cond_end(name, value: str, case_sensitive: bool = False, folded=None) -> Column:
    n, v = _fold(_c(name), value, case_sensitive, folded)
    return F.endswith(n, v)


def cond_contain(name, value: str, case_sensitive: bool = False, folded=None) -> Column:
    n, v = _fold(_c(name), value, case_sensitive, folded)
    return F.contains(n, v)


# --- F4: regex, anchored at the start only -----------------------------------------------------

def _rewrite_escapes(p: str) -> str | None:
    """Python-only syntax -> Java syntax; None when there is no faithful rewrite."""
    out, i = [], 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            out.append("\\z" if nxt == "Z" else p[i:i + 2])
            i += 2
            continue
        if p.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if p.startswith("(?P=", i):
            j = p.find(")", i)
            if j < 0:
                return None
            out.append("\\k<" + p[i + 4:j] + ">")
            i = j + 1
            continue
        if p.startswith("(?(", i):
            return None  # conditional groups: no Java equivalent
        out.append(ch)
        i += 1
    return "".join(out)


def java_match_pattern(pattern: str, case_sensitive: bool) -> str | None:
    """Java pattern that accepts exactly the names ``re.match(pattern, name)`` accepts.

    ``d`` = only '\\n' ends a line (as in Python), ``U`` = Unicode classes for \\w \\d \\s,
    ``iu`` = Unicode case folding when insensitive; ``\\A(?:...)`` anchors at the start only.
    """
    body = _rewrite_escapes(pattern)
    if body is None:
        return None
    flags = "dU" if case_sensitive else "dUiu"
    return f"(?{flags})\\A(?:{body})"


_java_ok: dict[str, bool] = {}


def _java_accepts(spark: SparkSession | None, jpat: str) -> bool:
    """Check on the cluster's regex engine that a pattern compiles (one tiny driver query)."""
    if spark is None:
        return True
    if jpat not in _java_ok:
        try:
            spark.range(1).select(F.lit("x").rlike(jpat).alias("m")).collect()
            _java_ok[jpat] = True
        except Exception:  # invalid for Java: fall back to Python's engine
            _java_ok[jpat] = False
    return _java_ok[jpat]


def _python_match_udf(pattern: str, ignorecase: bool):
    flags = re.IGNORECASE if ignorecase else 0

    @F.pandas_udf(T.BooleanType())
    def py_match(s: pd.Series) -> pd.Series:
        rx = re.compile(pattern, flags)
        return s.map(lambda x: None if x is None else rx.match(x) is not None)

    return py_match


def cond_regex(name, pattern: str, case_sensitive: bool = False, spark: SparkSession | None = None) -> Column:
    re.compile(pattern)  # a pattern Python rejects is a rule error, raised on the driver
    jpat = java_match_pattern(pattern, case_sensitive)
    if jpat is not None and _java_accepts(spark, jpat):
        return _c(name).rlike(jpat)
    return _python_match_udf(pattern, not case_sensitive)(_c(name))


# --- F5-F8: size and age ------------------------------------------------------------------------

def cond_larger(size, value) -> Column:
    return _c(size) > F.lit(py_parse_size(value))


def cond_smaller(size, value) -> Column:
    return _c(size) < F.lit(py_parse_size(value))


def cond_older(mtime, value, as_of_micros: int) -> Column:
    """age >= n, written as ``mtime <= as_of - n`` so the bound is a literal that pushes down."""
    bound = as_of_micros - py_parse_duration(value) * 1_000_000
    return _c(mtime) <= F.timestamp_micros(F.lit(bound))


def cond_newer(mtime, value, as_of_micros: int) -> Column:
    """age <= n  <=>  mtime >= as_of - n."""
    bound = as_of_micros - py_parse_duration(value) * 1_000_000
    return _c(mtime) >= F.timestamp_micros(F.lit(bound))


# --- F9 / F10: conjunction -----------------------------------------------------------------------

def conditions_predicate(conditions: dict, case_sensitive: bool = False, *, name="name", size="size",
                         mtime="mtime", as_of_micros: int = 0, spark: SparkSession | None = None,
                         folded=None) -> Column:
    """AND of every known condition (unknown keys are ignored, as by the matcher); none -> TRUE.

    A NULL input (unknown size or time) makes the predicate NULL, which ``WHERE`` and
    ``CASE WHEN`` treat as no match. It is deliberately not wrapped in ``coalesce``: the bare
    comparisons are what Parquet pushdown understands.
    """
    parts = []
    for key in EVAL_ORDER:  # cheapest first; AND is order-free, so the answer does not change
        if key not in conditions:
            continue
        value = conditions[key]
        if isinstance(value, (list, dict)) or value is None:
            raise ValueError(f"Condition '{key}' must be a scalar")
        value = str(value) if not isinstance(value, str) else value
        if key == "start":
            parts.append(cond_start(name, value, case_sensitive, folded))
        elif key == "end":
            parts.append(cond_end(name, value, case_sensitive, folded))
        elif key == "contain":
            parts.append(cond_contain(name, value, case_sensitive, folded))
        elif key == "regex":
            parts.append(cond_regex(name, value, case_sensitive, spark))
        elif key == "larger":
            parts.append(cond_larger(size, value))
        elif key == "smaller":
            parts.append(cond_smaller(size, value))
        elif key == "older":
            parts.append(cond_older(mtime, value, as_of_micros))
        elif key == "newer":
            parts.append(cond_newer(mtime, value, as_of_micros))
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a & b, parts)


# --- F11-F14: gates on the row itself --------------------------------------------------------

def kind_gate(is_directory, rule_is_directory: bool) -> Column:
    return F.coalesce(_c(is_directory), F.lit(False)) == F.lit(bool(rule_is_directory))


def not_hidden(name) -> Column:
    return ~F.coalesce(F.startswith(_c(name), F.lit(".")), F.lit(False))


def no_hidden_component(rel) -> Column:
    return ~F.coalesce(_c(rel).rlike(r"(^|/)\."), F.lit(False))


def not_path(path, excluded: str | None) -> Column:
    if excluded is None:
        return F.lit(True)
    return F.coalesce(_c(path) != F.lit(excluded), F.lit(True))


# --- the same predicates as SQL text (one JVM call for a whole rule list) -----------------------

def sql_str(v: str) -> str:
    """A Spark SQL string literal for any text (backslashes and quotes escaped)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_col(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def conditions_sql(conditions: dict, case_sensitive: bool = False, *, name="name", size="size", mtime="mtime",
                   as_of_micros: int = 0, spark: SparkSession | None = None, folded=None) -> str | None:
    """SQL text of :func:`conditions_predicate`; None when a regex needs Python's engine."""
    n = sql_col(name)
    nf = n if case_sensitive else (sql_col(folded) if folded else f"lower({n})")
    parts = []
    for key in EVAL_ORDER:
        if key not in conditions:
            continue
        value = conditions[key]
        if isinstance(value, (list, dict)) or value is None:
            raise ValueError(f"Condition '{key}' must be a scalar")
        value = str(value) if not isinstance(value, str) else value
        lit = sql_str(value) if case_sensitive else f"lower({sql_str(value)})"
        if key == "start":
            parts.append(f"startswith({nf}, {lit})")
        elif key == "end":
            parts.append(f"endswith({nf}, {lit})")
        elif key == "contain":
            parts.append(f"contains({nf}, {lit})")
        elif key == "regex":
            re.compile(value)
            jpat = java_match_pattern(value, case_sensitive)
            if jpat is None or not _java_accepts(spark, jpat):
                return None
            parts.append(f"{n} rlike {sql_str(jpat)}")
        elif key == "larger":
            parts.append(f"{sql_col(size)} > {py_parse_size(value)}L")
        elif key == "smaller":
            parts.append(f"{sql_col(size)} < {py_parse_size(value)}L")
        elif key == "older":
            parts.append(f"{sql_col(mtime)} <= timestamp_micros({as_of_micros - py_parse_duration(value) * 1_000_000}L)")
        elif key == "newer":
            parts.append(f"{sql_col(mtime)} >= timestamp_micros({as_of_micros - py_parse_duration(value) * 1_000_000}L)")
    return " AND ".join(f"({p})" for p in parts) if parts else "true"
