"""Rule-catalog checks over rule sets stored as JSON text (V1-V22 as one job).

Input: ``ruleset, rules_json`` -- one rule set per row, as written in a rules file. The text is
parsed into a VARIANT, so wrong *types* stay visible: ``schema_of_variant`` reports ``STRING``,
``BIGINT``, ``BOOLEAN``, ``OBJECT<...>``, ``ARRAY<...>`` or ``VOID`` (JSON null) per field, and a
missing field is NULL. Rule sets explode to rules, rules to conditions; every check is a column
predicate and only the regex check runs Python, once per distinct pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parse_duration, parse_size
from ..functions.conditions import ACTION_TYPES, CONDITION_KEYS
from .catalog import MAX_DESCRIPTION_LEN, MAX_NAME_LEN, UNSAFE_TARGET_PARTS, UNSAFE_TARGET_PREFIX, _regex_error

FLAGS = ("case_sensitive", "check_archive", "is_directory", "delete_unpacked_on_match")
OUT = ["ruleset", "rule_num", "rule_id", "check", "detail"]


def _type(v: str, path: str) -> Column:
    """JSON type of a field of variant column ``v`` (NULL when the field is missing)."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _present(t: Column) -> Column:
    return t.isNotNull() & (t != "VOID")


def _err(check: str, detail: Column | str, when: Column) -> Column:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.struct(F.lit(check).alias("check"), d.alias("detail")))


def rule_checks_json(catalog: DataFrame, ruleset: str = "ruleset", text: str = "rules_json") -> DataFrame:
    """Every error of every rule set: ``ruleset, rule_num, rule_id, check, detail``."""
    v = catalog.select(F.col(ruleset).alias("ruleset"), F.try_parse_json(text).alias("v"))
    v = v.withColumn("arr", F.try_variant_get("v", "$", "array<variant>"))
    set_level = v.select("ruleset", F.lit(None).cast("int").alias("rule_num"), F.lit(None).cast("string").alias("rule_id"),
                         F.explode(F.filter(F.array(
                             _err("V1", "rule set must be a list of rules", F.col("arr").isNull()),
                             _err("V2", "rule set is empty", F.size("arr") == 0)), lambda c: c.isNotNull())).alias("c"))

    rules = v.select("ruleset", F.posexplode("arr").alias("pos", "r")).withColumn("rule_num", F.col("pos") + 1)
    name_t = _type("r", "$.name")
    name = F.when(name_t == "STRING", F.try_variant_get("r", "$.name", "string"))
    rules = rules.select("ruleset", "rule_num", "r", F.schema_of_variant("r").alias("rt"), name_t.alias("name_t"),
                         name.alias("name"))
    rid = F.when(F.length(F.trim("name")) > 0, F.col("name")).otherwise(F.concat(F.lit("#"), F.col("rule_num").cast("string")))
    rules = rules.withColumn("rule_id", rid)
    not_obj = rules.filter(~F.coalesce(F.col("rt").startswith("OBJECT"), F.lit(False)))
    bad_type = not_obj.select("ruleset", "rule_num", F.concat(F.lit("#"), F.col("rule_num").cast("string")).alias("rule_id"),
                              F.struct(F.lit("V3").alias("check"),
                                       F.concat(F.lit("rule must be a mapping, got "), F.coalesce("rt", F.lit("null"))).alias("detail")).alias("c"))
    objs = rules.filter(F.coalesce(F.col("rt").startswith("OBJECT"), F.lit(False)))

    desc_t, cond_t, act_t = _type("r", "$.description"), _type("r", "$.conditions"), _type("r", "$.action")
    atype_t, target_t = _type("r", "$.action.type"), _type("r", "$.action.target")
    atype = F.when(atype_t == "STRING", F.try_variant_get("r", "$.action.type", "string"))
    target = F.when(target_t == "STRING", F.try_variant_get("r", "$.action.target", "string"))
    act_empty = (~_present(act_t)) | ((act_t == "STRING") & (F.try_variant_get("r", "$.action", "string") == "")) \
        | (act_t == "OBJECT<>") | (act_t == "BOOLEAN") & ~F.try_variant_get("r", "$.action", "boolean")
    act_obj = F.coalesce(act_t.startswith("OBJECT"), F.lit(False)) & ~act_empty
    target_truthy = _present(target_t) & ~((target_t == "STRING") & (target == ""))
    suspicious = target.startswith(UNSAFE_TARGET_PREFIX) | F.exists(F.split(target, "/"), lambda p: p.isin(*UNSAFE_TARGET_PARTS))
    cond_obj = F.coalesce(cond_t.startswith("OBJECT"), F.lit(False))
    checks = [
        _err("V4", F.concat(F.lit("name must be text, got "), F.col("name_t")), _present(F.col("name_t")) & (F.col("name_t") != "STRING")),
        _err("V5", "name cannot be empty", F.col("name").isNotNull() & (F.trim("name") == "")),
        _err("V6", F.concat(F.lit("name too long ("), F.length("name").cast("string"), F.lit(" chars)")),
             F.length("name") > MAX_NAME_LEN),
        _err("V7", "description must be text of limited length",
             _present(desc_t) & ((desc_t != "STRING")
                                 | (F.length(F.try_variant_get("r", "$.description", "string")) > MAX_DESCRIPTION_LEN))),
        _err("V8", F.concat(F.lit("conditions must be a mapping, got "), cond_t), cond_t.isNotNull() & ~cond_obj),
        _err("V9", "rule has no condition", ~cond_t.isNotNull() | (cond_t == "OBJECT<>")),
        _err("V15", "rule has no action", act_empty),
        _err("V16", F.concat(F.lit("action must be a mapping, got "), act_t), ~act_empty & ~act_obj),
        _err("V17", "action has no type", act_obj & (~_present(atype_t) | (atype == ""))),
        _err("V18", F.concat(F.lit("unknown action type "), F.coalesce(atype, atype_t)),
             act_obj & _present(atype_t) & (F.coalesce(atype, F.lit("?")) != "") & ~F.coalesce(atype.isin(*ACTION_TYPES), F.lit(False))),
        _err("V19", F.concat(F.lit("'"), atype, F.lit("' needs a target")),
             act_obj & F.coalesce(atype.isin("move", "compress"), F.lit(False)) & ~target_truthy),
        _err("V20", F.concat(F.lit("target must be text, got "), target_t), act_obj & target_truthy & (target_t != "STRING")),
        _err("V21", "target path looks unsafe", act_obj & F.coalesce(target_truthy & suspicious, F.lit(False))),
    ] + [_err("V22", f"'{f}' must be boolean", _present(_type("r", f"$.{f}")) & (_type("r", f"$.{f}") != "BOOLEAN"))
         for f in FLAGS]
    # a rule whose conditions are not a mapping is not checked further (as a rules-file check stops)
    stop = cond_t.isNotNull() & ~cond_obj
    rule_level = objs.select("ruleset", "rule_num", "rule_id", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c"))
    stopped = objs.filter(stop).select("ruleset", "rule_num")
    rule_level = (rule_level.join(stopped.withColumn("_stop", F.lit(True)), ["ruleset", "rule_num"], "left")
                  .filter(~F.coalesce("_stop", F.lit(False)) | F.col("c.check").isin("V4", "V5", "V6", "V7", "V8"))
                  .drop("_stop"))

    conds = objs.filter(cond_obj).select("ruleset", "rule_num", "rule_id", F.explode(
        F.try_variant_get("r", "$.conditions", "map<string,variant>")).alias("key", "val"))
    vt = F.schema_of_variant("val")
    sval = F.when(~(vt.startswith("OBJECT") | vt.startswith("ARRAY")), F.try_variant_get("val", "$", "string"))
    conds = conds.withColumn("vt", vt).withColumn("sval", sval)
    patterns = (conds.filter((F.col("key") == "regex") & F.col("sval").isNotNull()).select(F.col("sval").alias("pattern"))
                .distinct().withColumn("regex_error", _regex_error("pattern")))
    conds = conds.join(patterns, conds.sval == patterns.pattern, "left")
    known, key = F.col("key").isin(*CONDITION_KEYS), F.col("key")
    empty = (F.col("vt") == "VOID") | (F.col("sval") == "")
    compound = F.col("vt").startswith("OBJECT") | F.col("vt").startswith("ARRAY")
    ok = known & ~empty & ~compound
    cond_checks = F.array(
        _err("V10", F.concat(F.lit("unknown condition '"), key, F.lit("'")), ~known),
        _err("V11", F.concat(F.lit("condition '"), key, F.lit("' is empty")), known & empty),
        _err("V11", F.concat(F.lit("condition '"), key, F.lit("' must be a single value")), known & ~empty & compound),
        _err("V12", F.concat(F.lit("bad size '"), F.col("sval"), F.lit("' for '"), key, F.lit("'")),
             ok & key.isin("larger", "smaller") & parse_size("sval").isNull()),
        _err("V13", F.concat(F.lit("bad duration '"), F.col("sval"), F.lit("' for '"), key, F.lit("'")),
             ok & key.isin("older", "newer") & parse_duration("sval").isNull()),
        _err("V14", F.concat(F.lit("bad regex '"), F.col("sval"), F.lit("': "), F.col("regex_error")),
             ok & (key == "regex") & F.col("regex_error").isNotNull()),
    )
    cond_level = conds.select("ruleset", "rule_num", "rule_id",
                              F.explode(F.filter(cond_checks, lambda c: c.isNotNull())).alias("c"))
    out = set_level.unionByName(bad_type).unionByName(rule_level).unionByName(cond_level)
    return out.select("ruleset", F.col("rule_num").cast("int").alias("rule_num"), "rule_id",
                      F.col("c.check").alias("check"), F.col("c.detail").alias("detail"))
