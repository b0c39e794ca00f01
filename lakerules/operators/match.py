"""Rule matching (J6, J7, W1, A7): every inventory row gets the index of its first matching rule.

Two physical forms with the same answer:

* ``match_rules`` compiles the ordered rules into one ``CASE WHEN`` (first true branch wins). It is
  a pure projection: no shuffle, whole-stage codegen, literal bounds for size and time.
* ``match_rules_indexed`` (``match_rules_join`` for rules in a table) keeps the rules as data: a
  constant array of structs, filed by hash of a prefix, suffix or other key, from which a row reads its
  candidates and tests those. It is a projection as well, whose generated code does not grow with the rules.

``check_archive`` rules also fire when any member of the archive satisfies the conditions. The
members are evaluated map-side into one bit per such rule, OR-ed per archive (partial aggregate
before the shuffle) and joined back only onto archive rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import _c, is_archive, path_of, py_parse_duration, py_parse_size
from ..functions.conditions import (CONDITION_KEYS, _java_accepts, _python_match_udf, conditions_predicate, conditions_sql,
                                    java_match_pattern, kind_gate, sql_col)
from ..functions.rules import Rule, as_of_micros, rules_from_frame, to_rules

BITS_PER_MASK = 62  # bits used per bigint mask column (sign bit kept clear)
RULES_PER_CASE = 40  # rules per CASE chunk (measured best with hugeMethodLimit=8000)
MOST_COMPILED = 80


FOLDED = "__lname"  # lower-cased name, computed once per row for all case-insensitive tests


def _predicate(rule: Rule, spark, as_of: int, name="name", size="size", mtime="mtime", folded=None) -> Column:
    return conditions_predicate(rule.conditions, rule.case_sensitive, name=name, size=size, mtime=mtime,
                                as_of_micros=as_of, spark=spark, folded=folded)


def archive_rules(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.check_archive]


def member_masks(members: DataFrame, rules, as_of, spark: SparkSession | None = None,
                 archive_col: str = "archive", name_col: str = "member") -> DataFrame:
    """Per archive: ``mask_k`` bigint columns, bit j set when some member satisfies the j-th
    ``check_archive`` rule. Only archives with at least one bit are kept."""
    rules = to_rules(rules)
    spark = spark or members.sparkSession
    ca = archive_rules(rules)
    as_of = as_of_micros(as_of)
    has_mtime = "mtime" in members.columns
    m = members if has_mtime else members.withColumn("mtime", F.lit(None).cast("timestamp"))
    n_masks = max(1, (len(ca) + BITS_PER_MASK - 1) // BITS_PER_MASK)
    cols = []
    for k in range(n_masks):
        chunk = ca[k * BITS_PER_MASK:(k + 1) * BITS_PER_MASK]
        terms = [F.when(_predicate(r, spark, as_of, name=name_col), F.lit(1 << j)).otherwise(F.lit(0))
                 for j, r in enumerate(chunk)]
        cols.append((reduce(lambda a, b: a.bitwiseOR(b), terms) if terms else F.lit(0)).cast("bigint").alias(f"mask_{k}"))
    per_member = m.select(F.col(archive_col).alias("archive"), *cols)
    agg = per_member.groupBy("archive").agg(*[F.bit_or(f"mask_{k}").alias(f"mask_{k}") for k in range(n_masks)])
    return agg.filter(reduce(lambda a, b: a | b, [F.col(f"mask_{k}") != 0 for k in range(n_masks)]))


def _rule_chunks(rules, spark, as_of, *, name, size, mtime, is_directory, archive_file, folded) -> list[Column]:
    """One ``CASE WHEN`` (first true branch wins) per run of ``RULES_PER_CASE`` rules."""
    ca_pos = {r.idx: j for j, r in enumerate(archive_rules(rules))}
    chunks, expr = [], None
    for n, r in enumerate(rules):
        hit = _predicate(r, spark, as_of, name, size, mtime, folded)
        if r.check_archive and archive_file is not None:
            j = ca_pos[r.idx]
            bit = F.col(f"mask_{j // BITS_PER_MASK}").bitwiseAND(F.lit(1 << (j % BITS_PER_MASK))) != 0
            hit = hit | (archive_file & F.coalesce(bit, F.lit(False)))
        cond = kind_gate(is_directory, r.is_directory) & hit
        expr = F.when(cond, F.lit(r.idx)) if expr is None else expr.when(cond, F.lit(r.idx))
        if (n + 1) % RULES_PER_CASE == 0:
            chunks.append(expr.cast("int"))
            expr = None
    if expr is not None:
        chunks.append(expr.cast("int"))
    return chunks


def first_match_sql(rules: list[Rule], spark, as_of: int, *, name="name", size="size", mtime="mtime",
                    is_directory="is_directory", folded=None) -> str | None:
    """The first-match expression as SQL text, built in Python and parsed once by Spark (a rule
    list of hundreds costs one call instead of thousands). None if a rule needs Python's regex."""
    if not rules:
        return "CAST(NULL AS INT)"
    chunks, branches = [], []
    for n, r in enumerate(rules):
        pred = conditions_sql(r.conditions, r.case_sensitive, name=name, size=size, mtime=mtime,
                              as_of_micros=as_of, spark=spark, folded=folded)
        if pred is None:
            return None
        gate = f"coalesce({sql_col(is_directory)}, false) = {'true' if r.is_directory else 'false'}"
        branches.append(f"WHEN ({gate}) AND ({pred}) THEN {int(r.idx)}")
        if (n + 1) % RULES_PER_CASE == 0 or n == len(rules) - 1:
            chunks.append("CAST(CASE " + " ".join(branches) + " END AS INT)")
            branches = []
    return chunks[0] if len(chunks) == 1 else "coalesce(" + ", ".join(chunks) + ")"


def first_match(rules, spark, as_of, *, name="name", size="size", mtime="mtime",
                is_directory="is_directory", archive_file: Column | None = None, folded=None) -> Column:
    """``CASE WHEN`` over the ordered rules -> int index of the first match, NULL when none.

    When ``archive_file`` is given, ``mask_k`` columns (from :func:`member_masks`) must be present.
    Rules are grouped into ``CASE`` chunks combined by ``coalesce`` (evaluated lazily, so later
    chunks run only for rows still unmatched); with ``spark.sql.codegen.hugeMethodLimit=8000`` a
    stage too large for the JIT falls back to split, compilable functions.
    """
    rules = to_rules(rules)
    if archive_file is None:
        text = first_match_sql(rules, spark, as_of_micros(as_of), name=name, size=size, mtime=mtime,
                               is_directory=is_directory, folded=folded)
        if text is not None:
            return F.expr(text)
    chunks = _rule_chunks(rules, spark, as_of_micros(as_of), name=name, size=size, mtime=mtime,
                          is_directory=is_directory, archive_file=archive_file, folded=folded)
    if not chunks:
        return F.lit(None).cast("int")
    return chunks[0] if len(chunks) == 1 else F.coalesce(*chunks)


def match_rules(inv: DataFrame, rules, as_of, members: DataFrame | None = None,
                spark: SparkSession | None = None) -> DataFrame:
    """Inventory + ``rule_idx`` (first matching rule or NULL).

    Without ``check_archive`` rules (or members) this is one projection. With them, only rows
    that are archive files take part in the join with the member masks; the rest bypass it. More rules
    than ``MOST_COMPILED`` go through the index: as generated code they would pass the compiler's limits.
    """
    rules = to_rules(rules)
    spark = spark or inv.sparkSession
    if len(rules) > MOST_COMPILED:
        return match_rules_indexed(inv, rules, as_of, members)
    if members is None or not archive_rules(rules):
        return (inv.withColumn(FOLDED, F.lower("name"))
                .withColumn("rule_idx", first_match(rules, spark, as_of, folded=FOLDED)).drop(FOLDED))
    masks = member_masks(members, rules, as_of, spark)
    mask_cols = [c for c in masks.columns if c.startswith("mask_")]
    arch = F.coalesce(is_archive("name") & ~F.coalesce(F.col("is_directory"), F.lit(False)), F.lit(False))
    arch_rows = (inv.filter(arch).withColumn("__path", path_of("parent", "name"))
                 .join(masks.withColumnRenamed("archive", "__path"), "__path", "left").drop("__path"))
    other_rows = inv.filter(~arch)
    for c in mask_cols:
        other_rows = other_rows.withColumn(c, F.lit(None).cast("bigint"))
    both = arch_rows.unionByName(other_rows).withColumn(FOLDED, F.lower("name"))
    out = both.withColumn("rule_idx", first_match(rules, spark, as_of, archive_file=arch, folded=FOLDED)).drop(FOLDED)
    return out.drop(*mask_cols)


def rule_attribute(rules, rule_idx, attr: str) -> Column:
    """Look a rule attribute up by index with a literal CASE (no join needed)."""
    rules = to_rules(rules)
    idx = _c(rule_idx)
    expr = None
    for r in rules:
        v = getattr(r, attr)
        expr = F.when(idx == r.idx, F.lit(v)) if expr is None else expr.when(idx == r.idx, F.lit(v))
    return expr if expr is not None else F.lit(None)


# --- rules as data ---------------------------------------------------------------------------

def rule_patterns(rules, spark=None) -> list[tuple[str, bool, str | None]]:
    """Distinct regex conditions in first-use order: (pattern, case-sensitive, Java pattern). The last
    is None where only Python's engine answers as Python does."""
    out = {}
    for r in to_rules(rules):
        if "regex" in r.conditions:
            text = str(r.conditions["regex"])
            if (text, r.case_sensitive) not in out:
                re.compile(text)
                java = java_match_pattern(text, r.case_sensitive)
                out[text, r.case_sensitive] = java if java is not None and _java_accepts(spark, java) else None
    return [(*k, java) for k, java in out.items()]


RULE_FIELDS = ("rule_idx int, r_is_directory boolean, r_case boolean, r_start string, r_end string, "
               "r_contain string, r_regex int, r_larger bigint, r_smaller bigint, r_older_us bigint, r_newer_us bigint")
_FIELD_NAMES = [f.split()[0] for f in RULE_FIELDS.split(", ")]
_RULE_TYPE = f"struct<{RULE_FIELDS.replace(' ', ':').replace(',:', ',')}>"


def rule_rows(rules, as_of, patterns) -> list[dict]:
    """The rules in order, every condition parsed into a typed field (NULL = not given); a regex is
    referenced by its position in :func:`rule_patterns`."""
    as_of = as_of_micros(as_of)
    at = {(text, case): i for i, (text, case, _) in enumerate(patterns)}
    rows = []
    for r in to_rules(rules):
        c = {k: (str(v) if v is not None else None) for k, v in r.conditions.items()}
        for key, value in r.conditions.items():
            if key in CONDITION_KEYS and (value is None or isinstance(value, (list, dict))):
                raise ValueError(f"Condition '{key}' must be a scalar")
        text = {k: c[k] if r.case_sensitive else c[k].lower() for k in ("start", "end", "contain") if k in c}
        rows.append(dict(zip(_FIELD_NAMES, (
            r.idx, r.is_directory, r.case_sensitive, text.get("start"), text.get("end"), text.get("contain"),
            at[c["regex"], r.case_sensitive] if "regex" in c else None,
            py_parse_size(c["larger"]) if "larger" in c else None,
            py_parse_size(c["smaller"]) if "smaller" in c else None,
            as_of - py_parse_duration(c["older"]) * 1_000_000 if "older" in c else None,
            as_of - py_parse_duration(c["newer"]) * 1_000_000 if "newer" in c else None))))
    return rows


# Rules are found through keys that a row can have: a prefix or a suffix of a length that some rule
# uses, three characters in a row, or how many bits its size or age has. A key's hash is a place in one
# constant array, so a row reads as many places as it has keys, however many rules there are.
MANY = 16  # so many rules, or rules of a weak kind of key, are tried one by one
ANY_BITS = 64  # negative numbers


def _size_bits(low: int | None, high: int | None) -> list[int]:
    """Bit lengths of numbers strictly above ``low`` and below ``high``."""
    first = max(low + 1, 0).bit_length() if low is not None else 0
    last = max(high - 1, 0).bit_length() if high is not None else 63
    return [*range(min(first, 63), min(last, 63) + 1), *([ANY_BITS] if low is None or low < -1 else [])]


def _grams(text: Column, mark: str) -> Column:
    """The distinct runs of three characters of a text, after a mark."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    grams = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(3))))
    return F.array_distinct(F.coalesce(grams, F.array().cast("array<string>")))


class RuleIndex:
    """``places`` (rules per hash of a key), ``rest`` (tried for every row) and the kinds of keys that
    rows need."""

    def __init__(self, rows: list[dict], as_of: int):
        options = [self._options(r, as_of) if len(rows) > MANY else [] for r in rows]
        load = Counter(k for keys in options for group in keys for k in group)
        self.rest, chosen = [], []
        for row, keys in zip(rows, options):
            if keys:
                chosen.append((row, min(keys, key=lambda group: (max(load[k] for k in group), len(group)))))
            else:
                self.rest.append(row)
        # a weak kind of key is not worth a look into the array when few rules have it
        kinds = Counter(group[0][0] for _, group in chosen)
        for row, group in chosen:
            if group[0][0] in "GNA" and kinds[group[0][0]] <= MANY:
                self.rest.append(row)
        chosen = [(row, group) for row, group in chosen if group[0][0] not in "GNA" or kinds[group[0][0]] > MANY]
        self.n_places = 1 << max(1, (2 * sum(len(g) for _, g in chosen)).bit_length())
        self.places: list[list[dict]] = [[] for _ in range(self.n_places)]
        self.kinds = set()
        for row, group in chosen:
            for key in group:
                self.kinds.add((key[0], key[1], len(key) - 2 if key[0] in "PS" else 0))
                place = self.places[zlib.crc32(key.encode()) % self.n_places]
                if row not in place:
                    place.append(row)

    @staticmethod
    def _options(r: dict, as_of: int) -> list[list[str]]:
        """Ways to file a rule: each a list of keys, of which every row that the rule fits has one."""
        case = "c" if r["r_case"] else "i"
        out = []
        if r["r_start"]:
            out.append([f"P{case}{r['r_start']}"])
        if r["r_end"]:
            out.append([f"S{case}{r['r_end']}"])
        if r["r_contain"] and len(r["r_contain"]) >= 3:
            out += [[f"G{case}{r['r_contain'][i:i + 3]}"] for i in range(len(r["r_contain"]) - 2)]
        if r["r_larger"] is not None or r["r_smaller"] is not None:
            out.append([f"N-{b}" for b in _size_bits(r["r_larger"], r["r_smaller"])])
        if r["r_older_us"] is not None or r["r_newer_us"] is not None:
            older = None if r["r_older_us"] is None else as_of - r["r_older_us"] - 1
            newer = None if r["r_newer_us"] is None else as_of - r["r_newer_us"] + 1
            out.append([f"A-{b}" for b in _size_bits(older, newer)])
        return [group for group in out if group]

    def candidates(self, name: str, as_of: int) -> Column:
        """The rules that a row has to be tested against."""
        rest = F.from_json(F.lit(json.dumps(self.rest)), f"array<{_RULE_TYPE}>")
        if not self.kinds:
            return rest
        text = {"c": F.col(name), "i": F.col(FOLDED)}
        bits = lambda c: F.when(c >= 0, F.when(c == 0, 0).otherwise(F.length(F.bin(c)))).otherwise(ANY_BITS).cast("string")
        keys = []
        for kind, case, n in sorted(self.kinds):
            if kind == "P":
                keys.append(F.concat(F.lit(f"P{case}"), F.substring(text[case], 1, n)))
            elif kind == "S":
                keys.append(F.concat(F.lit(f"S{case}"), F.right(text[case], F.lit(n))))
            elif kind == "N":
                keys.append(F.concat(F.lit("N-"), bits(F.col("size"))))
            elif kind == "A":
                keys.append(F.concat(F.lit("A-"), bits(F.lit(as_of) - F.unix_micros("mtime"))))
        all_keys = F.array(*keys) if keys else F.array().cast("array<string>")
        for kind, case, _ in sorted(self.kinds):
            if kind == "G":
                all_keys = F.concat(all_keys, _grams(text[case], f"G{case}"))
        places = F.from_json(F.lit(json.dumps(self.places)), f"array<array<{_RULE_TYPE}>>")
        none = F.from_json(F.lit("[]"), f"array<{_RULE_TYPE}>")
        found = F.transform(all_keys, lambda k: F.coalesce(
            F.get(places, F.pmod(F.crc32(k.cast("binary")), F.lit(self.n_places)).cast("int")), none))
        return F.concat(rest, F.flatten(found))


def _first_hit(rules: list[Rule], as_of, name: str, regexes: str, gate: bool, patterns) -> Column:
    """Index of the first of ``rules`` whose conditions a row meets; with ``gate`` its kind as well.
    ``regexes`` is the row's array of pattern results."""
    us = F.unix_micros("mtime")

    def hit(r: Column) -> Column:
        text = F.when(r["r_case"], F.col(name)).otherwise(F.col(FOLDED))
        tests = [
            r["r_start"].isNull() | F.startswith(text, r["r_start"]),
            r["r_end"].isNull() | F.endswith(text, r["r_end"]),
            r["r_contain"].isNull() | F.contains(text, r["r_contain"]),
            r["r_regex"].isNull() | F.get(F.col(regexes), r["r_regex"]),
            r["r_larger"].isNull() | (F.col("size") > r["r_larger"]),
            r["r_smaller"].isNull() | (F.col("size") < r["r_smaller"]),
            r["r_older_us"].isNull() | (us <= r["r_older_us"]),
            r["r_newer_us"].isNull() | (us >= r["r_newer_us"]),
        ]
        if gate:
            tests.insert(0, F.coalesce(F.col("is_directory"), F.lit(False)) == r["r_is_directory"])
        return reduce(lambda a, b: a & b, tests)

    if not rules:
        return F.lit(None).cast("int")
    as_of = as_of_micros(as_of)
    found = F.filter(RuleIndex(rule_rows(rules, as_of, patterns), as_of).candidates(name, as_of), hit)
    return F.array_min(F.transform(found, lambda r: r["rule_idx"]))


def _with_tests(df: DataFrame, name: str, patterns) -> DataFrame:
    """Per row, once: the folded name and every distinct regex as a literal pattern (a pattern taken
    from a struct would be recompiled for every rule)."""
    tests = [F.col(name).rlike(java) if java is not None else _python_match_udf(text, not case)(F.col(name))
             for text, case, java in patterns]
    return df.withColumn(FOLDED, F.lower(name)).withColumn(
        "__re", F.array(*tests) if tests else F.array().cast("array<boolean>"))


def match_rules_join(inv: DataFrame, rules_df: DataFrame, as_of, members: DataFrame | None = None) -> DataFrame:
    """Rules as a table -> inventory + ``rule_idx``, the same answer as :func:`match_rules`.

    A projection without a shuffle. With ``members`` the first ``check_archive`` rule that a member
    meets is a ``min`` per archive, which only archive rows join; an archive is a file, so rules for
    directories have no say there.
    """
    return match_rules_indexed(inv, rules_from_frame(rules_df), as_of, members)


def match_rules_indexed(inv: DataFrame, rules, as_of, members: DataFrame | None = None) -> DataFrame:
    """:func:`match_rules` through an index over the rules: a row is tested against those only that
    share a key with it, so thousands of rules cost a row no more than some."""
    rules = to_rules(rules)
    spark = inv.sparkSession
    patterns = rule_patterns(rules, spark)
    out = _with_tests(inv, "name", patterns).withColumn("rule_idx", _first_hit(rules, as_of, "name", "__re", True, patterns))
    out = out.select(*inv.columns, "rule_idx")
    inside = [r for r in archive_rules(rules) if not r.is_directory]
    if members is None or not inside:
        return out
    m = members if "mtime" in members.columns else members.withColumn("mtime", F.lit(None).cast("timestamp"))
    patterns = rule_patterns(inside, spark)
    hits = (_with_tests(m, "member", patterns)
            .select(F.col("archive").alias("__path"), _first_hit(inside, as_of, "member", "__re", False, patterns).alias("__inside"))
            .filter("__inside is not null").groupBy("__path").agg(F.min("__inside").alias("__inside")))
    arch = F.coalesce(is_archive("name") & ~F.coalesce(F.col("is_directory"), F.lit(False)), F.lit(False))
    found = (out.filter(arch).withColumn("__path", path_of("parent", "name")).join(hits, "__path", "left")
             .withColumn("rule_idx", F.least("rule_idx", "__inside")))
    return found.select(*inv.columns, "rule_idx").unionByName(out.filter(~arch))
