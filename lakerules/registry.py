"""Query registry: every operator as a Spark query over the driver tables, plus DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``. Every query reads whole
tables through the adapters in :mod:`lakerules.sources.adapters`; nothing is sampled or capped
except where the limit is the feature (``top_differences``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle_sql as O
from .functions import columns as C
from .functions import conditions as K
from .functions.rules import as_of_micros
from .operators import match as M
from .sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


INV_AS_OF = as_of_micros(A.INV_AS_OF)
INVL_AS_OF = as_of_micros(A.INVL_AS_OF)

# Fixed rule set for the INV inventory (as of 2024-01-31; files are 1 to 30 days old).
INV_RULES = [
    {"name": "old logs", "conditions": {"end": ".log", "older": "20d"}, "action": {"type": "delete"}},
    {"name": "big zips", "conditions": {"regex": "(?:click|view)_[0-9]+[.]zip$", "larger": "200MB"},
     "action": {"type": "move", "target": "archives"}, "check_archive": True, "delete_unpacked_on_match": True},
    {"name": "upper tmp", "conditions": {"end": ".TMP"}, "case_sensitive": True,
     "action": {"type": "compress", "target": "packed"}},
    {"name": "recent errors", "conditions": {"start": "error", "newer": "1w"},
     "action": {"type": "compress", "target": "/archive/errors"}},
    {"name": "small csv", "conditions": {"contain": "_1", "end": ".CSV", "smaller": "50MB"},
     "action": {"type": "move", "target": "csv"}},
    {"name": "signups", "conditions": {"start": "SIGNUP", "larger": "1.5MB", "older": "3d"},
     "action": {"type": "move", "target": "."}},
    {"name": "big dirs", "is_directory": True, "conditions": {"larger": "2GB"},
     "action": {"type": "compress", "target": "dirs"}},
    {"name": "purchases", "conditions": {"start": "purchase"}, "action": {"type": "delete"}},
]

# The same rule set as DuckDB SQL (written by hand, independent of the compiler).
INV_RULES_SQL = """case
 when not is_directory and ends_with(lower(name), '.log') and mtime <= timestamp '2024-01-31' - interval 20 day then 0
 when not is_directory and regexp_matches(name, '^(?:(?:click|view)_[0-9]+[.]zip$)', 'i') and size > 209715200 then 1
 when not is_directory and ends_with(name, '.TMP') then 2
 when not is_directory and starts_with(lower(name), 'error') and mtime >= timestamp '2024-01-31' - interval 7 day then 3
 when not is_directory and contains(lower(name), '_1') and ends_with(lower(name), '.csv') and size < 52428800 then 4
 when not is_directory and starts_with(lower(name), 'signup') and size > 1572864
      and mtime <= timestamp '2024-01-31' - interval 3 day then 5
 when is_directory and size > 2147483648 then 6
 when not is_directory and starts_with(lower(name), 'purchase') then 7
end"""

INV_COLS = "parent, name, size, mtime, is_directory, seq"


# =============================================================================================
# Slice 1: rule matching
# =============================================================================================

@query("match_rules", O.with_(O.INV) + f"select {INV_COLS}, cast({INV_RULES_SQL} as integer) as rule_idx from inv")
def q_match_rules(spark, d):
    return M.match_rules(A.inv(spark, d), INV_RULES, INV_AS_OF)


@query("match_rules_join", ORACLE["match_rules"])
def q_match_rules_join(spark, d):
    from .functions.rules import rules_frame
    return M.match_rules_join(A.inv(spark, d), rules_frame(spark, INV_RULES), INV_AS_OF)


def many_rules(n: int) -> list[dict]:
    """n rules from a rule: a prefix o<k>, one of four endings, a size bound that grows."""
    ends = [".zip", ".tmp", ".parquet", "_1"]
    return [{"conditions": {"start": f"o{k + 1}", "end": ends[k % 4], "larger": f"{k % 50 * 20}KB"},
             "action": {"type": "delete"}} for k in range(n)]


@query("match_rules_many", O.with_(O.INVL) + r""", rules as (select k as rule_idx, 'o' || (k + 1) as s,
  ['.zip', '.tmp', '.parquet', '_1'][k % 4 + 1] as e, k % 50 * 20 * 1024 as larger from range(2000) t(k))
select parent, name, size, cast(min(rule_idx) as integer) as rule_idx
from invl left join rules on starts_with(lower(name), s) and ends_with(lower(name), e) and size > larger
group by seq, parent, name, size""")
def q_match_rules_many(spark, d):
    return M.match_rules(A.invl(spark, d), many_rules(2000), INVL_AS_OF).select("parent", "name", "size", "rule_idx")


# =============================================================================================
# One query per condition
# =============================================================================================

def _cond_query(name, pred_fn, sql_pred):
    @query(name, O.with_(O.INV) + f"select seq, parent, name, size, mtime from inv where {sql_pred}")
    def q(spark, d):
        inv = A.inv(spark, d)
        return inv.filter(pred_fn(spark)).select("seq", "parent", "name", "size", "mtime")
    return q


_cond_query("cond_start", lambda s: K.cond_start("name", "Click_1"), "starts_with(lower(name), 'click_1')")
_cond_query("cond_end", lambda s: K.cond_end("name", ".tmp"), "ends_with(lower(name), '.tmp')")
_cond_query("cond_contain", lambda s: K.cond_contain("name", "W_12"), "contains(lower(name), 'w_12')")
_cond_query("cond_regex", lambda s: K.cond_regex("name", r"(sign|purch)[a-z]*_\d*7\.", False, s),
            "regexp_matches(name, '^(?:(sign|purch)[a-z]*_[0-9]*7\\.)', 'i')")
_cond_query("cond_larger", lambda s: K.cond_larger("size", "300MB"), "size > 314572800")
_cond_query("cond_smaller", lambda s: K.cond_smaller("size", "0.5mb"), "size < 524288")
_cond_query("cond_older", lambda s: K.cond_older("mtime", "25d", INV_AS_OF),
            "mtime <= timestamp '2024-01-31' - interval 25 day")
_cond_query("cond_newer", lambda s: K.cond_newer("mtime", "36h", INV_AS_OF),
            "mtime >= timestamp '2024-01-31' - interval 36 hour")
_cond_query("cond_all", lambda s: K.conditions_predicate(
    {"start": "view", "contain": "_2", "regex": r"v.*\d", "end": ".log", "larger": "10MB", "smaller": "300MB",
     "older": "1w", "newer": "4w"}, False, as_of_micros=INV_AS_OF, spark=s),
    "starts_with(lower(name), 'view') and contains(lower(name), '_2') and ends_with(lower(name), '.log') "
    "and regexp_matches(name, '^(?:v.*[0-9])', 'i') and size > 10485760 and size < 314572800 "
    "and mtime <= timestamp '2024-01-31' - interval 7 day and mtime >= timestamp '2024-01-31' - interval 28 day")


@query("cond_case", O.with_(O.INV) + """select seq, name,
  ends_with(lower(name), '.tmp') as hit_insensitive, ends_with(name, '.tmp') as hit_sensitive,
  regexp_matches(name, '^(?:CLICK)', 'i') as re_insensitive, regexp_matches(name, '^(?:CLICK)') as re_sensitive
from inv where ends_with(lower(name), '.tmp') or regexp_matches(name, '^(?:CLICK)', 'i')""")
def q_cond_case(spark, d):
    inv = A.inv(spark, d)
    out = inv.select("seq", "name",
                     K.cond_end("name", ".tmp", False).alias("hit_insensitive"),
                     K.cond_end("name", ".tmp", True).alias("hit_sensitive"),
                     K.cond_regex("name", "CLICK", False, spark).alias("re_insensitive"),
                     K.cond_regex("name", "CLICK", True, spark).alias("re_sensitive"))
    return out.filter(F.col("hit_insensitive") | F.col("re_insensitive"))


# =============================================================================================
# Scalar projections
# =============================================================================================

@query("path_parts", O.with_(O.INV) + r"""select seq, parent || '/' || name as path,
  parent as parent_dir, name as base_name,
  regexp_extract(name, '^.+(\.[^.]+)$', 1) as suffix,
  substr(name, 1, length(name) - length(regexp_extract(name, '^.+(\.[^.]+)$', 1))) as stem from inv""")
def q_path_parts(spark, d):
    inv = A.inv(spark, d)
    p = C.path_of("parent", "name")
    return inv.select("seq", p.alias("path"), C.parent_of(p).alias("parent_dir"), C.name_of(p).alias("base_name"),
                      C.suffix_of("name").alias("suffix"), C.stem_of("name").alias("stem"))


@query("archive_format", O.with_(O.INV) + """select seq, name,
  case when ends_with(lower(name), '.zip') then 'zip' when ends_with(lower(name), '.rar') then 'rar'
       when ends_with(lower(name), '.7z') then '7z' end as fmt,
  lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) in ('.zip','.rar','.7z','.tar','.gz','.bz2') as already_compressed,
  case when is_directory then name else substr(name, 1, length(name) - length(regexp_extract(name, '^.+(\\.[^.]+)$', 1))) end
    || '.zip' as zip_name
from inv""")
def q_archive_format(spark, d):
    inv = A.inv(spark, d)
    return inv.select("seq", "name", C.archive_format("name").alias("fmt"),
                      C.is_compressed_file("name", "is_directory").alias("already_compressed"),
                      C.zip_name("name", "is_directory").alias("zip_name"))


@query("age_bands", O.with_(O.INV) + """select seq, age_s,
  case when age_s < 86400 then 'day' when age_s < 604800 then 'week' when age_s < 2592000 then 'month' else 'older' end as band
from (select seq, cast(floor((epoch_us(timestamp '2024-01-31') - epoch_us(mtime)) / 1e6) as bigint) as age_s from inv)""")
def q_age_bands(spark, d):
    inv = A.inv(spark, d)
    age = F.floor(C.age_seconds("mtime", INV_AS_OF)).cast("bigint")
    band = (F.when(age < 86400, "day").when(age < 604800, "week").when(age < 2592000, "month").otherwise("older"))
    return inv.select("seq", age.alias("age_s"), band.alias("band"))


def _size_texts(e):
    n = F.col("user_id").cast("string")
    k = F.col("event_id") % 10
    return (F.when(k == 0, F.concat(n, F.lit("KB"))).when(k == 1, F.concat(n, F.lit(" kb")))
            .when(k == 2, F.concat(n, F.lit(".5GB"))).when(k == 3, F.concat(n, F.lit("M")))
            .when(k == 4, n).when(k == 5, F.concat(n, F.lit("B")))
            .when(k == 6, F.concat(F.lit(" "), n, F.lit("MB "))).when(k == 7, F.concat(n, F.lit("."), n, F.lit(".5GB")))
            .when(k == 8, F.concat(F.lit("x"), n)).otherwise(F.concat(n, F.lit("TB"))))


_SIZE_TEXT_SQL = """case event_id%10 when 0 then user_id||'KB' when 1 then user_id||' kb' when 2 then user_id||'.5GB'
  when 3 then user_id||'M' when 4 then cast(user_id as varchar) when 5 then user_id||'B' when 6 then ' '||user_id||'MB '
  when 7 then user_id||'.'||user_id||'.5GB' when 8 then 'x'||user_id else user_id||'TB' end"""


@query("parse_size", f"""with t as (select event_id as seq, trim({_SIZE_TEXT_SQL}) as txt, {_SIZE_TEXT_SQL} as size_text from events),
u as (select seq, size_text, txt, regexp_full_match(txt, '(\\d+(\\.\\d+)?)\\s*([KMG]?B?)?', 'i') as ok,
  upper(regexp_extract(txt, '^(\\d+(\\.\\d+)?)\\s*([KMG]?B?)?$', 3, 'i')) as unit,
  regexp_extract(txt, '^(\\d+(\\.\\d+)?)\\s*([KMG]?B?)?$', 1, 'i') as num from t)
select seq, size_text, case when ok then cast(trunc(cast(num as double) *
  case when unit in ('', 'B') then 1 when unit in ('K','KB') then 1024 when unit in ('M','MB') then 1048576
       when unit in ('G','GB') then 1073741824 end) as bigint) end as size_bytes, ok as is_valid from u""")
def q_parse_size(spark, d):
    e = A.table(spark, d, "events")
    t = _size_texts(e)
    b = C.parse_size(t)
    return e.select(F.col("event_id").alias("seq"), t.alias("size_text"), b.alias("size_bytes"),
                    b.isNotNull().alias("is_valid"))


_DUR_TEXT_SQL = """case event_id%9 when 0 then user_id||'s' when 1 then user_id||'M' when 2 then user_id||'.5h'
  when 3 then user_id||' d' when 4 then cast(user_id as varchar) when 5 then user_id||'W' when 6 then user_id||'.25m'
  when 7 then user_id||'..5d' else user_id||'y' end"""


@query("parse_duration", f"""with t as (select event_id as seq, {_DUR_TEXT_SQL} as dur_text from events),
u as (select seq, dur_text, regexp_full_match(trim(dur_text), '(\\d+(\\.\\d+)?)\\s*([smhdw])?', 'i') as ok,
  lower(regexp_extract(trim(dur_text), '^(\\d+(\\.\\d+)?)\\s*([smhdw])?$', 3, 'i')) as unit,
  regexp_extract(trim(dur_text), '^(\\d+(\\.\\d+)?)\\s*([smhdw])?$', 1, 'i') as num from t)
select seq, dur_text, case when ok then cast(trunc(cast(num as double) *
  case unit when 'm' then 60 when 'h' then 3600 when 'd' then 86400 when 'w' then 604800 else 1 end) as bigint) end
  as seconds, ok as is_valid from u""")
def q_parse_duration(spark, d):
    e = A.table(spark, d, "events")
    n = F.col("user_id").cast("string")
    k = F.col("event_id") % 9
    t = (F.when(k == 0, F.concat(n, F.lit("s"))).when(k == 1, F.concat(n, F.lit("M")))
         .when(k == 2, F.concat(n, F.lit(".5h"))).when(k == 3, F.concat(n, F.lit(" d"))).when(k == 4, n)
         .when(k == 5, F.concat(n, F.lit("W"))).when(k == 6, F.concat(n, F.lit(".25m")))
         .when(k == 7, F.concat(n, F.lit("..5d"))).otherwise(F.concat(n, F.lit("y"))))
    s = C.parse_duration(t)
    return e.select(F.col("event_id").alias("seq"), t.alias("dur_text"), s.alias("seconds"), s.isNotNull().alias("is_valid"))


_PARTS_SQL = """[case event_id%7 when 0 then 9999 when 1 then 1969 when 2 then 1970 else 1990+event_id%40 end,
  event_id%14, event_id%75-30, event_id%26, event_id%62, (event_id*7)%63][1:(1+event_id%6)]"""


@query("normalize_dates", f"""with p as (select event_id as seq, cast({_PARTS_SQL} as integer[]) as parts from events),
q as (select seq, len(parts) as n,
  least(greatest(parts[1], 1970), 9999) as y,
  case when len(parts) > 1 then least(greatest(parts[2], 1), 12) else 1 end as m,
  case when len(parts) > 2 then parts[3] else 1 end as d,
  case when len(parts) > 3 then least(greatest(parts[4], 0), 23) else 0 end as h,
  case when len(parts) > 4 then least(greatest(parts[5], 0), 59) else 0 end as mi,
  case when len(parts) > 5 then least(greatest(parts[6], 0), 59) else 0 end as s from p),
r as (select seq, h, mi, s, cast(make_date(y, m, 1) - date '1970-01-01' as bigint) + d - 1 as day0 from q),
z as (select seq, h, mi, s, case when day0 < 0 then ((day0 % 365) + 365) % 365 else day0 end as day from r)
select seq, case when day <= 2932896 then timestamp '1970-01-01' + to_seconds(day*86400 + h*3600 + mi*60 + s) end as ts,
  day > 2932896 as is_error from z""")
def q_normalize_dates(spark, d):
    e = A.table(spark, d, "events")
    i = F.col("event_id")
    y = F.when(i % 7 == 0, 9999).when(i % 7 == 1, 1969).when(i % 7 == 2, 1970).otherwise(1990 + i % 40)
    parts = F.slice(F.array(y, i % 14, i % 75 - 30, i % 26, i % 62, (i * 7) % 63).cast("array<int>"), 1,
                    (1 + i % 6).cast("int"))
    ts = C.normalize_date_parts(parts)
    return e.select(i.alias("seq"), ts.alias("ts"), ts.isNull().alias("is_error"))


@query("nfc_names", O.with_(O.TXT) + """select seq, parent, nfc_normalize(name_nfd) as name,
  nfc_normalize(name_nfd) = name_nfc as same_as_nfc, name_nfd <> name_nfc as was_decomposed from txt""")
def q_nfc_names(spark, d):
    t = A.txt(spark, d)
    n = C.nfc("name_nfd")
    return t.select("seq", "parent", n.alias("name"), (n == F.col("name_nfc")).alias("same_as_nfc"),
                    (F.col("name_nfd") != F.col("name_nfc")).alias("was_decomposed"))


# =============================================================================================
# Scanning an inventory
# =============================================================================================

@query("inventory_scan", O.with_(O.INV) + f"select {INV_COLS} from inv")
def q_inventory_scan(spark, d):
    return A.inv(spark, d)


@query("hidden_filter", O.with_(O.INV) + f"select {INV_COLS} from inv where not starts_with(name, '.')")
def q_hidden_filter(spark, d):
    return A.inv(spark, d).filter(K.not_hidden("name"))


@query("exclude_path", O.with_(O.INV) + f"select {INV_COLS} from inv where parent||'/'||name <> '/data/click/u1/click_11.zip'")
def q_exclude_path(spark, d):
    return A.inv(spark, d).filter(K.not_path(C.path_of("parent", "name"), "/data/click/u1/click_11.zip"))


# =============================================================================================
# directories
# =============================================================================================

from .sources import inventory as I  # noqa: E402


def _tree_entries(spark, d):
    files, dirs = I.paths_to_files(A.tree(spark, d).withColumn("mtime", F.lit(None).cast("timestamp")))
    return I.entries(files, dirs)


def _inv_entries(spark, d):
    return I.entries(A.inv(spark, d))


@query("dir_rollup", O.with_(O.INV, O.INV_DIRS) + "select path, size, mtime, n_files from dirs")
def q_dir_rollup(spark, d):
    return I.dir_rollup(A.inv(spark, d))


@query("collect_level", O.with_(O.TREE, O.TREE_ENTRIES) + """select regexp_extract(path, '[^/]*$') as name, is_directory, size
from tentries where regexp_extract(path, '^(.*)/[^/]*$', 1) = '' and not starts_with(regexp_extract(path, '[^/]*$'), '.')""")
def q_collect_level(spark, d):
    return I.collect_level(_tree_entries(spark, d), "/").select("name", "is_directory", "size")


@query("collect_depth", O.with_(O.TREE, O.TREE_ENTRIES) + """select substr(path, 2) as rel, is_directory, size from tentries
where len(string_split(substr(path, 2), '/')) <= 2 and not regexp_matches(substr(path, 2), '(^|/)\\.')""")
def q_collect_depth(spark, d):
    return I.collect_depth(_tree_entries(spark, d), "/", 2).select("rel", "is_directory", "size")


@query("kind_gate", O.with_(O.INV, O.INV_DIRS, O.INV_ENTRIES) + """select parent, name, is_directory, size,
  is_directory and size > 314572800 as dir_rule_hit, not is_directory and size > 314572800 as file_rule_hit
from entries where size > 314572800""")
def q_kind_gate(spark, d):
    e = _inv_entries(spark, d)
    big = K.cond_larger("size", "300MB")
    return (e.select("parent", "name", "is_directory", "size",
                     (K.kind_gate("is_directory", True) & big).alias("dir_rule_hit"),
                     (K.kind_gate("is_directory", False) & big).alias("file_rule_hit"))
            .filter(F.col("dir_rule_hit") | F.col("file_rule_hit")))


@query("hidden_prune", O.with_(O.INV, O.INV_DIRS, O.INV_ENTRIES) + """select parent, name, is_directory from entries
where not regexp_matches(substr(parent || '/' || name, 2), '(^|/)\\.')""")
def q_hidden_prune(spark, d):
    e = _inv_entries(spark, d)
    rel = I.relative_to(C.path_of("parent", "name"), "/")
    return e.filter(K.no_hidden_component(rel)).select("parent", "name", "is_directory")


@query("dir_structure", O.with_(O.TREE) + r""", b as (select '/' || regexp_extract(path, '^/([^/]+)/', 1) as dir,
  regexp_extract(path, '^/[^/]+/(.*)$', 1) as rel, size from tree where regexp_extract(path, '^/[^/]+/(.*)$', 1) <> ''),
c as (select dir, rel, string_split(regexp_replace(rel, '/+$', ''), '/') as comps,
  case when ends_with(rel, '/') then len(string_split(regexp_replace(rel, '/+$', ''), '/'))
       else len(string_split(regexp_replace(rel, '/+$', ''), '/')) - 1 end as n from b),
s as (select dir, rel, size, false as is_dir_entry from b where not ends_with(rel, '/')
  union all
  select distinct dir, unnest(list_transform(range(1, n + 1), lambda i: array_to_string(comps[1:i], '/') || '/')) as rel,
    cast(0 as bigint) as size, true as is_dir_entry from c where n >= 1)
select dir, rel, size, is_dir_entry from s where not regexp_matches(rel, '(^|/)\.')""")
def q_dir_structure(spark, d):
    return I.dir_structure(A.tree(spark, d))


@query("dir_details", O.with_(O.DIR) + """select dir, rel, max(size) as size, dir || '/' || regexp_replace(rel, '/$', '') as path
from dirf group by dir, rel""")
def q_dir_details(spark, d):
    return I.dir_details(A.dirfiles(spark, d))


# =============================================================================================
# Archive vs. directory
# =============================================================================================

from .operators import diff as D  # noqa: E402

_DIFF_SQL = O.with_(O.MEM, O.DIR, O.DIFF)


def _sides(spark, d):
    return D.sides(A.mem(spark, d), A.dirfiles(spark, d))


@query("pair_archives", _DIFF_SQL + "select archive, dir from pairs")
def q_pair_archives(spark, d):
    return D.pair_archives(A.mem(spark, d), A.dirfiles(spark, d))


@query("strip_root", _DIFF_SQL + "select archive, dir, rel, size, pos from aside")
def q_strip_root(spark, d):
    m = A.mem(spark, d)
    pairs = D.pair_archives(m, A.dirfiles(spark, d))
    return D.archive_side(m, pairs).select("archive", "dir", "rel", "size", "pos")


@query("dir_entry_rule", _DIFF_SQL + "select archive, dir, rel, size from dside")
def q_dir_entry_rule(spark, d):
    m, f = A.mem(spark, d), A.dirfiles(spark, d)
    pairs = D.pair_archives(m, f)
    return D.dir_side(f, pairs, D.has_dirs(m, pairs))


@query("dedupe_members", _DIFF_SQL + "select archive, dir, rel, archive_size, copies from a")
def q_dedupe_members(spark, d):
    m = A.mem(spark, d)
    pairs = D.pair_archives(m, A.dirfiles(spark, d))
    return D.dedupe_archive(D.archive_side(m, pairs))


@query("structure_diff", _DIFF_SQL + "select archive, dir, rel, kind, archive_size, dir_size from diffs")
def q_structure_diff(spark, d):
    return D.structure_diff(A.mem(spark, d), A.dirfiles(spark, d))


@query("diff_missing", _DIFF_SQL + "select archive, dir, rel, archive_size from cmp where kind = 'missing'")
def q_diff_missing(spark, d):
    _, a, dd = _sides(spark, d)
    return D.diff_missing(a, dd)


@query("diff_extra", _DIFF_SQL + "select archive, dir, rel, dir_size from cmp where kind = 'extra'")
def q_diff_extra(spark, d):
    _, a, dd = _sides(spark, d)
    return D.diff_extra(a, dd)


@query("diff_size", _DIFF_SQL + "select archive, dir, rel, archive_size, dir_size from cmp where kind = 'size_mismatch'")
def q_diff_size(spark, d):
    _, a, dd = _sides(spark, d)
    return D.diff_size(a, dd)


@query("set_missing", _DIFF_SQL + "select archive, dir, rel from a except select archive, dir, rel from d")
def q_set_missing(spark, d):
    _, a, dd = _sides(spark, d)
    return a.select(*D.KEY).subtract(dd.select(*D.KEY))


@query("set_extra", _DIFF_SQL + "select archive, dir, rel from d except select archive, dir, rel from a")
def q_set_extra(spark, d):
    _, a, dd = _sides(spark, d)
    return dd.select(*D.KEY).subtract(a.select(*D.KEY))


@query("set_common", _DIFF_SQL + "select archive, dir, rel from a intersect select archive, dir, rel from d")
def q_set_common(spark, d):
    _, a, dd = _sides(spark, d)
    return a.select(*D.KEY).intersect(dd.select(*D.KEY))


def _ident(spark, d):
    m, f = A.mem(spark, d), A.dirfiles(spark, d)
    pairs, a, dd = D.sides(m, f)
    return D.identical_pairs(pairs, D.compare(a, dd).filter(F.col("kind") != "same"))


@query("identical_pairs", _DIFF_SQL + "select archive, dir, n_differences, identical from ident")
def q_identical_pairs(spark, d):
    return _ident(spark, d)


@query("diff_summary", _DIFF_SQL + """select count(*) as total, count_if(identical) as identical,
  count(*) - count_if(identical) as different,
  coalesce(count_if(identical) * 100.0 / nullif(count(*), 0), 0.0) as identical_pct from ident""")
def q_diff_summary(spark, d):
    return D.diff_summary(_ident(spark, d))


_MSG_SQL = """case kind when 'missing' then 'Missing in directory: ' || rel when 'extra' then 'Extra in directory: ' || rel
  else 'Size mismatch for ' || rel || ': archive=' || archive_size || ', directory=' || dir_size end"""
_RANK_SQL = "case kind when 'missing' then 0 when 'extra' then 1 else 2 end"


@query("diff_messages", _DIFF_SQL + f"select archive, dir, {_RANK_SQL} as kind_rank, rel, {_MSG_SQL} as message from diffs")
def q_diff_messages(spark, d):
    return D.diff_messages(D.structure_diff(A.mem(spark, d), A.dirfiles(spark, d)))


@query("top_differences", _DIFF_SQL + f"""select archive, dir, line, message from (
  select archive, dir, row_number() over (partition by archive, dir order by {_RANK_SQL}, rel) as line, {_MSG_SQL} as message
  from diffs) where line <= 5
union all
select archive, dir, 6 as line, '... and ' || (count(*) - 5) || ' more differences' as message from diffs
group by archive, dir having count(*) > 5""")
def q_top_differences(spark, d):
    return D.top_differences(D.structure_diff(A.mem(spark, d), A.dirfiles(spark, d)), 5)


# =============================================================================================
# plans
# =============================================================================================

from .operators.naming import resolve_names  # noqa: E402
from .plans import actions as P  # noqa: E402
from .plans import decisions as Dc  # noqa: E402


@query("conflict_names", O.with_(O.CLAIM) + r""", occ as (select distinct parent, name from claim where seq % 4 = 0),
cl as (select seq, parent, name, row_number() over (partition by parent, name order by seq) as k from claim where seq % 4 <> 0),
j as (select cl.*, cl.k - 1 + case when o.name is null then 0 else 1 end as slot,
  regexp_extract(cl.name, '^.+(\.[^.]+)$', 1) as suffix from cl left join occ o using (parent, name))
select seq, parent, name, case when slot = 0 then name
  else substr(name, 1, length(name) - length(suffix)) || '_' || slot || suffix end as final_name from j""")
def q_conflict_names(spark, d):
    c = A.claim(spark, d)
    claims = c.filter(F.col("seq") % 4 != 0).select(F.col("seq").alias("claim_id"), "seq",
                                                     F.col("parent").alias("dir"), "name")
    occ = c.filter(F.col("seq") % 4 == 0).select(F.col("parent").alias("dir"), "name")
    names = resolve_names(claims, occ)
    return (c.filter(F.col("seq") % 4 != 0).join(names.withColumnRenamed("claim_id", "seq"), "seq")
            .select("seq", "parent", "name", "final_name"))


# Claims of names that are numbered forms of other claimed names, over names held with gaps.
_LINKED_SQL = """with recursive part_claim as (select p_partkey as seq, p_brand as dir, 'p'||(p_partkey % 7) as key,
  'p'||(p_partkey % 7)||case p_partkey % 5 when 0 then '_1' when 1 then '_2_1' else '' end as stem from part where p_partkey % 4 <> 0),
held as (select distinct p_brand as dir, 'p'||(p_partkey % 7) as key,
  'p'||(p_partkey % 7)||case when p_partkey % 8 = 0 then '_'||(p_partkey % 3 + 1) else '' end||'.dat' as name, {release} as release
  from part where p_partkey % 4 = 0),
stays as (select dir, key, name, case when count(*) = count(release) then max(release) end as release from held group by all),
cl as (select c.seq, c.dir, c.key, c.stem, row_number() over (partition by c.dir, c.key order by c.seq) as i,
  coalesce(list(s.name) filter (s.name is not null), []) as there
  from part_claim c left join stays s on s.dir = c.dir and s.key = c.key and (s.release is null or s.release >= c.seq)
  group by c.seq, c.dir, c.key, c.stem),
steps as (select distinct dir, key, cast(0 as bigint) as i, cast(null as bigint) as seq, cast(null as varchar) as stem,
    cast(null as varchar) as final_name, cast([] as varchar[]) as taken from cl
  union all
  select dir, key, i, seq, stem, f, list_append(taken, f) from (
    select c.dir, c.key, c.i, c.seq, c.stem, s.taken, case when not list_contains(list_concat(s.taken, c.there), c.stem||'.dat') then c.stem||'.dat'
      else c.stem||'_'||list_filter(range(1, len(s.taken) + len(c.there) + 2),
        lambda j: not list_contains(list_concat(s.taken, c.there), c.stem||'_'||j||'.dat'))[1]||'.dat' end as f
    from steps s join cl c on c.dir = s.dir and c.key = s.key and c.i = s.i + 1))
select seq, dir, stem||'.dat' as name, final_name from steps where i > 0"""


def _linked_claims(spark, d):
    part = A.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("dir"))
    key = F.concat(F.lit("p"), (F.col("seq") % 7).cast("string"))
    tail = F.when(F.col("seq") % 5 == 0, "_1").when(F.col("seq") % 5 == 1, "_2_1").otherwise("")
    number = F.when(F.col("seq") % 8 == 0, F.concat(F.lit("_"), (F.col("seq") % 3 + 1).cast("string"))).otherwise("")
    claims = part.filter("seq % 4 <> 0").select(F.col("seq").alias("claim_id"), "seq", "dir", F.concat(key, tail, F.lit(".dat")).alias("name"))
    held = part.filter("seq % 4 = 0").select("seq", "dir", F.concat(key, number, F.lit(".dat")).alias("name"))
    return claims, held


def _resolved(claims, held):
    return (claims.join(resolve_names(claims, held), "claim_id").select("seq", "dir", "name", "final_name"))


@query("linked_names", _LINKED_SQL.format(release="cast(null as bigint)"))
def q_linked_names(spark, d):
    claims, held = _linked_claims(spark, d)
    return _resolved(claims, held.select("dir", "name"))


@query("released_names", _LINKED_SQL.format(release="case when p_partkey % 3 > 0 then p_partkey + 700 end"))
def q_released_names(spark, d):
    claims, held = _linked_claims(spark, d)
    leaves = F.when(F.col("seq") % 3 > 0, F.col("seq") + 700)
    held = held.groupBy("dir", "name").agg(F.when(F.count(F.lit(1)) == F.count(leaves), F.max(leaves)).alias("release"))
    return _resolved(claims, held)


def _visible_inv(spark, d):
    return A.inv(spark, d).filter(K.not_hidden("name"))


def _inv_plan(spark, d, rules=None, mode=Dc.AUTOMATIC, always_delete=True, approved=None, custom=None):
    rules = rules or INV_RULES
    inv = _visible_inv(spark, d)
    matched = M.match_rules(inv, rules, INV_AS_OF)
    occupied = I.entry_names(A.inv(spark, d))
    return P.plan_actions(matched, rules, occupied, mode=mode, always_delete=always_delete,
                          approved=approved, custom=custom)


_SUFFIX = r"regexp_extract(name, '^.+(\.[^.]+)$', 1)"
_INV_PLAN_BODY = f""", m as (select *, cast({INV_RULES_SQL} as integer) as rule_idx from inv
  where not starts_with(name, '.')),
p as (select seq, parent || '/' || name as path, parent, name, is_directory, rule_idx,
  case rule_idx when 0 then 'delete' when 1 then 'move' when 2 then 'compress' when 3 then 'compress'
    when 4 then 'move' when 5 then 'move' when 6 then 'compress' when 7 then 'delete' end as action_type,
  case rule_idx when 1 then parent || '/archives' when 2 then parent || '/packed' when 3 then '/archive/errors'
    when 4 then parent || '/csv' when 5 then parent when 6 then parent || '/dirs' end as target_dir,
  lower({_SUFFIX}) in ('.zip', '.rar', '.7z', '.tar', '.gz', '.bz2') and not is_directory as compressed,
  substr(name, 1, length(name) - length({_SUFFIX})) as stem
  from m where rule_idx is not null),
plan as (select seq, path, parent, name, is_directory, rule_idx, action_type, target_dir,
  case when action_type = 'move' and target_dir = parent then path
       when action_type = 'move' then target_dir || '/' || name
       when action_type = 'compress' and compressed then null
       when action_type = 'compress' then target_dir || '/' || case when is_directory then name else stem end || '.zip'
  end as final_path,
  case when action_type = 'move' and target_dir = parent then 'unchanged'
       when action_type = 'compress' and compressed then 'skipped_archive' else 'planned' end as status
  from p)
"""
_INV_PLAN_SQL = O.with_(O.INV) + _INV_PLAN_BODY
_PLAN_COLS_SQL = "seq, path, parent, name, is_directory, rule_idx, action_type, target_dir, final_path, status"


@query("plan_move", _INV_PLAN_SQL + f"select {_PLAN_COLS_SQL}, status in ('planned', 'unchanged') as decision from plan where action_type = 'move'")
def q_plan_move(spark, d):
    return _inv_plan(spark, d).filter(F.col("action_type") == "move")


@query("plan_delete", _INV_PLAN_SQL + f"select {_PLAN_COLS_SQL}, true as decision from plan where action_type = 'delete'")
def q_plan_delete(spark, d):
    return _inv_plan(spark, d).filter(F.col("action_type") == "delete")


@query("plan_compress", _INV_PLAN_SQL + f"select {_PLAN_COLS_SQL}, status = 'planned' as decision from plan where action_type = 'compress'")
def q_plan_compress(spark, d):
    return _inv_plan(spark, d).filter(F.col("action_type") == "compress")


# Rules that exercise every plan status (fixed values).
STATUS_RULES = [
    {"name": "shred csv", "conditions": {"end": ".csv"}, "action": {"type": "shred"}},
    {"name": "move logs nowhere", "conditions": {"end": ".log"}, "action": {"type": "move"}},
    {"name": "pack zips", "conditions": {"end": ".zip"}, "action": {"type": "compress", "target": "z"}},
    {"name": "stay", "conditions": {"start": "click"}, "action": {"type": "move", "target": "."}},
    {"name": "no action", "conditions": {"start": "view"}, "action": {}},
    {"name": "pack the rest", "conditions": {"larger": "100MB"}, "action": {"type": "compress", "target": "big"}},
]


@query("plan_status", O.with_(O.INV) + r"""select seq, rule_idx,
  case rule_idx when 0 then 'shred' when 1 then 'move' when 2 then 'compress' when 3 then 'move'
    when 5 then 'compress' end as action_type,
  case when rule_idx in (0, 4) then 'invalid_action' when rule_idx = 1 then 'missing_target'
       when rule_idx = 2 then 'skipped_archive' when rule_idx = 3 then 'unchanged'
       when rule_idx = 5 and lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) in ('.zip','.rar','.7z','.tar','.gz','.bz2')
         then 'skipped_archive'
       else 'planned' end as status
from (select *, case when ends_with(lower(name), '.csv') then 0 when ends_with(lower(name), '.log') then 1
  when ends_with(lower(name), '.zip') then 2 when starts_with(lower(name), 'click') then 3
  when starts_with(lower(name), 'view') then 4 when size > 104857600 then 5 end as rule_idx
  from inv where not starts_with(name, '.')) where rule_idx is not null""")
def q_plan_status(spark, d):
    return _inv_plan(spark, d, STATUS_RULES).select("seq", "rule_idx", "action_type", "status")


@query("run_stats", O.with_(O.INV) + f"""select count(*) as total_files,
  count_if(rule_idx is not null) as processed_files, count_if(rule_idx is null) as skipped_files,
  cast(0 as bigint) as errors from (select {INV_RULES_SQL} as rule_idx from inv where not starts_with(name, '.'))""")
def q_run_stats(spark, d):
    return P.run_stats(M.match_rules(_visible_inv(spark, d), INV_RULES, INV_AS_OF))


@query("organize", _INV_PLAN_SQL + f"select {_PLAN_COLS_SQL}, status in ('planned', 'unchanged') as decision from plan")
def q_organize(spark, d):
    return _inv_plan(spark, d)


@query("survivors", _INV_PLAN_SQL + f"""select {INV_COLS} from inv
where seq not in (select seq from plan where action_type = 'delete' and status = 'planned')""")
def q_survivors(spark, d):
    return P.survivors(A.inv(spark, d), _inv_plan(spark, d))


@query("route_by_rule", O.with_(O.INV) + f"""select {INV_COLS}, rule_idx,
  case rule_idx when 0 then 'old logs' when 1 then 'big zips' when 2 then 'upper tmp' when 3 then 'recent errors'
    when 4 then 'small csv' when 5 then 'signups' when 6 then 'big dirs' when 7 then 'purchases' else '_unmatched' end as route
from (select *, cast({INV_RULES_SQL} as integer) as rule_idx from inv)""")
def q_route_by_rule(spark, d):
    return P.route(M.match_rules(A.inv(spark, d), INV_RULES, INV_AS_OF), INV_RULES)


# Directory rules for the page tree, organised at the root: every host is a directory entry.
TREE_RULES = [
    {"name": "drop mobile", "is_directory": True, "conditions": {"start": "m."}, "action": {"type": "delete"}},
    {"name": "pack blogs", "is_directory": True, "conditions": {"start": "blog."},
     "action": {"type": "compress", "target": "packed"}},
    {"name": "org sites", "is_directory": True, "conditions": {"end": ".org"}, "action": {"type": "move", "target": "org"}},
    {"name": "big net", "is_directory": True, "conditions": {"contain": ".net", "larger": "50KB"},
     "action": {"type": "move", "target": "/net"}},
]

_TREE_PLAN_SQL = O.with_(O.TREE, O.TREE_ENTRIES) + """, top as (select path, regexp_extract(path, '[^/]*$') as name, size
  from tentries where is_directory and regexp_extract(path, '^(.*)/[^/]*$', 1) = ''),
tp as (select name, case when starts_with(lower(name), 'm.') then 'delete' when starts_with(lower(name), 'blog.') then 'compress'
    when ends_with(lower(name), '.org') then 'move' when contains(lower(name), '.net') and size > 51200 then 'move' end as action_type,
  case when starts_with(lower(name), 'm.') then null when starts_with(lower(name), 'blog.') then '/packed/' || name || '.zip'
    when ends_with(lower(name), '.org') then '/org/' || name when contains(lower(name), '.net') and size > 51200 then '/net/' || name
  end as final_path from top),
tf as (select path, size, regexp_extract(path, '^/([^/]+)/', 1) as host from tfiles)
"""


def _tree_plan(spark, d):
    files, dirs = I.paths_to_files(A.tree(spark, d).withColumn("mtime", F.lit(None).cast("timestamp")))
    entries = I.entries(files, dirs)
    level = I.collect_level(entries, "/", include_hidden=True)
    matched = M.match_rules(level, TREE_RULES, INV_AS_OF)
    plan = P.plan_actions(matched, TREE_RULES, entries.select("parent", "name"), mode=Dc.AUTOMATIC, always_delete=True)
    return files, dirs, plan


@query("after_state", _TREE_PLAN_SQL + """select case when tp.action_type = 'move' then tp.final_path || substr(tf.path, length(tf.host) + 2)
  else tf.path end as path, tf.size, cast(null as timestamp) as mtime, false as is_directory
from tf left join tp on tf.host = tp.name where tp.action_type is null or tp.action_type = 'move'
union all
select final_path, cast(null as bigint), cast(null as timestamp), false from tp where action_type = 'compress'""")
def q_after_state(spark, d):
    files, _, plan = _tree_plan(spark, d)
    return P.after_state(files, plan, base="/")


@query("pack_layout", _TREE_PLAN_SQL + """, ed as (select d.path from tdirs d where not exists (select 1 from tree t
    where starts_with(t.path, d.path || '/') and t.path <> d.path || '/'))
select tp.final_path as archive, substr(tf.path, 2) as member, tf.size from tf join tp on tf.host = tp.name
where tp.action_type = 'compress'
union all
select tp.final_path, substr(ed.path, 2) || '/', cast(0 as bigint) from ed
join tp on regexp_extract(ed.path, '^/([^/]+)/', 1) = tp.name where tp.action_type = 'compress'""")
def q_pack_layout(spark, d):
    files, dirs, plan = _tree_plan(spark, d)
    return P.pack_layout(files, plan, base="/", known_dirs=dirs)


@query("approvals", O.with_(O.APPR) + """, a as (select id, key, case when trim(lower(resp)) = '' then 'y' else trim(lower(resp)) end as resp from appr),
s as (select key, arg_min(resp, id) as sticky_resp, min(id) as sticky_id from a where resp in ('a', 'never') group by key)
select a.id, a.key, a.resp, coalesce(a.id > s.sticky_id, false) as sticky,
  case when coalesce(a.id > s.sticky_id, false) then s.sticky_resp = 'a' else a.resp in ('y', 'a') end as approved
from a left join s using (key)""")
def q_approvals(spark, d):
    ap = A.appr(spark, d)
    return Dc.approvals(ap.select("id", "key"), ap.select("id", "resp"))


@query("decisions", O.with_(O.APPR, O.INV) + _INV_PLAN_BODY + """, ans as (select id, case when resp = '' then 'y' else resp end as resp from appr),
pr as (select p.seq, p.rule_idx, ans.resp from plan p left join ans on ans.id = p.seq where p.action_type = 'delete'),
st as (select rule_idx, arg_min(resp, seq) as sticky_resp, min(seq) as sticky_id from pr where resp in ('a', 'never') group by rule_idx),
ap as (select pr.seq, case when coalesce(pr.seq > st.sticky_id, false) then st.sticky_resp = 'a'
  else coalesce(pr.resp in ('y', 'a'), false) end as approved from pr left join st using (rule_idx))
select plan.seq, plan.action_type, plan.status,
  false as dry_run,
  status in ('planned', 'unchanged') and action_type <> 'delete' as automatic,
  status in ('planned', 'unchanged') as automatic_always,
  status in ('planned', 'unchanged') and (action_type <> 'delete' or coalesce(ap.approved, false)) as interactive
from plan left join ap using (seq)""")
def q_decisions(spark, d):
    ap = A.appr(spark, d)
    base = _inv_plan(spark, d, mode=Dc.DRY_RUN)
    # interactive: delete prompts are keyed by rule (M7), answered by the answers table
    prompts = base.filter(F.col("action_type") == "delete").select(F.col("seq").alias("id"), F.col("rule_idx").alias("key"))
    appr = Dc.approvals(prompts, ap.select("id", "resp")).select(F.col("id").alias("seq"), "approved")
    ok = F.col("status").isin(P.PLANNED, P.UNCHANGED)
    return (base.join(appr, "seq", "left")
            .select("seq", "action_type", "status",
                    (ok & Dc.decide("action_type", Dc.DRY_RUN)).alias("dry_run"),
                    (ok & Dc.decide("action_type", Dc.AUTOMATIC, False)).alias("automatic"),
                    (ok & Dc.decide("action_type", Dc.AUTOMATIC, True)).alias("automatic_always"),
                    (ok & Dc.decide("action_type", Dc.INTERACTIVE, approved=F.col("approved"))).alias("interactive")))


# =============================================================================================
# Clean-up of unpacked directories; J6/A7: matching inside archives
# =============================================================================================

from .plans import cleanup as Cl  # noqa: E402

CONV_ROOT = "/data/conv"


@query("cleanup_plan", _DIFF_SQL + """select archive, dir, n_differences, identical, false as has_hidden,
  identical as decision, case when identical then 'removed' else 'different' end as status, identical as removes from ident""")
def q_cleanup_plan(spark, d):
    compared = Cl.compared_pairs(A.mem(spark, d), A.dirfiles(spark, d))
    return Cl.cleanup_plan(compared, Dc.cleanup_mode(always_delete=True), always_delete=True)


def _mem_with_7z(spark, d):
    m = A.mem(spark, d)
    num = F.split_part(F.split_part("archive", F.lit("_"), F.lit(2)), F.lit("."), F.lit(1)).cast("int")
    extra = m.filter(num % 9 == 0).withColumn("archive", F.regexp_replace("archive", r"\.zip$", ".7z"))
    return m.unionByName(extra)


_MEM7 = O.MEM.replace("mem as (", "mem0 as (", 1) + """,
mem as (select * from mem0 union all
  select replace(archive, '.zip', '.7z'), member, size, pos from mem0
  where cast(split_part(split_part(archive, '_', 2), '.', 1) as int) % 9 = 0)"""


@query("cleanup_order", O.with_(_MEM7, O.DIR, O.DIFF) + """, r as (select *, min(case when identical then archive end)
  over (partition by dir) as removed_by from ident)
select archive, dir, n_differences, identical, false as has_hidden, identical as decision,
  case when archive = removed_by then 'removed' when removed_by is not null and archive > removed_by then 'gone'
       when identical then 'kept' else 'different' end as status, coalesce(archive = removed_by, false) as removes from r""")
def q_cleanup_order(spark, d):
    compared = Cl.compared_pairs(_mem_with_7z(spark, d), A.dirfiles(spark, d))
    return Cl.cleanup_plan(compared, Dc.AUTOMATIC, always_delete=True)


# Organise the conversation archives (fixed rule): move them away, clean up identical unpacked copies.
CONV_RULES = [
    {"name": "archive conversations", "conditions": {"start": "conv_", "end": ".zip"},
     "action": {"type": "move", "target": "archived"}, "delete_unpacked_on_match": True},
]


@query("cleanup_unpacked", _DIFF_SQL + f"""select '{CONV_ROOT}/' || archive as archive,
  '{CONV_ROOT}/archived/' || archive as final_path, '{CONV_ROOT}/' || dir as dir, identical, identical as decision,
  case when identical then 'removed' else 'different' end as status from ident""")
def q_cleanup_unpacked(spark, d):
    members = Cl.world_members(A.mem(spark, d), CONV_ROOT)
    dirfiles = Cl.world_dirs(A.dirfiles(spark, d), CONV_ROOT)
    entries = Cl.archive_rows(members).unionByName(
        dirfiles.select("dir").distinct().select(C.parent_of("dir").alias("parent"), C.name_of("dir").alias("name"),
                                                 F.lit(0).cast("bigint").alias("size"),
                                                 F.lit(None).cast("timestamp").alias("mtime"),
                                                 F.lit(True).alias("is_directory"), F.xxhash64("dir").alias("seq")))
    matched = M.match_rules(entries, CONV_RULES, INV_AS_OF)
    occupied = entries.select("parent", "name").unionByName(Cl.dir_rows(dirfiles).select("parent", "name"))
    plan = P.plan_actions(matched, CONV_RULES, occupied, mode=Dc.AUTOMATIC, always_delete=True)
    return Cl.cleanup_unpacked(plan, CONV_RULES, members, dirfiles, Dc.AUTOMATIC, always_delete=True)


# Rules that look inside archives (fixed values).
ARCHIVE_RULES = [
    {"name": "long assistant turns", "conditions": {"contain": "assistant/t", "larger": "300B"},
     "check_archive": True, "action": {"type": "move", "target": "long"}},
    {"name": "has user folder", "conditions": {"end": "user/"}, "check_archive": True,
     "action": {"type": "move", "target": "with_dirs"}},
    {"name": "zips", "conditions": {"end": ".zip"}, "action": {"type": "compress", "target": "z"}},
]


@query("match_in_archive", O.with_(O.INV, O.MEM) + f""", world as (select parent, name, size, is_directory from inv
  union all select '{CONV_ROOT}', archive, cast(sum(size) as bigint), false from mem group by archive)
select w.parent, w.name, w.size, cast(case
  when not w.is_directory and ((contains(lower(w.name), 'assistant/t') and w.size > 300) or (regexp_matches(lower(w.name), '(\\.zip|\\.rar|\\.7z)$')
    and exists (select 1 from mem m where '{CONV_ROOT}/' || m.archive = w.parent || '/' || w.name
                and contains(lower(m.member), 'assistant/t') and m.size > 300))) then 0
  when not w.is_directory and (ends_with(lower(w.name), 'user/') or (regexp_matches(lower(w.name), '(\\.zip|\\.rar|\\.7z)$')
    and exists (select 1 from mem m where '{CONV_ROOT}/' || m.archive = w.parent || '/' || w.name
                and ends_with(lower(m.member), 'user/')))) then 1
  when not w.is_directory and ends_with(lower(w.name), '.zip') then 2 end as integer) as rule_idx from world w""")
def q_match_in_archive(spark, d):
    members = Cl.world_members(A.mem(spark, d), CONV_ROOT)
    world = A.inv(spark, d).drop("seq").unionByName(Cl.archive_rows(members).drop("seq"))
    return M.match_rules(world, ARCHIVE_RULES, INV_AS_OF, members=members).select("parent", "name", "size", "rule_idx")


# =============================================================================================
# Rule catalogs and extensions
# =============================================================================================

from .operators import catalog as Ca  # noqa: E402


@query("rules_flat", O.with_(O.RULES) + """select ruleset, rule_idx, first(name) filter (where name is not null) as name,
  array_to_string(list_sort(list(cond_key)), ',') as condition_keys, cast(count(cond_key) as integer) as n_conditions,
  first(action_type) filter (where action_type is not null) as action_type,
  first(target) filter (where target is not null) as target from rules group by ruleset, rule_idx""")
def q_rules_flat(spark, d):
    f = Ca.rules_flat(A.rules_rows(spark, d))
    return f.select("ruleset", "rule_idx", "name", F.array_join(F.sort_array(F.map_keys("conditions")), ",").alias("condition_keys"),
                    F.size("conditions").alias("n_conditions"), "action_type", "target")


_CHECKS_SQL = O.with_(O.RULES) + r""", flat as (select ruleset, rule_idx, first(name) filter (where name is not null) as name,
  count(cond_key) as n_cond, first(action_type) filter (where action_type is not null) as action_type,
  first(target) filter (where target is not null) as target from rules group by ruleset, rule_idx),
checks as (
  select ruleset, rule_idx, name, 'V5' as "check", 'name cannot be empty' as detail from flat where trim(name) = ''
  union all select ruleset, rule_idx, name, 'V6', 'name too long (' || length(name) || ' chars)' from flat where length(name) > 200
  union all select ruleset, rule_idx, name, 'V9', 'rule has no condition' from flat where n_cond = 0
  union all select ruleset, rule_idx, name, 'V15', 'rule has no action' from flat where action_type is null and target is null
  union all select ruleset, rule_idx, name, 'V17', 'action has no type' from flat where coalesce(action_type, '') = '' and target is not null
  union all select ruleset, rule_idx, name, 'V18', 'unknown action type ''' || action_type || '''' from flat
    where coalesce(action_type, '') <> '' and action_type not in ('move', 'delete', 'compress')
  union all select ruleset, rule_idx, name, 'V19', '''' || action_type || ''' needs a target' from flat
    where action_type in ('move', 'compress') and coalesce(target, '') = ''
  union all select ruleset, rule_idx, name, 'V21', 'target path looks unsafe' from flat
    where target <> '' and (starts_with(target, '..') or list_contains(string_split(target, '/'), '....')
                            or list_contains(string_split(target, '/'), '../../../..'))
  union all select ruleset, rule_idx, name, 'V10', 'unknown condition ''' || cond_key || '''' from rules
    where cond_key is not null and cond_key not in ('start', 'end', 'contain', 'regex', 'larger', 'smaller', 'older', 'newer')
  union all select ruleset, rule_idx, name, 'V11', 'condition ''' || cond_key || ''' is empty' from rules
    where cond_key in ('start', 'end', 'contain', 'regex', 'larger', 'smaller', 'older', 'newer') and coalesce(cond_value, '') = ''
  union all select ruleset, rule_idx, name, 'V12', 'bad size ''' || cond_value || ''' for ''' || cond_key || '''' from rules
    where cond_key in ('larger', 'smaller') and coalesce(cond_value, '') <> ''
      and not regexp_full_match(trim(cond_value), '(\d+(\.\d+)?)\s*([KMG]?B?)?', 'i')
  union all select ruleset, rule_idx, name, 'V13', 'bad duration ''' || cond_value || ''' for ''' || cond_key || '''' from rules
    where cond_key in ('older', 'newer') and coalesce(cond_value, '') <> ''
      and not regexp_full_match(trim(cond_value), '(\d+(\.\d+)?)\s*([smhdw])?', 'i'))
"""
_CHECKS_SELECT = """select ruleset, rule_idx + 1 as rule_num,
  case when length(trim(coalesce(name, ''))) > 0 then name else '#' || (rule_idx + 1) end as rule_id, "check", detail from checks"""


@query("rule_checks", _CHECKS_SQL + _CHECKS_SELECT)
def q_rule_checks(spark, d):
    return Ca.rule_checks(A.rules_rows(spark, d))


@query("rule_check_counts", _CHECKS_SQL + """select s.ruleset, cast(count(c.ruleset) as bigint) as n_errors
from (select distinct ruleset from rules) s left join checks c using (ruleset) group by s.ruleset""")
def q_rule_check_counts(spark, d):
    rows = A.rules_rows(spark, d)
    return Ca.rule_check_counts(Ca.rule_checks(rows), rows)


@query("custom_check", _CHECKS_SQL.replace("checks as (", "checks as (select ruleset, rule_idx, name, 'unnamed' as \"check\", "
                                           "'failed check ''unnamed''' as detail from flat where name is null union all ", 1)
       + _CHECKS_SELECT)
def q_custom_check(spark, d):
    return Ca.rule_checks(A.rules_rows(spark, d), extra=[("unnamed", lambda flat: F.col("name").isNull())])


def _tag_action(plan, name):
    """A user action: tag the entry in place (final path = path + '.tagged')."""
    mine = F.col("action_type") == name
    return (plan.withColumn("final_path", F.when(mine, F.concat(F.col("path"), F.lit(".tagged"))).otherwise(F.col("final_path"))))


TAG_RULES = [dict(r) for r in INV_RULES[:7]] + [
    {"name": "purchases", "conditions": {"start": "purchase"}, "action": {"type": "tag", "target": "tagged"}}]


@query("custom_action", O.with_(O.INV) + f"""select seq, parent || '/' || name as path, 'tag' as action_type,
  parent || '/' || name || '.tagged' as final_path, 'planned' as status, true as decision
from (select *, {INV_RULES_SQL} as rule_idx from inv where not starts_with(name, '.')) where rule_idx = 7""")
def q_custom_action(spark, d):
    custom = P.register_actions({"tag": _tag_action})
    plan = _inv_plan(spark, d, rules=TAG_RULES, custom=custom)
    return plan.filter(F.col("action_type") == "tag").select("seq", "path", "action_type", "final_path", "status", "decision")


# =============================================================================================
# Archives as bytes; T1: streaming
# =============================================================================================

from .sources import archives as Ar  # noqa: E402


def _tree_pack_rows(spark, d, suffix=".zip"):
    files, dirs, plan = _tree_plan(spark, d)
    layout = P.pack_layout(files, plan, base="/", known_dirs=dirs)
    pages = A.tree(spark, d).join(A.table(spark, d, "pages").select(F.col("page_id").alias("seq"), "html"), "seq")
    # pages of one path are one file: the first of them
    content = pages.groupBy(F.substring("path", 2, 1 << 30).alias("member")).agg(
        F.min_by(F.encode("html", "UTF-8"), "seq").alias("content"))
    rows = layout.join(content, "member", "left").select("archive", "member", "content")
    return rows.withColumn("archive", F.regexp_replace("archive", r"\.zip$", suffix))


_LAYOUT_SQL = ORACLE["pack_layout"]


@query("pack_groups")
def q_pack_groups(spark, d):
    return Ar.pack_groups(_tree_pack_rows(spark, d))


@query("archive_members", "select archive, member from (" + _LAYOUT_SQL + ")")
def q_archive_members(spark, d):
    packed = Ar.pack_groups(_tree_pack_rows(spark, d))
    return Ar.list_members(packed).select("archive", "member")


@query("custom_reader", "select replace(archive, '.zip', '.tar') as archive, member from (" + _LAYOUT_SQL + ")")
def q_custom_reader(spark, d):
    packed = Ar.pack_groups(_tree_pack_rows(spark, d, ".tar"), fmt="tar")
    return Ar.list_members(packed, readers=Ar.default_readers() + [(".tar", Ar.read_tar)]).select("archive", "member")


from .streaming.match_stream import match_stream  # noqa: E402


@query("match_stream", ORACLE["match_rules"])
def q_match_stream(spark, d):
    schema = A.table(spark, d, "events").schema
    return match_stream(spark, d, schema, A.inv_from_events, INV_RULES, INV_AS_OF, glob="events.parquet")


from .operators.catalog_json import rule_checks_json  # noqa: E402


def json_catalogs(spark, d):
    """One JSON rules file per tenant, built from the RULES rows; tenants whose source ends in an
    odd digit write their first rule's ``case_sensitive`` flag as text (a type error)."""
    rows = A.rules_rows(spark, d)
    odd = F.substring("ruleset", -1, 1).isin("1", "3", "5", "7", "9")
    rules = (rows.groupBy("ruleset", "rule_idx")
             .agg(F.first("name", ignorenulls=True).alias("name"),
                  F.map_from_entries(F.collect_list(F.struct("cond_key", "cond_value"))).alias("conditions"),
                  F.first("action_type", ignorenulls=True).alias("type"),
                  F.first("target", ignorenulls=True).alias("target"))
             .withColumn("case_sensitive", F.when(odd & (F.col("rule_idx") == 0), F.lit("yes"))))
    rule_js = F.to_json(F.struct("name", "conditions",
                                 F.struct(F.col("type").alias("type"), F.col("target").alias("target")).alias("action"),
                                 "case_sensitive"))
    ordered = F.sort_array(F.collect_list(F.struct("rule_idx", rule_js.alias("js"))))
    return (rules.groupBy("ruleset")
            .agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda r: r["js"]), ","), F.lit("]"))
                 .alias("rules_json")))


@query("rule_checks_json")
def q_rule_checks_json(spark, d):
    return rule_checks_json(json_catalogs(spark, d))


@query("cleanup_summary", O.with_(_MEM7, O.DIR, O.DIFF) + """, r as (select *, min(case when identical then archive end)
  over (partition by dir) as removed_by from ident)
select count(*) as total_pairs, count_if(identical) as identical, count_if(not identical) as different,
  count_if(coalesce(archive = removed_by, false)) as deleted from r""")
def q_cleanup_summary(spark, d):
    compared = Cl.compared_pairs(_mem_with_7z(spark, d), A.dirfiles(spark, d))
    return Cl.cleanup_summary(Cl.cleanup_plan(compared, Dc.AUTOMATIC, always_delete=True))


ORACLE["rule_checks_json"] = (
    _CHECKS_SQL.replace("'unknown action type ''' || action_type || ''''", "'unknown action type ' || action_type")
    .replace("checks as (", "checks as (select ruleset, rule_idx, name, 'V22' as \"check\", "
                            "'''case_sensitive'' must be boolean' as detail from flat "
                            "where rule_idx = 0 and right(ruleset, 1) in ('1', '3', '5', '7', '9') union all ", 1)
    + _CHECKS_SELECT)


# =============================================================================================
# J1, S4, S6 at any depth; M8, M7, M10 as whole runs: queries over the nested world
# =============================================================================================

from .plans import runs as R  # noqa: E402


@query("pairs_any_depth", O.with_(O.CONV_MEM, O.CONVW) + "select archive, dir from convpairs")
def q_pairs_any_depth(spark, d):
    return I.archives_with_directory(A.conv_world(spark, d))


@query("list_directories", O.with_(O.CONV_MEM, O.CONVW) + """,
wanted as (select distinct dir from convpairs union select distinct '/data/conv/'||(conv_id%7) from conversations)
select w.dir, substr(c.parent||'/'||c.name, length(w.dir)+2) as rel, c.size, cast(c.date as bigint) as date, false as is_dir_entry
from convw c join wanted w on starts_with(c.parent||'/', w.dir||'/')
union all
select w.dir, substr(p.path, length(w.dir)+2)||'/', cast(0 as bigint), cast(t.date as bigint), true
from cdirs p join wanted w on starts_with(p.path, w.dir||'/')
left join (select parent, max(date) as date from convw group by parent) t on t.parent = p.path""")
def q_list_directories(spark, d):
    world = A.conv_world(spark, d)
    conv = A.table(spark, d, "conversations").select(F.concat(F.lit("/data/conv/"), (F.col("conv_id") % 7).cast("string")).alias("dir"))
    dirs = I.archives_with_directory(world).select("dir").unionByName(conv)
    return (I.list_directories(world, dirs, include_hidden=True)
            .select("dir", "rel", "size", F.unix_seconds("mtime").alias("date"), "is_dir_entry"))


@query("listing_details", O.with_(O.CONV_MEM, O.CONVW) + """, l as (
select w.dir, substr(c.parent||'/'||c.name, length(w.dir)+2) as rel, c.size, c.date
from convw c join (select distinct dir from convpairs) w on starts_with(c.parent||'/', w.dir||'/')
union all
select w.dir, substr(p.path, length(w.dir)+2)||'/', 0, t.date from cdirs p
join (select distinct dir from convpairs) w on starts_with(p.path, w.dir||'/')
left join (select parent, max(date) as date from convw group by parent) t on t.parent = p.path)
select dir, rel, cast(arg_max(size, coalesce(date, -1)) as bigint) as size, cast(max(date) as bigint) as date,
  dir||'/'||rtrim(rel, '/') as path from l group by dir, rel""")
def q_listing_details(spark, d):
    world = A.conv_world(spark, d)
    return I.listing_details(I.list_directories(world, I.archives_with_directory(world), include_hidden=True))


_CONV_DIFF_SQL = O.with_(O.CONV_MEM, O.CONV_DIR, O.DIFF)
_CONV_ANSWERED = """, ans as (select *, regexp_extract(dir, '^(.*)/[^/]*$', 1) as key, case
    when n%29=3 then 'never' when n%23=5 then 'a' when n%4=2 then 'n' when n%5=0 then null else 'y' end as resp
  from (select *, cast(regexp_extract(archive, 'conv_(-?[0-9]+)[.]', 1) as bigint) as n from ident where identical)),
asked as (select *, not coalesce(bool_or(resp in ('y', 'a')) over (partition by dir order by archive
  rows between unbounded preceding and 1 preceding), false) as asked from ans),
sticky as (select key, arg_min(resp, archive) as sticky_resp, min(archive) as sticky_id from asked
  where asked and resp in ('a', 'never') group by key),
ok as (select a.archive, a.dir, case when coalesce(a.archive > s.sticky_id, false) then s.sticky_resp = 'a'
  else a.asked and coalesce(a.resp in ('y', 'a'), false) end as approved from asked a left join sticky s using (key)),
first_ok as (select dir, min(archive) as removed_by from ok where approved group by dir)
"""


@query("cleanup_interactive", _CONV_DIFF_SQL + _CONV_ANSWERED + """select i.archive, i.dir, i.n_differences, i.identical,
  coalesce(o.approved, false) as decision, case when i.archive = f.removed_by then 'removed'
    when i.archive > f.removed_by then 'gone' when i.identical then 'kept' else 'different' end as status,
  coalesce(i.archive = f.removed_by, false) as removes
from ident i left join ok o using (archive) left join first_ok f on f.dir = i.dir""")
def q_cleanup_interactive(spark, d):
    plan = R.delete_unpacked(A.conv_world(spark, d), A.conv_members(spark, d), A.conv_answers(spark, d))
    return plan.select("archive", "dir", "n_differences", "identical", "decision", "status", "removes")


# Fixed rules of the whole run: archives with long turns are moved and cleaned up, short files deleted.
RUN_RULES = [
    {"name": "long turns", "conditions": {"contain": "assistant/t", "larger": "300B"}, "check_archive": True,
     "action": {"type": "move", "target": "../long"}, "delete_unpacked_on_match": True},
    {"name": "short turns", "conditions": {"end": ".txt", "smaller": "100B"}, "action": {"type": "delete"}},
]
_RUN_SQL = _CONV_DIFF_SQL + ", " + O.CONVW + """, inside as (select distinct archive from mem
  where contains(lower(member), 'assistant/t') and size > 300),
hit as (select c.*, c.parent||'/'||c.name as path, case when i.archive is not null then 0
  when ends_with(c.name, '.txt') and c.size < 100 then 1 end as rule_idx
  from convw c left join inside i on i.archive = c.parent||'/'||c.name)"""
_UP_SQL = "regexp_extract(parent, '^(.*)/[^/]*$', 1) || '/long/' || name"


def _conv_run(spark, d):
    world, members = A.conv_world(spark, d), A.conv_members(spark, d)
    return R.organize(world, RUN_RULES, INV_AS_OF, members=members, always_delete=True)


@query("organize_run", _RUN_SQL + f"""select path, rule_idx, case rule_idx when 0 then 'move' else 'delete' end as action_type,
  case rule_idx when 0 then {_UP_SQL} end as final_path, 'planned' as status, true as decision from hit where rule_idx is not null""")
def q_organize_run(spark, d):
    return _conv_run(spark, d).plan.select("path", "rule_idx", "action_type", "final_path", "status", "decision")


@query("organize_run_stats", _RUN_SQL + """select count(*) as total_files, count_if(date is not null and rule_idx is not null) as processed_files,
  count_if(date is not null and rule_idx is null) as skipped_files, count_if(date is null) as errors from hit""")
def q_organize_run_stats(spark, d):
    return _conv_run(spark, d).stats


@query("organize_run_cleanup", _RUN_SQL + f""", mv as (select path as archive, {_UP_SQL} as final_path from hit where rule_idx = 0),
r as (select m.archive, m.final_path, i.dir, i.identical, min(case when i.identical then i.archive end) over (partition by i.dir) as removed_by
  from mv m join ident i using (archive))
select archive, final_path, dir, identical, identical as decision, case when archive = removed_by then 'removed'
  when archive > removed_by then 'gone' when identical then 'kept' else 'different' end as status from r""")
def q_organize_run_cleanup(spark, d):
    return _conv_run(spark, d).cleanup


@query("match_stream_epochs", ORACLE["match_rules"])
def q_match_stream_epochs(spark, d):
    import uuid

    from .session import checkpoint_dir
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = A.table(spark, d, "events")
    events.repartition(4).write.parquet(f"{base}/in")  # several files, so several micro-batches
    return match_stream(spark, f"{base}/in", events.schema, A.inv_from_events, INV_RULES, INV_AS_OF, out_dir=f"{base}/out")
