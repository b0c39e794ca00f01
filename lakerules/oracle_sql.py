"""DuckDB SQL for the adapters, used by the oracle strings of the query registry.

These are written independently of the Spark code (plain SQL over the driver's tables).
"""

INV = """inv as (select '/data/'||event_type||'/u'||user_id as parent,
  case when event_id%17=0 then '.' else '' end||event_type||'_'||event_id||
  case event_id%5 when 0 then '.log' when 1 then '.zip' when 2 then '.TMP' when 3 then '.csv' else '' end as name,
  cast(floor(value*1048576) as bigint) as size, ts as mtime, false as is_directory, event_id as seq from events)"""

INVL = """invl as (select '/'||l_returnflag||'/s'||l_suppkey as parent,
  'o'||l_orderkey||'_'||l_linenumber||
  case l_partkey%4 when 0 then '.parquet' when 1 then '.tmp' when 2 then '.zip' else '' end as name,
  cast(floor(l_extendedprice*100) as bigint) as size, l_shipdate as mtime, false as is_directory,
  l_orderkey*8+l_linenumber as seq from lineitem)"""

CLAIM = """claim as (select p_brand as parent, replace(p_name,' ','_')||'.dat' as name, p_partkey as seq from part)"""

MEM = """mem as (select 'conv_'||conv_id||'.zip' as archive,
  case when conv_id%4=0 then 'conv_'||conv_id||'/' else '' end||role||'/t'||turn||'.txt' as member,
  cast(length(text)+case when conv_id%7=0 then 1 else 0 end as bigint) as size, turn as pos
from conversations where not (conv_id%5=0 and turn=0)
union all
select distinct 'conv_'||conv_id||'.zip', case when conv_id%4=0 then 'conv_'||conv_id||'/' else '' end||role||'/', cast(0 as bigint),
  cast(-1 as bigint) from conversations where conv_id%6=0)"""

DIR = """dirf as (select 'conv_'||conv_id as dir, role||'/t'||turn||'.txt' as rel, cast(length(text) as bigint) as size
from conversations where conv_id%3<>1 and not (conv_id%8=0 and turn=1)
union all
select distinct 'conv_'||conv_id, role||'/', cast(0 as bigint) from conversations where conv_id%3<>1)"""

TREE = """tree as (select '/'||regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') as path,
  cast(length(html) as bigint) as size, page_id as seq from pages)"""

TXT = """txt as (select doc_id as seq, '/'||source||'/'||lang as parent, text as name_nfc,
  replace(text,'\u00e9','e\u0301') as name_nfd, n_chars as size from documents)"""

APPR = """appr as (select event_id as id, event_type as key,
  case when event_id%97=3 then 'never' when event_id%89=5 then 'a' when event_id%2=0 then 'n' else '' end as resp
from events)"""

RULES = """rules as (select s.source as ruleset, r.* from (values
 (0,'old tmp','end','.tmp','delete',null), (0,'old tmp','older','7d','delete',null),
 (1,'big zips','regex','(?:click|view)_[0-9]+[.]zip$','move','archives'), (1,'big zips','larger','100MB','move','archives'),
 (2,'errors','start','error','compress','errs'), (2,'errors','newer','2w','compress','errs'),
 (3,'','bigger','1XB','shred',null), (4,null,'larger','1.5.5GB','move',null), (5,'up','start','x','move','../x')
) r(rule_idx, name, cond_key, cond_value, action_type, target), (select distinct source from documents) s)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"

# Directory rows of INV: sizes and times rolled up from the immediate parents to every ancestor.
INV_DIRS = """dirs as (select path, cast(sum(size) as bigint) as size, max(mtime) as mtime, cast(sum(n) as bigint) as n_files
from (select unnest(list_filter(list_transform(range(1, len(string_split(parent,'/'))+1),
        lambda i: array_to_string(string_split(parent,'/')[1:i], '/')), lambda x: x <> '')) as path, size, mtime, n
      from (select parent, sum(size) as size, max(mtime) as mtime, count(*) as n from inv group by parent))
group by path)"""

INV_ENTRIES = """entries as (select parent, name, size, mtime, false as is_directory from inv
union all select regexp_extract(path, '^(.*)/[^/]*$', 1), regexp_extract(path, '[^/]*$'), size, mtime, true from dirs)"""

# TREE as files + every directory (derived from paths and explicit entries) with its size.
TREE_ENTRIES = """tfiles as (select path, size from tree where not ends_with(path, '/')),
tdirs as (select distinct unnest(list_filter(list_transform(
    range(1, len(string_split(rtrim(path, '/'), '/')) + case when ends_with(path, '/') then 1 else 0 end),
    lambda i: array_to_string(string_split(rtrim(path, '/'), '/')[1:i], '/')), lambda x: x <> '')) as path from tree),
tentries as (select path, size, false as is_directory from tfiles
  union all
  select d.path, cast(coalesce(sum(f.size), 0) as bigint), true from tdirs d
  left join tfiles f on starts_with(f.path, d.path || '/') group by d.path)"""

# Structure diff of MEM (archives) against DIR (directories), step by step.
_STEM = "substr(regexp_extract({c}, '[^/]*$'), 1, length(regexp_extract({c}, '[^/]*$')) - length(regexp_extract(regexp_extract({c}, '[^/]*$'), '^.+(\\.[^.]+)$', 1)))"
DIFF = """arcs as (select distinct archive from mem),
dirs as (select distinct dir from dirf),
pairs as (select a.archive, d.dir from arcs a join dirs d
  on regexp_extract(a.archive, '^(.*)/[^/]*$', 1) = regexp_extract(d.dir, '^(.*)/[^/]*$', 1)
  and """ + _STEM.format(c="a.archive") + """ = regexp_extract(d.dir, '[^/]*$')
  where regexp_matches(lower(a.archive), '(\\.zip|\\.rar|\\.7z)$')),
am as (select p.archive, p.dir, m.member, m.size, m.pos, nfc_normalize(m.member) as n,
  nfc_normalize(""" + _STEM.format(c="p.archive") + """) || '/' as root from mem m join pairs p using (archive)),
hasdirs as (select archive, dir, bool_or(ends_with(n, '/') and n <> root) as has_dirs from am group by archive, dir),
aside as (select archive, dir, case when starts_with(n, root) then substr(n, length(root) + 1) else member end as rel,
  size, pos from am where n <> root),
a as (select archive, dir, nfc_normalize(rel) as rel, arg_max(size, pos) as archive_size, count(*) as copies
  from aside group by archive, dir, nfc_normalize(rel)),
dside as (select p.archive, p.dir, f.rel, f.size from dirf f join pairs p using (dir) left join hasdirs h using (archive, dir)
  where (coalesce(h.has_dirs, false) or not ends_with(f.rel, '/')) and not regexp_matches(f.rel, '(^|/)\\.')),
d as (select archive, dir, nfc_normalize(rel) as rel, arg_max(size, rel) as dir_size from dside
  group by archive, dir, nfc_normalize(rel)),
cmp as (select coalesce(a.archive, d.archive) as archive, coalesce(a.dir, d.dir) as dir, coalesce(a.rel, d.rel) as rel,
  case when a.rel is null then 'extra' when d.rel is null then 'missing'
       when a.archive_size <> d.dir_size then 'size_mismatch' else 'same' end as kind,
  a.archive_size, d.dir_size
  from a full outer join d on a.archive = d.archive and a.dir = d.dir and a.rel = d.rel),
diffs as (select * from cmp where kind <> 'same'),
ident as (select p.archive, p.dir, cast(coalesce(n.n, 0) as bigint) as n_differences, coalesce(n.n, 0) = 0 as identical
  from pairs p left join (select archive, dir, count(*) as n from diffs group by archive, dir) n using (archive, dir))"""

# MEM, DIR and the files of the nested world: archives at two depths, every ninth as two formats.
_ROOT = "'/data/conv/'||({n}%7)||case when {n}%2=1 then '/deep/er' else '' end"
_NUMBER = "cast(regexp_extract(archive, 'conv_(-?[0-9]+)[.]', 1) as bigint)"
CONV_MEM = MEM.replace("mem as (", "mem0 as (", 1) + """,
mem1 as (select *, """ + _NUMBER + """ as n from mem0),
mem as (select """ + _ROOT.format(n="n") + """||'/'||archive as archive, member, size, pos from mem1
  union all select """ + _ROOT.format(n="n") + """||'/'||replace(archive, '.zip', '.7z'), member, size, pos from mem1 where n%9=0)"""
CONV_DIR = DIR.replace("dirf as (", "dirf0 as (", 1) + """,
dirf1 as (select *, cast(split_part(dir, '_', 2) as bigint) as n from dirf0),
dirf as (select """ + _ROOT.format(n="n") + """||'/'||dir as dir, rel, size from dirf1 d
  where not ends_with(rel, '/') or exists (select 1 from dirf1 f where f.dir = d.dir and starts_with(f.rel, d.rel) and f.rel <> d.rel))"""
CONVW = """convw as (select """ + _ROOT.format(n="conv_id") + """||'/conv_'||conv_id||'/'||role as parent, 't'||turn||'.txt' as name,
  cast(length(text) as bigint) as size, 1700000000+conv_id*100+turn as date from conversations
  where conv_id%3<>1 and not (conv_id%8=0 and turn=1)
union all
select regexp_extract(archive, '^(.*)/[^/]*$', 1), regexp_extract(archive, '[^/]*$'), cast(sum(size) as bigint), null from mem group by archive),
cdirs as (select distinct unnest(list_filter(list_transform(range(1, len(string_split(parent,'/'))+1),
  lambda i: array_to_string(string_split(parent,'/')[1:i], '/')), lambda x: x <> '')) as path from convw),
convpairs as (select c.parent||'/'||c.name as archive, d.path as dir from convw c
  join cdirs d on d.path = c.parent||'/'||regexp_replace(c.name, '[.](zip|7z)$', '') where regexp_matches(c.name, '[.](zip|7z)$'))"""
