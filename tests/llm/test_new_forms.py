"""Sharding, conversation repair and tokenizer alignment against plain models of the same."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakerules.llm import align, queries, repair, sharding

SF = "/root/testdata/sf0.01"


# --- sharding -------------------------------------------------------------------------------------

class Twister:
    """Uniform draws below n, as the Mersenne twister behind the built-in shuffle gives them."""

    def __init__(self, seed):
        self.state = np.random.RandomState([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF])

    def below(self, n):
        while True:
            bits = int(self.state.randint(0, 1 << 32, dtype=np.uint32)) >> 1
            if n & (n - 1) == 0:
                return n * bits >> 31
            if bits - bits % n + n - 1 < 1 << 31:
                return bits % n


def fisher_yates(n, draws):
    out = []
    for i in range(n):
        j = draws.below(i + 1)
        out.append(i)
        out[i], out[j] = out[j], i
    return out


def plain_shards(rows, n_shards, seed, buckets):
    """rows of (id, text) -> (id, text, shard, slot)."""
    held = collections.defaultdict(list)
    for i, text in rows:
        h = 42
        for part in (f"shard:{seed}", "" if i is None else str(i), text or ""):
            h = xxhash.xxh64_intdigest(part.encode(), h)
        h -= (h >= 1 << 63) << 64
        crc = -1 if text is None else zlib.crc32(text.encode())
        held[h % sharding.CELLS // (sharding.CELLS // buckets)].append(((h, "" if i is None else str(i), crc), (i, text)))
    most, order = max(map(len, held.values())), []
    for b in range(buckets):
        records = [r for _, r in sorted(held[b], key=lambda v: v[0])]
        order += [records[i] for i in fisher_yates(most, Twister(seed + b)) if i < len(records)]
    short, longer = divmod(len(order), n_shards)
    out = []
    for s in range(n_shards):
        size = short + (s < longer)
        out += [(*r, s, slot) for slot, r in enumerate(order[:size])]
        order = order[size:]
    return out


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("n_shards,least", [(8, 16), (3, 1), (2000, 4)])
def test_shards_equal_a_plain_external_shuffle(spark, n_shards, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    awkward = spark.createDataFrame([(None, None), (-1, ""), (-2, None), (-3, "x" * 200_000)], docs.schema)
    rows = docs.unionByName(awkward)
    got = sharding.shuffle_shards(rows, n_shards=n_shards, least_buckets=least, bucket_rows=1 << 12).collect()
    want = plain_shards([tuple(r) for r in rows.collect()], n_shards, sharding.SEED, max(least, 1))
    assert by_text(tuple(r) for r in got) == by_text(want)


def check_law(rows, n, n_shards):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(n_shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_with_a_third_of_equal_rows(spark):
    rows = spark.range(900).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text")
    got = sharding.shuffle_shards(rows, bucket_rows=16, least_buckets=4).collect()
    check_law(got, 900, 8)
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(map(tuple, rows.collect()))
    # copies are dealt over all buckets: no shard has more than its share by far
    assert max(collections.Counter(r["shard"] for r in got if r["text"] == "same").values()) < 75


def test_shards_of_awkward_columns_and_empty_tables(spark):
    rows = spark.sql("select cast(id as string) as doc_id, 'a' as text, map('k', id) as m, id as shard, id as __bucket, "
                     "id as DOC_ID, id as c0 from range(20)")
    got = sharding.shuffle_shards(rows, n_shards=4)
    assert got.columns == [*rows.columns, "shard", "slot"]
    out = got.collect()
    assert sorted(r[0] for r in out) == sorted(str(i) for i in range(20)) and all(r[2] == {"k": r[3]} for r in out)
    assert collections.Counter(r[7] for r in out) == {0: 5, 1: 5, 2: 5, 3: 5}
    none = sharding.shuffle_shards(rows.limit(0))
    assert none.columns == got.columns and none.count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_shards(rows, n_shards=0)


def test_shards_do_not_depend_on_how_rows_arrive(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = ["doc_id", "shard", "slot"]
    a = sharding.shuffle_shards(docs).select(cols)
    b = sharding.shuffle_shards(docs.repartition(5).orderBy("n_chars")).select(cols)
    assert a.exceptAll(b).isEmpty()


def test_written_shards_are_whole_and_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    back = sharding.write_shards(docs, str(tmp_path / "out"))
    check_law(back.select("shard", "slot").collect(), 1000, 8)
    assert back.select(docs.columns).exceptAll(docs).isEmpty()
    one = spark.read.parquet(str(tmp_path / "out" / "shard=3")).select(F.input_file_name().alias("f"), "slot").collect()
    for _, slots in collections.Counter(r["f"] for r in one).items():
        assert slots
    files = collections.defaultdict(list)
    for r in one:
        files[r["f"]].append(r["slot"])
    assert all(v == sorted(v) for v in files.values())


def test_shard_query_has_the_columns_of_its_contract(spark):
    got = queries.op11_sharding(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    check_law(rows, 1000, 8)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "rows")


# --- repair ---------------------------------------------------------------------------------------

AFTER = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def with_inserts(found):
    """Every state's parses, after up to three inserts."""
    out, front = {k: list(v) for k, v in found.items()}, [(k, v) for k, vs in found.items() for v in vs]
    for _ in range(3):
        front = [(AFTER[st][i], (cost + 3, audit + "I", left + ((repair.NAMES[i], ""),)))
                 for st, (cost, audit, left) in front for i in "ua" if i in AFTER[st]]
        for st, parse in front:
            out.setdefault(st, []).append(parse)
    return out


def plain_repair(rows):
    """The result of one conversation's (turn, role, text) rows, by search over whole audits: parses are
    dropped only where they cost more than every cheaper one could make up for."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults, found = set(), [], {"0": [(0, "", ())]}
    for turn, role, text in rows:
        held = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        after = {}
        for st, parses in with_inserts(found).items():
            for cost, audit, left in parses:
                after.setdefault(st, []).append((cost + 4, audit + "D", left))
                if fault in ("blank", "duplicate"):
                    continue
                for initial, letter, price, kept in ((role[:1], "K", 0, role), ("u", "R", 3, "user"), ("a", "R", 3, "assistant")):
                    to = AFTER[st].get(initial)
                    if to:
                        after.setdefault(to, []).append((cost + price + 3 * (fault == "truncated"), audit + letter, left + ((kept, text),)))
        found = {}
        for st, parses in after.items():
            least = min(p[0] for p in parses)
            found[st] = sorted(p for p in parses if p[0] <= least + 6)[:200]
    ends = with_inserts(found)
    cost, audit, left = min((p for st in "0a" for p in ends.get(st, [])), key=lambda p: p[:2])
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()}, left


def plain_repairs(rows, originals):
    held = collections.defaultdict(list)
    for conv, *row in rows:
        held[conv].append(tuple(row))
    return {conv: plain_repair(held[conv]) for conv in originals}


def by_conversation(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def random_turns(seed, conversations=40):
    rnd, rows = random.Random(seed), []
    for conv in [*range(conversations), None]:
        for _ in range(60 if conv == 7 else rnd.randint(0, 9)):
            rows.append((conv, rnd.choice([None, *range(7)]) if conv != 7 else rnd.randint(0, 80),
                         rnd.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]),
                         rnd.choice(["a.", "b", "c!", "d?  ", "", " \n", None, "e", "f.", "g.", "h.", "é…"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 23)])
def test_repair_equals_a_search_also_when_cut_into_runs(spark, seed, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = random_turns(seed)
        plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        decided = repair.repair(spark.createDataFrame(rows, SCHEMA))
        want = plain_repairs(plain, {r[0] for r in rows})
        assert by_conversation(decided.digests()) == {c: w for c, (w, _) in want.items()}
        left = collections.defaultdict(list)
        for r in decided.repaired().orderBy("conv_id", "n").collect():
            assert r["n"] == len(left[r["conv_id"]])
            left[r["conv_id"]].append((r["role"], r["text"]))
        assert {c: tuple(v) for c, v in left.items()} == {c: v for c, (_, v) in want.items() if v}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repair_query_equals_a_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    want = plain_repairs(plain_damage(rows), {r[0] for r in rows})
    assert by_conversation(queries.op12_repair(spark, SF)) == {c: w for c, (w, _) in want.items()}


def test_damage_of_nulls_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 3, "user", "x."), (5, None, None, "y!"), (5, 1, "assistant", None)] * 2
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA + ", TEXT string, fault int")
    got = repair.damage(df)
    assert by_text(tuple(r) for r in got.collect()) == by_text(plain_damage(rows))
    everything = by_conversation(repair.with_every_conversation(repair.repair(got).digests(), df))
    assert everything == {c: w for c, (w, _) in plain_repairs(plain_damage(rows), {None, 5}).items()}


def test_repair_of_nothing_and_of_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).digests().count() == 0 and repair.repair(none).repaired().count() == 0
    some = spark.createDataFrame([(4, 0, "user", "a.")], SCHEMA)
    got = repair.with_every_conversation(repair.repair(none).digests(), some).collect()
    assert [tuple(r) for r in got] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_of_many_equal_rows_and_a_long_text(spark):
    rows = spark.sql("select 1L as conv_id, 2L as turn, 'user' as role, 'same.' as text from range(5000) union all "
                     "select 1L, 3L, 'assistant', repeat('long ', 100000) || '.'")
    [r] = repair.repair(rows).digests().collect()
    text = "user:same.\nassistant:" + "long " * 100000 + "."
    assert r["audit"] == "K" + "D" * 4999 + "K" and r["cost"] == 4 * 4999 and r["illegal"] == 4999
    assert r["duplicate"] == 4999 and r["gaps"] == 0 and r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# --- alignment ------------------------------------------------------------------------------------

A = Tokenizer.from_file(align.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
BYTES = align.byte_alphabet()
OF_A = {i: bytes(BYTES[c] for c in t) for t, i in A.get_vocab().items()}


def of_b(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def spans(ids, token):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(token(i)), i))
        at = out[-1][1]
    return out


def plain_alignment(rows):
    docs, counts = [], collections.Counter()
    for i, text in rows:
        text = text or ""
        a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
        want = (" " + text).encode()
        if not text or b"".join(map(OF_A.get, a)) != want or b"".join(map(of_b, b)) != want:
            docs.append((i, [], [], [], []))
            continue
        a, b = spans(a, OF_A.get), spans(b, of_b)
        links, low = [], 0
        for start, end, x in a:
            while b[low][1] <= start:
                low += 1
            at = low
            while at < len(b) and b[at][0] < end:
                links.append((x, b[at][2]))
                at += 1
        counts.update(links)
        ends = sorted({s[1] for s in a} & {s[1] for s in b})
        parts = [[[] for _ in ends] for _ in "ab"]
        for part, side in zip(parts, (a, b)):
            for _, end, x in side:
                part[bisect.bisect_left(ends, end)].append(str(x))
        groups = ["|".join(map(",".join, g)) for g in zip(*parts)]
        docs.append((i, a, b, groups, links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, len(a), len(b), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, links in docs]


AWKWARD = [(-1, None), (-2, ""), (-3, "a  b ▁x"), (-4, "<|endoftext|> é😀​\n\n\t x  "), (None, "<0x41> <unk></s>"), (-6, " "),
           (-7, "\x00a"), (-7, "\x00a"), (-8, "日本語テキスト 한국어" * 3), (-9, "x" * 5000), (-10, "\U0001F468‍\U0001F469 ẛ̣ ﬁ")]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 300, 0])
def test_alignment_equals_a_plain_model(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 2000").select("doc_id", "text")
    rows = docs.unionByName(spark.createDataFrame(AWKWARD, docs.schema)).withColumn("row", F.lit(2)).toDF("doc_id", "text", "row")
    want = plain_alignment([(r[0], r[1]) for r in rows.collect()])
    assert by_text(map(tuple, align.align(rows, frequent=frequent).collect())) == by_text(want)


def test_alignment_query_has_all_documents(spark):
    got = queries.op13_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert by_text(map(tuple, got.collect())) == by_text(plain_alignment([tuple(r) for r in docs.collect()]))


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "doc_id int, text string")
    assert [tuple(r) for r in align.align(none).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert align.align(none.limit(0)).count() == 0


def test_rank_encoder_gives_the_ids_of_the_file(spark):
    rnd = random.Random(4)
    texts = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x500), rnd.randrange(0x2000, 0x2100),
                                     rnd.randrange(0x1F300, 0x1F700), 10, 32, 32])) for _ in range(60)) for _ in range(2000)]
    got = align.byte_level().encode(texts).to_pylist()
    assert got == [e.ids for e in A.encode_batch([" " + t for t in texts], add_special_tokens=False)]
