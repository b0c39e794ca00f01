"""Conversation structure repair (operator 12): generalised LR repair over the role grammar.

    Conversation -> (nothing) | Body
    Body         -> Pair | s Pair | Body Pair
    Pair         -> u a

A conversation's rows are the input symbols, by the initial of their role. Besides shifting a row
(keep), the parser may shift it as another role (rerole), skip it (delete) or shift an empty message
that is not there (insert), each at a price. All parses run at once on a graph-structured stack;
stacks with equal tops merge into the one with the least (cost, audit).

Merging is exact. Inserts are made as late as possible, right before a shift or at the end, so the
audits of two tops at one row end in a row's edit and have as many of those: neither begins the
other, whichever is smaller stays smaller whatever follows, and a rank per top stands for its audit.

For the same reasons parses compose. The rows, reduced to a hash and a few bits, are dealt out by range
of (conversation, turn), so one conversation of any length is cut into runs over many tasks. A run that
may continue a conversation is parsed from every top; a fold over runs, of a few numbers each, picks the
path. Equal rows of a turn travel as one with a count.

The edits go back to the texts as a script per run that sorts right before its first row: one shuffle by
conversation, streamed row by row. That last pass reads a conversation in one task, as its digest, one
hash over all of it in order, cannot be split; it holds one script and no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakerules.llm._common import crc, cut, pick

KEEP, REROLE, DELETE, INSERT, OPEN_ENDED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}

# Scripts say what is done row by row: K keep, D delete, u / a rerole, U / A insert before the row.
TO_AUDIT = str.maketrans("uaUA", "RRII")


# --- the parser -----------------------------------------------------------------------------------

SHIFT = {(0, "s"): 3, (0, "u"): 5, (3, "u"): 5, (2, "u"): 5, (5, "a"): 8}
REDUCE = {8: ("Pair", 2), 4: ("Body", 1), 6: ("Body", 2), 7: ("Body", 2)}
GOTO = {(0, "Pair"): 4, (3, "Pair"): 6, (2, "Pair"): 7, (0, "Body"): 2}
ACCEPTS = (0, 2)
#: A stack for each top that can be left after a symbol. Which stack is below a top does not matter
#: to this grammar: every way through state 5 reduces to the same stack.
STACKS = {0: (0,), 3: (0, 3), 5: (0, 5), 2: (0, 2)}
TOPS = tuple(STACKS)


def shift(top: int, symbol: str) -> int | None:
    """The top after shifting ``symbol`` and reducing what can be reduced; None where it is an error."""
    if (top, symbol) not in SHIFT:
        return None
    stack = [*STACKS[top], SHIFT[top, symbol]]
    while stack[-1] in REDUCE:
        head, n = REDUCE[stack[-1]]
        del stack[-n:]
        stack.append(GOTO[stack[-1], head])
    return stack[-1]


def _inserts(top: int) -> dict[int, str]:
    """Every top that inserts alone lead to, with the shortest run of them."""
    found, open_tops = {top: ""}, [top]
    for at in open_tops:
        for symbol in "ua":
            to = shift(at, symbol)
            if to is not None and to not in found:
                found[to] = found[at] + symbol.upper()
                open_tops.append(to)
    return found


INSERTS = {top: _inserts(top) for top in TOPS}


def _edits(initial: str, open_ended: bool) -> dict[int, list[tuple[int, int, str]]]:
    """What a row that need not go may do: per top the new tops, each with the least (price, audit)."""
    table = {}
    for top in TOPS:
        best = {top: (DELETE, "D", "D")}
        for at, before in INSERTS[top].items():
            for symbol, letter, price in ((initial, "K", KEEP), ("u", "u", REROLE), ("a", "a", REROLE)):
                to = shift(at, symbol)
                if to is None:
                    continue
                script = before + letter
                price = price + INSERT * len(before) + OPEN_ENDED * open_ended
                best[to] = min(best.get(to, (price + 1, "", "")), (price, script.translate(TO_AUDIT), script))
        table[top] = [(to, price, script) for to, (price, _, script) in best.items()]
    return table


EDITS = {(initial, open_ended): _edits(initial, open_ended) for initial in "sua?" for open_ended in (False, True)}


def parse(rows: list[tuple[str, bool, bool, int]], entry: int) -> dict[int, tuple[int, int, str]]:
    """Parse ``rows`` of (initial, must go, open-ended, further copies that must go) from one top.
    Returns per top at the end its cost, the rank of its audit and its script."""
    tops = {entry: (0, 0)}
    back = []
    for initial, must_go, open_ended, more in rows:
        gone = must_go + more
        if not must_go:
            table = EDITS[initial, open_ended]
            merged: dict[int, tuple] = {}
            for top, (cost, rank) in tops.items():
                for to, price, script in table[top]:
                    new = (cost + price, rank, script.translate(TO_AUDIT), top, script)
                    if to not in merged or new < merged[to]:
                        merged[to] = new
            ordered = sorted(merged, key=lambda to: merged[to][1:3])
            tops = {to: (merged[to][0], rank) for rank, to in enumerate(ordered)}
            back.append({to: (m[3], m[4]) for to, m in merged.items()})
        if gone:  # the same edit on every stack
            tops = {top: (cost + DELETE * gone, rank) for top, (cost, rank) in tops.items()}
            back.append("D" * gone)
    out = {}
    for top, (cost, rank) in tops.items():
        at, parts = top, []
        for step in reversed(back):
            if isinstance(step, str):
                parts.append(step)
            else:
                at, script = step[at]
                parts.append(script)
        out[top] = (cost, rank, "".join(reversed(parts)))
    return out


def finish(tops: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
    """The cheapest way to end: (cost, top, inserts at the end)."""
    ends = []
    for top, (cost, rank) in tops.items():
        for to, inserts in INSERTS[top].items():
            if to in ACCEPTS:
                ends.append((cost + INSERT * len(inserts), rank, inserts.translate(TO_AUDIT), top, inserts))
    cost, _, _, top, inserts = min(ends)
    return cost, top, inserts


# --- rows -----------------------------------------------------------------------------------------

def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with faults by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the
    row, 1 empties its text, 2 removes its ``.!?``, 3 gives it twice, 4 makes its role ``user``. Null
    roles and texts become one space, null parts of the key as well."""
    rows = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(crc(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    rows = rows.withColumn("fault", fault).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(blank("role")).alias("role"),
                       text.alias("text"), twice.alias("copy"))
    return rows.drop("copy")


def facts(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, key, kind``: the key is a hash of role and text, and the kind holds the role's
    initial (0 to 3 for s, u, a and any other) and whether the text is blank (4) or open-ended (8)."""
    initial = F.substring("role", 1, 1)
    held = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = held == ""
    kind = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
            + F.when(blank, 4).otherwise(0) + F.when(~blank & ~F.right(held, F.lit(1)).isin(".", "!", "?"), 8).otherwise(0))
    return rows.select("conv_id", "turn", _key().alias("key"), kind.alias("kind"))


def _key() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, key, kind, n, again``: equal rows of a turn as one with their number, and
    whether an earlier turn of the conversation has the same."""
    one = facts(rows).groupBy("conv_id", "turn", "key", "kind").agg(F.count(F.lit(1)).alias("n"))
    # the order of turns, nulls first; only keys of several turns are joined back
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    first = one.groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    found = one.join(first, one["conv_id"].eqNullSafe(first["c"]) & (one["key"] == first["k"]), "left")
    return found.select("conv_id", "turn", "key", "kind", "n", F.coalesce(place > F.col("first"), F.lit(False)).alias("again"))


# --- runs -----------------------------------------------------------------------------------------

def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _write(rows: Iterator[dict], schema: pa.Schema, size: int = 4096, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row.values() if isinstance(v, (str, list)))
        if len(held) >= size or weight > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


MOVE = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("script", pa.string())])
STATS = ("blank", "duplicate", "truncated", "illegal", "turns")
RUN_FIELDS = [*((s, pa.int64()) for s in STATS), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
              ("first_key", pa.binary()), ("has_null", pa.bool_()), ("initials", pa.string()), ("moves", pa.list_(MOVE))]
RUN_SQL = ("blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
           "first_key binary, has_null boolean, initials string, "
           "moves array<struct<entry:int, exit:int, cost:long, rank:int, script:string>>")
LEGAL = {"su", "ua", "au"}


def _runs(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), ("part", pa.int32()), *RUN_FIELDS])

    def run(conv, rows: Iterator[tuple], entries: tuple[int, ...]) -> dict:
        out = dict.fromkeys(STATS, 0) | {"conv_id": conv, "first_turn": None, "last_turn": None, "has_null": False}
        symbols, previous, begun = [], "", False
        for _, turn, key, kind, n, again, part in rows:
            initial, blank, open_ended = "sua?"[kind & 3], bool(kind & 4), bool(kind & 8)
            if not begun:
                out |= {"part": part, "first_key": key, "initials": initial}
                begun = True
            if turn is None:
                out["has_null"] = True
            elif turn != out["last_turn"]:
                out["turns"] += 1
                out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
                out["last_turn"] = turn
            out["illegal"] += (previous != "" and previous + initial not in LEGAL) + (n - 1)
            previous = initial
            if blank:
                out["blank"] += n
            else:
                out["duplicate"] += n - 1 + again
                out["truncated"] += open_ended and not again
            symbols.append((initial, blank or again, open_ended, n - 1))
        out["initials"] += previous
        out["moves"] = [{"entry": entry, "exit": to, "cost": cost, "rank": rank, "script": script}
                        for entry in entries for to, (cost, rank, script) in parse(symbols, entry).items()]
        return out

    def runs(batches):
        def found():
            entries = TOPS  # the first run of a part may continue the part before
            for conv, rows in groupby(_stream(batches), key=lambda r: r[0]):
                yield run(conv, rows, entries)
                entries = (0,)
        return _write(found(), schema)
    return runs


def runs(rows: DataFrame) -> DataFrame:
    """One row per conversation and part of the range partitioning: its counts and what parsing it does
    from each top."""
    order = ["conv_id", "turn", "key"]
    kind = rows.schema["conv_id"].dataType
    dealt = distinct_rows(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select(*order, "kind", "n", "again", F.spark_partition_id().alias("part"))
    return dealt.mapInArrow(_runs(_arrow(rows, "conv_id")), f"conv_id {kind.simpleString()}, part int, {RUN_SQL}")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _fold(conv_type: pa.DataType):
    path = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32())]))
    schema = pa.schema([("conv_id", conv_type), *((c, pa.int64()) for c in RESULT), ("tail", pa.string()), ("path", path)])

    def fold(conv, parts: Iterator[tuple]) -> dict:
        out = dict.fromkeys(RESULT, 0) | {"conv_id": conv}
        tops, back, last, low, high, turns = {0: (0, 0)}, [], "", None, None, 0
        for _, part, blank, duplicate, truncated, illegal, n_turns, first, latest, initials, moves in parts:
            out["blank"] += blank
            out["duplicate"] += duplicate
            out["truncated"] += truncated
            out["illegal"] += illegal + (last != "" and last + initials[0] not in LEGAL)
            last = initials[1]
            if first is not None:
                turns += n_turns - (first == high)  # a turn cut in two
                low, high = first if low is None else low, latest
            merged: dict[int, tuple] = {}
            for m in moves:
                if m["entry"] in tops:
                    cost, rank = tops[m["entry"]]
                    new = (cost + m["cost"], rank, m["rank"], m["entry"])
                    if m["exit"] not in merged or new < merged[m["exit"]]:
                        merged[m["exit"]] = new
            ordered = sorted(merged, key=lambda to: merged[to][1:3])
            tops = {to: (merged[to][0], rank) for rank, to in enumerate(ordered)}
            back.append((part, {to: m[3] for to, m in merged.items()}))
        out["cost"], top, out["tail"] = finish(tops)
        out["gaps"] = 0 if low is None else high - low + 1 - turns
        out["path"] = []
        for part, entry_of in reversed(back):
            out["path"].append({"part": part, "entry": entry_of[top], "exit": top})
            top = entry_of[top]
        return out

    def folds(batches):
        return _write((fold(conv, parts) for conv, parts in groupby(_stream(batches), key=lambda r: r[0])), schema)
    return folds


class Repair:
    """The decided repair of a table of ``conv_id, turn, role, text`` (as :func:`damage` returns)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.conv_type = rows.schema["conv_id"].dataType.simpleString()
        self.arrow_type = _arrow(rows, "conv_id")
        found = cut(runs(rows))
        numbers = found.select("conv_id", "part", *STATS, "first_turn", "last_turn", "initials", F.transform(
            "moves", lambda m: m.dropFields("script")).alias("moves"))
        numbers = numbers.repartition("conv_id").sortWithinPartitions("conv_id", "part")
        self.decided = cut(numbers.mapInArrow(_fold(self.arrow_type), f"conv_id {self.conv_type}, " + ", ".join(
            f"{c} long" for c in RESULT) + ", tail string, path array<struct<part:int, entry:int, exit:int>>"))
        steps = self.decided.select(F.col("conv_id").alias("c"), F.explode("path").alias("s"))
        chosen = F.filter("moves", lambda m: (m["entry"] == F.col("s.entry")) & (m["exit"] == F.col("s.exit")))
        self.scripts = found.join(steps, found["conv_id"].eqNullSafe(steps["c"]) & (found["part"] == steps["s.part"])).select(
            "conv_id", F.when(~F.col("has_null"), F.col("first_turn")).alias("turn"), F.col("first_key").alias("key"),
            F.get(chosen, F.lit(0))["script"].alias("script"))

    def _dealt(self) -> DataFrame:
        """Rows, the scripts right before the rows they begin with, and the end of each conversation; in
        order within a partition that holds whole conversations."""
        none = {"turn": "long", "key": "binary", "role": "string", "text": "string", "script": "string"} | dict.fromkeys(RESULT, "long")

        def padded(df: DataFrame, tag: int) -> DataFrame:
            cols = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
            return df.select("conv_id", F.lit(tag).alias("tag"), *cols)

        parts = [padded(self.scripts, 0), padded(self.rows.withColumn("key", _key()), 1),
                 padded(self.decided.withColumnRenamed("tail", "script"), 2)]
        all_rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return all_rows.repartition("conv_id").sortWithinPartitions(
            "conv_id", F.col("tag") == 2, F.col("turn").asc_nulls_first(), "key", "tag").select(
            "conv_id", "tag", "role", "text", "script", *RESULT)

    def repaired(self) -> DataFrame:
        """``conv_id, n, role, text, edit``: the messages of every conversation after the repair,
        numbered from 0; ``edit`` is keep, rerole or insert."""
        schema = pa.schema([("conv_id", self.arrow_type), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

        def run(batches):
            def found():
                for conv, rows in groupby(_stream(batches), key=lambda r: r[0]):
                    n = 0
                    for _, role, text, edit in _apply(rows):
                        if edit:
                            yield {"conv_id": conv, "n": n, "role": role, "text": text, "edit": edit}
                            n += 1
            return _write(found(), schema)
        return self._dealt().mapInArrow(run, f"conv_id {self.conv_type}, n long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """``conv_id``, the counts, ``cost``, ``audit`` and ``repaired_sha256`` of every conversation."""
        schema = pa.schema([("conv_id", self.arrow_type), *((c, pa.int64()) for c in RESULT), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def run(batches):
            def found():
                for conv, rows in groupby(_stream(batches), key=lambda r: r[0]):
                    audit, digest, glue, result = [], hashlib.sha256(), "", None
                    for record, role, text, edit in _apply(rows):
                        if record is not None:
                            audit.append(record[4].translate(TO_AUDIT))
                            result = record[5:]
                        if edit:
                            digest.update(f"{glue}{role}:{text}".encode())
                            glue = "\n"
                    yield dict(zip(RESULT, result)) | {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            return _write(found(), schema)
        return self._dealt().mapInArrow(run, f"conv_id {self.conv_type}, " + ", ".join(f"{c} long" for c in RESULT)
                                        + ", audit string, repaired_sha256 string")


def _apply(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Follow the scripts of one conversation: (record, None, None, "") for every script and the end,
    and (None, role, text, edit) for every message that is left."""
    script, at = "", 0
    for record in rows:
        _, tag, role, text, given = record[:5]
        if tag != 1:
            yield record, None, None, ""
            if tag == 2:
                for letter in given:
                    yield None, NAMES[letter.lower()], "", "insert"
            else:
                script, at = given, 0
            continue
        while script[at] in "UA":
            yield None, NAMES[script[at].lower()], "", "insert"
            at += 1
        edit = script[at]
        at += 1
        if edit == "K":
            yield None, role, text, "keep"
        elif edit != "D":
            yield None, NAMES[edit], text, "rerole"


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repair:
    """Decide the repair of every conversation; see :class:`Repair` for what it gives.

    A conversation's rows are taken by turn, nulls first; rows of one turn by the hash of role and text,
    so that equal ones are neighbours. A row is blank if its text has nothing but white space, a
    duplicate if role and text came before in the conversation, truncated if its last character that
    is not white space is none of ``.!?``; the first that holds counts.

    - Null roles and texts count as one space. Rows with a null conversation id are one conversation.
    - A role that does not begin with s, u or a can only be deleted or reroled; so can an empty one.
    - Rows given twice are duplicates. A conversation of faulty rows alone is left empty.
    - Conversations and texts of any length are repaired whole. An empty table gives empty results;
      other columns are not read.
    """
    picked = pick(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return Repair(picked.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text")))


def with_every_conversation(found: DataFrame, originals: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Adds conversations of ``originals`` that have no rows left: zeros, an empty audit, and the hash
    of nothing."""
    ids = pick(originals, conv_id=conv_col).distinct().withColumnRenamed("conv_id", "original")
    both = ids.join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(F.col("original").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in RESULT],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
