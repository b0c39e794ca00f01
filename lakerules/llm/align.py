"""Cross-tokenizer alignment (operator 13): two vocabularies' tokens of the same bytes.

Tokenizer A is a byte-level BPE read from a ``tokenizers`` file, B a SentencePiece model. A text is
encoded by both as ``space + text``; a text whose joined token bytes differ from that under either
one has no tokens.

A batch is worked on as whole Arrow columns: the ids of all texts are one list array, which is
flattened with its parent indices; token lengths are summed up cumulatively, restarted at each text;
text and end offset form the key on which a hash join of the two sides finds the ends they share.
Those cut the text into groups. Between two neighbouring ends of either side lies exactly one piece
of one A token and one B token, so the ends of both sides are the links. ``Table.group_by`` counts
id pairs within a text.

Spark adds these partial counts up to counts of the corpus and brings them back to the texts. The
most frequent pairs, at most ``FREQUENT`` of them, are broadcast; links of the others, the few of a long
tail, are joined by shuffle. Nothing is left out, and no table that grows with the corpus is broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakerules.llm._common import cut, pick
from lakerules.llm._text import buffer_of, release, slices

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SLICE = 1 << 19  # bytes of text worked on at once
FREQUENT = 1 << 18  # pairs that are broadcast at most
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for
    themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """``encode`` texts to an Arrow list array of ids; ``bytes`` of every id; its ``numbers`` as text."""

    def __init__(self, encode, token_bytes: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(token_bytes, pa.large_binary())
        self.lengths = pc.binary_length(self.bytes)
        self.size = len(token_bytes)


def byte_level(path: str = BYTE_BPE) -> Vocabulary:
    """Vocabulary of a ``tokenizers`` file. Its merges must be in the order of the ids they make: the
    file then says no more than ranks do, and the rank encoder gives the same ids, in a third of the time."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = byte_alphabet()
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or min(made, default=256) < 256:
        raise ValueError(f"merges of {path} are not in the order of their ids")
    ordinary = set(range(256)).union(made)  # special tokens are text like any other
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if i in ordinary}
    coder = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token

    def encode(texts: list[str]) -> pa.Array:
        ids = [coder.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return _lists(ids)

    return Vocabulary(encode, table)


def sentence_pieces(path: str = PIECES) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            table.append(bytes([int(piece[3:5], 16)]))
        else:
            table.append(piece.replace(SPACE, " ").encode())

    def encode(texts: list[str]) -> pa.Array:
        return _lists([np.array(x, np.int32) for x in model.encode(texts, num_threads=1)])

    return Vocabulary(encode, table)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values))


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(kind: str, path: str) -> Vocabulary:
    """Loaded once per process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = byte_level(path) if kind == "byte_level" else sentence_pieces(path)
    return _loaded[kind, path]


def tokens(lists: pa.Array, vocab: Vocabulary) -> pa.Table:
    """``text`` (parent index), ``id`` and ``end`` (offset in its text's bytes) of every token."""
    ids = lists.flatten()
    parent = pc.list_parent_indices(lists)
    length = vocab.lengths.take(ids)
    total = pc.cumulative_sum(length.cast(pa.int64()))
    # restart at each text: take off the sum up to where the text begins
    first = lists.offsets.slice(0, len(lists))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(first)
    return pa.table({"text": parent, "id": ids, "end": pc.subtract(total, before.take(parent))})


def _faithful(lists: pa.Array, vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: do its tokens' bytes join to a space and the text?"""
    joined = vocab.bytes.take(lists.flatten())
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    held = joined.buffers()[2]
    held = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    bounds = at[np.asarray(lists.offsets)]
    same = np.diff(bounds) == np.diff(offsets) + 1
    for i in np.flatnonzero(same):
        own = held[bounds[i]:bounds[i + 1]]
        same[i] = own[0] == 0x20 and np.array_equal(own[1:], data[offsets[i]:offsets[i + 1]])
    return same


def _numbers(size: int) -> pa.Array:
    """Ids as decimal text followed by what comes next: a comma, a bar or a semicolon."""
    digits = pa.array(np.arange(size)).cast(pa.large_string())
    return pa.concat_arrays([pc.binary_join_element_wise(digits, pa.scalar(mark, pa.large_string()), pa.scalar("", pa.large_string()))
                             for mark in ",|;"])


class Aligner:
    """Aligns batches of texts under two vocabularies."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides = (a, b)
        self.width = max(a.size, b.size)
        self.numbers = _numbers(self.width)
        # pairs are a * radix + b: 32 bits for the vocabularies at hand
        self.radix = 1 << (b.size - 1).bit_length()

    def align(self, texts: pa.Array) -> pa.Table:
        """Per text: ``n_a, n_b, n_groups, n_links, pairs, times, groups_sha256``."""
        n = len(texts)
        data, offsets = buffer_of(texts)
        plain = ["" if t is None else t for t in texts.to_pylist()]
        lists = [side.encode(plain) for side in self.sides]
        good = np.diff(offsets) > 0
        for side, ids in zip(self.sides, lists):
            good &= _faithful(ids, side, data, offsets)
        mask = pa.array(good)
        empty = pa.scalar([], lists[0].type)
        a, b = (tokens(pc.if_else(mask, ids, empty) if not good.all() else ids, side) for side, ids in zip(self.sides, lists))

        base = np.concatenate(([0], np.cumsum(np.diff(offsets) + 2)))  # keys of different texts never meet
        key = [np.asarray(t["end"]) + base[np.asarray(t["text"])] for t in (a, b)]
        shared = pa.table({"key": key[0]}).join(pa.table({"key": key[1]}), "key", join_type="inner", use_threads=False)
        ends = np.sort(np.asarray(shared["key"]))
        text_of_end = np.searchsorted(base, ends, "left") - 1
        n_groups = np.bincount(text_of_end, minlength=n)

        # every end of either side closes the overlap of one token of A and one of B
        links = np.sort(np.concatenate([key[0], key[1][~np.isin(key[1], ends, assume_unique=True)]]))
        at = [np.searchsorted(k, links, "left") for k in key]
        of = np.searchsorted(base, links, "left") - 1
        ids = [np.asarray(t["id"]) for t in (a, b)]
        pair = ids[0][at[0]].astype(np.int64) * self.radix + ids[1][at[1]]
        counted = pa.table({"text": of, "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
        order = np.argsort(np.asarray(counted["text"]), kind="stable")
        n_pairs = np.concatenate(([0], np.cumsum(np.bincount(np.asarray(counted["text"]), minlength=n))))
        as_list = lambda name: pa.ListArray.from_arrays(
            pa.array(n_pairs, pa.int32()), counted[name].combine_chunks().take(pa.array(order)))

        return pa.table({
            "n_a": np.bincount(np.asarray(a["text"]), minlength=n), "n_b": np.bincount(np.asarray(b["text"]), minlength=n),
            "n_groups": n_groups, "n_links": np.bincount(of, minlength=n), "pairs": as_list("pair"),
            "times": as_list("count_all").cast(pa.list_(pa.int32())),
            "groups_sha256": self._digests(ids, key, ends, n, [np.asarray(t["text"]) for t in (a, b)])})

    def _digests(self, ids, key, ends, n, text) -> pa.Array:
        """Hashes of the groups in writing, built as one buffer for the batch: every token is its number
        and the mark after it, ordered by group, then side."""
        group = [np.searchsorted(ends, k, "left") for k in key]
        mark = []
        for g, last in zip(group, (1, 2)):
            closes = np.ones(len(g), bool)
            closes[:-1] = g[1:] != g[:-1]
            mark.append(np.where(closes, last, 0))
        token = np.concatenate([i + m * self.width for i, m in zip(ids, mark)])
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        written = self.numbers.take(pa.array(token[order]))
        at = np.frombuffer(written.buffers()[1], np.int64)[written.offset:written.offset + len(written) + 1]
        held = written.buffers()[2]
        first = np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(text), minlength=n))))
        view = memoryview(held) if held is not None else memoryview(b"")
        # the mark after a text's last token belongs to no group
        return pa.array([hashlib.sha256(view[at[low]:at[high] - 1]).hexdigest() if high > low else ""
                         for low, high in zip(first[:-1], first[1:])])


COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


def _align_batches(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary("byte_level", path_a), vocabulary("pieces", path_b))
        for batch in batches:
            for low, high in slices(batch["text"], SLICE):
                found = aligner.align(batch["text"].slice(low, high - low))
                for part in found.add_column(0, "doc_id", [batch["doc_id"].slice(low, high - low)]).to_batches():
                    yield part
        release()
    return run


def token_alignment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = BYTE_BPE,
                    path_b: str = PIECES) -> DataFrame:
    """Per row: ``doc_id, n_a, n_b, n_groups, n_links, pairs, times, groups_sha256``. ``pairs`` are the
    linked id pairs of the text as ``a * radix + b`` (see :func:`radix`), ``times`` their links. Each
    text is read whole; nothing is shuffled."""
    rows = pick(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_align_batches(path_a, path_b), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS)
                           + ", pairs array<long>, times array<int>, groups_sha256 string")


def radix(path_b: str = PIECES) -> int:
    size = vocabulary("pieces", path_b).size
    return 1 << (size - 1).bit_length()


def pair_counts(aligned: DataFrame, radix: int) -> DataFrame:
    """``pair, n, best``: links per id pair in the corpus, and whether no pair of the same B id has more."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = cut(links.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n")))
    b = F.pmod(F.col("pair"), F.lit(radix))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_pairs(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The pairs with the highest counts, at most ``most`` of them, and whether these are all. The least
    count comes from a histogram of at most some thousand bins."""
    size = F.floor(F.log2("n") * 32)
    bins = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    least, held = None, 0
    for size_bin, pairs in sorted(bins, reverse=True):
        if held + pairs > most:
            break
        least, held = size_bin, held + pairs
    top = counts.filter(F.lit(False) if least is None else size >= least)
    return top, held == sum(pairs for _, pairs in bins)


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECES,
          frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row.

    ``n_best`` counts links whose pair is the most frequent of its B id in the corpus, ties included;
    ``count_sum`` adds the corpus counts of all links. ``groups_sha256`` hashes ``a,a|b;a|b,b`` in
    decimal ids.

    - Null and empty texts, and those that either tokenizer does not give back byte by byte, have zeros
      and an empty digest; they add nothing to the counts.
    - Rows given twice count twice; null ids are kept; an empty table gives an empty result; other
      columns are not read.
    - A text is one task's work, whole; memory grows with the longest text, at some 100 bytes a byte.
    """
    aligned = cut(token_alignment(df, id_col, text_col, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(aligned, radix(path_b)))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    top, complete = frequent_pairs(counts, frequent)
    known = links.join(F.broadcast(top), "pair", "left")
    add = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    sums = known.groupBy("row").agg(*add)
    if not complete:
        tail = counts.join(F.broadcast(top.select("pair")), "pair", "left_anti")
        rare = known.filter(F.col("n").isNull()).select("row", "pair", "times").join(tail.hint("merge"), "pair")
        sums = (sums.unionByName(rare.groupBy("row").agg(*add))
                .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return aligned.join(sums, "row", "left").select("doc_id", *COLUMNS, zero("n_best"), zero("count_sum"), "groups_sha256")
