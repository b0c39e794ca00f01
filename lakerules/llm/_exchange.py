"""Corpus counts of n-grams, brought back to the documents that hold them.

Counting every n-gram of a corpus and looking each one up again takes two shuffles of nearly all
tokens as rows. Here they travel packed instead. Documents are dealt into *blocks* by the hash of
their id. A block finds its distinct n-gram hashes and sends them, sorted and packed with a count
each, in *buckets*: ranges of the hash space. A bucket adds up the counts of all blocks and returns
to each block the totals of its n-grams, in the same order.

An n-gram counts once per block however often it occurs there, so the most frequent ones weigh no
more than others, and hash ranges hold even shares. Blocks and buckets grow in number with the
corpus, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakerules.llm._text import U64

BLOCK_BYTES = 6 << 20   # of text, on average
BUCKET_KEYS = 1 << 21   # distinct n-grams of all blocks, on average, at one per 6 bytes of text
SENT = "bucket int, block long, keys binary, counts binary"
TOTALS = "block long, bucket int, totals binary"


def sizes(docs: DataFrame, per_byte: float = 1 / 6) -> tuple[int, int]:
    """(number of blocks, log2 of the number of buckets) for the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, total * per_byte / BUCKET_KEYS)
    return max(1, -(-total // BLOCK_BYTES)), max(2, int(np.ceil(np.log2(buckets))))


def in_blocks(docs: DataFrame, blocks: int, *by: str) -> DataFrame:
    """Deals rows by the columns ``by``, by default their id."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*(by or ("doc_id",))), F.lit(blocks)))


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: like bytes of all numbers side by side, compressed."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def send(block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    """One row per bucket for a block's sorted distinct ``keys``."""
    bounds = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    used = np.flatnonzero(bounds[1:] > bounds[:-1])
    packed, weights = [], []
    for b in used:
        part = keys[bounds[b]:bounds[b + 1]]
        packed.append(squeeze(np.concatenate((part[:1], np.diff(part)))))
        weights.append(squeeze(counts[bounds[b]:bounds[b + 1]].astype(np.uint32)))
    return pa.table([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()),
                     pa.array(packed, pa.binary()), pa.array(weights, pa.binary())],
                    names=["bucket", "block", "keys", "counts"])


def add_up(sent: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For one bucket: each block's positions among the distinct keys, those keys, their totals
    and in how many blocks each occurs."""
    parts = [np.cumsum(expand(k, np.uint64), dtype=np.uint64) for k in sent["keys"].to_pylist()]
    counts = np.concatenate([expand(c, np.uint32) for c in sent["counts"].to_pylist()])
    keys, which = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(which, weights=counts, minlength=len(keys)).astype(np.int64)
    blocks = np.bincount(which, minlength=len(keys))
    return np.split(which, np.cumsum([len(p) for p in parts])[:-1]), keys, totals, blocks


def totals_rows(sent: pa.Table, per_block: list[np.ndarray]) -> pa.Table:
    return pa.table([sent["block"], sent["bucket"], pa.array([squeeze(v.astype(np.uint64)) for v in per_block], pa.binary())],
                    names=["block", "bucket", "totals"])


def received(totals: pa.Table) -> np.ndarray:
    """A block's totals in the order of its sorted keys."""
    rows = sorted(zip(totals["bucket"].to_pylist(), totals["totals"].to_pylist()))
    return np.concatenate([expand(t, np.uint64) for _, t in rows]) if rows else np.zeros(0, np.uint64)
