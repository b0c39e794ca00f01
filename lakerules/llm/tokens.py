"""Token counts (operator 4): offset-mapped attribution.

A whole document is encoded once. Its tokens' byte lengths give their character spans, and an
interval join by binary search brings the spans to the document's sections, in Arrow batches. So a
section's count is what it costs inside its document, unlike the count of the section encoded
alone. A token that crosses a boundary is allocated by an explicit rule:

- ``first``: to the first section it touches;
- ``most``: to the section with most of its characters, the earlier one on a tie;
- ``share``: to each section by its share of the token's characters inside sections.

The vocabulary is a file of byte-pair ranks; its path is a parameter and must be readable on every
executor.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from lakerules.llm._common import pick
from lakerules.llm._text import buffer_of, slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
RULE = "most"
OUTSIDE = -1
SLICE = 1 << 20

_loaded: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(path: str = RANKS) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the byte length of each token; loaded once per process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(t) for t in ranks]
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={}), size
    return _loaded[path]


def token_spans(text: str, data: np.ndarray, path: str = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of ``text`` (whose UTF-8 bytes are ``data``) and their character spans [start, end).
    A token that holds part of a character spans the whole character."""
    coder, size = encoding(path)
    ids = coder.encode_to_numpy(text, disallowed_special=())
    ends = np.cumsum(size[ids])
    head = (data & 0xC0) != 0x80
    begun = np.concatenate(([0], np.cumsum(head)))
    starts = np.concatenate(([0], ends[:-1])) if len(ids) else ends
    return ids, begun[starts + 1] - 1 if len(ids) else starts, begun[ends]


def lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of a text's lines, each with its line break; an empty text has none."""
    head = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    cuts = np.flatnonzero(data == 10) + 1
    bounds = head[np.unique(np.concatenate(([0], cuts, [len(data)])))]
    return bounds[:-1], bounds[1:]


def allocate(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray,
             rule: str = RULE) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens [start, end) to disjoint, ordered sections [low, high): tokens per section, how many
    of those that touch it cross one of its bounds to another section, and tokens outside all."""
    first = np.searchsorted(high, start, "right")
    last = np.searchsorted(low, end, "left") - 1
    inside = last >= first
    crossing = last > first
    count = np.bincount(first[inside & ~crossing], minlength=len(low)).astype(float)
    n = (last - first + 1)[crossing]
    token = np.repeat(np.flatnonzero(crossing), n)
    section = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[token]
    common = np.minimum(end[token], high[section]) - np.maximum(start[token], low[section])
    begins = np.cumsum(n) - n
    if rule == "first":
        count += np.bincount(section[begins], minlength=len(low))
    elif rule == "most":
        order = np.lexsort((section, -common, token))
        count += np.bincount(section[order[begins]], minlength=len(low))
    elif rule == "share":
        whole = np.add.reduceat(common, begins) if len(n) else n
        count += np.bincount(section, weights=common / np.repeat(whole, n), minlength=len(low))
    else:
        raise ValueError(f"no such rule: {rule}")
    return count, np.bincount(section, minlength=len(low)), float((~inside).sum())


def _attribute(rule: str, path: str, with_sections: bool):
    def attribute(batches):
        for batch in batches:
            for low, high in slices(batch["text"], SLICE):
                texts = batch["text"].slice(low, high - low)
                data, offsets = buffer_of(texts)
                given = batch["sections"].slice(low, high - low).to_pylist() if with_sections else None
                out: list[list] = [[] for _ in range(7)]
                for i, text in enumerate(texts.to_pylist()):
                    own = data[offsets[i]:offsets[i + 1]]
                    ids, start, end = token_spans(text or "", own, path)
                    if given is None:
                        a, b = lines(own)
                    else:
                        spans = sorted((s["start"], s["end"]) for s in given[i] or () if s and s["end"] > s["start"])
                        a, b = (np.array(x, np.int64) for x in (zip(*spans) if spans else ((), ())))
                    count, crossing, outside = allocate(start, end, a, b, rule)
                    section = np.arange(len(a))
                    if outside or not len(a):
                        section, a, b = np.append(section, OUTSIDE), np.append(a, 0), np.append(b, 0)
                        count, crossing = np.append(count, outside), np.append(crossing, 0)
                    for column, v in zip(out, (np.full(len(a), low + i), section, a, b, count, crossing,
                                               np.full(len(a), len(ids)))):
                        column.append(v)
                columns = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(columns[0])), pa.array(columns[1], pa.int32()),
                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64()),
                     pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64())],
                    names=["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"])
    return attribute


def attribute(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None,
              rule: str = RULE, path: str = RANKS) -> DataFrame:
    """``doc_id, section, start, end, tokens, crossing, doc_tokens``: one row per section.

    Sections are the lines, or the disjoint spans ``array<struct<start, end>>`` (characters) of
    ``sections_col``, numbered from 0 by their start; empty and null spans are left out.
    ``crossing`` counts tokens that touch the section and another one.

    - Tokens outside all sections are counted in a row with section -1, which also stands for a
      document without sections (null and empty texts), so the rows of a document add up to
      ``doc_tokens`` and every document has one.
    - Whole texts are read. Rows given twice are attributed twice; null ids are kept; an empty
      table gives an empty result; other columns are not read.
    """
    cols = {"doc_id": id_col, "text": text_col} | ({"sections": sections_col} if sections_col else {})
    rows = pick(df, **cols)
    return rows.mapInArrow(
        _attribute(rule, path, sections_col is not None),
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, section int, start long, end long, "
        "tokens double, crossing long, doc_tokens long")
