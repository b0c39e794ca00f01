"""Language-model scoring (operator 6): a weighted backoff automaton.

The model's n-grams are counted over all training texts. A state is a context of up to ``order`` - 1
tokens seen in training; it has an arc for each token that followed it, and a failure arc to the
next shorter context. With lambda the share that context keeps for the failure arc,

    weight of an arc       (1 - lambda) * count / context count + lambda * shorter(token)
    weight of a failure    lambda
    shortest state         (count + 0.5) / (N + 0.5 * (V + 1))

which is a proper distribution in every state. lambda is the Good-Turing mass of unseen tokens: of
all training tokens whose context falls in the same class (power of two of its count), the share
that are the only one of their n-gram.

Spark plan. No table of n-grams is broadcast or joined row by row: ``_exchange`` counts them and
brings each block of documents the counts of its own. A document then holds, for each token, the
counts of the n-grams that end there, which is all that the automaton's arcs and states on its path
need. The orders go in ``turns``: each writes the totals it brings back and drops its shuffle files
before the next begins, so the disk holds the n-grams of one turn only. The documents' counts are
written once; sums over them give lambda (at most 64 rows per order), N and V, and one left-to-right
pass per text follows the arcs. Shuffled data grow with the corpus: each block sends its distinct
n-grams, about 6 bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakerules.llm import _exchange as ex
from lakerules.llm._common import crc, cut, pick
from lakerules.llm._text import BASE, U64, Words, mix, salt

ORDER = 3
CLASSES = 64
END = mix(np.array([0x454E44], np.uint64))[0]
START = mix(np.array([0x5354415254], np.uint64))[0]


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, one end after each row's words, and the row of each token."""
    last = words.first[1:]
    return np.insert(words.hash, last, END), np.insert(words.doc, last, np.arange(len(last)))


def ngrams(token: np.ndarray, row: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams ending at each token, for 1 to ``order`` tokens. Texts begin with as many
    start marks as needed. The last two bits of a key tell its order."""
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    out, before, start = [], None, None
    for m in range(1, order + 1):
        if m == 1:
            h, start = mix(token + salt(1)), mix(np.array([START]) + salt(1))[0]
        else:
            shifted = np.empty_like(before)
            shifted[1:] = before[:-1]
            shifted[first] = start
            h = mix(mix(shifted * BASE + token) + salt(m))
            start = mix(mix(np.array([start]) * BASE + START) + salt(m))[0]
        before = h
        out.append((h & ~U64(3)) | U64(m - 1))
    return out


def turns(order: int) -> list[tuple[int, ...]]:
    """The orders that are exchanged together. One and two tokens take about as many keys as three."""
    return [t for t in (tuple(range(1, min(order, 2) + 1)), (3,), (4,)) if t[0] <= order]


def _emit(own: tuple[int, ...], bits: int):
    def emit(key, docs):
        words = Words(docs["text"])
        token, row = tokens(words)
        learn = docs["learn"].to_numpy(zero_copy_only=False).astype(bool)[row]
        grams = ngrams(token, row, own[-1])[own[0] - 1:]
        every = np.sort(np.concatenate(grams))
        keys = every[np.concatenate(([True], every[1:] != every[:-1]))]
        learned = np.sort(np.concatenate([g[learn] for g in grams]))
        counts = np.searchsorted(learned, keys, "right") - np.searchsorted(learned, keys, "left")
        return ex.send(key[0].as_py(), keys, counts, bits)
    return emit


def _total(turn: int):
    def total(key, sent):
        where, keys, totals, _ = ex.add_up(sent)
        back = ex.totals_rows(sent, [totals[w] for w in where])
        none = pa.nulls(len(back), pa.int64())
        back = back.append_column("n", none).append_column("v", none)
        single = (keys & U64(3) == 0) & (totals > 0)
        own = pa.table([pa.array([-1], pa.int64()), pa.array([key[0].as_py()], pa.int32()), pa.nulls(1, pa.binary()),
                        pa.array([int(totals[single].sum())], pa.int64()), pa.array([int(single.sum())], pa.int64())],
                       names=back.column_names)
        rows = pa.concat_tables([back, own])
        return rows.append_column("turn", pa.array([turn] * len(rows), pa.int32()))
    return total


def _classes(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(float))[1]


def _contexts(counts: np.ndarray, m: int, first: np.ndarray, texts: float) -> np.ndarray:
    """Counts of the contexts of order-``m`` n-grams; ``first`` marks each text's first token."""
    context = np.empty(counts.shape[1])
    context[1:] = counts[m - 2][:-1]
    context[first] = texts
    return context


def _look_up(order: int, id_type: pa.DataType):
    def look_up(docs, back):
        out = {k: [] for k in ("doc_id", "n_tokens", "n_known", "log_known", "texts", "counts",
                               "level", "class", "among", "novel", "n", "v")}

        def row(**values):
            for k, column in out.items():
                column.append(values.get(k))

        for n, v in zip(back["n"].to_pylist(), back["v"].to_pylist()):
            if n is not None:
                row(n=n, v=v)
        if len(docs):
            words = Words(docs["text"])
            token, of = tokens(words)
            grams = ngrams(token, of, order)
            back = back.filter(pc.is_valid(back["totals"]))
            counts = np.empty((order, len(token)), np.uint64)
            for turn, own in enumerate(turns(order)):
                every = np.sort(np.concatenate([grams[m - 1] for m in own]))
                keys = every[np.concatenate(([True], every[1:] != every[:-1]))]
                found = ex.received(back.filter(pc.equal(back["turn"], turn)))
                for m in own:
                    counts[m - 1] = found[np.searchsorted(keys, grams[m - 1])]
            end = np.searchsorted(of, np.arange(len(docs)), "right")
            start = np.concatenate(([0], end[:-1]))
            texts = int(counts[0][end[-1] - 1])  # ends seen in training: one per text
            first = np.zeros(len(token), bool)
            first[start] = True
            learn = docs["learn"].to_numpy(zero_copy_only=False).astype(bool)[of]
            for m in range(2, order + 1):
                kind = _classes(_contexts(counts, m, first, texts))[learn]
                novel = (counts[m - 1] == 1)[learn]
                among = np.bincount(kind, minlength=CLASSES + 1)
                new = np.bincount(kind[novel], minlength=CLASSES + 1)
                for c in np.flatnonzero(among):
                    row(level=m, **{"class": int(c)}, among=int(among[c]), novel=int(new[c]))
            known = np.concatenate(([0], np.cumsum(counts[0] > 0)))
            logs = np.concatenate(([0.0], np.cumsum(np.log10(counts[0] + 0.5))))
            ids = docs["doc_id"].to_pylist()
            for i, (a, b) in enumerate(zip(start, end)):
                row(doc_id=ids[i], n_tokens=int(b - a), n_known=int(known[b] - known[a]),
                    log_known=float(logs[b] - logs[a]), texts=texts,
                    counts=ex.squeeze(np.ascontiguousarray(counts[:, a:b]).reshape(-1)))
        types = {"doc_id": id_type, "log_known": pa.float64(), "counts": pa.binary(), "level": pa.int32(), "class": pa.int32()}
        return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})
    return look_up


def traverse(counts: np.ndarray, texts: int, n: int, v: int, keep: dict[int, np.ndarray]) -> float:
    """log10 of a text's probability.

    ``counts[m - 1][i]`` is the training count of the n-gram of ``m`` tokens that ends at token i;
    ``texts`` that of the start; ``keep[m]`` the failure mass by context class. The state before
    token i is the longest context with a count, so the states of a whole path are known at once and
    the walk is a pass per order: arcs where the n-gram has a count, failures elsewhere.
    """
    first = np.zeros(counts.shape[1], bool)
    first[0] = True
    p = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
    for m in range(2, len(counts) + 1):
        context = _contexts(counts, m, first, texts)
        state = context > 0
        fail = np.where(state, keep[m][_classes(context)], 1.0)
        arc = np.where(state, (1 - fail) * counts[m - 1] / np.maximum(context, 1), 0.0)
        p = arc + fail * p
    return float(np.log10(p).sum())


def _score(order: int, n: int, v: int, keep: dict[int, np.ndarray]):
    def score(batches):
        for batch in batches:
            scores = []
            for texts, data in zip(batch["texts"].to_pylist(), batch["counts"].to_pylist()):
                scores.append(traverse(ex.expand(data, np.uint64).reshape(order, -1), texts, n, v, keep))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_tokens"], batch["n_known"], batch["log_known"], pa.array(scores, pa.float64())],
                names=["doc_id", "n_tokens", "n_known", "log_known", "score"])
    return score


def score_texts(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                order: int = ORDER) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``learn`` is a condition on ``doc_id``: the rows that the model counts. ``order`` is 1 to 4.

    - A null or empty text is one end token.
    - Rows given twice are counted twice and scored twice. A null id is scored like any other.
    - With nothing to learn from, N = V = 0 and every token has probability 1. An empty table gives
      an empty result; other columns are not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    blocks, bits = ex.sizes(rows, per_byte=order / 6)
    rows = ex.in_blocks(rows.withColumn("learn", F.coalesce(learn, F.lit(False))), blocks, "doc_id", "text")
    totals = None
    for turn, own in enumerate(turns(order)):
        sent = rows.groupBy("block").applyInArrow(_emit(own, bits), ex.SENT)
        part = cut(sent.groupBy("bucket").applyInArrow(_total(turn), ex.TOTALS + ", n long, v long, turn int"), tidy=True)
        totals = part if totals is None else totals.union(part)
    id_type = rows.schema["doc_id"].dataType
    found = cut(rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _look_up(order, to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, n_tokens long, n_known long, log_known double, texts long, counts binary, "
        "level int, class int, among long, novel long, n long, v long"), tidy=True)
    total = found.agg(F.sum("n"), F.sum("v")).first()
    n, v = total[0] or 0, total[1] or 0
    keep = {m: np.full(CLASSES + 1, 0.5) for m in range(2, order + 1)}
    shares = found.filter("level is not null").groupBy("level", "class").agg(F.sum("among").alias("a"), F.sum("novel").alias("b"))
    for r in shares.collect():
        keep[r["level"]][r["class"]] = (r["b"] + 0.5) / (r["a"] + 1.0)
    texts = found.filter("counts is not null").select("doc_id", "n_tokens", "n_known", "log_known", "texts", "counts")
    scored = texts.mapInArrow(_score(order, n, v, keep),
                              f"doc_id {id_type.simpleString()}, n_tokens long, n_known long, log_known double, score double")
    base = F.col("log_known") - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                         base.alias("base_score"), "score")


def held_out(doc_id: Column) -> Column:
    return crc(doc_id) % 5 == 1
