"""SentencePiece encoding and decoding (operator 3): distinct sampled segmentations.

A text's segmentations are the paths of a lattice: nodes are its characters, edges the vocabulary's
pieces, and a path has the product of its pieces' weights. Gumbel top-k sampling without
replacement draws ``k`` of them: if every path's log-probability were perturbed by Gumbel noise, the
k largest would be the sample. A* search finds those without looking at the others. It holds sets
of paths, each with the exact largest perturbed value in it, and splits the best set along a path:
the paths that leave it at its i-th piece form one set, whose largest value is a Gumbel of the set's
log-mass truncated at the value of the set split. The backward sums of the lattice are the exact
heuristic, so the first path out of a set is a plain sample, piece by piece.

The value of the (k+1)-th path, kappa, gives each path's inclusion score, log(1 - exp(-exp(log p -
kappa))), which makes sums over the sample unbiased.

All noise comes from a hash of the row's key, the sample's number and the character position, so a
row's sample depends on nothing else.

The vocabulary file is a BPE model: it has merge ranks and no probabilities. A piece weighs
``(rank + 1) ** -ZIPF``, Zipf's law on the ranks; characters without a piece fall back to their
bytes, each with the weight of the last rank. The file's path is a parameter and must be readable on
every executor.

Lattices are built once per distinct word of a slice of text, with numpy over all of them at once:
no piece of such a vocabulary reaches over the start of a run of spaces or over a line break, so a
text's lattice is the chain of its words' lattices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakerules.llm._common import pick
from lakerules.llm._text import BASE, U64, _power_tables, buffer_of, mix, rehash_long, release, salt, slices

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ZIPF = 1.0
SAMPLES = 2
SEED = 20
SLICE = 1 << 20
SPACE = "▁"

_BYTE_MIX = mix(np.arange(256, dtype=np.uint64) + salt(5))


class Vocabulary:
    """Pieces by the hash of their code points, their log-weights, and their bytes."""

    def __init__(self, path: str, zipf: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        score = np.array([model.get_score(i) for i in range(size)])
        byte = np.array([model.is_byte(i) for i in range(size)])
        normal = ~byte & np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)])
        rank = np.minimum(-score, size)
        self.weight = -zipf * np.log(rank + 1)
        self.byte_weight = -zipf * np.log(size + 1.0)
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(byte):
            self.byte_id[int(pieces[i][3:5], 16)] = i
        raw = [bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() if normal[i] else b""
               for i, p in enumerate(pieces)]
        self.bytes_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        texts = {p.replace(SPACE, " "): i for i, p in enumerate(pieces) if normal[i]}
        self.longest = max(map(len, texts))
        inner = [t for t in texts if "\n" in t or " " in t.lstrip(" ")]
        if inner:
            raise ValueError(f"pieces reach over a word's start: {inner[:3]}")
        hashes = np.array([code_hash(np.array([ord(c) for c in t], np.uint64)) for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(texts.values()), np.int32)[order]
        # By the top 21 bits of a hash: 1 if it may be a piece, 2 if it may begin a longer one, and the
        # first piece there. A slot's pieces follow each other.
        slots, first, many = np.unique((self.hashes >> U64(43)).astype(np.int64), return_index=True, return_counts=True)
        self.most = int(many.max())
        self.first = np.zeros(1 << 21, np.int32)
        self.first[slots] = first
        self.may = np.zeros(1 << 21, np.uint8)
        self.may[slots] = 1
        longer = {t[:n] for t in texts for n in range(1, len(t))}
        starts = np.array([code_hash(np.array([ord(c) for c in t], np.uint64)) for t in longer], np.uint64)
        self.may[(starts >> U64(43)).astype(np.int64)] |= 2

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are pieces, their ids, and which may begin a longer piece."""
        slot = (hashes >> U64(43)).astype(np.int64)
        may = self.may[slot]
        hit = np.flatnonzero(may & 1)
        at, wanted = self.first[slot[hit]], hashes[hit]
        same = self.hashes[at] == wanted
        left = np.flatnonzero(~same)
        for _ in range(1, self.most):
            at[left] = np.minimum(at[left] + 1, len(self.hashes) - 1)
            same[left] = self.hashes[at[left]] == wanted[left]
            left = left[~same[left]]
        return hit[same], self.ids[at[same]], np.flatnonzero(may & 2)


def code_hash(codes: np.ndarray) -> np.uint64:
    power, _ = _power_tables(len(codes))
    return mix(np.sum(mix(codes + salt(5)) * power[:len(codes)], keepdims=True, dtype=np.uint64))[0]


_loaded: dict[tuple, Vocabulary] = {}


def vocabulary(path: str = MODEL, zipf: float = ZIPF) -> Vocabulary:
    if (path, zipf) not in _loaded:
        _loaded[path, zipf] = Vocabulary(path, zipf)
    return _loaded[path, zipf]


class Lattices:
    """The lattices of a slice's distinct words, chained into its texts.

    ``word`` is each occurrence's distinct word, ``doc`` its row. Per position of the distinct words
    (``first[word]`` onwards) the edges ``edge_at[p]:edge_at[p + 1]`` lead ``length`` characters on,
    the longest first, with log-probabilities ``log_p`` given that the path comes by.
    """

    def __init__(self, texts: pa.Array, vocab: Vocabulary):
        spaced = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 0), spaced,
                            pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), spaced, pa.scalar("", pa.large_string())))
        data, offsets = buffer_of(spaced)
        n = len(data)
        before = np.concatenate((np.full(min(n, 1), 10, np.uint8), data[:-1]))
        starts = (data == 10) | (before == 10) | ((data == 32) & (before != 32))
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], n) if len(start) else start
        self.doc = np.searchsorted(offsets, start, "right") - 1
        power, inverse = _power_tables(n)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_MIX[data] * power[:n], out=total[1:])
        keys = rehash_long(data, start, end, mix((total[end] - total[start]) * inverse[start]))
        _, sample, word = np.unique(keys, return_index=True, return_inverse=True)
        # Words as they first occur: frequent ones lie together, near the front.
        order = np.argsort(sample)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sample, self.word = sample[order], rank[word]
        self._build(data, start[sample], end[sample], vocab)
        # Where each occurrence begins in its row, in characters.
        size = np.diff(self.first)[self.word]
        run = np.cumsum(size) - size
        row_start = np.concatenate(([True], self.doc[1:] != self.doc[:-1])) if len(self.doc) else np.zeros(0, bool)
        self.offset = run - run[np.maximum.accumulate(np.where(row_start, np.arange(len(run)), 0))] if len(run) else run

    def _build(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, vocab: Vocabulary) -> None:
        size = end - start
        at = np.concatenate(([0], np.cumsum(size)))
        source = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(start, size)
        letters = data[source]
        codes = np.frombuffer(letters.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        head = (letters & 0xC0) != 0x80
        begun = np.concatenate(([0], np.cumsum(head)))
        self.first = begun[at]
        n = len(codes)
        width = np.diff(np.append(np.flatnonzero(head), len(letters)))  # bytes per character
        byte_at = np.cumsum(width) - width
        rest = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)  # characters to the word's end
        power, inverse = _power_tables(n)
        single = mix(codes + salt(5))
        total = np.zeros(n + 1, U64)
        np.cumsum(single * power[:n], out=total[1:])
        # Pieces by length; every character has an edge: its piece, or its bytes.
        found, where, degree = [], np.arange(n), np.ones(n, np.int64)
        for length in range(1, vocab.longest + 1):
            if length > 1:
                where = where[rest[where] >= length]
            if not len(where):
                break
            hit, ids, on = vocab.find(mix((total[where + length] - total[where]) * inverse[where] if length > 1 else single))
            if length == 1:
                own = np.full(n, -1, np.int32)
                own[hit] = ids
                found.append((where, own))
            else:
                found.append((where[hit], ids))
                degree[where[hit]] += 1
            where = where[on]
        # Edges by position, the longest first.
        self.edge_at = np.concatenate(([0], np.cumsum(degree)))
        position = np.repeat(np.arange(n, dtype=np.int32), degree)
        piece, length = np.empty(len(position), np.int32), np.empty(len(position), np.int32)
        free = self.edge_at[:-1].copy()
        for size, (where, ids) in reversed(list(enumerate(found, 1))):
            at = free[where]
            piece[at], length[at] = ids, size
            free[where] = at + 1
        value = vocab.weight[piece]
        bytes_ = piece < 0
        value[bytes_] = vocab.byte_weight * width[position[bytes_]]
        # Backward sums, by distance from the word's end.
        by_rest = np.argsort(rest.astype(np.uint16) if n and rest.max() < 1 << 16 else rest, kind="stable")
        layers = np.searchsorted(rest[by_rest], np.arange(1, (rest.max() if n else 0) + 2))
        beta = np.zeros(n + 1)
        target = position + length
        target[np.repeat(rest.astype(np.int32), degree) <= length] = n  # beta[n] is 0
        for low, high in zip(layers[:-1], layers[1:]):
            p = by_rest[low:high]
            if not len(p):
                continue
            d = degree[p]
            begin = np.cumsum(d) - d
            edge = np.arange(begin[-1] + d[-1]) + np.repeat(self.edge_at[p] - begin, d)
            v = value[edge] + beta[target[edge]]
            value[edge] = v
            peak = np.maximum.reduceat(v, begin)
            beta[p] = peak + np.log(np.add.reduceat(np.exp(v - np.repeat(peak, d)), begin))
        self.position, self.length, self.piece = position, length, piece
        value -= np.repeat(beta[:n], degree)
        self.log_p = np.minimum(value, 0.0, out=value)
        total_p = np.zeros(len(position) + 1)
        np.cumsum(np.exp(self.log_p), out=total_p[1:])
        self.cdf = total_p[1:] - np.repeat(total_p[self.edge_at[:-1]], degree)
        self.cdf[self.edge_at[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        self.rest = rest.astype(np.int32)
        # Bytes of the characters, for those that fall back to bytes.
        self.width, self.byte_at, self.letters = width, byte_at, letters

    def walk(self, position: np.ndarray, seed: np.ndarray, offset: np.ndarray, draw: int):
        """Sample a path from each position to its word's end: edges in order, and where each path's
        begin. ``offset`` is the character offset in the row that position 0 of each would have."""
        n = len(position)
        count = np.ones(n, np.int64)
        steps, active, here = [], np.arange(n), position
        while len(active):
            u = uniforms(seed, offset + here, draw)
            edge = self.edge_at[here]
            late = np.flatnonzero(u > self.cdf[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] > self.cdf[edge[late]]]
            steps.append((active, edge))
            length = self.length[edge]
            more = np.flatnonzero(self.rest[here] > length)  # whose words go on
            active, here, seed, offset = active[more], here[more] + length[more], seed[more], offset[more]
            count[active] += 1
        at = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(at[-1], np.int64)
        for t, (who, edge) in enumerate(steps):
            out[at[who] + t] = edge
        return out, at


def uniforms(seed: np.ndarray, position: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1) from a row's seed, a character position and what they are drawn for."""
    bits = position.astype(np.uint64)
    bits *= BASE
    bits += salt(100 + draw)
    bits = mix(seed ^ bits)
    bits >>= U64(11)
    u = bits.astype(float)
    u += 0.5
    u *= 2.0 ** -53
    return u


def _truncated(log_mass: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Largest perturbed value of sets with these log-masses, given that it is below ``top``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(u)) - log_mass)


class _Row:
    """The A* search of one row: emitted paths, and for each the values of the sets beside it."""

    def __init__(self, lattices: Lattices, seed: np.uint64, k: int):
        self.lat, self.seed, self.k = lattices, np.array([seed], np.uint64), k
        self.paths: list[tuple] = []  # (edges, log-probability, value)
        self.beside: list[np.ndarray] = []  # values of the sets that leave path i at each of its pieces
        self.taken: list[dict[int, list[int]]] = []  # edges already used where a set leaves path i

    def emit(self, edges: np.ndarray, value: float, shared: int) -> None:
        """Add a path whose first ``shared`` pieces it has in common with an earlier one."""
        n = len(self.paths)
        log_p = self.lat.log_p[edges]
        before = np.cumsum(log_p) - log_p
        value_of = np.zeros(0)  # of the first pieces; sets further on are too light
        done, upto = 0, min(len(edges), 64)
        while done < upto:
            u = uniforms(self.seed, np.arange(done, upto), 1000 + 2 * n)
            with np.errstate(divide="ignore"):  # log-mass of the paths that leave at each piece
                mass = before[done:upto] + np.log(-np.expm1(log_p[done:upto]))
            value_of = np.concatenate((value_of, np.where(mass > -np.inf, _truncated(mass, value, u), -np.inf)))
            done = upto
            # Noise from 53 bits is below 38, so sets much lighter than the k + 1 best so far cannot
            # be among the k + 1 best; masses fall along the path.
            rivals = value_of[value_of > -np.inf]
            least = np.partition(rivals, -self.k - 1)[-self.k - 1] if len(rivals) > self.k else -np.inf
            upto = int(np.searchsorted(-before, 38.0 - least, "right"))
        value_of[:shared] = -np.inf
        self.paths.append((edges, float(log_p.sum()), value))
        self.beside.append(value_of)
        self.taken.append({})

    def best(self) -> tuple[int, int, float]:
        """(path, piece, value) of the best set."""
        found = max(range(len(self.paths)), key=lambda i: self.beside[i].max(initial=-np.inf))
        at = int(self.beside[found].argmax()) if len(self.beside[found]) else 0
        return found, at, float(self.beside[found][at]) if len(self.beside[found]) else -np.inf

    def branch(self, path: int, at: int, value: float) -> int:
        """The edge by which the next path leaves ``path`` at piece ``at``; what then is left of the
        set gets its own value."""
        lat, edges = self.lat, self.paths[path][0]
        used = self.taken[path].setdefault(at, [int(edges[at])])
        p = lat.position[edges[at]]
        options = np.array([e for e in range(lat.edge_at[p], lat.edge_at[p + 1]) if e not in used])
        chance = np.exp(lat.log_p[options] - lat.log_p[options].max())
        u = uniforms(self.seed, np.array([at]), 2000 + len(self.paths))[0]
        pick_ = min(int(np.searchsorted(np.cumsum(chance) / chance.sum(), u)), len(options) - 1)
        used.append(int(options[pick_]))
        left = np.delete(options, pick_)
        if len(left):
            before = lat.log_p[edges[:at]].sum()
            mass = before + np.logaddexp.reduce(lat.log_p[left])
            u = uniforms(self.seed, np.array([at]), 3000 + len(self.paths))
            self.beside[path][at] = _truncated(np.array([mass]), value, u)[0]
        else:
            self.beside[path][at] = -np.inf
        return int(options[pick_])


def sample_paths(lat: Lattices, rows: int, seeds: np.ndarray, k: int) -> tuple[list[_Row], np.ndarray]:
    """The search of each row after ``k`` paths (fewer where there are no more), and kappa."""
    first_word = np.searchsorted(lat.doc, np.arange(rows + 1))
    seed_of = seeds[lat.doc] if len(lat.doc) else np.zeros(0, np.uint64)
    begin = lat.first[:-1][lat.word]
    searches = [_Row(lat, s, k) for s in seeds]
    live = np.ones(rows, bool)
    for draw in range(k):
        edges, at = lat.walk(begin, seed_of, lat.offset - begin, draw)
        for r in np.flatnonzero(live):
            search, a, b = searches[r], first_word[r], first_word[r + 1]
            free = edges[at[a]:at[b]]
            if draw == 0:
                u = uniforms(search.seed, np.zeros(1), 999)[0]
                search.emit(free, float(-np.log(-np.log(u))), 0)
                continue
            path, piece, value = search.best()
            if value == -np.inf:
                live[r] = False
                continue
            old = search.paths[path][0]
            edge = search.branch(path, piece, value)
            # The word in which the path branches is finished from there; the next words are free.
            # A path ends a word where its piece reaches the word's end.
            ends = lat.rest[lat.position[old[:piece]]] == lat.length[old[:piece]]
            word = a + int(ends.sum())
            here = lat.position[edge] + lat.length[edge]
            parts = [old[:piece], np.array([edge])]
            if lat.rest[lat.position[edge]] > lat.length[edge]:
                parts.append(lat.walk(np.array([here]), search.seed, np.array([lat.offset[word] - begin[word]]), 500 + draw)[0])
            parts.append(edges[at[word + 1]:at[b]])
            search.emit(np.concatenate(parts), value, piece + 1)
    return searches, np.array([s.best()[2] for s in searches])


def path_ids(lat: Lattices, vocab: Vocabulary, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary ids of the paths, one after the other, and where each path's begin; characters
    without a piece give one id per byte."""
    edges = np.concatenate([np.zeros(0, np.int64), *paths])
    ids = lat.piece[edges]
    bare = np.flatnonzero(ids < 0)
    p = lat.position[edges[bare]]
    width = lat.width[p]
    n = np.ones(len(ids), np.int64)
    n[bare] = width
    begin = np.concatenate(([0], np.cumsum(n)))
    out = np.repeat(ids, n)
    nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    out[np.repeat(begin[bare], width) + nth] = vocab.byte_id[lat.letters[np.repeat(lat.byte_at[p], width) + nth]]
    return out, begin[np.concatenate(([0], np.cumsum([len(x) for x in paths], dtype=np.int64)))]


def piece_ids(lat: Lattices, vocab: Vocabulary, edges: np.ndarray) -> np.ndarray:
    """Vocabulary ids of one path."""
    return path_ids(lat, vocab, [edges])[0]


def _sample(k: int, path: str, zipf: float, carry: list[str], decoded: bool):
    def sample(batches):
        vocab = vocabulary(path, zipf)
        for batch in batches:
            for low, high in slices(batch["text"], SLICE):
                rows = high - low
                lat = Lattices(batch["text"].slice(low, rows), vocab)
                seeds = batch["seed"].slice(low, rows).to_numpy().view(np.uint64)
                searches, kappa = sample_paths(lat, rows, seeds, k)
                row, number, paths, log_p, score = [], [], [], [], []
                for r, search in enumerate(searches):
                    for i, (edges, p, _) in enumerate(search.paths):
                        row.append(low + r)
                        number.append(i)
                        paths.append(edges)
                        log_p.append(p)
                        # log(1 - exp(-exp(x))), which is x for small x and 0 without a rival
                        x = p - kappa[r]
                        score.append(0.0 if x == np.inf else x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 50.0))))))
                ids, at = path_ids(lat, vocab, paths)
                take = pa.array(row, pa.int64())
                columns = {c: batch[c].take(take) for c in carry} | {
                    "sample": pa.array(number, pa.int32()),
                    "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                    "log_prob": pa.array(log_p, pa.float64()), "inclusion": pa.array(score, pa.float64())}
                if decoded:
                    columns["text"] = pa.array(decode_all(ids, at, vocab), pa.string())
                yield pa.RecordBatch.from_pydict(columns)
            release()
    return sample


def sample_segmentations(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES,
                         seed: int = SEED, path: str = MODEL, zipf: float = ZIPF, decoded: bool = False) -> DataFrame:
    """``doc_id, text_hash, sample, ids, log_prob, inclusion``: up to ``k`` rows per input row; with
    ``decoded`` also ``text``, decoded from the ids in the same pass.

    ``sample`` counts from 0 in the order found, the largest perturbed value first; ``inclusion`` is
    the log inclusion score. ``text_hash`` is the text's xxhash64, by which decoded text can be
    checked without carrying the text.

    - A null or empty text has one segmentation, without pieces, log-probability and score 0. A row
      with fewer than ``k`` segmentations has them all, each with score 0.
    - Segmentations of a row are distinct. Rows that share id and text get the same ones; null ids
      share one seed.
    - Whole texts are segmented. An empty table gives an empty result; other columns are not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", "text", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("seed"),
                       F.xxhash64(spaced(F.col("text"))).alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_sample(k, path, zipf, ["doc_id", "text_hash"], decoded),
                           f"doc_id {kind}, text_hash long, sample int, ids array<int>, log_prob double, inclusion double"
                           + ", text string" * decoded)


def spaced(text: Column) -> Column:
    """The text that decoding gives back: the vocabulary's mark for a space reads as a space."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(SPACE), F.lit(" "))


def decode_all(ids: np.ndarray, at: np.ndarray, vocab: Vocabulary) -> list[str]:
    """The texts of piece ids, of which the i-th has ``ids[at[i]:at[i + 1]]``. Bytes that are not
    UTF-8 become U+FFFD."""
    begin = vocab.bytes_at[ids]
    n = vocab.bytes_at[ids + 1] - begin
    end = np.concatenate(([0], np.cumsum(n)))
    data = vocab.bytes[np.arange(end[-1]) + np.repeat(begin - end[:-1], n)].tobytes()
    bounds = end[at].tolist()
    texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
    return [t[1:] if t[:1] == " " else t for t in texts]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of piece ids. Ids out of range and control pieces give nothing."""
    ids = ids[(ids >= 0) & (ids < len(vocab.bytes_at) - 1)]
    return decode_all(ids, np.array([0, len(ids)]), vocab)[0]


def decoder(path: str = MODEL):
    """A column function: piece ids -> text (see ``decode_ids``). Null ids give null."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        vocab = vocabulary(path)
        return pa.array([None if x is None else decode_ids(np.array(x, np.int64), vocab) for x in ids.to_pylist()], pa.string())

    return decode
