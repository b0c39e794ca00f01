"""N-gram Jaccard join (operator 8): vertical partitioning of the global n-gram order.

Two documents link when the Jaccard similarity of their sets of ``SHINGLE``-word shingles is at
least ``LEAST`` percent; linked documents form components.

1. Documents with the same set are one class (a 128-bit signature of the set, one narrow pass).
   Only a class's smallest id goes on, weighed by its rows, so copies are never paired.
2. ``_exchange`` counts, for each shingle, how many classes have it. The global order puts rare
   shingles first: by *fragment*, the power of two of that count, then by hash. Shingles of one
   class only cannot be shared. They come first, so a document with enough of them has no partner
   and leaves here; in ordinary text nearly all do.
3. Prefix filter: similar documents share a shingle among the first ``n - ceil(0.75 n) + 1`` of
   each. Where they share their first one, the shingles from there on must suffice (positions),
   and the sizes must be within 75 % of each other.
4. Verification. A document is cut by the global order into fragments. A candidate pair meets
   once per fragment, the overlaps are counted there and summed per pair.
5. Of shingles that the very same prefixes hold, only the first is needed. In each, every document
   meets the shingle's *leader*, the one with the fewest rarer shingles: linear, and enough to connect
   nearly all of a group of near copies however large, as the leader has the least that is only its own.
   The links' components are the labels. A document whose position in a shingle allows a link with none
   of the sizes there has left it before, so a group's outliers do not keep its shingles; those left with
   one label drop out for good. Then, while more pairs of different labels could meet than rows are left,
   every document meets the leader of the other labels in each shingle, which is linear too, and labels
   that a link joins become one. A round that leaves more than three quarters of these meetings is the
   last, so their number grows with the logarithm of the meetings, not with the links. Last, in each
   shingle, the members of labels that are still different meet whose sizes and positions allow a link.
   Pairs inside a group are connected already, so thousands of near copies never meet all pairs; no
   candidate between groups is left out.
6. Components by large-star and small-star steps on the links, in one task where they are few. Links
   found in a later round join labels, not documents: only the labels' components are new.
7. Links are counted over all pairs, those inside a group included. Both ends of a link are in one
   component, so components are compared whole: small ones many to a task, large ones in *rooms* of
   one size class, each of which meets the rooms of its own and of the next class. A meeting counts
   all its overlaps as products of 0/1 matrices and hands on one number per document, so pairs are
   never rows.

Shingles are compared by 64-bit hashes (58 bits inside a fragment when counting overlaps): a chance
collision would have to fall into the same two documents to move a count by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakerules.llm import _exchange as ex
from lakerules.llm._common import cut, pick
from lakerules.llm._text import U64, Words, mix, release, salt, shingles, slices, sorted_distinct

SHINGLE = 5
LEAST = 75  # percent
SIZE_STEP = 1.4  # ratio of size classes; more than 100 / LEAST, so partners are one class apart at most
ROOM = 512  # documents that meet as one
ROOM_GRAMS = 1 << 20
TASK_GRAMS = 1 << 18  # of small components that share a task, on average
COLUMNS = 4096  # shingles per matrix product
HASH_BITS = 58  # of an order key: fragment above, hash below
FEW_LINKS = 1 << 18  # that one task makes components of; more take star steps


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows and where each row's begin. A row with fewer
    than ``n`` words has one, its whole sequence; a row without words has none."""
    words = Words(texts)
    rows = len(words.offsets) - 1
    values, row = shingles(words, n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        extra = []
        for r in short:
            h = np.zeros(1, U64)
            for w in words.hash[words.first[r]:words.first[r + 1]]:
                h = mix(h * salt(3) + w)
            extra.append(h[0])
        values, row = np.concatenate((values, np.array(extra, U64))), np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        values, row = values[order], row[order]
    return sorted_distinct(values, row, rows)


def _signatures(n: int):
    def signatures(batches):
        for batch in batches:
            for low, high in slices(batch["text"]):
                values, at = shingle_sets(batch["text"].slice(low, high - low), n)
                sums = []
                for i in (11, 12):
                    total = np.concatenate(([U64(0)], np.cumsum(mix(values + salt(i)), dtype=np.uint64)))
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(low, high - low), pa.array(np.diff(at), pa.int64()), *map(pa.array, sums)],
                    names=["doc_id", "n_shingles", "s1", "s2"])
            release()
    return signatures


def _block_sets(docs: pa.Table, reps: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, list]:
    """The sets of a block's class representatives. Rows that share an id are read as one set."""
    chosen = pc.is_in(docs["doc_id"], value_set=reps["rep"].combine_chunks())
    docs = docs.filter(chosen)
    ids, of = np.unique(np.array(docs["doc_id"].to_pylist(), dtype=object), return_inverse=True) if len(docs) else ([], [])
    texts = docs["text"].combine_chunks()
    values, row = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for low, high in slices(texts) if len(docs) else ():
        own, at = shingle_sets(texts.slice(low, high - low), n)
        values.append(own)
        row.append(np.repeat(np.asarray(of[low:high], dtype=np.int64), np.diff(at)))
    values, row = np.concatenate(values), np.concatenate(row)
    order = np.argsort(row, kind="stable")
    values, at = sorted_distinct(values[order], row[order], len(ids))
    return values, at, list(ids)


def _emit(n: int, bits: int):
    def emit(docs, reps):
        if not len(docs) or not len(reps):
            return ex.send(0, np.zeros(0, U64), np.zeros(0, int), bits)
        values, _, _ = _block_sets(docs, reps, n)
        keys, counts = np.unique(values, return_counts=True)
        release()
        return ex.send(docs["block"][0].as_py(), keys, counts, bits)
    return emit


def _total(key, sent):
    where, _, totals, _ = ex.add_up(sent)
    rows = ex.totals_rows(sent, [totals[w] for w in where]).append_column("rep", pa.nulls(len(sent), pa.int64()))
    del where, totals
    release()
    return rows


def _fragments(n: int, id_type: pa.DataType):
    def fragments(docs, back):
        out = {k: [] for k in ("doc_id", "n", "start", "fragment", "grams")}
        reps = back.filter(pc.is_valid(back["rep"]))
        if len(docs) and len(reps):
            values, at, ids = _block_sets(docs, reps, n)
            keys, which = np.unique(values, return_inverse=True)
            df = ex.received(back.filter(pc.is_valid(back["totals"])))[which].astype(np.int64)
            size = np.diff(at)
            alone = np.bincount(np.repeat(np.arange(len(ids)), size)[df == 1], minlength=len(ids))
            live = np.flatnonzero(alone < prefix_length(size))
            # Fragment 1 holds counts of 2, fragment 2 those of 3 and 4, and so on.
            fragment = np.ceil(np.log2(np.maximum(df, 1))).astype(np.int64)
            order_key = (fragment << HASH_BITS) | (values >> U64(64 - HASH_BITS)).astype(np.int64)
            for i in live:
                own = order_key[at[i]:at[i + 1]][df[at[i]:at[i + 1]] > 1]
                own.sort()
                cuts = np.flatnonzero(np.diff(own >> HASH_BITS)) + 1
                start = int(alone[i])
                for part in np.split(own, cuts):
                    if len(part):
                        for k, v in zip(out, (ids[i], int(size[i]), start, int(part[0] >> HASH_BITS), part)):
                            out[k].append(v)
                        start += len(part)
        release()
        types = {"doc_id": id_type, "fragment": pa.int32(), "grams": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})
    return fragments


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-LEAST * n // 100) + 1


def _can_reach(n_x: Column, n_y: Column, rest_x: Column, rest_y: Column) -> Column:
    """Whether sizes, and what is left from the shared position on, allow the similarity."""
    return (100 * F.least(rest_x, rest_y) * (100 + LEAST) >= 100 * LEAST * (n_x + n_y)) & (
        100 * F.least(n_x, n_y) >= LEAST * F.greatest(n_x, n_y))


def _can_be_smaller() -> Column:
    """Whether a row's position allows a link with a document of its size or larger: the rest must
    reach the similarity alone, which leaves the first seventh of the set."""
    return (100 + LEAST) * (F.col("n") - F.col("at")) >= 2 * LEAST * F.col("n")


def _verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (x, y, n_x, n_y) that are similar: overlaps counted per fragment, then summed."""
    left = parts.select(F.col("doc_id").alias("x"), "fragment", F.col("grams").alias("grams_x"))
    right = parts.select(F.col("doc_id").alias("y"), "fragment", F.col("grams").alias("grams_y"))
    met = pairs.join(left, "x").join(right, ["y", "fragment"])
    overlap = met.select("x", "y", "n_x", "n_y", F.size(F.array_intersect("grams_x", "grams_y")).alias("both"))
    total = overlap.groupBy("x", "y", "n_x", "n_y").agg(F.sum("both").alias("both"))
    return total.filter(100 * F.col("both") >= LEAST * (F.col("n_x") + F.col("n_y") - F.col("both"))).select("x", "y")


def _first_shared(prefix: DataFrame) -> DataFrame:
    """The rows of shingles that two or more prefixes hold; of shingles that the very same documents
    hold, only the first in the order. The others give the same pairs, with later positions. ``low``
    is the least size of a shingle's rows that can be the smaller one of a link, null without any."""
    held = prefix.groupBy("gram").agg(
        F.count(F.lit(1)).alias("many"), F.min(F.when(_can_be_smaller(), F.col("n"))).alias("low"),
        *[F.bit_xor(F.xxhash64(F.lit(i), F.col("doc_id"))).alias(f"s{i}") for i in (1, 2)])
    first = held.filter("many > 1").groupBy("many", "s1", "s2").agg(F.min(F.struct("gram", "low")).alias("first"))
    return prefix.join(first.select("first.gram", "first.low"), "gram")


def _within_reach(prefix: DataFrame) -> DataFrame:
    """The rows that can link in their shingle at all, by position and size. Of two documents that
    link, the smaller one has at least the size ``low`` and both have enough left for their sizes."""
    rest = F.col("n") - F.col("at")
    return prefix.filter((100 + LEAST) * rest >= LEAST * (F.col("n") + F.col("low"))).drop("low")


def _leader_pairs(prefix: DataFrame) -> DataFrame:
    """Each document with the leader of every shingle of its prefix, where that can do. A shingle's
    leader has the fewest rarer shingles, so it is near to what the others share."""
    lead = prefix.groupBy("gram").agg(F.min(F.struct("at", "n", "doc_id")).alias("lead"))
    met = prefix.join(lead, "gram").filter(F.col("doc_id") != F.col("lead.doc_id"))
    return _met(met)


def _met(met: DataFrame) -> DataFrame:
    """``x, y, n_x, n_y``: the distinct pairs of a row's document and its ``lead`` that can link."""
    met = met.filter(_can_reach(F.col("lead.n"), F.col("n"), F.col("lead.n") - F.col("lead.at"), F.col("n") - F.col("at")))
    ends = [F.struct(F.col("doc_id").alias("id"), "n"), F.struct(F.col("lead.doc_id").alias("id"), F.col("lead.n").alias("n"))]
    met = met.select(F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
    return met.select(F.col("low.id").alias("x"), F.col("high.id").alias("y"), F.col("low.n").alias("n_x"),
                      F.col("high.n").alias("n_y")).distinct()


def _undecided(prefix: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of shingles with two or more labels, and their labels. Labels only ever merge, so
    what drops out here stays out."""
    rows = prefix.join(found, prefix["doc_id"] == found["node"], "left").select(
        "gram", "doc_id", "n", "at", F.coalesce("component", "doc_id").alias("label"))
    labels = rows.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return rows.join(labels.filter("low <> high").select("gram"), "gram", "left_semi")


def _meetings(prefix: DataFrame) -> tuple[int, int]:
    """How many pairs of different labels could meet at most, shingle by shingle, and the rows."""
    groups = prefix.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("m"), F.count_if(_can_be_smaller()).alias("s"))
    each = groups.groupBy("gram").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum(F.col("m") * F.col("s")).alias("own"))
    total = each.agg(F.sum(F.col("m") * F.col("s") - F.col("own")), F.sum("m")).first()
    return total[0] or 0, total[1] or 0


def _other_leader_pairs(prefix: DataFrame) -> DataFrame:
    """Each document with the leader of the other labels in every shingle of its prefix. Only the
    first two of different labels are needed: the second serves the documents of the first's label."""
    leads = prefix.groupBy("gram", "label").agg(F.min(F.struct("at", "n", "doc_id")).alias("lead"))
    leads = leads.select("gram", F.struct("lead.at", "lead.n", "lead.doc_id", "label").alias("lead"))
    first = leads.groupBy("gram").agg(F.min("lead").alias("first"))
    second = leads.join(first, "gram").filter("lead.label <> first.label").groupBy("gram", "first").agg(F.min("lead").alias("second"))
    return _met(prefix.join(second, "gram").withColumn("lead", F.when(
        F.col("label") == F.col("first.label"), F.col("second")).otherwise(F.col("first"))))


def _cross_pairs(prefix: DataFrame) -> DataFrame:
    """Candidates whose two documents have different labels.

    Shingles with one label drop out first. In the others, documents of the most frequent label meet
    only those of other labels (``part`` 1; the others meet all, in part 0). Of two documents the
    smaller one must have the shingle it shares first within a seventh of its set (else the rest
    cannot reach 75 %), and the larger one has at most 4/3 of its size: so only such rows meet, within
    classes of size.
    """
    groups = prefix.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("members"))
    top = groups.groupBy("gram").agg(F.max(F.struct("members", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    rows = prefix.join(top.filter("labels > 1").select("gram", F.col("top.label").alias("main")), "gram")
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(SIZE_STEP)))
    rows = rows.select("gram", "doc_id", "n", "at", "label", (F.col("label") == F.col("main")).alias("of_main"), size.alias("size"))
    small = rows.filter(_can_be_smaller())
    small = small.select("gram", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), F.col("of_main").cast("int").alias("part"),
                         F.col("doc_id").alias("x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"), F.col("label").alias("label_x"))
    parts = F.when(F.col("of_main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    large = rows.select(F.col("gram").alias("g"), F.col("size").alias("s"), F.explode(parts).alias("p"), F.col("doc_id").alias("y"),
                        F.col("n").alias("n_y"), F.col("at").alias("at_y"), F.col("label").alias("label_y"))
    reach = _can_reach(F.col("n_x"), F.col("n_y"), F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    met = small.join(large, (F.col("gram") == F.col("g")) & (F.col("size") == F.col("s")) & (F.col("part") == F.col("p"))
                     & (F.col("n_x") <= F.col("n_y")) & (F.col("label_x") != F.col("label_y")) & reach)
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
                      F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_x"),
                      F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_y")).distinct()


def _forest(id_type: pa.DataType):
    def forest(edges):
        code = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(code.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        u, v = np.split(rank[code.indices.to_numpy()], 2)
        root = np.arange(len(order))
        while True:  # hook the larger root to the smaller one, then let every node point to its root
            a, b = root[u], root[v]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        low = np.flatnonzero(root != np.arange(len(order)))
        ids = code.dictionary.take(order)
        return pa.table({"node": ids.take(pa.array(low)).cast(id_type), "component": ids.take(pa.array(root[low])).cast(id_type)})
    return forest


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``x``, ``y``) but the smallest of its
    component: the smallest node reachable.

    Up to ``FEW_LINKS`` distinct links are one task's work. More alternate large-star and small-star
    until the edges stay as they are; every step writes its edges to the shared folder, so a lost
    executor costs at most one step.
    """
    edges = cut(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = mark(edges)
    if state[0] <= FEW_LINKS:
        kind = edges.schema["u"].dataType
        name = kind.simpleString()
        return cut(edges.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(_forest(to_arrow_type(kind)), f"node {name}, component {name}"))
    while state[0]:
        both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        new = mark(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found``, the components of earlier links, with ``links`` added: only their labels' components
    are computed, so a round costs what it adds."""
    for end in ("x", "y"):
        label = found.select(F.col("node").alias(end), F.col("component").alias(f"label_{end}"))
        links = links.join(label, end, "left")
    between = components(links.select(F.coalesce("label_x", "x").alias("x"), F.coalesce("label_y", "y").alias("y")))
    renamed = between.select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = found.join(renamed, found["component"] == renamed["old"], "left").select(
        "node", F.coalesce("new", "component").alias("component"))
    return cut(moved.union(between))


def _overlaps(grams: np.ndarray, doc: np.ndarray, docs: int, split: int) -> np.ndarray:
    """Shared shingles of each document under ``split`` with each from there on; of all with all
    where ``split`` is 0."""
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    shared = counts > 1
    used = shared[which]
    which, doc = (np.cumsum(shared) - 1)[which[used]], doc[used]
    order = np.argsort(which, kind="stable")
    which, doc = which[order], doc[order]
    both = np.zeros((split or docs, docs - split), np.int64)
    many = int(shared.sum())
    for low in range(0, many, COLUMNS):
        begin, end = np.searchsorted(which, (low, low + COLUMNS))
        has = np.zeros((docs, min(COLUMNS, many - low)), np.float32)
        has[doc[begin:end], which[begin:end] - low] = 1
        both += (has[:split or docs] @ has[split:].T).astype(np.int64)
    return both


def _count_links(id_type: pa.DataType):
    def count(rows):
        meet = rows["meet"].to_numpy()
        order = np.lexsort((rows["side"].to_numpy(), meet))
        rows = rows.take(pa.array(order)).combine_chunks()
        meet, side = meet[order], rows["side"].to_numpy()
        code = rows["doc_id"].combine_chunks().dictionary_encode()
        ids, code = code.dictionary, code.indices.to_numpy()
        lists = rows["grams"].combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        n, weight = rows["n"].to_numpy(), rows["weight"].to_numpy()
        found, links = [], []
        cuts = np.flatnonzero(np.diff(meet)) + 1
        for begin, end in zip((0, *cuts), (*cuts, len(meet))):
            # A document's rows, one per fragment, are on one side; side 0 comes first.
            own, first, doc = np.unique(code[begin:end], return_index=True, return_inverse=True)
            sides = side[begin:end][first]
            place = np.argsort(sides, kind="stable")
            split = int((sides == 0).sum()) if sides.any() else 0
            if rows["paired"][begin].as_py() and split in (0, len(own)):
                continue  # one of the two rooms only
            back = np.empty(len(own), np.int64)
            back[place] = np.arange(len(own))
            doc = np.repeat(back[doc], np.diff(at[begin:end + 1]))
            both = _overlaps(values[at[begin]:at[end]], doc, len(own), split)
            own, first = own[place], first[place]
            size, rows_of = n[begin:end][first], weight[begin:end][first]
            similar = 100 * both >= LEAST * (size[:split or len(own), None] + size[None, split:] - both)
            if split:
                links.append(np.concatenate((similar @ rows_of[split:], similar.T @ rows_of[:split])))
            else:
                np.fill_diagonal(similar, False)
                links.append(similar @ rows_of)
            found.append(own)
        release()
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.table({"doc_id": ids.take(pa.array(found)).cast(id_type),
                         "links": pa.array(np.concatenate(links) if links else np.zeros(0, np.int64), pa.int64())})
    return count


def _partners(parts: DataFrame, found: DataFrame, classes: DataFrame, name: str, id_type: pa.DataType) -> DataFrame:
    """``rep, partners``: for each class representative with links, the rows of the classes that it
    links to."""
    members = found.union(found.select(F.col("component").alias("node"), "component").distinct())
    held = parts.groupBy("doc_id", "n").agg(F.sum(F.size("grams")).alias("held"))
    docs = cut(held.join(members, held["doc_id"] == members["node"]).select("doc_id", "n", "held", "component"))
    totals = docs.groupBy(F.col("component").alias("whole")).agg(F.count(F.lit(1)).alias("m"), F.sum("held").alias("g"))
    large = totals.filter((F.col("m") > ROOM) | (F.col("g") > ROOM_GRAMS)).select("whole", F.lit(True).alias("large"))
    docs = docs.join(large, docs["component"] == large["whole"], "left")
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(SIZE_STEP))).cast("int")
    docs = cut(docs.select("doc_id", "held", "component", F.coalesce("large", F.lit(False)).alias("large"),
                           F.when(F.col("large"), size).otherwise(F.lit(0)).alias("size")))
    tasks = max(1, -(-(docs.filter("not large").agg(F.sum("held")).first()[0] or 0) // TASK_GRAMS))

    rooms = cut(docs.groupBy("component", "size").agg(F.when(F.first("large"), F.greatest(
        F.ceil(F.count(F.lit(1)) / ROOM), F.ceil(F.sum("held") / ROOM_GRAMS))).otherwise(F.lit(1)).cast("int").alias("k")))
    above = rooms.select("component", (F.col("size") - 1).alias("size"), F.col("k").alias("k_above"))
    below = rooms.select("component", (F.col("size") + 1).alias("size"), F.col("k").alias("k_below"))
    rooms = rooms.join(above, ["component", "size"], "left").join(below, ["component", "size"], "left")
    docs = docs.join(rooms, ["component", "size"]).withColumn("room", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))

    def meetings(k: Column, low: Column, paired: int, left, right, side) -> Column:
        every = F.when(F.coalesce(k, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(
            low.alias("low"), left(j).alias("left"), right(j).alias("right"),
            (F.lit(bool(paired)) | (left(j) != right(j))).alias("paired"), F.lit(paired).alias("next"),
            side(j).cast("int").alias("side"))))
        return F.coalesce(every, F.array().cast(
            "array<struct<low:int,left:int,right:int,paired:boolean,next:int,side:int>>"))

    room = F.col("room")
    each = F.concat(
        meetings(F.col("k"), F.col("size"), 0, lambda j: F.least(room, j), lambda j: F.greatest(room, j), lambda j: j < room),
        meetings(F.col("k_above"), F.col("size"), 1, lambda j: room, lambda j: j, lambda j: F.lit(0)),
        meetings(F.col("k_below"), F.col("size") - 1, 1, lambda j: j, lambda j: room, lambda j: F.lit(1)))
    docs = docs.select("doc_id", "component", "large", F.explode(each).alias("m"))
    meet = F.xxhash64("component", "m.low", "m.left", "m.right", "m.next")
    docs = docs.select("doc_id", F.when(F.col("large"), meet).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks))).alias("task"),
                       meet.alias("meet"), "m.paired", "m.side")
    weights = classes.filter("class_id is not null").groupBy(F.col("class_id").alias("doc_id")).agg(
        F.sum("class_size").alias("weight"))
    sent = parts.select("doc_id", "n", "grams").join(weights, "doc_id").join(docs, "doc_id")
    sent = sent.select("task", "meet", "paired", "side", "doc_id", "n", "weight", "grams")
    links = sent.groupBy("task").applyInArrow(_count_links(id_type), f"doc_id {name}, links long")
    return links.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("partners"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   count_links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, class_size, n_links`` for every row.

    ``component_id`` is the smallest id reachable by links, ``class_id`` the smallest id with the
    very same set, ``class_size`` the number of rows with it. ``n_links`` is the number of other rows
    that the row links to, all of its class and of the classes similar to it; without ``count_links``
    the column is left out.

    - Null texts and texts without words have no shingles, no class but themselves and no links;
      texts of fewer than ``shingle`` words have one, their whole sequence.
    - Rows given twice are two members of one class. Rows that share an id but not their text link
      as one document that has both sets.
    - A null id takes part in its class only: its component is that of the class, and null where
      all ids of the class are null.
    - An empty table gives an empty result; other columns are not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType
    id_type, name = to_arrow_type(kind), kind.simpleString()
    signed = cut(rows.mapInArrow(_signatures(shingle), f"doc_id {name}, n_shingles long, s1 long, s2 long"))
    classes = signed.filter("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))

    blocks, bits = ex.sizes(rows)
    docs = ex.in_blocks(rows, blocks)
    reps = classes.filter("class_id is not null").select(F.col("class_id").alias("rep")).distinct()
    reps = cut(reps.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks))))
    sent = docs.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(_emit(shingle, bits), ex.SENT)
    totals = sent.groupBy("bucket").applyInArrow(_total, ex.TOTALS + ", rep long")
    none = F.lit(None)
    back = totals.select("block", "bucket", "totals", F.col("rep").cast(name).alias("rep")).union(reps.select(
        "block", none.cast("int").alias("bucket"), none.cast("binary").alias("totals"), "rep"))
    parts = cut(docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        _fragments(shingle, id_type), f"doc_id {name}, n long, start long, fragment int, grams array<bigint>"))

    longest = F.col("n") - F.ceil(F.col("n") * LEAST / 100) + 1
    prefix = parts.select("doc_id", "n", "start", F.posexplode(F.slice("grams", F.lit(1), F.greatest(
        F.lit(0), longest - F.col("start")).cast("int"))).alias("nth", "gram"))
    prefix = cut(_within_reach(_first_shared(prefix.select("doc_id", "n", "gram", (F.col("start") + F.col("nth")).alias("at")))))

    pairs = cut(_leader_pairs(prefix))
    found = components(cut(_verified(pairs, parts)))
    tested, before = pairs.select("x", "y"), None
    while True:
        prefix = cut(_undecided(prefix.drop("label"), found))
        meetings, left = _meetings(prefix)
        if meetings <= left or before is not None and 4 * meetings > 3 * before:
            break
        before = meetings
        more = cut(_other_leader_pairs(prefix).join(tested, ["x", "y"], "left_anti"))
        if more.isEmpty():
            break
        tested = tested.union(more.select("x", "y"))
        new = cut(_verified(more, parts))
        if new.isEmpty():
            break
        found = _joined(found, new)
    others = cut(_cross_pairs(prefix).join(tested, ["x", "y"], "left_anti"))
    if not others.isEmpty():
        far = cut(_verified(others, parts))
        if not far.isEmpty():
            found = _joined(found, far)

    named = classes.join(found, classes["class_id"] == found["node"], "left").select(
        F.col("n_shingles").alias("n"), F.col("s1").alias("a"), F.col("s2").alias("b"), "class_id", "class_size",
        F.coalesce("component", "class_id").alias("component"))
    if count_links:
        known = classes.filter("class_id is not null").groupBy(F.col("class_id").alias("rep")).agg(
            F.sum("class_size").alias("weight"))
        known = known.join(_partners(parts, found, classes, name, id_type), "rep", "left")
        named = named.join(cut(known), F.col("class_id") == F.col("rep"), "left").withColumn(
            "links", F.coalesce("weight", "class_size") - 1 + F.coalesce("partners", F.lit(0)))
    joined = signed.join(named, (F.col("n_shingles") == F.col("n")) & (F.col("s1") == F.col("a")) & (F.col("s2") == F.col("b")), "left")
    empty = F.col("n_shingles") == 0
    last = [F.coalesce("links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return joined.select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), *last)
