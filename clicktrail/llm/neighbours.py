"""N-gram Jaccard join by vertical partitioning of a global order of n-grams."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.llm.components import components
from clicktrail.llm.wordhash import U, Words, mix, runs, slices
from clicktrail.spark import let_go, materialize

N = 5
#: Similarity in fifths: two sets link when 5 * both >= 4 * either.
FIFTHS = 4
#: n-grams in more documents than this come last in the global order, the most frequent at the end.  Only the order
#: depends on it, and any order gives the same result.  A table of at most 2 ** CELLS cells of 4 bits, by the first bits of their hashes, says how
#: frequent they are; it has room for half as many n-grams, and rare ones that share a cell go last with them.  Frequent n-grams that it
#: left out would stand among the first of many sets, and tie sets that have nothing else in common.
COMMON = 4
CELLS = 25
#: Rows that go on are found by a bitmap of at most 2 ** MARKS bits; others pass it by chance only, and are left out by the join behind it.
MARKS = 27
#: A group of up to this many documents under one n-gram is paired; larger ones are tied to their first document.
PAIRED = 8
#: Different sets that link have four n-grams in common at least.  Prefixes are so long that links have SHARED of them there, and
#: pairs whose partial counts add up to fewer are no candidates.
SHARED = 3
#: n-grams of a fragment.
FRAGMENT = 1 << 20
#: What a task holds at most: n-grams before they are sent, n-grams and documents of a block.
HELD, BLOCK_GRAMS, BLOCK_DOCS = 1 << 18, 1 << 21, 2048
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20
FRAGMENTS = 8
DENSE = 48
_LAST = (1 << 63) - 1


def grams(texts: pa.Array, n: int = N):
    """``(text, hash)`` of the distinct n-grams of each text, by text, then hash; and their number per text.

    A text with fewer words has all its words as one n-gram; one without words has none.
    """
    words = Words(texts, lower=True)
    counts = words.counts
    text, place = words.places()
    start = np.flatnonzero((place + n <= counts[text]) | (place == 0))
    of = text[start]
    hashes = runs(words.hash, start, start + np.minimum(counts[of], n))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    of, hashes = of[new], hashes[new]
    return of, hashes, np.bincount(of, minlength=len(texts))


def set_keys(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit key of each set of n-grams, the same for equal sets; 0 for the empty one."""
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes ^ U(0x5851F42D4C957F2D)), out=total[1:], dtype=U)
    first = np.concatenate([[0], np.cumsum(n)])
    key = mix((total[first[1:]] - total[first[:-1]]) ^ n.astype(U))
    return np.where(n > 0, np.maximum(key, U(1)), U(0)).view(np.int64)


def _signatures(batches):
    """(doc_id, id, n, key): size and key of each set."""
    for batch in batches:
        for part in slices(batch, most=SLICE):
            _, hashes, n = grams(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("id"), pa.array(n.astype(np.int64)), pa.array(set_keys(hashes, n))], ["doc_id", "id", "n", "key"])


def _one_each(column, wanted):
    """(id, key, ``column``) of the first row in a task of each id and set that is ``wanted``, so that copies without an id are few."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, most=SLICE):
                _, hashes, n = grams(part.column("text"))
                keys, new = set_keys(hashes, n), []
                ids = part.column("id").to_numpy()
                use = np.flatnonzero(wanted(ids, keys))
                for k, pair in zip(use.tolist(), zip(ids[use].tolist(), keys[use].tolist())):
                    if pair not in seen:
                        seen.add(pair)
                        new.append(k)
                new = pa.array(new, pa.int64())
                yield pa.RecordBatch.from_arrays([x.take(new) for x in (part.column("id"), pa.array(keys), part.column(column))], ["id", "key", column])

    return run


def _places(ids: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(U) ^ mix(ids.astype(np.int64).view(U))) >> U(64 - bits)).astype(np.int64)


class Marks:
    """A bitmap of rows ``(id, key)``, on the executors: ``of`` is true for every one of them, and for few others."""

    PARTS = 9

    def __init__(self, pairs: DataFrame):
        self.bits = bits = min(MARKS, max(16, (32 * pairs.count()).bit_length()))
        parts = self.PARTS

        def placed(batches):
            for batch in batches:
                places = _places(batch.column("id").to_numpy(), batch.column("key").to_numpy(), bits)
                yield pa.RecordBatch.from_arrays([pa.array(places >> (bits - parts)), pa.array(places)], ["part", "place"])

        def drawn(t):
            bitmap = np.zeros(1 << (bits - parts), bool)
            bitmap[t.column("place").to_numpy() & ((1 << (bits - parts)) - 1)] = True
            packed = zlib.compress(np.packbits(bitmap, bitorder="little").tobytes(), 1)
            return pa.table({"part": t.column("part").slice(0, 1), "bitmap": pa.array([packed], pa.binary())})

        found = pairs.select("id", "key").mapInArrow(placed, "part long, place long").groupBy("part").applyInArrow(drawn, "part long, bitmap binary").collect()
        bitmap = np.zeros((1 << parts, 1 << (bits - parts - 3)), np.uint8)
        for part, packed in found:
            bitmap[part] = np.frombuffer(zlib.decompress(packed), np.uint8)
        self.sent = pairs.sparkSession.sparkContext.broadcast(bitmap.ravel())

    def of(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        places = _places(ids, keys, self.bits)
        return (self.sent.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _sets(batch):
    """Keys and distinct n-grams of the different sets in a batch, copies left out."""
    of, hashes, n = grams(batch.column("text"))
    keys = set_keys(hashes, n)
    use = np.zeros(len(n), bool)
    use[np.unique(keys, return_index=True)[1]] = True
    return keys, of[use[of]], hashes[use[of]], n


def _groups(keys: np.ndarray):
    """Start and size of each run of equal columns of ``keys``."""
    if not keys.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return at, np.diff(np.append(at, keys.shape[1]))


def _cut(hashes, bits):
    """Fragments of the order by hash: the first ``bits`` bits; where each is in a sorted array."""
    fragment = hashes >> U(64 - bits)
    return [(int(fragment[at]), slice(at, at + size)) for at, size in zip(*_groups(fragment[None]))]


def _packed(batches, collect, emit):
    """Gather arrays from parts of batches and send them on when there are enough."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, most=SLICE):
            got = collect(part)
            if len(got[0]):
                held.append(got)
                size += len(got[0])
            if size >= HELD:
                yield from emit([np.concatenate(x) for x in zip(*held)])
                held, size = [], 0
    if held:
        yield from emit([np.concatenate(x) for x in zip(*held)])


def _gram_rows(bits):
    """(fragment, grams, counts): the next 32 bits of the n-grams of a fragment and in how many sets of the task each is."""

    def emit(arrays):
        hashes = np.sort(arrays[0])
        at, n = _groups((hashes >> U(32 - bits))[None])
        hashes, n = hashes[at], n.astype(np.uint32)
        parts = _cut(hashes, bits)
        low = ((hashes >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)
        packed = [pa.array([x[s].tobytes() for _, s in parts], pa.binary()) for x in (low, n)]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in parts], pa.int64()), *packed], ["fragment", "grams", "counts"])

    return lambda batches: _packed(batches, lambda part: (_sets(part)[2],), emit)


def _levels(bits, cells):
    """(fragment, levels): the part of the table of frequencies that belongs to a fragment."""

    def run(t: pa.Table) -> pa.Table:
        low, counts = (np.concatenate([np.frombuffer(x, np.uint32) for x in t.column(c).to_pylist()]) for c in ("grams", "counts"))
        order = np.argsort(low, kind="stable")
        low, total = low[order], np.concatenate([[0], np.cumsum(counts[order], dtype=np.int64)])
        at, size = _groups(low[None])
        n = total[at + size] - total[at]
        low, n = low[at[n > COMMON]].astype(np.int64), n[n > COMMON]
        span = 1 << (cells - bits)
        most = np.argsort(n, kind="stable")[-max(1, span // 2):]
        levels = np.zeros(span, np.uint8)
        np.maximum.at(levels, low[most] >> (32 - (cells - bits)), (np.log2(n[most]) - 1).clip(max=15).astype(np.uint8))
        packed = zlib.compress((levels[::2] | levels[1::2] << 4).tobytes(), 1)
        return pa.table({"fragment": t.column("fragment").slice(0, 1), "levels": pa.array([packed], pa.binary())})

    return run


def frequent(rows: DataFrame, bits: int, cells: int) -> np.ndarray:
    """How frequent n-grams are, by the first ``cells`` bits of their hashes: 0 for rare ones, else a power of 2; two cells to a byte."""
    sent = rows.mapInArrow(_gram_rows(bits), "fragment long, grams binary, counts binary")
    found = sent.groupBy("fragment").applyInArrow(_levels(bits, cells), "fragment long, levels binary").collect()  # as large as the table at most
    levels = np.zeros((1 << bits, 1 << (cells - bits - 1)), np.uint8)
    for fragment, packed in found:
        levels[fragment] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return levels.ravel()


def _posting_rows(sent, cells, fragment_bits):
    """(fragment, hash, id, n, place, many): the first n-grams of each set in the global order, packed by fragment.

    Sets that link have SHARED of these in common: a set of n has n - ceil(4 n / 5) + SHARED.  An n-gram that more than PAIRED sets
    of the task have goes out once, with their number; the sets are tied to its first, in a row without a fragment: ``hash`` holds
    the first ones' ids there, and ``id`` the others'.
    """

    def collect(part):
        ids, of, hashes, n = _sets(part)
        levels = sent.value
        cell = (hashes >> U(64 - cells)).astype(np.int64)
        rank = levels[cell >> 1] >> (cell & 1).astype(np.uint8) * np.uint8(4) & np.uint8(15) if len(levels) else np.zeros(len(hashes), np.uint8)
        order = np.lexsort((rank, of))  # equally frequent ones stay in the order of their hashes
        of, hashes = of[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) if len(of) else of
        use = place < n[of] - (FIFTHS * n[of] + 4) // 5 + SHARED
        return hashes[use], ids[of[use]], n[of[use]].astype(np.int32), place[use].astype(np.int32)

    def emit(arrays):
        order = np.lexsort((arrays[1], arrays[0]))
        arrays = [x[order] for x in arrays]
        new, _ = _groups(np.stack([arrays[0], arrays[1].view(U)]))
        arrays = [x[new] for x in arrays]
        at, size = _groups(arrays[0][None])
        large = np.repeat(size > PAIRED, size)
        lead = np.repeat(at, size)
        tied = np.flatnonzero(large & (lead != np.arange(len(lead))))
        ties = np.unique(np.stack([arrays[1][lead[tied]], arrays[1][tied]]), axis=1)
        arrays.append(np.repeat(size, size).astype(np.int32))
        stay = np.ones(len(lead), bool)
        stay[tied] = False
        arrays = [x[stay] for x in arrays]
        parts = _cut(arrays[0], fragment_bits)
        columns = [[x[s].tobytes() for _, s in parts] for x in arrays]
        for column, extra in zip(columns, (ties[0].tobytes(), ties[1].tobytes(), None, None, None)):
            column.append(extra)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(f for f, _ in parts), None], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["fragment", "hash", "id", "n", "place", "many"])

    return lambda batches: _packed(batches, collect, emit)


def _candidates(t: pa.Table) -> pa.Table:
    """(a, b, n): for a fragment, which documents have how many of their first n-grams in common.

    Pairs whose sizes or places rule out enough n-grams in common are left out; the first SHARED common n-grams of a link
    never rule it out.  In a large group every document is only tied to the first, to be compared later as a block.
    The ties that tasks have sent, dealt under fragments below zero, are candidates each.
    """
    if t.column("fragment")[0].as_py() < 0:
        a, b = (np.concatenate([np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]) for c in ("hash", "id"))
        return pa.table({"a": a, "b": b, "n": np.full(len(a), SHARED)})
    h, ids, n, place, many = (np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()])
                              for c, k in (("hash", U), ("id", np.int64), ("n", np.int32), ("place", np.int32), ("many", np.int32)))
    order = np.lexsort((-many, ids, h))
    h, ids, n, place, many = (x[order] for x in (h, ids, n, place, many))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])])
    h, ids, n, place, many = (x[new] for x in (h, ids, n, place, many))
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(at, len(h)))
    large = np.repeat(np.maximum(size, np.maximum.reduceat(many, at)) > PAIRED, size)
    found = []
    for d in range(1, PAIRED):
        i = np.flatnonzero((h[d:] == h[:-d]) & ~large[d:])
        if not len(i):
            break
        j, a, b = i + d, n[i].astype(np.int64), n[i + d].astype(np.int64)
        rest = np.minimum(a - place[i], b - place[j]) + SHARED - 1
        ok = (5 * np.minimum(a, b) >= FIFTHS * np.maximum(a, b)) & (9 * rest >= FIFTHS * (a + b))
        found.append((np.minimum(ids[i[ok]], ids[j[ok]]), np.maximum(ids[i[ok]], ids[j[ok]])))
    pairs, count = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1, return_counts=True) if found else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    tied = np.flatnonzero(large)
    lead = np.repeat(at, size)[tied]
    ties = np.unique(np.stack([ids[lead[lead != tied]], ids[tied[lead != tied]]]), axis=1)
    both = np.concatenate([pairs, ties], axis=1)
    return pa.table({"a": both[0], "b": both[1], "n": np.concatenate([count, np.full(ties.shape[1], SHARED)]).astype(np.int64)})


def candidates(rows: DataFrame, total: int) -> DataFrame:
    """``(a, b, n)``: keys of sets that may link; ``n``, summed over the fragments, decides.

    ``total`` is the number of n-grams in all rows, copies included.
    """
    bits = min(31, max(9, (total // FRAGMENT).bit_length()))
    cells = max(bits + 1, min(CELLS, max(16, total.bit_length())))
    sent = rows.sparkSession.sparkContext.broadcast(frequent(rows, bits, cells))
    let_go(rows.sparkSession)
    postings = rows.mapInArrow(_posting_rows(sent, cells, bits), "fragment long, hash binary, id binary, n binary, place binary, many binary")
    dealt = F.coalesce("fragment", -1 - F.pmod(F.xxhash64("id"), F.lit(1 << bits)))
    partial = postings.withColumn("fragment", dealt).groupBy("fragment").applyInArrow(_candidates, "a long, b long, n long")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED)


def _pairs_of(h: np.ndarray, r: np.ndarray):
    """All pairs of sets under equal hashes in a sorted array."""
    for d in range(1, len(h)):
        i = np.flatnonzero(h[d:] == h[:-d])
        if not len(i):
            return
        yield r[i], r[i + d]


def linked(of: np.ndarray, hashes: np.ndarray, n: np.ndarray):
    """Pairs ``(x, y)`` of the sets of one cluster that link, by their exact overlaps.

    Overlaps are counted for each fragment of the order of n-grams, and summed per pair.  A small cluster lists the
    pairs under each n-gram; a large one, of at most two blocks, adds up a matrix of counts: n-grams in few sets as
    listed pairs, those in many as products of incidence matrices.
    """
    order = np.argsort(hashes, kind="stable")
    of, hashes = of[order], hashes[order]
    parts = [part for _, part in _cut(hashes, FRAGMENTS.bit_length() - 1)]
    m = len(n)
    if m <= DENSE:
        keys = [np.minimum(x, y) * m + np.maximum(x, y) for part in parts for x, y in _pairs_of(hashes[part], of[part])]
        both = np.bincount(np.concatenate(keys), minlength=m * m).reshape(m, m) if keys else np.zeros((m, m), np.int64)
    else:
        both = np.zeros((m, m), np.float32)  # counts far below 2 ** 24 are exact
        for part in parts:
            h, r = hashes[part], of[part]
            _, size = _groups(h[None])
            many = np.repeat(size > DENSE, size)
            for x, y in _pairs_of(h[~many], r[~many]):
                np.add.at(both, (np.minimum(x, y), np.maximum(x, y)), 1)
            hm, rm = h[many], r[many]
            column = np.cumsum(np.concatenate([[0], hm[1:] != hm[:-1]])) if len(hm) else hm
            for low in range(0, int(column[-1]) + 1 if len(hm) else 0, 1024):
                now = slice(*np.searchsorted(column, [low, low + 1024]))
                a = np.zeros((m, 1024), np.float32)
                a[rm[now], (column[now] - low).astype(np.int64)] = 1
                both += np.triu(a @ a.T, 1)
    return np.nonzero(5 * both >= FIFTHS * (n[:, None] + n[None, :] - both)) if m else (n, n)


def _linked(t: pa.Table) -> pa.Table:
    """(a, b): of the sets in a block, each with the smallest id that it reaches by links inside the block."""
    cluster, ids = t.column("cluster").to_numpy(), t.column("id").to_numpy()
    order = np.lexsort((ids, cluster))
    at, _ = _groups(np.stack([cluster[order], ids[order]]))  # copies of a set that share an id may come from several tasks
    order = order[at]
    cluster, ids = cluster[order], ids[order]
    sets = t.column("grams").take(pa.array(order))
    a, b = [], []
    for at, size in zip(*_groups(cluster[None])):
        own = [np.frombuffer(x.as_py(), U) for x in sets[at:at + size]]
        n, low = np.array([len(s) for s in own]), ids[at:at + size].copy()
        x, y = linked(np.repeat(np.arange(size), n), np.concatenate(own), n)
        while len(x):
            before = low.copy()
            least = np.minimum(low[x], low[y])
            np.minimum.at(low, x, least)
            np.minimum.at(low, y, least)
            if (before == low).all():
                break
        moved = low != ids[at:at + size]
        a.append(low[moved])
        b.append(ids[at:at + size][moved])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _gram_sets(batches):
    for batch in batches:
        for part in slices(batch, most=SLICE):
            of, hashes, n = grams(part.column("text"))
            sets = np.split(hashes, np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("block", "cluster", "id")), pa.array([s.tobytes() for s in sets], pa.binary())], ["block", "cluster", "id", "grams"])


def _rows(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), "text")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, id, n, key)`` of every row, and ``(key, first, component)`` of every set: its smallest id and its component.

    1. Equal sets have one key, and only keys are linked, whatever the ids of their rows.  So copies never meet in pairs.
    2. The global order of n-grams puts frequent ones last (``frequent``) and the rest by hash.  It is cut into fragments;
       a task for each counts which sets have n-grams of their prefixes in common, and the partial counts are
       summed per pair; pairs with a sum below SHARED go (``candidates``).
    3. Candidates that hang together form a cluster, and clusters are dealt into blocks of bounded size; a cluster
       beyond a block is split into blocks that meet two by two.  In a block all overlaps are counted exactly, fragment
       by fragment, and summed per pair; each set goes out with the smallest key that it reaches.
    4. Components of these links.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _rows(docs, "doc_id")
    marked = materialize(rows.mapInArrow(_signatures, f"doc_id {kind}, id long, n long, key long"), "gram-signatures")
    total = marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    clusters = components(candidates(rows.select("text"), total).select("a", "b"))
    let_go(docs.sparkSession)

    sets = materialize(marked.where("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.min("id").alias("first")), "gram-sets")
    sizes = clusters.join(sets.withColumnRenamed("key", "id"), "id")
    blocks = sizes.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_DOCS)).alias("parts"), F.sum("n").alias("grams"))
    blocks = materialize(blocks, "gram-blocks")
    small = blocks.where("parts = 1").agg(F.coalesce(F.sum("grams"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-small // BLOCK_GRAMS) * 2)
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("p")
    member = sizes.join(blocks, "component").select("id", "first", F.col("component").alias("cluster"), "parts", part)
    block = F.when(
        F.col("parts") == 1, F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(buckets)))),
    ).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.concat_ws(
        "-", F.col("cluster").cast("string"), F.least(i, "p").cast("string"), F.greatest(i, "p").cast("string"))))
    member = materialize(member.select(F.col("id").alias("key"), F.col("first").alias("id"), "cluster", block.alias("blocks")), "gram-members")

    one = rows.select("id", "text").mapInArrow(_one_each("text", Marks(member).of), rows.select("id", F.col("id").alias("key"), "text").schema)
    together = one.join(member, ["id", "key"]).select(F.explode("blocks").alias("block"), "cluster", F.col("key").alias("id"), "text")
    grams_of = together.mapInArrow(_gram_sets, "block string, cluster long, id long, grams binary")
    links = grams_of.groupBy("block").applyInArrow(_linked, "a long, b long")
    ends = components(links).withColumnRenamed("id", "key")
    let_go(docs.sparkSession)
    return marked, sets.join(ends, "key", "left").select("key", "first", F.coalesce("component", "key").alias("component"))


def near(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the component is the smallest id that is not null among its texts.

    Texts are linked, not ids: rows that share an id, or have none, and differ in text have each the component of their text;
    it is null if no row of the component has an id; an id of 2^63 - 1 is taken for none.  A text without words, null or not, has an empty set and links to
    nothing; it goes with the smallest component of other rows of its id, if there are any.  Sets are told apart by 64-bit keys, as
    n-grams are.  Empty tables give empty results; further columns are ignored.
    """
    marked, sets = _grouped(docs)
    sets = materialize(sets, "gram-components")
    least = sets.groupBy("component").agg(F.min("first").alias("least"))
    full = marked.where("n > 0").join(sets.join(least, "component").select("key", "least"), "key")
    full = materialize(full.select("doc_id", "id", "n", "least"), "gram-named")
    others = full.groupBy("id").agg(F.min("least").alias("least"))
    blank = marked.where("n = 0").join(others, "id", "left").select("doc_id", "id", "n", F.coalesce("least", "id").alias("least"))
    return full.union(blank).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("least") < _LAST, F.col("least")).alias("component_id"))


def different(docs: DataFrame) -> DataFrame:
    """One row of each component of texts, with the smallest id in it; of rows without words, one for each id.

    A row that stays, and is alone with its id and set, goes out from where it is read; only those that may not be so meet in an exchange.
    """
    marked, sets = _grouped(docs)
    stay = sets.groupBy("component").agg(F.min(F.struct("first", "key")).alias("own")).select(F.col("own.first").alias("id"), "own.key")
    stay = materialize(stay.union(marked.where("n = 0").select("id", "key").distinct()), "gram-kept")
    several = marked.groupBy("id", "key").count().join(stay.withColumn("stays", F.lit(True)), ["id", "key"], "left")
    kept, unsure = Marks(stay), Marks(several.where("stays IS NULL OR count > 1"))
    let_go(docs.sparkSession)
    rows = _rows(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    one = lambda wanted: rows.mapInArrow(_one_each("row", wanted), rows.select("id", F.col("id").alias("key"), "row").schema)
    sure = one(lambda ids, keys: kept.of(ids, keys) & ~unsure.of(ids, keys))
    tried = one(lambda ids, keys: kept.of(ids, keys) & unsure.of(ids, keys)).join(stay.hint("shuffle_hash"), ["id", "key"], "left_semi")
    first = Window.partitionBy("id", "key").orderBy(F.xxhash64("row"))
    return sure.select("row.*").union(tried.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("row.*"))


@query("op5_jaccard_join")
def op5(spark, folder):
    return near(table(spark, folder, "documents"))
