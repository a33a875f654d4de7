"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

1. A string within e edits of an item of L words has in common with it a run of at least (L - e) / (e + 1) words.  Hashes of the
   items' runs of that many words fill a Bloom filter of bounded size, and windows without any of its runs are left out,
   which loses nothing.  What is left of the texts, as hashed words, are the pieces.
2. The benchmark is cut into parts of bounded bytes.  A join of runs tells which part may concern a piece.
3. Parts and pieces meet in groups of bounded size.  There every window as long as some item is embedded and looked up
   among the keys of the items of its length; windows that share a key with an item are compared with it exactly.

``plan`` measures how many keys, of how many sampled coordinates, an item length takes.  No window is compared with an item without a key
in common, whatever the length.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.llm.wordhash import BASE, U, Words, mix, slices
from clicktrail.spark import materialize

#: A window leaks an item if at most this share of the item's words must be edited.
MAX_EDITS = 0.2
#: Sampled coordinates of a key at most; keys per window, at most; the share of items at the full distance to be found, and the
#: trials by which that is measured.
BITS, KEYS, RECALL, TRIALS = 3, 96, 0.99, 128
#: Words in the longest runs that are looked up.
RUN = 4
SLICE_BYTES = 4 << 20
#: Benchmark text in a part; hashed words of pieces in a group; window starts in a piece, at least; bits of the filter, at least and at most.
PART_BYTES, GROUP_BYTES, PIECE, FILTER = 2 << 20, 2 << 20, 1024, (22, 26)
PIECES = "uid long, at long, starts long, words long, hashes binary, runs array<long>"


def edits_of(length: int) -> int:
    return int(MAX_EDITS * length)


def run_of(length: int) -> int:
    """Words in a row, ``RUN`` at most, that a window leaking an item of ``length`` words has in common with it."""
    return min(RUN, -(-(length - edits_of(length)) // (edits_of(length) + 1)))


def coordinates(length: int, seed: int, bits: int = BITS) -> np.ndarray:
    """Steps to sample.  A walk is through its row after about twice its length in steps, so later steps say nothing."""
    return np.random.default_rng([seed, length]).choice(max(1, 2 * length - 1), min(BITS, max(1, 2 * length - 1)), replace=False)[:bits]


def walks(windows: np.ndarray, keys: int, bits: int = BITS) -> np.ndarray:
    """``(bits, keys, rows)``: the words at the sampled coordinates of the CGK embeddings of rows of word hashes.

    A walk emits the word it stands on and then goes on or waits, by a random bit of step and word.  Two rows that walk
    with the same bits fall into step again soon after an edit, so that edits turn into few different coordinates.
    Each key has its own bits and its own coordinates; all its walks take their steps together.
    """
    n, length = windows.shape
    sampled = [coordinates(length, k, bits) for k in range(keys)]
    wanted: dict[int, list] = {}
    for k, steps in enumerate(sampled):
        for b, step in enumerate(steps):
            wanted.setdefault(int(step), []).append((b, k))
    last = 1 + max(wanted)
    odd = np.random.default_rng(1).integers(0, 1 << 63, (2 * length, KEYS), np.uint64)[:last, :keys] * U(2) + U(1)
    padded = np.concatenate([windows, np.zeros((n, 1), U)], 1)
    at, rows, out = np.zeros((keys, n), np.int64), np.arange(n), np.zeros((bits, keys, n), U)
    for step in range(last):
        word = padded[rows, at]
        for b, k in wanted.get(step, ()):
            out[b, k] = mix(word[k] + U(step + 1))
        at += ((word * odd[step][:, None]) >> U(63)).view(np.int64)  # words are hashes, so one product mixes them with the step
        np.minimum(at, length, out=at)
    return out


def embed(windows: np.ndarray, keys: int, bits: int) -> np.ndarray:
    """``(keys, rows)``: a hash of the sampled coordinates for each key."""
    out = np.zeros((keys, len(windows)), U)
    for words in walks(windows, keys, bits):
        out = mix(out * U(3) ^ words)
    return out


@lru_cache(maxsize=None)
def plan(length: int) -> tuple[int, int]:
    """``(bits, keys)`` with which ``RECALL`` of the items of ``length`` words are found at the full distance, in trials with random words.

    Half the trials replace words, half remove and insert some.  The most coordinates a key that do with half of ``KEYS``, or else
    one: walks of longer items drift further apart and agree in fewer places.
    """
    most = edits_of(length)
    if not most:
        return BITS, 1
    rng = np.random.default_rng([7, length])
    rows = rng.integers(0, 1 << 63, (TRIALS, length), np.uint64) * U(2) + U(1)
    shifted, replaced = rows.copy(), rows.copy()
    for row, moved, other in zip(rows, shifted, replaced):
        other[rng.choice(length, most, replace=False)] = rng.integers(0, 1 << 63, most, np.uint64) * U(2)
        left = np.delete(row, rng.choice(length, most // 2, replace=False))
        moved[:] = np.insert(left, rng.integers(0, len(left) + 1, most // 2), rng.integers(0, 1 << 63, most // 2, np.uint64) * U(2))
    own = walks(rows, KEYS)
    same = [own == walks(x, KEYS) for x in (shifted, replaced)]
    for bits in range(BITS, 0, -1):
        found = np.minimum(*(np.logical_or.accumulate(x[:bits].all(0)).mean(1) for x in same))
        enough = np.flatnonzero(found >= RECALL)
        if len(enough) and (bits == 1 or enough[0] < KEYS // 2):
            return bits, int(enough[0]) + 1
    return 1, KEYS


def planned(length: int) -> int:
    """The length whose plan holds for ``length``: rounded up to eight per octave, so few are tried."""
    step = max(1, (1 << max(0, length.bit_length() - 1)) // 8)
    return -(-length // step) * step


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance between the rows of two equally tall arrays of word hashes."""
    n, width = a.shape[0], b.shape[1]
    row = np.tile(np.arange(width + 1, dtype=np.int32), (n, 1))
    steps = np.arange(width + 1, dtype=np.int32)
    for i in range(a.shape[1]):
        best = np.empty_like(row)
        best[:, 0] = i + 1
        best[:, 1:] = np.minimum(row[:, :-1] + (a[:, i, None] != b), row[:, 1:] + 1)
        row = np.minimum.accumulate(best - steps, axis=1) + steps  # insertions
    return row[:, -1]



def run_hashes(hashes: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every run of ``size`` words that stays within its text; ``ends``: where the text of each word ends."""
    place = np.flatnonzero(np.arange(len(hashes)) + size <= ends)
    out = np.full(len(place), size, U)
    for k in range(size):
        out = out * U(BASE) + hashes[place + k]
    return place, mix(out)


def _ends(first: np.ndarray) -> np.ndarray:
    return np.repeat(first[1:], np.diff(first))


def prepared(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, words, hashes, runs`` of every item with words: a number of its own, its hashed words, and those of its runs."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                words = Words(part.column("text"), lower=True)
                split = [words.hash[a:b] for a, b in zip(words.first, words.first[1:])]
                runs = [np.unique(run_hashes(h, np.full(len(h), len(h)), run_of(len(h)))[1]).view(np.int64) if len(h) else [] for h in split]
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id"), pa.array(words.counts.astype(np.int64)), pa.array([h.tobytes() for h in split], pa.binary()), pa.array(runs, pa.list_(pa.int64()))],
                    ["item_id", "words", "hashes", "runs"])

    made = rows.mapInArrow(run, f"item_id {kind}, words long, hashes binary, runs array<long>").where("words > 0")
    return materialize(made.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")


def bloom(runs: DataFrame, total: int) -> np.ndarray:
    """A Bloom filter over the column ``run``, two bits each, as 64-bit words; its size follows ``total`` within ``FILTER``."""
    bits = min(FILTER[1], max(FILTER[0], (32 * total).bit_length()))
    mask = (1 << bits) - 1
    place = F.explode(F.array(F.col("run").bitwiseAND(mask), F.shiftrightunsigned("run", 32).bitwiseAND(mask)))
    words = (
        runs.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("set")).collect()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for row in words:  # at most 2 ** (FILTER[1] - 6)
        out[row["word"]] = row["set"]
    return out.view(U)


def _in(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = U(len(filter_) * 64 - 1)
    has = lambda h: (filter_[(h >> U(6)).astype(np.int64)] >> (h & U(63))) & U(1) == 1
    out = has(hashes & mask)
    out[out] = has((hashes[out] >> U(32)) & mask)
    return out


def _cutter(sent, sizes: list[int], longest: int):
    """The pieces of texts: all window starts with a run of the filter in reach, and the words of their windows."""

    def run(batches):
        filter_, uid = sent.value, TaskContext.get().partitionId() << 33
        block = max(PIECE, longest)
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                words = Words(part.column("text"), lower=True)
                ends, n = _ends(words.first), len(words.hash)
                hits, hashes = [], []
                for size in sizes:
                    place, runs = run_hashes(words.hash, ends, size)
                    own = _in(filter_, runs)
                    hits.append(place[own])
                    hashes.append(runs[own])
                hits, hashes = np.concatenate(hits), np.concatenate(hashes)
                order = np.argsort(hits, kind="stable")
                hits, hashes = hits[order], hashes[order]
                text = np.searchsorted(words.first, hits, "right") - 1
                change = np.zeros(n + 1, np.int32)
                np.add.at(change, np.maximum(hits - longest + 1, words.first[text]), 1)
                np.add.at(change, hits + 1, -1)
                start = np.cumsum(change[:n]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], start.view(np.int8), [0]])))
                rows, columns = [], [[], [], [], [], [], []]
                for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    while low < high:
                        t = int(np.searchsorted(words.first, low, "right")) - 1
                        first, end = int(words.first[t]), int(words.first[t + 1])
                        upto = min(high, low + block, end)
                        stop = min(end, upto + longest)
                        own = hashes[np.searchsorted(hits, low):np.searchsorted(hits, stop)]
                        rows.append(t)
                        for column, value in zip(columns, (uid + t, low - first, upto - low, end - first, words.hash[low:stop].tobytes(), np.unique(own).view(np.int64))):
                            column.append(value)
                        low = upto
                uid += part.num_rows
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row").take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["row", "uid", "at", "starts", "words", "hashes", "runs"])

    return run


class Items:
    """The items of a part: their runs with the lengths that have them, and per length the rows and the LSH keys."""

    def __init__(self, numbers: np.ndarray, rows: list[np.ndarray], plans: dict[int, tuple[int, int]]):
        self.lengths = np.unique([len(r) for r in rows])
        self.groups, runs, of = [], [], []
        for place, length in enumerate(self.lengths.tolist()):
            own = [i for i, r in enumerate(rows) if len(r) == length]
            stacked = np.stack([rows[i] for i in own])
            flat, size = stacked.ravel(), run_of(length)
            found = np.unique(run_hashes(flat, np.repeat(np.arange(1, len(own) + 1) * length, length), size)[1])
            runs.append(found)
            of.append(np.full(len(found), place))
            bits, keys = plans[planned(length)]
            tables = []
            for hashes in embed(stacked, keys, bits):
                order = np.argsort(hashes, kind="stable")
                tables.append((hashes[order], order))
            self.groups.append((length, size, bits, numbers[own], stacked, tables))
        runs, of = np.concatenate(runs), np.concatenate(of)
        order = np.argsort(runs, kind="stable")
        self.runs, self.of = runs[order], of[order]

    def matches(self, hashes: np.ndarray, first: np.ndarray, at: np.ndarray, starts: np.ndarray, words: np.ndarray):
        """``(piece, item, place, edits)`` of windows that share a key with an item and are near enough.

        ``hashes[first[i]:first[i + 1]]`` are the words of piece i, which begins at word ``at`` of a text of ``words`` words and
        has ``starts`` window starts.
        """
        ends, n, out = _ends(first), len(hashes), []
        piece = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.arange(n) - first[piece] < starts[piece]
        begins = (np.arange(n) == first[piece]) & (at[piece] == 0)  # a text that is a little shorter than the item is one window
        hits, lengths = [], []
        for size in sorted({size for _, size, *_ in self.groups}):
            place, runs = run_hashes(hashes, ends, size)
            low, high = np.searchsorted(self.runs, runs, "left"), np.searchsorted(self.runs, runs, "right")
            many = high - low
            hits.append(np.repeat(place, many))
            lengths.append(self.of[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
        hits, lengths = np.concatenate(hits), np.concatenate(lengths)
        for k in np.unique(lengths).tolist():
            length, size, bits, numbers, rows, tables = self.groups[k]
            most = edits_of(length)
            total = np.zeros(n + length + 1, np.int64)
            total[1:n + 1] = np.cumsum(np.bincount(hits[lengths == k], minlength=n))
            total[n + 1:] = total[n]
            # each edit spoils as many runs as a run has words; a run of the next piece does no harm here
            enough = total[length - size + 1:length - size + 1 + n] - total[:n] >= max(1, length - size + 1 - size * most)
            whole = np.arange(n) + length <= ends
            short = begins & (words[piece] >= length - most)
            start = np.flatnonzero(enough & inside & (whole | short))
            for block in np.array_split(start, max(1, len(start) * length >> 20)):
                if len(block):
                    out += self._near(hashes, ends, block, piece, length, most, bits, numbers, rows, tables, at, first)
        return out

    @staticmethod
    def _near(hashes, ends, start, piece, length, most, bits, numbers, rows, tables, at, first):
        place = start[:, None] + np.arange(length)
        own = place < ends[start][:, None]
        windows = np.where(own, hashes[np.minimum(place, len(hashes) - 1)], U(0))
        pairs = []
        for got, (known, order) in zip(embed(windows, len(tables), bits), tables):
            low, high = np.searchsorted(known, got, "left"), np.searchsorted(known, got, "right")
            hit = np.flatnonzero(high > low)
            many = (high - low)[hit]
            item = order[np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            pairs.append(np.repeat(hit, many) * len(rows) + item)
        pairs, out = np.unique(np.concatenate(pairs)), []
        for part in np.array_split(pairs, max(1, len(pairs) * length >> 21)):
            w, item = part // len(rows), part % len(rows)
            distance = edit_distances(rows[item], windows[w])
            # padding at the end costs a substitution each; a shorter text is compared without it
            missing = (~own[w]).sum(1)
            for k in np.flatnonzero(missing):
                distance[k] = edit_distances(rows[item[k]][None], windows[w[k]][None, :length - missing[k]])[0]
            for k in np.flatnonzero(distance <= most):
                p = int(piece[start[w[k]]])
                out.append((p, int(numbers[item[k]]), int(at[p] + start[w[k]] - first[p]), int(distance[k])))
        return out


def _matcher(plans):
    def run(items: pa.Table, pieces: pa.Table) -> pa.Table:
        rows = []
        if len(items) and len(pieces):
            hashed = lambda t: [np.frombuffer(h.as_py(), U) for h in t["hashes"]]
            built = Items(items["item"].to_numpy(), hashed(items), plans)
            own = hashed(pieces)
            first = np.concatenate([[0], np.cumsum([len(h) for h in own])])
            found = built.matches(np.concatenate(own), first, *(pieces[c].to_numpy() for c in ("at", "starts", "words")))
            best: dict = {}
            for piece, item, at, edits in found:
                key = (piece, item)
                if key not in best or (edits, at) < best[key]:
                    best[key] = (edits, at)
            rows = [(p, i, at, edits) for (p, i), (edits, at) in best.items()]
        column = lambda k: pa.array([r[k] for r in rows], pa.int64())
        return pa.table([pieces["piece"].take(column(0)) if rows else column(0), column(1), column(2), column(3)], ["piece", "item", "at", "edits"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``row, item_id, at, edits`` for each document and item that it leaks: the columns ``keep`` (all), and the nearest window.

    Words are runs of characters between ASCII white space, A-Z lower-cased.  A document leaks an item if one of its
    windows of as many words as the item has is within ``MAX_EDITS`` of it, by words inserted, removed and replaced.  A
    document with fewer words than the item is one window.  Of windows equally near the first counts.

    Null and empty texts and items leak nothing; texts of any length are searched as a whole; repeated rows are judged each; equal items are all
    named; empty tables are fine.  Neither texts nor benchmark are gathered or sent whole: the executors get the Bloom filter, 8 MB at most,
    and groups of at most ``part_bytes`` of benchmark and some ``GROUP_BYTES`` of pieces, or one piece.
    """
    spark = docs.sparkSession
    record = F.struct(*[docs[f"`{c}`"] for c in keep or docs.columns]).alias("row")
    rows = docs.select(record, "text")
    items = prepared(benchmark)
    stated = items.groupBy("words").agg(F.count("*").alias("n"), F.sum(F.size("runs")).alias("runs")).collect()  # a row per length
    lengths = [r["words"] for r in stated] or [1]
    plans = {k: plan(k) for k in {planned(n) for n in lengths}}
    parts = max(1, -(-8 * sum(r["words"] * r["n"] for r in stated) // part_bytes))
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")
    runs = items.select(part, F.explode("runs").alias("run")).distinct()

    sent = spark.sparkContext.broadcast(bloom(runs, sum(r["runs"] for r in stated)))
    kind = rows.schema["row"].dataType.simpleString()
    pieces = rows.mapInArrow(_cutter(sent, sorted({run_of(n) for n in lengths}), max(lengths)), f"row {kind}, {PIECES}")
    pieces = materialize(pieces.withColumn("piece", F.monotonically_increasing_id()), "benchmark-pieces")
    sent.unpersist()

    routes = pieces.select("piece", F.octet_length("hashes").alias("bytes"), F.explode("runs").alias("run")).join(runs, "run")
    routes = materialize(routes.select("piece", "bytes", "part").distinct(), "benchmark-routes")
    groups = routes.groupBy("part").agg(F.ceil(F.sum("bytes") / GROUP_BYTES).alias("salts"))
    groups = materialize(groups, "benchmark-groups")
    there = routes.join(groups, "part").select("piece", "part", F.pmod(F.xxhash64("piece"), "salts").alias("salt"))
    there = pieces.select("piece", "at", "starts", "words", "hashes").join(there, "piece")
    here = items.select("item", "hashes", part).join(groups, "part").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    met = here.select("part", "salt", "item", "hashes").groupBy("part", "salt").cogroup(there.groupBy("part", "salt")).applyInArrow(
        _matcher(plans), "piece long, item long, at long, edits long")

    named = met.join(pieces.select("piece", "uid", "row"), "piece")
    nearest = named.groupBy("uid", "item").agg(F.min(F.struct("edits", "at")).alias("best"), F.first("row").alias("row"))
    return nearest.join(items.select("item", "item_id"), "item").select("row", "item_id", F.col("best.at").alias("at"), F.col("best.edits").cast("int").alias("edits"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks."""
    return scan(docs, benchmark, ["doc_id"]).select("row.doc_id", "item_id", "at", "edits")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak nothing; rows are numbered and written first, so each is judged by itself."""
    record = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("record")
    rows = materialize(docs.select(record, F.monotonically_increasing_id().alias("own")), "benchmark-rows")
    bad = materialize(scan(rows.select("own", "record.text"), benchmark, ["own"]).select("row.own").distinct(), "benchmark-leaks")
    return rows.join(bad, "own", "left_anti").select("record.*")


@query("op9_decontamination")
def op9(spark, folder):
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
