"""Remove passages that repeat an earlier document, found by anchors at the positions of a difference cover."""

import hashlib
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.llm.wordhash import U, Words, mix, runs, slices
from clicktrail.spark import materialize

WINDOW = 50
#: Anchors stand at the places of a text that are in the cover modulo the period.
PERIOD = 31
#: Anchors or windows that a task holds to settle repeats among them before the shuffle.
HELD = 1_500_000
_LAST = (1 << 63) - 1


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A small set of residues whose differences give every residue: greedy, then without what is not needed."""
    best: tuple[int, ...] = ()

    def grow(chosen, missing, limit):
        nonlocal best
        if not missing:
            best = chosen
            return True
        if len(chosen) == limit or len(missing) > sum(2 * len(chosen) + 2 * k for k in range(limit - len(chosen))):
            return False
        target = min(missing)
        options = {(c + s * target) % period for c, s in product(chosen, (1, -1))} | set(range(period))
        for x in sorted(options - set(chosen)):
            gained = {(x - c) % period for c in chosen} | {(c - x) % period for c in chosen}
            if grow((*chosen, x), missing - gained, limit):
                return True
        return False

    limit = 1
    while not grow((0,), frozenset(range(1, period)), limit):
        limit += 1
    return tuple(sorted(best))


def _rows(names, arrays):
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def _settle(key: np.ndarray, second: np.ndarray | None, id_: np.ndarray):
    """Order by key, then id; the first of each key, the lowest id of its key and whether the key has several ids."""
    order = np.lexsort((id_, key) if second is None else (id_, second, key))
    k, i = key[order], id_[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if second is not None:
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low, high = i[at], i[np.append(at[1:], len(i)) - 1] if len(i) else i
    return order, new, low[group] if len(i) else i, (low != high)[group] if len(i) else new


def _anchor_rows(window: int, period: int):
    """(key, id, copy, pos, sure): anchors of texts.

    Among the anchors that a task holds, a key with several documents is known to be shared.  All its rows but one
    are sure at once and travel under a key of their own; one row goes on for the other tasks.
    """
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    width = window - period + 1

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                text, place = words.places()
                n = words.counts[text]
                at = np.flatnonzero(cover[place % period] & (place + width <= n) & (n >= window))
                if len(at):
                    ids, copies = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "copy"))
                    held.append((runs(words.hash, at, at + width).view(np.int64), ids[text[at]], copies[text[at]], place[at].astype(np.int32)))
                    size += len(at)
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def send(held):
        key, id_, copy, pos = (np.concatenate(x) for x in zip(*held))
        order, new, _, shared = _settle(key, None, id_)
        key, id_, copy, pos = (x[order] for x in (key, id_, copy, pos))
        sure = shared & ~new
        own = mix((id_ ^ copy).view(U) * U(0x9E3779B97F4A7C15) + pos.astype(U)).view(np.int64)
        # the row that goes on for the others is marked for itself as well
        again = shared & new
        out = [np.concatenate([np.where(sure, own, key), own[again]])]
        out += [np.concatenate([x, x[again]]) for x in (id_, copy, pos)]
        return _rows(["key", "id", "copy", "pos", "sure"], [*out, np.concatenate([sure, np.ones(again.sum(), bool)])])

    return run


def _window_rows(window: int, period: int):
    """(key, second, id, copy, pos, sure): the windows that contain a shared anchor, under a 128-bit hash.

    Among the windows that a task holds, all but those of the lowest id are known to repeat; one row per hash goes on.
    """
    reach = period  # an anchor at q lies in the windows that start at q - period + 1 .. q

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                ids, copies = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "copy"))
                for i, marks in enumerate(part.column("marks")):
                    n = words.counts[i] - window + 1
                    if n <= 0:
                        continue
                    step = np.zeros(n + 1, np.int32)
                    q = np.unique(marks.values.to_numpy())
                    np.add.at(step, np.maximum(q - reach + 1, 0).clip(max=n), 1)
                    np.add.at(step, (q + 1).clip(max=n), -1)
                    pos = np.flatnonzero(np.cumsum(step[:n]) > 0)
                    if len(pos):
                        own = words.hash[words.first[i]:words.first[i + 1]]
                        held.append((runs(own, pos, pos + window).view(np.int64), runs(mix(own ^ U(0x5851F42D4C957F2D)), pos, pos + window).view(np.int64),
                                     np.full(len(pos), ids[i]), np.full(len(pos), copies[i]), pos.astype(np.int32)))
                        size += len(pos)
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def send(held):
        key, second, id_, copy, pos = (np.concatenate(x) for x in zip(*held))
        order, new, low, _ = _settle(key, second, id_)
        key, second, id_, copy, pos = (x[order] for x in (key, second, id_, copy, pos))
        sure = id_ > low
        go = sure | new | (id_ == low)
        key = np.where(sure, mix((id_ ^ copy).view(U) * U(0x9E3779B97F4A7C15) + pos.astype(U)).view(np.int64), key)
        return _rows(["key", "second", "id", "copy", "pos", "sure"], [x[go] for x in (key, second, id_, copy, pos, sure)])

    return run


def _kept_rows(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, whole, marks in zip(*(batch.column(c) for c in ("text", "repeats", "marks"))):
                words = (text.as_py() or "").encode().split()
                n, gone = len(words), None
                if whole.as_py() and n >= window:
                    kept = []
                elif marks.is_valid:
                    pos = np.unique(marks.values.to_numpy())
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, pos, 1)
                    np.add.at(step, pos + window, -1)
                    gone = np.cumsum(step[:n]) > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    kept = words
                joined = b" ".join(kept)
                out.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))] if out else []
            if out:
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns][: 5 if with_text else 4], names[: 5 if with_text else 4])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the text that stays) of every document.

    A word goes if a window of ``window`` words around it also starts in a document with a smaller id.

    1. Equal texts: all but the lowest id repeat it as a whole, and only that one goes on.
    2. Runs of ``window - period + 1`` words are hashed at the places of a difference cover modulo ``period``.  Whatever
       the shift between two equal windows, some place of the cover meets another one, so they share an anchor.
    3. Where an anchor is shared, the match is extended: the windows around it are hashed in full (128 bits) and
       compared by the lowest id.
    Tasks settle repeats among what they hold before each shuffle, so a passage in every document sends a row per
    task, not per document.  Texts are shuffled once, by id and text, and that exchange is reused; marks are gathered per text, so
    any share of the rows may have no id or the same one.

    Null texts have no words.  A null id counts as the highest; an id of 2^63 - 1 is taken for a null one.  Rows with the same id never remove from each other.
    Texts under ``window`` words stay whole.  An empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), text.alias("text"),
    )
    own = hashed.select("id", "h1", "h2").distinct()
    lowest = own.groupBy("h1", "h2").agg(F.min("id").alias("lowest"))
    named = own.join(lowest, ["h1", "h2"]).groupBy("id", F.col("h1").alias("copy")).agg(F.every(F.col("lowest") < F.col("id")).alias("repeats"))
    named = materialize(named, "substring-versions")
    # by id and text alone, so that the exchange of the texts serves all joins with them
    rows = hashed.select("id", F.col("h1").alias("copy"), "text").join(named.hint("shuffle_hash"), ["id", "copy"]).select("id", "copy", "repeats", "text")

    fields = "id long, copy long, pos int, sure boolean"
    by_key = Window.partitionBy("key")
    anchors = rows.where("NOT repeats").select("id", "copy", "text").mapInArrow(_anchor_rows(window, period), f"key long, {fields}")
    shared = anchors.withColumn("several", F.min("id").over(by_key) < F.max("id").over(by_key)).where("sure OR several")
    per_text = lambda df: df.groupBy("id", "copy").agg(F.collect_list("pos").alias("marks")).hint("shuffle_hash")

    around = rows.where("NOT repeats").join(per_text(shared), ["id", "copy"]).select("id", "copy", "text", "marks")
    windows = around.mapInArrow(_window_rows(window, period), f"key long, second long, {fields}")
    covered = windows.withColumn("low", F.min("id").over(Window.partitionBy("key", "second"))).where("sure OR id > low")

    final = rows.join(per_text(covered), ["id", "copy"], "left").select("id", "repeats", "text", "marks")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return final.mapInArrow(_kept_rows(window, with_text), schema).withColumn("doc_id", F.when(F.col("doc_id") < _LAST, F.col("doc_id")))


@query("op3_substring_dedup")
def op3(spark, folder):
    return deduplicate(table(spark, folder, "documents"))
