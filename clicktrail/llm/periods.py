"""Periodic runs of words inside documents: seeds on diagonals, extended once per lag and stretch.

A run of length L and smallest period q is a stretch of L - q words on the diagonal of lag q of the document against itself.
With L >= max(24, 3 q) that stretch has 16 words at least, and 2 q.  So lags are taken in octaves up to Q = 16, 32, 64, ...:
every run whose lag lies in (Q / 2, Q] holds a pair of equal Q-grams q apart, and since Q >= q these are *neighbouring*
occurrences of that Q-gram: an occurrence between them would give the run a smaller period.  Neighbouring occurrences of
the same Q-gram are all pairs that have to be enumerated, one per word and octave at most, however often a word repeats.
An octave looks only at places whose grams of the octave before occur twice.
"""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.llm.wordhash import BASE, U, Words, mix, slices
from clicktrail.llm.wordhash import runs as span_hash

#: Words in a run at least, and how many times its period.
LEAST, TIMES = 24, 3
#: The overlap that the shortest run guarantees on its diagonal.
SEED = LEAST - LEAST // TIMES
#: Text that is worked on at once, besides the last row.
BLOCK_BYTES = 2 << 20
COLUMNS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
           "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def seeds(codes: np.ndarray, first: np.ndarray):
    """``(text, lag, place, k)`` arrays per octave: neighbouring occurrences, ``lag`` words apart, of a k-gram at ``place``.

    ``codes`` are the words of all texts as integers, those of text i at ``first[i]:first[i + 1]``.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    values = mix(codes.astype(U) + U(1))
    place, k = np.arange(len(codes)), SEED
    while len(place):
        place = place[place + k <= end[place]]
        grams = mix(span_hash(values, place, place + k) ^ (text[place].astype(U) * U(BASE)))
        order = np.argsort(grams, kind="stable")  # equal grams stay in the order of their places
        same = grams[order[1:]] == grams[order[:-1]]
        here, there = place[order[:-1][same]], place[order[1:][same]]
        lag = there - here
        own = (lag <= k) & (lag > (k // 2 if k > SEED else 0)) & (text[here] == text[there])
        if own.any():
            at = np.lexsort((here[own], lag[own], text[here[own]]))
            yield text[here[own]][at], lag[own][at], here[own][at], k
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        place, k = place[twice], 2 * k


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two equally long arrays are equal; looks in growing steps."""
    at, step = 0, 64
    while at < len(a):
        other = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(other):
            return at + int(other[0])
        at, step = at + step, step * 4
    return len(a)


def extended(codes: np.ndarray, low: int, high: int, place: int, lag: int) -> tuple[int, int]:
    """The stretch of the diagonal ``lag`` around ``place`` in ``codes[low:high]``: first place, and the one after the last."""
    ahead = _equal(codes[place:high - lag], codes[place + lag:high])
    back = _equal(codes[low:place][::-1], codes[low + lag:place + lag][::-1])
    return place - back, place + ahead


def periodic_runs(codes: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Per text with any, its runs ``(start, length, period)``, by start and then period."""
    found: dict[int, list] = {}
    for text, lag, place, k in seeds(codes, first):
        # the table holds for each text and lag how far its diagonal is covered; a seed before that is not extended again
        covered: dict[tuple[int, int], int] = {}
        head = np.ones(len(place), bool)  # a seed right after another of its diagonal lies in the same stretch
        head[1:] = (place[1:] != place[:-1] + 1) | (lag[1:] != lag[:-1]) | (text[1:] != text[:-1])
        for t, q, p in zip(text[head].tolist(), lag[head].tolist(), place[head].tolist()):
            if p < covered.get((t, q), 0):
                continue
            low, high = int(first[t]), int(first[t + 1])
            begin, end = extended(codes, low, high, p, q)
            covered[t, q] = end
            length = end - begin + q
            if length >= max(LEAST, TIMES * q):
                found.setdefault(t, []).append((begin - low, length, q))
    return {t: sorted(r, key=lambda x: (x[0], x[2])) for t, r in found.items()}


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length over period, as a fraction; of equal ones the first by start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def looped(n: int, id_) -> tuple[int, int] | None:
    """``(a, p)`` if the words of this document from a on go round in p words, by the checksum of its id."""
    if id_ is None or n == 0:
        return None
    h = zlib.crc32(str(id_).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _batch(part: pa.RecordBatch, arrange) -> list[pa.Array]:
    """The columns of ``COLUMNS`` for the rows of a batch; ``arrange(n, id)`` may make the words of a document go round."""
    words = Words(part.column("text"), hashed=False)
    source = np.arange(len(words.start))  # which word stands at each place
    for i, id_ in enumerate(part.column("doc_id").to_pylist()):
        low, high = int(words.first[i]), int(words.first[i + 1])
        if loop := arrange(high - low, id_):
            a, p = loop
            source[low + a:high] = low + a + np.arange(high - low - a) % p
    codes = words.strings().dictionary_encode().indices.to_numpy()[source] if len(source) else np.zeros(0, np.int32)
    runs = periodic_runs(codes, words.first)

    kept = np.ones(len(source), bool)
    for t, own in runs.items():
        for start, length, period in own:
            kept[words.first[t] + start + period:words.first[t] + start + length] = False
    counts = np.zeros(len(source) + 1, np.int64)
    np.cumsum(kept, out=counts[1:])
    at = source[kept]
    size = words.end[at] - words.start[at] + 1  # a word and the space behind it
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    data = np.append(words.data, np.uint8(32))
    flat = data[np.minimum(np.repeat(words.start[at], size) + inside, len(words.data))] if len(at) else np.zeros(0, np.uint8)
    flat[ends[1:] - 1] = 32
    flat, bounds = memoryview(np.ascontiguousarray(flat)), ends[counts[words.first]].tolist()

    rows = []
    for t in range(part.num_rows):
        own = runs.get(t, [])
        start, length, period = best(own) if own else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
        rows.append((len(own), start, length, period, 1000 * length // period if own else None, hashlib.sha256(listed.encode()).hexdigest(),
                     hashlib.sha256(flat[bounds[t]:max(bounds[t], bounds[t + 1] - 1)]).hexdigest()))
    return [pa.array(column, kind) for column, kind in zip(zip(*rows), COLUMNS.values())]


def detect(docs: DataFrame, arrange=None) -> DataFrame:
    """``doc_id`` and the columns of ``COLUMNS`` for every row: its runs, the strongest of them, and digests.

    ``arrange(n, doc_id)`` may give ``(a, p)`` to have the words from number a on go round in p words first; without it
    documents are taken as they are.  Runs are of whole texts, whatever their length; a text is worked on in one task.  Null and empty
    texts have no runs: 0, nulls, and digests of nothing.  Null and repeated ids and repeated rows are judged each by itself.  An empty table gives
    an empty result; further columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_batch(part, arrange or (lambda n, id_: None))], ["doc_id", *COLUMNS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(f"{name} {'string' if pa.types.is_string(kind) else 'long'}" for name, kind in COLUMNS.items())
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def spans(docs: DataFrame) -> DataFrame:
    """A row per run of every document: ``doc_id, start, length, period`` in words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=BLOCK_BYTES):
                words = Words(part.column("text"), hashed=False)
                codes = words.strings().dictionary_encode().indices.to_numpy() if len(words.start) else np.zeros(0, np.int32)
                rows = [(t, *r) for t, own in periodic_runs(codes, words.first).items() for r in own]
                of = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pc.take(part.column("doc_id"), of), *columns], ["doc_id", "start", "length", "period"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, period long")


@query("op12_periodic_runs")
def op12(spark, folder):
    return detect(table(spark, folder, "documents"), looped)
