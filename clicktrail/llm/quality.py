"""Quality classifier: a factorisation machine over hashed words, structure statistics and length."""

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.llm.wordhash import U, Words, runs, slices

BUCKETS = 1 << 14
RANK = 8
#: Labelled rows that the fit takes at most: those with the lowest hash of their id.
SAMPLE = 12_000
CLASSES = {"symbols": b"#*$%&<>", "pipes": b"|", "bangs": b"!", "capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)),
           "stops": b".,;:?", "beyond_ascii": bytes(range(128, 256))}
DENSE = [*CLASSES, "words", "word_bytes", "line_words", "repeated_lines", "distinct_words", "bytes"]


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(members)] = 1
    return out


_TABLES = {name: _table(members) for name, members in CLASSES.items()}


@dataclass
class Features:
    """Sparse hashed words ``(text, bucket, value)`` and a dense row per text."""

    text: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def features(texts: pa.Array, buckets: int = BUCKETS) -> Features:
    """Everything about the whole texts of a batch, vectorised; null texts count as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    words, n = Words(texts, lower=True), len(texts)
    lengths = np.array(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
    edge = np.concatenate([[0], np.cumsum(lengths)])
    text, _ = words.places()
    pair, count = np.unique(text * buckets + (words.hash % U(buckets)).astype(np.int64), return_counts=True)
    text, bucket = pair // buckets, pair % buckets
    value = 1 + np.log(count)
    value = (value / np.sqrt(np.maximum(np.bincount(text, value**2, n), 1e-9))[text]).astype(np.float32)

    def per_text(lut):
        total = np.zeros(len(words.data) + 1, np.int64)
        np.cumsum(lut[words.data], out=total[1:])
        return np.diff(total[edge])

    n_words, ink = words.counts, np.bincount(np.repeat(np.arange(n), words.counts), words.end - words.start, n)
    stops = np.unique(np.concatenate([edge, np.flatnonzero(words.data == 10) + 1]))
    begin, end = stops[:-1], stops[1:]
    of = np.searchsorted(edge, begin, "right") - 1
    n_lines = np.bincount(of, minlength=n)
    last = end - ((end > begin) & (words.data[end - 1] == 10)) if len(begin) else end
    line = np.unique(np.stack([of.astype(U), runs(words.data.astype(U) + U(1), begin, last)]), axis=1)[0].astype(np.int64) if len(begin) else of
    dense = [per_text(lut) / np.maximum(ink, 1) for lut in _TABLES.values()]
    dense += [np.log1p(n_words), ink / np.maximum(n_words, 1), np.log1p(n_words / np.maximum(n_lines, 1)),
              1 - np.bincount(line, minlength=n) / np.maximum(n_lines, 1), np.bincount(text, minlength=n) / np.maximum(n_words, 1), np.log1p(lengths)]
    return Features(text, bucket, value, np.stack(dense, 1).astype(np.float32))


@dataclass
class Machine:
    """``bias + linear + sum over factors of half of (sum of v x) squared - sum of (v x) squared``, linear in the entries."""

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def entries(self, f: Features):
        """Text, index and value of all entries: words first, then the dense ones scaled as in the fit."""
        n, d = f.dense.shape
        dense = np.clip((f.dense - self.mean) / self.scale, -4, 4)
        words = len(self.weight) - d
        return (np.concatenate([f.text, np.repeat(np.arange(n), d)]), np.concatenate([f.bucket, np.tile(np.arange(words, words + d), n)]),
                np.concatenate([f.value, dense.ravel()]))

    def raw(self, text, index, value, n):
        out = self.bias + np.bincount(text, self.weight[index] * value, n)
        sums = np.empty((n, self.factor.shape[1]), np.float32)
        for k in range(self.factor.shape[1]):
            vx = self.factor[index, k] * value
            sums[:, k] = np.bincount(text, vx, n)
            out += 0.5 * (sums[:, k] ** 2 - np.bincount(text, vx**2, n))
        return out, sums

    def score(self, f: Features) -> np.ndarray:
        text, index, value = self.entries(f)
        return 1 / (1 + np.exp(-np.clip(self.raw(text, index, value, len(f.dense))[0], -30, 30)))


def fit(f: Features, labels: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = 12, batch: int = 128, seed: int = 7) -> Machine:
    """Adagrad on the log loss with a little decay; rows in a seeded order, so equal inputs give equal machines."""
    rng, n, d = np.random.default_rng(seed), len(f.dense), f.dense.shape[1]
    share = np.clip(labels.mean(), 0.01, 0.99)
    m = Machine(f.dense.mean(0), f.dense.std(0) + 1e-3, float(np.log(share / (1 - share))), np.zeros(buckets + d, np.float32),
                rng.normal(0, 0.02, (buckets + d, rank)).astype(np.float32))
    first = np.searchsorted(f.text, np.arange(n + 1))
    gw, gv, gb = np.full(len(m.weight), 1e-2, np.float32), np.full(m.factor.shape, 1e-2, np.float32), 1e-2
    for epoch in range(epochs):
        order, rate = rng.permutation(n), 0.1 / (1 + 0.3 * epoch)
        for at in range(0, n, batch):
            chosen = order[at:at + batch]
            sizes = first[chosen + 1] - first[chosen]
            own = np.arange(sizes.sum()) + np.repeat(first[chosen] - np.cumsum(sizes) + sizes, sizes)
            part = Features(np.repeat(np.arange(len(chosen)), sizes), f.bucket[own].astype(np.int64), f.value[own], f.dense[chosen])
            text, index, value = m.entries(part)
            out, sums = m.raw(text, index, value, len(chosen))
            error = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[chosen]) / len(chosen)).astype(np.float32)
            used, own = np.unique(index, return_inverse=True)
            e = error[text] * value
            w = np.bincount(own, e, len(used)) + 1e-5 * m.weight[used]
            v = np.stack([np.bincount(own, e * (sums[text, k] - m.factor[index, k] * value), len(used)) for k in range(rank)], 1) + 1e-5 * m.factor[used]
            gw[used] += w**2
            gv[used] += v**2
            gb += error.sum() ** 2
            m.weight[used] -= rate * w / np.sqrt(gw[used])
            m.factor[used] -= rate * v / np.sqrt(gv[used])
            m.bias -= float(rate * error.sum() / np.sqrt(gb))
    return m


def _joined(column: pa.ChunkedArray, order: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a binary column, end to end in the given order, and how long each is; without a Python object per row."""
    whole = column.combine_chunks().cast(pa.large_binary()).take(pa.array(order))
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(whole.buffers()[2], kind)[offsets[0] // size:offsets[-1] // size], np.diff(offsets) // size


def held_out(id_) -> F.Column:
    """Rows that the fit never sees."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _made(batches):
    """Labels and features of some texts, the arrays of a text as binaries."""
    for batch in batches:
        for part in slices(batch):
            f = features(part.column("text"))
            ends = np.cumsum(np.bincount(f.text, minlength=part.num_rows))[:-1]
            lists = [[x.tobytes() for x in np.split(a, ends)] for a in (f.bucket.astype(np.int16), f.value)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label").cast(pa.int32()), *[pa.array(x, pa.binary()) for x in (*lists, [r.tobytes() for r in f.dense])]],
                ["doc_id", "label", "bucket", "value", "dense"])


def _fitted(kw: dict):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
        labels = got.column("label").to_numpy()[order].astype(np.float32)
        if len(set(labels.tolist())) == 2:
            bucket, sizes = _joined(got.column("bucket"), order, np.int16)
            dense, _ = _joined(got.column("dense"), order, np.float32)
            value, _ = _joined(got.column("value"), order, np.float32)
            f = Features(np.repeat(np.arange(len(order), dtype=np.int32), sizes), bucket, value, dense.reshape(len(order), -1))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(f, labels, **kw))], pa.binary())], ["machine"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **kw) -> Machine | None:
    """Fit on at most ``sample`` labelled documents outside the held-out third; None where there are none of both kinds.

    The chosen ids, those of lowest hash, are at most ``sample`` rows, so they are broadcast.  Of several rows with an id the text of lowest hash counts.
    Features are made where the texts are; one task gathers them, ``sample`` rows at most, and fits; the driver gets the machine alone.
    """
    chosen = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
        .where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(_made, f"doc_id {kind}, label int, bucket binary, value binary, dense binary")
    got = made.repartition(1).mapInArrow(_fitted(kw), "machine binary").collect()
    return pickle.loads(got[0]["machine"]) if got else None


def score(docs: DataFrame, machine: Machine | None, keep: list[str] | None = None) -> DataFrame:
    """``(row, score)``: the columns ``keep`` (all) of every document as a struct, and its quality between 0 and 1.

    Without a machine all score 1.
    The score comes from the text alone.  Null and empty texts get the score of a text without words.  A text of any
    length is scored as a whole.  Columns of any name stay inside ``row``.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in keep or docs.columns]).alias("row")
    rows = docs.select(row)
    if machine is None:
        return rows.withColumn("score", F.lit(1.0))
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed: buckets times rank

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                got = np.round(sent.value.score(features(part.column("text"))), 9)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(got.astype(np.float64))], ["row", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    return docs.select(row, "text").mapInArrow(run, f"row {kind}, score double")


def judge(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels of unknown ids are ignored, the lowest of several counts."""
    return score(docs, train(docs, labels, **kw), ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_quality_classifier")
def op7(spark, folder):
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
