"""Vector code compression: product codes whose nearest entries are found exactly, in whole numbers, by a Walsh-Hadamard transform.

The transform of a part, padded with zeros to P = 2^m components, has coefficients whose squared differences add up to P times the
squared distance.  Coefficients come in sequency order, so the slow ones, which tell entries apart best, come first; an entry
whose sum so far exceeds the whole distance of another one is out.  All of it is additions and products of longs.
"""

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.spark import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that are compared at once.
BLOCK = 8192


@lru_cache(maxsize=8)
def sequency(size: int) -> np.ndarray:
    """The rows of the Hadamard matrix of a power of two, by their number of sign changes."""
    rows = np.ones((1, 1), np.int8)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1))


def transform(parts: np.ndarray) -> np.ndarray:
    """Coefficients of the rows of ``parts``, padded with zeros, in sequency order; by additions alone."""
    size = 1 << max(0, parts.shape[1] - 1).bit_length()
    out = np.zeros((len(parts), size), np.int64)
    out[:, :parts.shape[1]] = parts
    step = 1
    while step < size:
        pairs = out.reshape(len(parts), -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(parts), size)
        step *= 2
    return out[:, sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, squared distance)`` of the nearest row of ``entries`` for each row of ``parts``; of equally near ones the first."""
    own, other = transform(parts), transform(entries)
    rows, size = np.arange(len(own)), own.shape[1]
    guess = np.abs(own[:, :1] - other[:, 0]).argmin(1)  # by the first coefficient; its whole distance is the bound
    bound = ((own - other[guess]) ** 2).sum(1)
    row, entry = np.repeat(rows, len(other)), np.tile(np.arange(len(other)), len(own))
    total = np.zeros(len(row), np.int64)
    for k in range(size):
        total += (own[row, k] - other[entry, k]) ** 2
        left = total <= bound[row]
        if not left.all():
            row, entry, total = row[left], entry[left], total[left]
    order = np.lexsort((entry, total, row))
    first = order[np.searchsorted(row[order], rows)]
    return entry[first], total[first] // size


def largest(part: int) -> int:
    """The largest component, after scaling, with which all sums of a part stay within a long."""
    size = 1 << max(0, part - 1).bit_length()
    return math.isqrt((1 << 60) // max(1, size * part * PARTS)) // 2


def whole(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """``vec_id, label, v``: rows whose vector has finite components only, each scaled, floored to a long and held within ``largest``."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(good)
    if dimension is None:
        return rows
    most = float(largest(-(-dimension // PARTS)))
    held = lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * SCALE).cast("double"))).cast("long")
    return rows.where(F.size("embedding") == dimension).select("vec_id", "label", F.transform("embedding", held).alias("v"))


def _parts(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """``(PARTS, rows, components)`` of a batch; the last parts are filled up with zeros."""
    width = -(-dimension // PARTS)
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimension)
    out = np.zeros((batch.num_rows, PARTS * width), np.int64)
    out[:, :dimension] = flat
    return out.reshape(batch.num_rows, PARTS, width).transpose(1, 0, 2)


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def refined(rows: DataFrame, books: np.ndarray, dimension: int) -> np.ndarray:
    """The codebooks after one round; every task sends a row per part and entry, the driver gets as many in all."""

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for block in _blocks(batches):
            for part, own in enumerate(_parts(block, dimension)):
                entry, _ = nearest(own, books[part])
                np.add.at(sums[part], entry, own)
                counts[part] += np.bincount(entry, minlength=books.shape[1])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    partial = rows.select("v").mapInArrow(run, "part long, entry long, n long, total array<long>")
    width = books.shape[2]
    whole_ = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])
    out = books.copy()
    for row in whole_.collect():  # at most PARTS * ENTRIES rows
        out[row["part"], row["entry"]] = [int(row[f"s{k}"]) // row["n"] for k in range(width)]
    return out


def coded(rows: DataFrame, books: np.ndarray, dimension: int) -> DataFrame:
    """``vec_id, label, code, error`` of every row."""

    def run(batches):
        for block in _blocks(batches):
            found = [nearest(own, books[part]) for part, own in enumerate(_parts(block, dimension))]
            index = np.stack([f[0] for f in found], 1).astype(np.uint8)
            text, width = index.tobytes().hex(), 2 * PARTS
            code = [text[i * width:(i + 1) * width] for i in range(block.num_rows)]
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), block.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return rows.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def fit(rows: DataFrame, dimension: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(PARTS, entries, components)``: the parts of the vectors of smallest id, refined ``rounds`` times over all rows.

    With fewer vectors than ``entries`` there are fewer entries.
    """
    lead = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()
    books = np.ascontiguousarray(_parts(pa.RecordBatch.from_arrays([lead["v"].combine_chunks()], ["v"]), dimension))
    for _ in range(rounds):
        books = refined(rows, books, dimension)
    return books


def digest(books: np.ndarray, dimension: int) -> str:
    """SHA-256 of all entries by part, entry and position, without the zeros that fill up the last parts."""
    width = books.shape[2]
    numbers = [str(x) for part, book in enumerate(books.tolist()) for entry in book for k, x in enumerate(entry) if part * width + k < dimension]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector with finite components only.

    The number of components is that of the vector of smallest id (null ids last); vectors of other lengths have no code and are
    left out, as are empty ones.  If it is no multiple of ``PARTS``, the last parts are filled up with zeros.  Components are held within ``largest``, so that
    distances are exact longs (32,768 and more before scaling at 64 components).  Equal ids among the first ones go by vector;
    repeated rows are each coded and counted; a null label is a label; an empty table gives an empty result; further columns are ignored.
    """
    first = whole(vectors).where(F.size("embedding") > 0).select("vec_id", F.size("embedding").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").limit(1).collect()
    dimension = first[0]["n"] if first else 1
    rows = materialize(whole(vectors, dimension), "vectors")
    books = fit(rows, dimension)
    done = materialize(coded(rows, books, dimension), "codes")
    label = F.col("label")
    sums = materialize(done.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    own = sums.select(label.alias("of"), "label_error")
    return done.join(own, label.eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books, dimension)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: a table of parts, and a pair of tables per round."""
    d = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v,
            row_number() OVER (ORDER BY vec_id NULLS LAST) AS place FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT place, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x
            FROM kept, range({PARTS}) t(part))""",
        f"b0 AS MATERIALIZED (SELECT part, place - 1 AS entry, x FROM parts WHERE place <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT place, part, x, entry, error FROM (
            SELECT p.place, p.part, p.x, b.entry, {d} AS error, row_number() OVER (PARTITION BY p.place, p.part ORDER BY {d}, b.entry) AS rank
            FROM parts p JOIN b{k} b USING (part)) WHERE rank = 1)""")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
                SELECT part, entry, list(value ORDER BY i) AS x FROM (
                    SELECT part, entry, i, CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS value
                    FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry) m
                ON m.part = b.part AND m.entry = b.entry)""")
    steps.append(f"""own AS (SELECT place, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY place)""")
    steps.append(f"hash AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN own USING (place), hash"""


SQL = _sql()


@query("op13_vector_codes", SQL)
def op13(spark, folder):
    return compress(table(spark, folder, "embeddings"))
