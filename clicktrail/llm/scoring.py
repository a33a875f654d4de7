"""Language-model scores: prediction by partial matching over bytes, and a unigram base over words.

The trie of byte contexts is a table per order, kept by Spark: an entry is a context of ``ORDER`` bytes or fewer and the byte
after it, packed in a long, with its count in the training texts.  Counts of a shorter context are sums over the longer
ones that end in it.  In such a trie the bytes seen after a context were all seen after its suffix too, so which symbols are
excluded after an escape follows from the context alone, and the code length of every entry is a few joins and bounded windows
(``code_lengths``).

Two passes over the texts: the first counts entries and words, per task before anything is sent; the second scores.  Entries and
words that occur often, ``FREQUENT`` of each at most, are broadcast for it.  A document hands the distinct others that it has on, and
they are looked up in joins.  As the others are rare, no join key is hot; as the frequent ones are bounded, nothing that grows
with the corpus is broadcast or held in one task.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.llm.wordhash import U, Words, slices
from clicktrail.spark import materialize

#: Bytes of context.
ORDER = 4
#: Bytes that UTF-8 never has: before the first byte of a text, and after its last.
BEGIN, END = 0xFE, 0xFF
#: Symbols that may follow: all bytes but BEGIN.
SYMBOLS = 255
#: Entries, and words, that every executor gets; an entry is a long and a double.
FREQUENT = 1 << 18
#: Text that is worked on at once, and distinct keys that a task gathers before it sends their counts.
BLOCK_BYTES, MOST_KEYS = 1 << 20, 1 << 18
REST = "array<struct<gram:long,word:binary,n:long>>"


def held_out(id_) -> F.Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def entries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text, gram)`` of every byte of the texts and of each one's end: the ``ORDER`` bytes before it and itself, as an integer."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw, n = texts.buffers()[2], len(texts)
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(n), sizes + 1)
    place = np.arange(len(text)) + (text + 1) * ORDER  # in a row of all texts with ORDER bytes before each and one behind
    row = np.full(len(text) + n * ORDER, BEGIN, np.uint8)
    last = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(text), bool)
    inner[last] = False
    row[place[inner]] = data
    row[place[last]] = END
    eight = np.ndarray(len(row), ">u8", np.append(row, np.zeros(8, np.uint8)), strides=(1,))  # the eight bytes from each place on
    gram = (eight.astype(np.uint64) >> U(8 * (7 - ORDER))).view(np.int64)[place - ORDER]
    return text, gram


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Text and string of every word, lower-cased, and the number of words of each text."""
    found = Words(texts, hashed=False)
    return found.places()[0], found.strings(lower=True).cast(pa.binary()), found.counts.astype(np.int64)


def _counted(keys: pa.Array, train: np.ndarray) -> pa.Table:
    codes = keys.dictionary_encode()
    at, size = codes.indices.to_numpy(), len(codes.dictionary)
    return pa.table({"key": codes.dictionary, "n": np.bincount(at[train], minlength=size).astype(np.int64), "m": np.bincount(at, minlength=size).astype(np.int64)})


def _counts(batches):
    """Distinct entries and words of a task: ``n`` times in rows to learn from, ``m`` times in all.  The end of a text is the empty word."""

    def merged(parts):
        return pa.concat_tables(parts).group_by("key").aggregate([("n", "sum"), ("m", "sum")]).rename_columns(["key", "n", "m"])

    def sent(whole, is_word):
        key, none = whole["key"].combine_chunks(), pa.nulls(len(whole), pa.int64() if is_word else pa.binary())
        return pa.RecordBatch.from_arrays([*([none, key] if is_word else [key, none]), whole["n"].combine_chunks(), whole["m"].combine_chunks()], ["gram", "word", "n", "m"])

    have: dict = {False: [], True: []}
    for batch in batches:
        for part in slices(batch, most=BLOCK_BYTES):
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            text, gram = entries(part.column("text"))
            have[False].append(_counted(pa.array(gram), train[text]))
            of, word, _ = _words(part.column("text"))
            have[True] += [_counted(word, train[of]), pa.table({"key": pa.array([b""], pa.binary()), "n": [int(train.sum())], "m": [len(train)]})]
            for is_word, parts in have.items():
                if sum(map(len, parts)) > 2 * MOST_KEYS:
                    parts[:] = [merged(parts)]
                    pa.default_memory_pool().release_unused()  # a worker keeps what its largest merge took otherwise
                    if len(parts[0]) > MOST_KEYS:
                        yield sent(parts.pop(), is_word)
    for is_word, parts in have.items():
        if parts:
            yield sent(merged(parts), is_word)


def code_lengths(grams: DataFrame) -> DataFrame:
    """``(gram, n, m)`` to ``(gram, m, value)``: log10 of the probability of the last byte after the bytes before it.

    ``n`` may be 0, for entries that only held-out texts have.  From the longest context on, a symbol seen there has
    its share ``n / (T + D)``, T being all counts and D the number of distinct symbols; otherwise the model escapes with ``D / (T + D)``
    to the context that is a byte shorter, where the symbols of the longer one are excluded from counts and distinct symbols alike.
    Behind the empty context the symbols never seen are equally likely.
    """
    levels = [grams.select(F.col("gram").alias("e"), "n", "m")]
    for k in range(ORDER - 1, -1, -1):
        levels.append(materialize(levels[-1].groupBy((F.col("e").bitwiseAND((1 << 8 * (k + 1)) - 1)).alias("e")).agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "trie"))
    below = None
    for k, level in enumerate(reversed(levels)):
        after = Window.partitionBy(F.shiftright("e", 8))  # the symbols after a context, at most SYMBOLS
        if below is None:
            level = level.select("e", "n", "m", *[F.lit(0).cast("long").alias(c) for c in ("n1", "t1", "d1")], F.lit(0.0).alias("b1"))
        else:
            short = F.col("e").bitwiseAND((1 << 8 * k) - 1).alias("e1")
            level = level.withColumn("e1", short).join(below, "e1").drop("e1")
        level = (
            level.withColumn("t", F.sum("n").over(after))
            .withColumn("d", F.sum((F.col("n") > 0).cast("long")).over(after))
            .withColumn("x", F.sum(F.when(F.col("n") > 0, F.col("n1")).otherwise(0)).over(after))
        )
        left, kinds = F.col("t1") - F.col("x"), F.col("d1") - F.col("d")
        if below is None:
            beyond = -F.log10((F.lit(SYMBOLS) - F.col("d")).cast("double"))
        else:
            beyond = (
                F.when(F.col("n1") > 0, F.log10(F.col("n1") / (left + kinds)))
                .when(kinds > 0, F.log10(kinds / (left + kinds)) + F.col("b1")).otherwise(F.col("b1"))
            )
        level = level.select("e", "n", "m", "t", "d", F.when(F.col("n") == 0, beyond).alias("b"))
        below = level.select(*[F.col(c).alias(f"{c}1") for c in ("e", "n", "t", "d", "b")])
    value = (
        F.when(F.col("n") > 0, F.log10(F.col("n") / (F.col("t") + F.col("d"))))
        .when(F.col("d") > 0, F.log10(F.col("d") / (F.col("t") + F.col("d"))) + F.col("b")).otherwise(F.col("b"))
    )
    return level.select(F.col("e").alias("gram"), "m", value.alias("value"))


def frequent(model: DataFrame, most: int) -> DataFrame:
    """``model`` with ``common``: whether a row is among the most frequent ones of its kind, ``most`` of them or fewer.

    Frequencies count in eighths of octaves; the driver gets the size of each.
    """
    level = F.floor(F.log2("m") * 8)
    sizes = model.groupBy(F.col("word").isNotNull().alias("is_word"), level.alias("level")).count().orderBy("is_word", F.desc("level")).collect()
    cut = {}
    for is_word in (False, True):
        total, low = 0, None
        for row in sizes:
            if row["is_word"] == is_word and (total := total + row["count"]) <= most:
                low = row["level"]
        cut[is_word] = F.lit(False) if low is None else level >= low
    return model.withColumn("common", F.when(F.col("word").isNotNull(), cut[True]).otherwise(cut[False]))


def _rest(n: int, parts: list[pa.Table]) -> pa.Array:
    """Per text of a block its keys that are not frequent, with how often it has them: a list of ``(gram, word, n)``."""
    rows = pa.concat_tables(parts)
    rows = rows.take(pc.sort_indices(rows, [("text", "ascending")])).combine_chunks()
    columns = [rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in ("gram", "word", "n")]
    offsets = np.searchsorted(rows["text"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["gram", "word", "n"]))


def _scorer(sent, tokens: int, distinct: int):
    """Scores by the frequent keys, and what is left to look up."""

    def looked_up(text, keys, known: pa.Array, n):
        """Where each key stands among the known ones, which are there, and a row for each other one of a text."""
        at = pc.fill_null(pc.index_in(keys, value_set=known), -1).to_numpy()
        here = at >= 0
        other = pa.table({"text": pa.array(text[~here]), "key": keys.filter(pa.array(~here))})
        return at[here], text[here], other.group_by(["text", "key"]).aggregate([([], "count_all")]).rename_columns(["text", "key", "n"])

    def run(batches):
        grams, lengths, words, counts = sent.value
        base = np.log10((counts + 0.5) / (tokens + 0.5 * (distinct + 1)))
        for batch in batches:
            for part in slices(batch, most=BLOCK_BYTES):
                n = part.num_rows
                text, gram = entries(part.column("text"))
                at, of, rest = looked_up(text, pa.array(gram), grams, n)
                score = np.bincount(of, lengths[at], n).astype(np.float64)  # longs if there is nothing to add
                rest = [pa.table({"text": rest["text"], "gram": rest["key"], "word": pa.nulls(len(rest), pa.binary()), "n": rest["n"]})]
                of, word, sizes = _words(part.column("text"))
                ends = pa.array([b""] * n, pa.binary())
                at, of, more = looked_up(np.concatenate([of, np.arange(n)]), pa.concat_arrays([word, ends]), words, n)
                rest.append(pa.table({"text": more["text"], "gram": pa.nulls(len(more), pa.int64()), "word": more["key"], "n": more["n"]}))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(sizes + 1), pa.array(np.bincount(of, counts[at] > 0, n).astype(np.int64)),
                     pa.array(np.bincount(of, base[at], n).astype(np.float64)), pa.array(score), _rest(n, rest)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Learned from all rows that are not held out; a null id is not held out.  ``score`` is of the UTF-8 bytes of the whole text as it
    stands, and of its end.  Null texts are empty ones; empty texts have one token, the end.  Texts of any length are scored as
    a whole, in one task each.  Repeated rows count and are scored each by itself; equal texts get equal scores.  With nothing to learn from every
    symbol is equally likely and ``base_score`` is 0.  An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    keys = rows.select("text", "held_out").mapInArrow(_counts, "gram long, word binary, n long, m long")
    keys = materialize(keys.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "scoring-keys")
    words = keys.where("word IS NOT NULL")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    tokens, distinct = whole["n"], whole["v"]
    of_grams = code_lengths(keys.where("gram IS NOT NULL")).select("gram", F.lit(None).cast("binary").alias("word"), "m", "value")
    model = frequent(materialize(of_grams.union(words.select("gram", "word", "m", F.col("n").cast("double"))), "scoring-model"), FREQUENT)

    common = model.where("common").select("gram", "word", "value").toArrow()
    kinds = [common.filter(pc.is_valid(common[c])).combine_chunks() for c in ("gram", "word")]
    (grams, lengths), (strings, counts) = [(pa.concat_arrays(k[c].chunks) if k[c].num_chunks else pa.array([], k[c].type), k["value"].to_numpy()) for k, c in zip(kinds, ("gram", "word"))]
    sent = spark.sparkContext.broadcast((grams, lengths, strings, counts))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(sent, tokens, distinct), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest {REST}")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scoring-rows")
    sent.unpersist()

    rest = scored.select("row", F.explode("rest").alias("k")).select("row", "k.gram", "k.word", F.col("k.n").alias("times"))
    rare = model.where(~F.col("common"))
    zero = F.lit(0.0)
    by_gram = rest.where("gram IS NOT NULL").drop("word").join(rare.select("gram", "value"), "gram").select(
        "row", F.lit(0).cast("long").alias("known"), zero.alias("base"), (F.col("value") * F.col("times")).alias("bytes"))
    by_word = rest.where("word IS NOT NULL").drop("gram").join(rare.where("word IS NOT NULL").select("word", "value"), "word").select(
        "row", F.when(F.col("value") > 0, F.col("times")).otherwise(0).alias("known"),
        (F.log10((F.col("value") + 0.5) / F.lit(tokens + 0.5 * (distinct + 1))) * F.col("times")).alias("base"), zero.alias("bytes"))
    more = by_gram.union(by_word).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base", "bytes")])
    of = lambda c, m: F.col(c) + F.coalesce(F.col(m), F.lit(0))
    return scored.drop("rest").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", of("n_known", "known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        F.round(of("base_score", "base"), 9).alias("base_score"), F.round(of("score", "bytes"), 9).alias("score"))


@query("op11_lm_scoring")
def op11(spark, folder):
    return score(table(spark, folder, "documents"))
