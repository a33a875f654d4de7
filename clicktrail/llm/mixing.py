"""Mix sources to target weights along a low-discrepancy schedule."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.llm.common import WORD, query, table
from clicktrail.spark import materialize

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: The schedule has 2 ** BITS slots, whatever the size of the corpus.  A source of FEW slots or more is off its target by a
#: slot at most; a smaller one takes its target to the word, in blocks of its own size that share slots with other sources.
BITS, FEW = 18, 64
#: Rows that one running sum takes; a source gets as many buckets as it needs for that.
BUCKET_ROWS = 2_000


def sizes(docs: DataFrame, own=None) -> DataFrame:
    """Id, source and number of words of each document, in a shuffled order that repeats: the md5 of the id, or of the text's hash.

    ``own`` is a column that tells rows apart, for those who join the result with them; null without.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text")))
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(name.cast("binary")).alias("key"), (F.lit(None) if own is None else own).cast("long").alias("own"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """A row per source: number, size, target, its range of schedule slots, and its blocks.

    Block b of a source holds its words from ``b * block_words / block_count`` on.  A source of fewer than ``FEW`` slots has a
    block in every slot that its part of the cumulative targets touches, one at least.

    Sources count by code point, null last, and weigh ``weights`` in turn.  A target stops at ``repeats`` times the
    size of its source; what is over is shared again by weight.  The level at which that ends follows from
    one pass over the sources in the order in which they reach their stops.
    """
    n = len(weights)
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % n + 1).cast("int"))
    fills = Window.orderBy("stop_level", "number").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    slots_to = lambda at: F.coalesce(at.cast("double") / F.when(F.col("whole") > 0, F.col("whole").cast("double")) * 2**BITS, F.lit(0.0))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(by_name))
        .withColumn("weight", weigh)
        .withColumn("words", F.sum("source_size").over(all_rows))
        .withColumn("stop", (F.col("source_size") * repeats).cast("double"))
        .withColumn("stop_level", F.col("stop") / F.col("weight"))
        # the level if all sources before this one stop and this and all later ones do not
        .withColumn("level", (F.col("words") - F.coalesce(F.sum("stop").over(fills), F.lit(0.0)))
                    / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(fills), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("stop_level"), F.col("level"))).over(all_rows))
        .withColumn("target", F.round(F.least("stop", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))), 6))
        .withColumn("exact", F.col("target").cast("decimal(28,6)"))
        .withColumn("through", F.sum("exact").over(upto))
        .withColumn("whole", F.sum("exact").over(all_rows))
        .withColumn("from", slots_to(F.col("through") - F.col("exact")))
        .withColumn("to", slots_to(F.col("through")))
        .withColumn("few", (F.col("exact") > 0) & (F.col("exact").cast("double") * 2**BITS < FEW * F.col("whole").cast("double")))
        .withColumn("first_point", F.when(F.col("few"), F.least(F.floor("from"), F.lit(2**BITS - 1))).otherwise(F.ceil("from")))
        .withColumn("end_point", F.when(F.col("few"), F.greatest(F.ceil("to"), F.col("first_point") + 1)).otherwise(F.ceil("to")))
        .withColumn("blocks", F.col("end_point") - F.col("first_point"))
        .select(
            "source", "number", "source_size", "target", "first_point", "end_point", "blocks",
            F.when(F.col("few"), F.greatest(F.round("target").cast("long"), F.lit(1))).otherwise(F.greatest("words", F.lit(1))).alias("block_words"),
            F.when(F.col("few"), F.col("blocks")).otherwise(F.lit(2**BITS)).alias("block_count"),
        )
    )


def schedule(goals: DataFrame) -> DataFrame:
    """``(slot, number, rank)``: which source each slot draws from, and the how-manieth slot of its source it is.

    Slot k stands at the van der Corput point of k, its ``BITS`` bits in reverse.  Those points are the multiples of
    2 ** -BITS, so a source takes the slots whose points lie in its part of the cumulative targets, and
    reversing the bits of these points gives the slots back; no range join is needed.  A slot has a row for the source that
    its point lies in and for each small source that touches it.
    """
    point = F.explode(F.sequence("first_point", F.col("end_point") - 1))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), BITS, "0")), 2, 10).cast("long")
    return (
        goals.where("blocks > 0").select("number", point.alias("point"))
        .select(slot.alias("slot"), "number")
        .withColumn("rank", (F.row_number().over(Window.partitionBy("number").orderBy("slot")) - 1).cast("long"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, own=None) -> tuple[DataFrame, DataFrame]:
    """The mix as ``(slots, pieces)``.

    Each source is a stream of words: its documents in shuffled order, ``repeats`` times over, cut into blocks of
    ``words / 2 ** BITS`` words, or those of its own size if it is small.  The r-th slot of a source takes its r-th block.
    ``slots`` is the schedule; ``pieces`` has a row for each document, turn and block: ``number, block, turn, words``, and a row without a block for a turn that
    the mix does not reach.  Joining both on source number and rank gives the training order.

    Positions come from per-bucket totals, so a source of any size is summed in parallel.  Null or empty
    texts have size 0 and are never taken; a null source is a source; repeated rows count each by itself; empty
    tables give empty results.  Reruns agree: everything depends on ids and sizes alone.
    """
    sized = materialize(sizes(docs, own), "mix-sizes")
    buckets = max(1, sized.count() // BUCKET_ROWS)
    goals = materialize(targets(sized, weights, repeats), "mix-targets")

    bucket = F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), F.lit(buckets))
    named = sized.join(
        goals.select(F.col("source").alias("of"), "number", "source_size", "target", "blocks", "block_words", "block_count"),
        F.col("source").eqNullSafe(F.col("of")),
    ).withColumn("bucket", bucket)
    sums = (
        named.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
        .withColumn("offset", F.sum("n").over(Window.partitionBy("number").orderBy("bucket")) - F.col("n"))
        .select("number", "bucket", "offset")
    )
    inside = Window.partitionBy("number", "bucket").orderBy("key", "doc_id", "size", "own")
    placed = (
        named.withColumn("row", F.row_number().over(inside))
        .withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(sums, ["number", "bucket"])
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("start", F.col("turn") * F.col("source_size") + F.col("offset") + F.col("inside"))
        .withColumn("end", F.col("start") + F.col("size"))
    )
    # block b holds words b * block_words div block_count up to, not including, (b + 1) * block_words div block_count
    block_of = lambda at: F.expr(f"CAST((CAST({at} AS DECIMAL(38,0)) * block_count + block_count - 1) DIV block_words AS BIGINT)")
    cut = lambda b: F.expr(f"CAST(CAST({b} AS DECIMAL(38,0)) * block_words DIV block_count AS BIGINT)")
    low = F.greatest(block_of("start") - 1, F.lit(0))
    high = F.least(block_of("`end`"), F.col("blocks") - 1)
    pieces = (
        placed.withColumn("block", F.explode_outer(F.when((F.col("size") > 0) & (F.col("blocks") > 0) & (low <= high), F.sequence(low, high))))
        .withColumn("words", F.greatest(F.lit(0), F.least("end", cut("(block + 1)")) - F.greatest("start", cut("block"))))
        .select("doc_id", "own", "size", "source", "source_size", "target", "number", "bucket", "row", "turn", "start", "block", "words")
    )
    return schedule(goals), pieces


def taken(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, own=None) -> DataFrame:
    """A row per document: how many of its words the mix takes, repeats counted, and in how many turns most of it."""
    slots, pieces = mix(docs, weights, repeats, own)
    joined = pieces.join(slots, (pieces["number"] == slots["number"]) & (pieces["block"] == slots["rank"]), "left")
    used = F.when(F.col("slot").isNotNull(), pieces["words"])
    turns = (
        joined.groupBy("doc_id", "own", "size", "source_size", "target", pieces["number"], "bucket", "row", "turn")
        .agg(F.coalesce(F.sum(used), F.lit(0)).alias("taken"))
    )
    return (
        turns.groupBy("doc_id", "own", "size", "source_size", "target", "number", "bucket", "row")
        .agg(F.sum("taken").alias("taken"), F.sum((2 * F.col("taken") > F.col("size")).cast("int")).alias("copies"))
        .drop("number", "bucket", "row")
    )


def mixed(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The documents of the mix, each as often as the mix takes more than half of it in a turn.

    Documents without words cost nothing and stay once.  Rows are numbered and written first, so that rows without an id, or
    with the same one, have each their own count.
    """
    record = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("record")
    rows = materialize(docs.select(record, F.monotonically_increasing_id().alias("own")), "mix-rows")
    slim = rows.select("record.doc_id", "record.source", "record.text", "own")
    counts = taken(slim, weights, repeats, F.col("own")).select("own", F.when(F.col("size") > 0, F.col("copies")).otherwise(1).alias("n")).where("n > 0")
    return rows.join(counts, "own").select("record", F.explode(F.sequence(F.lit(1), F.col("n")))).select("record.*")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s0),
s2 AS (SELECT *, CAST((number - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(sum(source_size) OVER () AS HUGEINT) AS words, CAST(3 * source_size AS DOUBLE) AS stop FROM s1),
s3 AS (SELECT *, stop / weight AS stop_level FROM s2),
s4 AS (SELECT *, (words - coalesce(sum(stop) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level FROM s3
       WINDOW f AS (ORDER BY stop_level, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, max(CASE WHEN level <= stop_level THEN level END) OVER () AS lv FROM s4),
s6 AS (SELECT *, round(least(stop, coalesce(lv * weight, 0)), 6) AS target FROM s5),
s7 AS (SELECT *, sum(CAST(target AS DECIMAL(28,6))) OVER (ORDER BY number) AS through, sum(CAST(target AS DECIMAL(28,6))) OVER () AS whole FROM s6),
s8 AS (SELECT *, CAST(ceil(CAST(through AS DOUBLE) / CAST(whole AS DOUBLE) * {2**BITS}) AS HUGEINT)
               - CAST(ceil(CAST(through - CAST(target AS DECIMAL(28,6)) AS DOUBLE) / CAST(whole AS DOUBLE) * {2**BITS}) AS HUGEINT) AS blocks FROM s7),
n AS (SELECT greatest(1, count(*) // {BUCKET_ROWS}) AS buckets FROM d),
p AS (SELECT d.doc_id, d.size, s8.source_size, s8.target, s8.blocks * s8.words // {2**BITS} AS upto,
             sum(d.size) OVER (PARTITION BY number ORDER BY CAST('0x' || substr(key, 1, 12) AS BIGINT) % n.buckets, key, d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source, n)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, upto - start)) + greatest(0, least(size, upto - start - source_size))
            + greatest(0, least(size, upto - start - 2 * source_size)) AS BIGINT) AS taken
FROM p
"""


@query("op4_mixing", SQL)
def op4(spark, folder):
    return taken(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
