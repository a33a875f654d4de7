"""Secret scan: candidates by pattern, false positives removed by a random forest trained on labelled findings."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.common import let, query, table
from clicktrail.spark import materialize

#: A candidate is a run of at least 16 of these characters with a digit, or of 20 in any case.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
LONG = 20
#: Besides, whatever follows a keyword and an assignment and has at least 6 characters, less quotes and closing punctuation.
ASSIGNED = r"""(?i)(?:pass|passwd|password|pwd|token|secret|api_?key|key|auth)["']?[=:]+["']?([^\s"']{6,})"""
ASSIGNED_BEFORE = r"""(?i)(?:pass|passwd|password|pwd|token|secret|api_?key|key|auth)["']?[\s=:]*[=:]$"""
#: Words of the dictionary: the most frequent short words of the corpus.
DICTIONARY = 120
#: Labelled findings that the fit takes at most: those with the lowest hash.
SAMPLE = 20_000
TREES, DEPTH = 20, 8
KEYWORD = r"(?:pass|passwd|password|pwd|token|secret|api_?key|key|auth)\W*$"

FEATURES = ["length", "digits", "capitals", "small", "others", "hex", "changes", "distinct", "dictionary", "keyword", "assigned",
            "before_length", "previous_length", "next_length", "previous_common", "next_common", "path"]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, source, at, value, before, previous, next`` of every candidate in every whole text.

    ``at`` counts words between ASCII white space; a word may hold several candidates: runs of the pattern, and the value that is
    assigned to a keyword in the word or right before it, whatever its characters.  Null and empty texts have none; texts of any length are
    searched as a whole; null sources are a path of their own; repeated rows are scanned each.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    found = let(words, lambda ws: F.filter(
        F.transform(ws, lambda w, i: F.when(
            (F.length(w) >= 6) & (((F.length(w) >= 16) & w.rlike(CANDIDATE)) | w.rlike(ASSIGNED) | F.get(ws, i - 1).rlike("[=:]$")),
            F.struct(i.alias("at"), w.alias("word"), F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1)).alias("previous"), F.get(ws, i + 1).alias("next")))),
        lambda x: x.isNotNull()))
    each = docs.select("doc_id", "source", F.inline(found))
    runs = F.filter(F.regexp_extract_all("word", F.lit(CANDIDATE), 0), lambda v: v.rlike("[0-9]") | (F.length(v) >= LONG))
    bare = lambda v: F.regexp_replace(v, r"""^["']+|["'.,;:!?)\]}>]+$""", "")
    after = F.when(F.col("word").rlike(ASSIGNED), F.regexp_extract("word", ASSIGNED, 1)).when(F.col("previous").rlike(ASSIGNED_BEFORE), F.col("word"))
    given = F.filter(F.array(bare(after)), lambda v: F.length(v) >= 6)
    each = each.select("*", F.explode(F.array_distinct(F.concat(runs, given))).alias("value"))
    return each.select(
        "doc_id", "source", F.col("at").cast("long").alias("at"), "value", F.expr("substring_index(word, value, 1)").alias("before"),
        "previous", F.coalesce("next", F.lit("")).alias("next"))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to seven letters, counted over all texts; at most ``size``."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\d])\p{L}{3,7}(?![\p{L}\d])"), 0)).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r["word"] for r in top.collect()]


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """Candidates with ``FEATURES``: length, character classes and their changes, dictionary coverage, neighbours, path."""
    v, n = F.col("value"), F.length("value")
    known = "|".join(sorted(words, key=lambda w: (-len(w), w))) or r"(?!)"
    share = lambda chars: (n - F.length(F.translate(v, chars, ""))) / n
    small, capitals, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    classes = F.translate(v, small + capitals + digits, "a" * 26 + "A" * 26 + "0" * 10)
    context = F.lower(F.concat(F.col("previous"), F.lit(" "), F.col("before")))
    common = lambda text: F.lower(F.regexp_extract(text, r"\p{L}+(?=\W*$)", 0)).isin(words or [""]).cast("double")
    columns = {
        "length": n, "digits": share(digits), "capitals": share(capitals), "small": share(small), "others": share("+/_-="),
        "hex": share("0123456789abcdefABCDEF"),
        "changes": F.regexp_count(classes, F.lit(r"a(?=[^a])|A(?=[^A])|0(?=[^0])|[^aA0](?=[aA0])")) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(v), known, "")) / n,
        "keyword": context.rlike(KEYWORD), "assigned": context.rlike("[=:][ \"']*$"),
        "before_length": F.length("before"), "previous_length": F.length("previous"), "next_length": F.length("next"),
        "previous_common": common(F.col("previous")), "next_common": common(F.col("next")),
        "path": F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(16)),
    }
    return found.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{name}") for name, c in columns.items()])


def weak_label() -> Column:
    """1 for findings of known form or assigned to a known keyword, 0 for numbers and plain words, else null."""
    v = F.col("value")
    return (
        F.when(v.rlike("^AKIA[A-Z0-9]{16}$") | ((F.col("f_keyword") == 1) & (F.col("f_assigned") == 1) & v.rlike("[0-9]")), 1)
        .when(v.rlike(r"^[0-9_-]+$") | v.rlike("^[A-Za-z][a-z_-]+$") | v.rlike("^[A-Z_-]+$"), 0)
    )


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, at, n_chars, value_sha256, score, secret`` of every candidate in every document.

    ``labelled`` has findings as ``value_sha256, label``, judged before; without it ``weak_label`` gives the labels.
    The forest is fitted on at most ``sample`` of them and its score decides for all candidates.  It does not see the two features that make
    weak labels, keyword and assignment, where these are what it learns from; candidates of equal features have equal scores.  Where the labels are of
    one kind only, or none, every candidate stays with score 1.  The secret itself is never returned.
    """
    slim = docs.select("doc_id", "source", "text")
    found = materialize(described(candidates(slim), dictionary(slim)).withColumn("value_sha256", F.sha2("value", 256)), "secret-candidates")
    if labelled is None:
        known = found.withColumn("label", weak_label())
    else:
        known = found.join(labelled.groupBy("value_sha256").agg(F.max("label").alias("label")), "value_sha256")
    known = known.where("label IS NOT NULL")
    # both kinds get half of the sample, each by the lowest hash of value and place
    rank = F.xxhash64("value_sha256", "doc_id", "at")
    halves = [known.where(F.col("label") == k).orderBy(rank).limit(sample // 2) for k in (0, 1)]
    names = [f"f_{f}" for f in FEATURES if labelled is not None or f not in ("keyword", "assigned")]
    train = materialize(halves[0].union(halves[1]).select(F.col("label").cast("double").alias("label"), *names), "secret-findings")
    result = [F.length("value").cast("long").alias("n_chars"), "value_sha256"]
    if train.select("label").distinct().count() < 2:
        return found.select("doc_id", "at", *result, F.lit(1.0).alias("score"), F.lit(True).alias("secret"))
    assemble = VectorAssembler(inputCols=names, outputCol="f_all")
    forest = RandomForestClassifier(featuresCol="f_all", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7)
    forest = forest.setProbabilityCol("f_probability").setRawPredictionCol("f_raw").setPredictionCol("f_prediction")
    model = forest.fit(assemble.transform(train))
    scored = model.transform(assemble.transform(found))
    score = vector_to_array("f_probability")[1]
    return scored.select("doc_id", "at", *result, F.round(score, 6).alias("score"), (score >= 0.5).alias("secret"))


@query("op10_secret_scan")
def op10(spark, folder):
    return scan(table(spark, folder, "documents"))
