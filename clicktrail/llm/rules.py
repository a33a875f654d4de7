"""Quality rules: fixed base rules, then a decision list learned from labelled statistics by sequential covering."""

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.common import SPACES, let, query, table
from clicktrail.spark import materialize

WINDOW = 5
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals",
          "n_digits", "n_bangs", "n_pipes"]
#: Statistics that conditions are about.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "pipes": "n_pipes / greatest(n_words, 1)",
}


def _repeated(words: Column) -> Column:
    """Words in windows that occur twice or more: hash windows, sort hashes, join up the windows that have a twin."""
    at = lambda i, k: F.get(words, i + k)
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twins(s):
            same = lambda e, k: F.get(s, k)["x"] == e["x"]
            found = F.transform(s, lambda e, k: F.when((k > 0) & same(e, F.greatest(k - 1, F.lit(0))) | F.coalesce(same(e, k + 1), F.lit(False)), e["i"]))
            return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

        def spans(p):
            own = F.transform(p, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, lambda s: let(twins(s), spans)))

    return let(hashes, covered)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COUNTS`` of every text, from one row each: no shuffle and no Python.

    A null text counts as empty and has zeros everywhere.  Further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), _repeated(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")))
    return docs.select(
        "doc_id", F.inline(F.array(by_words)),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        by_lines.alias("lines"),
        *[without(chars).alias(name) for name, chars in
          {"n_symbols": SYMBOLS, "n_capitals": CAPITALS, "n_digits": DIGITS, "n_bangs": "!", "n_pipes": "|"}.items()],
    ).select("*", "lines.*").select("doc_id", *[F.col(c).cast("long") for c in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.cut if self.above else value <= self.cut


@dataclass
class DecisionList:
    """Rules in order; a row that meets all conditions of one is rejected."""

    rules: list[list[Condition]] = field(default_factory=list)

    @staticmethod
    def meets(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & c.column()
        return out

    def kept(self) -> Column:
        out = F.when(F.lit(False), False)
        for rule in self.rules:
            out = out.when(self.meets(rule), False)
        return out.otherwise(True)


def learn(
    labelled: DataFrame, cuts: int = 32, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.8, least: float = 0.002
) -> DecisionList:
    """Sequential covering over ``doc_id, label, COUNTS``; label 0 is what rules look for.

    Two thirds of the rows grow rules, one third prunes them, by the hash of the id.  A rule grows by the condition with
    the highest FOIL gain among ``cuts`` quantiles of every statistic; its counts are one aggregate with a row for each
    statistic and quantile.  Pruning keeps the shortest beginning with the best (p - n) / (p + n) on the other
    third.  Rows that it covers leave, and the next rule starts.  It ends when a rule's share of label 0 is below
    ``precision`` on the pruning rows, when it covers under ``least`` of the rows, or after ``max_rules``.

    All rows count, each with the same weight; null labels are left out; without rows or without label 0 the list is empty.
    """
    names = list(FEATURES)
    rows = labelled.where("label IS NOT NULL").select("*", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"))
    steps = rows.agg(*[F.percentile_approx(F.expr(FEATURES[f]), [i / cuts for i in range(cuts)], 10_000).alias(f) for f in names]).first()
    edges = {f: sorted(set(steps[f] or [])) for f in names}
    total = rows.count()
    found = DecisionList()

    def bins(f):  # the number of edges below the value
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges[f]]), lambda e: e < F.expr(FEATURES[f]))).alias(f)

    def counts(rest, rule):
        """{(statistic, bin): [label 0, others]} of the growing rows that meet the rule so far."""
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), bins(f).alias("b")) for i, f in enumerate(names)])).alias("e")
        got = rest.where(~F.col("prune") & DecisionList.meets(rule)).select("label", each)
        got = got.groupBy("e.f", "e.b").agg(F.sum((F.col("label") == 0).cast("int")).alias("p"), F.count("*").alias("n"))
        return {(names[r["f"]], r["b"]): (r["p"], r["n"] - r["p"]) for r in got.collect()}

    while total and len(found.rules) < max_rules:
        rest, rule = rows.where(found.kept()), []
        while len(rule) < max_conditions:
            table_, best = counts(rest, rule), (0.0, None)
            p0, n0 = (sum(v[k] for (f, _), v in table_.items() if f == names[0]) for k in (0, 1))
            if not p0 or not n0:
                break
            for f in names:
                p = n = 0
                for b, edge in enumerate(edges[f]):
                    x, y = table_.get((f, b), (0, 0))
                    p, n = p + x, n + y
                    for above, (a, c) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if a and c < n0 and (gain := a * (log2(a / (a + c)) - log2(p0 / (p0 + n0)))) > best[0]:
                            best = (gain, Condition(f, above, float(edge)))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        tried = [rule[: k + 1] for k in range(len(rule))]
        held = rest.where("prune").agg(*[
            F.coalesce(F.sum((DecisionList.meets(t) & (F.col("label") == want)).cast("int")), F.lit(0)).alias(f"{k}_{want}")
            for k, t in enumerate(tried) for want in (0, 1)
        ]).first()
        worth = [(held[f"{k}_0"], held[f"{k}_1"]) for k in range(len(tried))]
        k = max(range(len(tried)), key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), -k))
        if sum(worth[k]) < max(2, least * total / 3) or worth[k][0] < precision * sum(worth[k]):
            break
        found.rules.append(tried[k])
    return found


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdicts of all documents, and the list behind them.

    ``labels`` has ``doc_id`` and ``quality``; of several labels of an id the lowest counts, labels of unknown ids
    are ignored.  A document without words fails the base rules.  Repeated rows get a row each.
    """
    stats = materialize(statistics(docs), "rule-statistics")
    label = labels.groupBy("doc_id").agg(F.min("quality").alias("label"))
    learned = learn(materialize(stats.where(~base_failed()).join(label, "doc_id"), "rule-labels"))
    failed = base_failed()
    return stats.select("*", failed.alias("base_failed"), (~failed & learned.kept()).alias("kept")), learned


@query("op8_quality_rules")
def op8(spark, folder):
    verdicts, _ = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return verdicts.select("doc_id", *COUNTS[:5], "base_failed", "kept")
