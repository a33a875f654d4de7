"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.spark import materialize

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked when even the lower posterior bound of its share of bad pages is above this.
MAX_BAD = 0.5
Z = 1.645
#: Prior strengths that no moment estimate leaves.
STRENGTHS = (1.0, 10_000.0)
# Public suffixes of two labels that are common in web text.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "blogspot.com", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au",
    "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr",
    "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.hk", "edu.tw", "github.io", "gitlab.io", "go.jp", "go.kr", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk",
    "herokuapp.com", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "netlify.app", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.uk",
    "org.za", "pages.dev", "vercel.app", "web.app",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url and one without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, as one ordered conditional; both null where none fits.

    A rule is ``host/path``; it fits its host and the hosts below it whose path starts with the rule's.
    """
    text, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        text, verdict = text.when(fits, rule), verdict.when(fits, kind)
    return text, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the suffix is one of ``SUFFIXES`` or the last label, the domain has one label more, if the host has."""
    two = F.substring_index(host, ".", -2)
    known = two.isin(*SUFFIXES)
    return F.when(known, F.substring_index(host, ".", -3)).otherwise(two), F.when(known, two).otherwise(F.substring_index(host, ".", -1))


def _strength(n: str, k: str, p: str) -> Column:
    """Prior strength of a beta-binomial level from the spread of its members, by moments."""
    flat = F.col(n) * F.col(p) * (1 - F.col(p))
    extra = F.sum(F.pow(F.col(k) - F.col(n) * F.col(p), 2) - flat)
    room = F.sum(flat * (F.col(n) - 1))
    rho = F.greatest(F.coalesce(extra / F.when(room > 0, room), F.lit(0.0)), F.lit(1e-9))
    return F.least(F.greatest(1 / rho - 1, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row per host: counts, posterior mean and bounds of its share of bad pages.

    ``pages`` has ``page_id, host``; ``outcomes`` has ``page_id, bad`` (0 or 1).  Counts go up from host to registered
    domain to suffix to all; shrunk means come down the same way: the mean of a level, with a strength from the spread
    among its members, is the prior of the next.  A host without outcomes has the mean of its domain.  Only the first
    sum sees pages, and it combines them before the shuffle, so one host may hold any share of them.
    """
    domain, suffix = levels(F.col("host"))
    hosts = materialize(
        pages.join(outcomes, "page_id", "left")
        .groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"),
        "url-hosts",
    )
    # one outcome of either kind is added at the top, so that the overall mean is never 0 or 1
    overall = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("p")).first()["p"]

    def shrunk(members: DataFrame, above: str) -> DataFrame:
        """``p``: the mean of each member, shrunk to the mean ``above`` by the strength of this level."""
        m = members.agg(_strength("n", "k", above).alias("m")).first()["m"]
        m = STRENGTHS[1] if m is None else m
        return members.withColumn("a", F.col("k") + m * F.col(above)).withColumn("b", F.col("n") - F.col("k") + m * (1 - F.col(above))).withColumn("p", F.col("a") / (F.col("a") + F.col("b")))

    by = lambda *keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = shrunk(by("suffix").withColumn("above", F.lit(overall)), "above").select("suffix", F.col("p").alias("suffix_p"))
    domains = shrunk(by("domain", "suffix").join(suffixes, "suffix"), "suffix_p").select("domain", F.col("p").alias("domain_p"))
    rated = shrunk(hosts.join(domains, "domain"), "domain_p")
    spread = Z * F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("a") + F.col("b") + 1))
    return rated.select("host", "domain", "suffix", "n", "k", F.col("p").alias("mean"), (F.col("p") - spread).alias("low"), (F.col("p") + spread).alias("high"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page, and the bounds behind it.

    Outcomes are the labels of the page's id: bad is low quality or toxic; of several labels of an id the worst counts.
    Pages without a host share the reputation of the empty host; null ids, empty tables and tables without any label
    are fine (everything without a rule is then allowed); repeated rows each get a verdict.
    """
    host, path = parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int")).alias("bad"))
    rated = reputation(parsed, outcomes).select("host", "mean", "low", "high")
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return parsed.join(rated, "host", "left").select(
        "page_id", "host", "path", text.alias("rule"),
        F.coalesce(verdict, F.when(F.col("low") > max_bad, "block").otherwise("allow")).alias("verdict"),
        "mean", "low", "high",
    )


def _level(name: str, members: str, above: str) -> str:
    """A level of the SQL twin: members with counts ``n, k`` and the mean ``above`` of their parent."""
    flat = f"(n * {above} * (1 - {above}))"
    return f"""
{name}_m AS (SELECT least(greatest(1 / greatest(coalesce(sum(pow(k - n * {above}, 2) - {flat}) / nullif(greatest(sum({flat} * (n - 1)), 0), 0), 0), 1e-9) - 1,
  {STRENGTHS[0]}), {STRENGTHS[1]}) AS m FROM {members}),
{name} AS (SELECT *, k + m * {above} AS a, n - k + m * (1 - {above}) AS b, (k + m * {above}) / (n + m) AS p FROM {members}, {name}_m)"""


_FITS = sorted(((kind, rule, *rule.partition("/")) for kind, rule in RULES), key=lambda r: -len(r[1]))
_WHEN = "\n  ".join(
    f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}') THEN '{kind} {rule}'" for kind, rule, name, slash, start in _FITS)
SQL = f"""
WITH r AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
outcomes AS (SELECT doc_id AS page_id, max(CAST(quality = 0 OR coalesce(toxic, 0) = 1 AS INTEGER)) AS bad FROM labels GROUP BY 1),
pairs AS (SELECT *, list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') AS two FROM parsed),
hosts AS (SELECT host, CASE WHEN two IN {SUFFIXES} THEN list_aggregate(list_slice(string_split(host, '.'), -3, -1), 'string_agg', '.') ELSE two END AS domain,
  CASE WHEN two IN {SUFFIXES} THEN two ELSE string_split(host, '.')[-1] END AS suffix,
  CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM pairs LEFT JOIN outcomes USING (page_id) GROUP BY host, two),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts) AS top FROM hosts GROUP BY suffix),{_level("s1", "s0", "top")},
d0 AS (SELECT domain, sum(h.n) AS n, sum(h.k) AS k, any_value(s1.p) AS up FROM hosts h JOIN s1 USING (suffix) GROUP BY domain),{_level("d1", "d0", "up")},
h0 AS (SELECT host, h.n, h.k, d1.p AS up FROM hosts h JOIN d1 USING (domain)),{_level("h1", "h0", "up")},
judged AS (SELECT page_id, host, path, CASE {_WHEN} END AS fits,
  CASE WHEN p - {Z} * sqrt(p * (1 - p) / (a + b + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS own FROM parsed LEFT JOIN h1 USING (host))
SELECT page_id, host, path, string_split(fits, ' ')[2] AS rule, coalesce(string_split(fits, ' ')[1], own) AS verdict FROM judged
"""


@query("op6_url_filters", SQL)
def op6(spark, folder):
    return judge(table(spark, folder, "pages"), table(spark, folder, "labels")).select("page_id", "host", "path", "rule", "verdict")
