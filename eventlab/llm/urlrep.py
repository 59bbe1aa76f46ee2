"""URL filters: rules, and reputations of hosts by empirical Bayes.

Only DataFrame functions.  Labelled pages are counted by host.  A host's rate of
good pages is shrunk to its registered domain's, that one's to its suffix's, and
the suffix's to the rate of all: each level has a beta prior around its parent's
posterior mean, whose concentration is estimated by moments from all nodes of the
level (beta-binomial).  A parent's mean leaves out what the child itself has: a host's domain is
judged by the domain's other hosts, that one's suffix by its other domains, so no page
counts twice.  A host is blocked if even the upper bound of its
posterior is below the least good rate.  Rules come before that.

For the hierarchy, user and port are cut off.  The registered domain is one label more than the suffix,
which is the last label or, where one fits, the longest of ``suffixes``; an IP address is its own domain and suffix.

Counts are combined before they are shuffled, and node tables have a row for each
host at most; the join back to pages is an ordinary one on the host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlab.llm.tables import cut, lower_ascii

#: (verdict, host, path) of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of several labels under which anybody may register; any list or table can be given to the operator.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "edu.au",
    "github.io", "gov.au", "gov.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "org.au", "org.br", "org.cn", "org.uk",
)
#: Blocked if mean + Z standard deviations of the posterior is under LEAST_GOOD.
Z, LEAST_GOOD = 1.645, 0.5
#: Bounds of the correlation within a node, and its value where moments can't tell.
RHO_LEAST, RHO_MOST, RHO_ELSE = 0.001, 0.5, 0.1


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    none = F.lit("")
    host = F.when(at > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(none)
    path = F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(none)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does.  ``rules`` is a short list in code."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _rho(nodes: DataFrame, parent: str) -> DataFrame:
    """One row: the correlation within the nodes (k of n good) around their parents' rates."""
    up = nodes.groupBy(parent).agg(F.sum("k").alias("pk"), F.sum("n").alias("pn")).where("pn > 0").withColumn("m", F.col("pk") / F.col("pn")).select(F.col(parent).alias("_p"), "m")
    both = nodes.where("n > 0").join(up, F.col(parent) == F.col("_p"))
    v = F.col("m") * (1 - F.col("m"))
    p = F.col("k") / F.col("n")
    sums = both.agg(F.sum(F.col("n") * (p - F.col("m")) * (p - F.col("m"))).alias("s"), F.sum(v).alias("a"), F.sum((F.col("n") - 1) * v).alias("b"))
    rho = F.when(F.col("b") > 0, F.least(F.lit(RHO_MOST), F.greatest(F.lit(RHO_LEAST), (F.col("s") - F.col("a")) / F.col("b")))).otherwise(F.lit(RHO_ELSE))
    return sums.select((1 / rho - 1).alias("kappa"))


def suffix_table(spark: SparkSession, suffixes: Sequence[str] | DataFrame) -> DataFrame:
    """(suffix, labels), each once: from a list or a table with a column ``suffix``, of any length."""
    if not isinstance(suffixes, DataFrame):
        suffixes = spark.createDataFrame([(s,) for s in suffixes], "suffix string")
    return suffixes.where("suffix is not null").select(lower_ascii(F.col("suffix")).alias("suffix")).distinct().withColumn("labels", F.size(F.split("suffix", r"\.", -1)))


def with_hierarchy(hosts: DataFrame, suffixes: Sequence[str] | DataFrame = SUFFIXES) -> DataFrame:
    """``hosts``, a row for each host, with its registered domain and suffix.

    A host asks the table of suffixes for its own last labels, as many as the longest suffix has, so the list may have any length.
    """
    table = cut(suffix_table(hosts.sparkSession, suffixes), "suffix-list")
    most = table.agg(F.coalesce(F.max("labels"), F.lit(1))).first()[0]
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), r":[0-9]*\z", "")
    own = cut(hosts.withColumn("_bare", bare).withColumn("_ip", F.col("_bare").rlike(r"^[0-9]+(\.[0-9]+){3}\z") | F.contains("_bare", F.lit("["))), "bare")
    labels = F.split("_bare", r"\.", -1)

    def last(k: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - k + 1), F.greatest(F.lit(1), k)), ".")

    tails = own.where("not _ip").select("host", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size(labels)))).alias("_k"), "_bare").select("host", last(F.col("_k")).alias("suffix"))
    fits = tails.join(table, "suffix").groupBy("host").agg(F.max("labels").alias("_n"))
    n = F.coalesce("_n", F.lit(1))
    both = own.join(fits, "host", "left")
    return both.select(*hosts.columns, F.when(F.col("_ip"), F.col("_bare")).otherwise(last(n + 1)).alias("domain"), F.when(F.col("_ip"), F.col("_bare")).otherwise(last(n)).alias("suffix"))


def host_reputation(hosts: DataFrame, suffixes: Sequence[str] | DataFrame = SUFFIXES) -> DataFrame:
    """Rows (host, n, k), one for each host, to (host, mean, sd): posterior mean and deviation of the good rate."""
    hosts = cut(with_hierarchy(hosts.select("host", "n", "k"), suffixes), "hosts")
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    tops = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1)), "suffixes")
    root = tops.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k0"), F.coalesce(F.sum("n"), F.lit(0)).alias("n0"))
    one = root.crossJoin(_rho(tops, "all").withColumnRenamed("kappa", "r1")).crossJoin(_rho(domains, "suffix").withColumnRenamed("kappa", "r2")).crossJoin(_rho(hosts, "domain").withColumnRenamed("kappa", "r3"))
    df = hosts.join(domains.select("domain", "suffix", F.col("n").alias("n2"), F.col("k").alias("k2")), ["domain", "suffix"])
    df = df.join(tops.select("suffix", F.col("n").alias("n1"), F.col("k").alias("k1")), "suffix").crossJoin(F.broadcast(one))  # one row

    def shrunk(kappa: str, above: Column, k: Column, n: Column) -> Column:
        return (F.col(kappa) * above + k) / (F.col(kappa) + n)

    m = (F.col("k0") - F.col("k1") + 1) / (F.col("n0") - F.col("n1") + 2)  # the other suffixes
    m = shrunk("r1", m, F.col("k1") - F.col("k2"), F.col("n1") - F.col("n2"))  # the suffix's other domains
    m = shrunk("r2", m, F.col("k2") - F.col("k"), F.col("n2") - F.col("n"))  # the domain's other hosts
    m = shrunk("r3", m, F.col("k"), F.col("n"))
    return df.select("host", m.alias("mean"), F.sqrt(m * (1 - m) / (F.col("r3") + F.col("n") + 1)).alias("sd"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, suffixes: Sequence[str] | DataFrame = SUFFIXES) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, good_rate, upper.

    ``pages`` has page_id and url; ``labels`` has doc_id, quality and toxic, and
    labels the page of that number: good if quality is 1 and toxic is 0, unknown if
    either is null; a page with several labels is good if all are.  Other
    columns are ignored.  Repeated pages each come out, and each counts.  Pages of
    unlabelled hosts are judged by their domain's, suffix's or all pages' rate.
    Empty tables give empty tables; without labels all hosts have the rate 1/2 and
    are allowed.
    """
    host, path = split_url(F.col("url").cast("string"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    outcome = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")).where("good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    known = p.join(outcome, p["page_id"] == outcome["doc_id"], "left")
    hosts = known.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    rep = cut(host_reputation(hosts, suffixes), "reputation")
    upper = F.col("mean") + Z * F.col("sd")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(upper < LEAST_GOOD, F.lit("block")).otherwise(F.lit("allow"))
    return p.join(rep, "host").select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("mean", 6).alias("good_rate"), F.round(upper, 6).alias("upper"))


def _rho_sql(name: str, nodes: str, parent: str) -> str:
    return f"""
{name} AS (SELECT 1 / CASE WHEN b > 0 THEN least({RHO_MOST}, greatest({RHO_LEAST}, (s - a) / b)) ELSE {RHO_ELSE} END - 1 AS {name} FROM (
    SELECT sum(n * (k / n - m) * (k / n - m)) AS s, sum(m * (1 - m)) AS a, sum((n - 1) * m * (1 - m)) AS b
    FROM (SELECT n, k, sum(k) OVER w / sum(n) OVER w AS m FROM {nodes} WHERE n > 0 WINDOW w AS (PARTITION BY {parent}))))"""


_SUFFIX = "|".join(s.replace(".", "[.]") for s in SUFFIXES)
_FITS = "\n".join(f"    WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{{i}}}" for i, (v, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2])))
ORACLE_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
outcome AS (SELECT doc_id, min((quality = 1 AND toxic = 0)::INT) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*\\z', '') AS bare, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k
            FROM p LEFT JOIN outcome ON doc_id = page_id GROUP BY host),
ends AS (SELECT *, regexp_full_match(bare, '[0-9]+([.][0-9]+){{3}}') OR contains(bare, '[') AS ip,
                coalesce(nullif(regexp_extract(bare, '(^|[.])({_SUFFIX})$', 2), ''), regexp_extract(bare, '[^.]*$')) AS suf FROM counted),
hosts AS (SELECT host, n, k, CASE WHEN ip THEN bare ELSE suf END AS suffix,
                 CASE WHEN ip OR bare = suf THEN bare ELSE regexp_extract(left(bare, length(bare) - length(suf) - 1), '[^.]*$') || '.' || suf END AS domain FROM ends),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
{_rho_sql("r1", "suffixes", "1")},{_rho_sql("r2", "domains", "suffix")},{_rho_sql("r3", "hosts", "domain")},
m1 AS (SELECT suffix, n AS n1, k AS k1, (sum(k) OVER () - k + 1) / (sum(n) OVER () - n + 2) AS m FROM suffixes),
m2 AS (SELECT domain, suffix, n AS n2, k AS k2, (r1 * m + k1 - k) / (r1 + n1 - n) AS m FROM domains JOIN m1 USING (suffix), r1),
m3 AS (SELECT host, n, k, (r2 * m + k2 - k) / (r2 + n2 - n) AS m FROM hosts JOIN m2 USING (domain, suffix), r2),
h AS (SELECT host, (r3 * m + k) / (r3 + n) AS m0, r3 + n AS total FROM m3, r3)
SELECT page_id, host, path,
    CASE
{_FITS.format(*[f"'{h}{p}'" for _, h, p in RULES])}
    END AS rule,
    CASE
{_FITS.format(*[f"'{v}'" for v, _, _ in RULES])}
    WHEN m0 + {Z} * sqrt(m0 * (1 - m0) / (total + 1)) < {LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict,
    round(m0, 6) AS good_rate, round(m0 + {Z} * sqrt(m0 * (1 - m0) / (total + 1)), 6) AS upper
FROM p JOIN h USING (host)
"""
