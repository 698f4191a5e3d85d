"""URL filtering: explicit rules first, then Empirical-Bayes host reputation.

Outcomes of labelled pages (bad or good) are counted for each host, registered domain and suffix.
The share of bad pages is shrunk down that chain: the suffix towards the whole corpus, the domain
towards its suffix, the host towards its domain, each through a beta prior whose strength is fitted
to the table by moments. A host is blocked when the lower bound of its posterior share of bad pages
exceeds what is tolerated, so a few unlucky pages do not block a host. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: Suffixes of two labels under which names are registered. A parameter of the operator.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr")


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Rules are literals of the plan; a longer list is refused rather than planned badly.
MAX_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without a user's name, a port and a dot at its end."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r"\.?(:[0-9]*)?\z", "")


def _address(site: Column) -> Column:
    return site.rlike(r"^([0-9]+\.){3}[0-9]+\z|^\[")


def suffix_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """What names are registered under; of an IP address, the address."""
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(_address(site), site).when(two.isin(*two_label), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered name; of an IP address, the address."""
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(_address(site), site).when(two.isin(*two_label), F.substring_index(site, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct ``text, action``; null without one. Of equal rules the first holds."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = F.lit(None).cast("struct<text:string,action:string>")
    for r in sorted(rules[::-1], key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.action).alias("action"))).otherwise(found)
    return found


def _strength(level: DataFrame) -> float:
    """The prior's weight in pages, from ``n, b, mean`` of each group, by the moments of the beta-binomial law."""
    spread = F.col("mean") * (1 - F.col("mean"))
    over, scale = level.agg(
        F.sum((F.col("b") - F.col("n") * F.col("mean")) ** 2 - F.col("n") * spread), F.sum(F.col("n") * (F.col("n") - 1) * spread)
    ).first()
    rho = min(0.5, max(0.001, over / scale)) if scale else 0.1
    return 1 / rho - 1


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``host, n_labelled, bad_rate, bad_bound`` for each distinct host of ``hosts(host)``.

    ``outcomes(host, bad)``: labelled pages, ``bad`` 0 or 1; rows with a null are ignored and repeated
    rows count each. Without any outcome, all hosts get the flat prior's mean of one half and a bound of zero.
    """
    seen = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))
    seen = Scratch(hosts.sparkSession, "urls").keep(seen.withColumns({"domain": domain_of(F.col("host"), two_label), "suffix": suffix_of(F.col("host"), two_label)}))
    n, b = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    overall, any_seen = (b + 1.0) / (n + 2.0), n > 0

    shrunk = lambda k: ((F.col("b") + k * F.col("mean")) / (F.col("n") + k)).alias("mean")
    sums = (F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = seen.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(overall))
    suffixes = suffixes.select("suffix", shrunk(_strength(suffixes)))
    domains = seen.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.select("domain", shrunk(_strength(domains)))
    k = _strength(seen.join(domains, "domain"))

    every = hosts.groupBy("host").agg(F.lit(1).alias("_1")).drop("_1")
    every = every.withColumns({"domain": domain_of(F.col("host"), two_label), "suffix": suffix_of(F.col("host"), two_label)})
    every = (
        every.join(seen.select("host", "n", "b"), "host", "left")
        .join(domains.select("domain", F.col("mean").alias("domain_mean")), "domain", "left")
        .join(suffixes.select("suffix", F.col("mean").alias("suffix_mean")), "suffix", "left")
    )
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(overall))
    n, b = F.coalesce("n", F.lit(0)), F.coalesce("b", F.lit(0))
    rate, weight = (b + k * prior) / (n + k), n + k
    bound = rate - z * F.sqrt(rate * (1 - rate) / (weight + 1))
    return every.select("host", n.cast("long").alias("n_labelled"), rate.alias("bad_rate"), (bound if any_seen else F.lit(0.0)).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, max_bad: float = 0.2, z: float = 1.645, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, n_labelled, bad_rate, bad_bound``.

    ``outcomes(url, bad)``. The rule that fits decides; else the host's posterior bound. A null url,
    or one without ``://``, has an empty host and path: no rule fits it and its reputation is that of
    the empty host. Reputations pass between hosts without their users' names and ports; an IP address is its own
    domain. Columns of ``pages`` with those names are replaced; repeated rows are judged each.
    An empty table gives an empty result.
    """
    made = ["host", "path", "rule", "verdict", "n_labelled", "bad_rate", "bad_bound"]
    pages = pages.drop(*made).withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    outcomes = outcomes.select(url_host(F.col("url")).alias("host"), "bad")
    known = host_reputation(pages, outcomes, z)
    pages = pages.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).join(known, "host")
    method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return pages.withColumns({"rule": F.col("rule.text"), "verdict": F.coalesce(F.col("rule.action"), method)})


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the same id: bad where its quality is 0."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = filter_urls(pages, pages.join(labels, "page_id").select("url", "bad"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


_SITE = r"regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.?(:[0-9]*)?\z', '')"
_TWO = r"regexp_extract(site, '([^.]*\.)?[^.]*\z')"
_LISTED = f"{_TWO} IN ({', '.join(repr(s) for s in TWO_LABEL_SUFFIXES)})"
_IP = r"regexp_matches(site, '^([0-9]+\.){3}[0-9]+\z|^\[')"
OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
o AS (
  SELECT host, CASE WHEN {_IP} THEN site WHEN {_LISTED} THEN regexp_extract(site, '([^.]*\.)?[^.]*\.[^.]*\z') ELSE {_TWO} END AS domain,
    CASE WHEN {_IP} THEN site WHEN {_LISTED} THEN {_TWO} ELSE regexp_extract(site, '[^.]*\z') END AS suffix
  FROM (SELECT host, {_SITE} AS site FROM (SELECT DISTINCT host FROM p))),
s AS (
  SELECT host, domain, suffix, count(*) AS n, sum(1 - quality) AS b
  FROM p JOIN o USING (host) JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT (coalesce(sum(b), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS overall FROM s),
x1 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b, any_value(overall) AS mean FROM s, g GROUP BY 1),
k1 AS (SELECT 1 / coalesce(least(0.5, greatest(0.001, sum((b - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0))), 0.1) - 1 AS k FROM x1),
m1 AS (SELECT suffix, (b + k * mean) / (n + k) AS mean FROM x1, k1),
x2 AS (SELECT domain, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b, any_value(mean) AS mean FROM s JOIN m1 USING (suffix) GROUP BY 1),
k2 AS (SELECT 1 / coalesce(least(0.5, greatest(0.001, sum((b - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0))), 0.1) - 1 AS k FROM x2),
m2 AS (SELECT domain, (b + k * mean) / (n + k) AS mean FROM x2, k2),
x3 AS (SELECT host, n::DOUBLE AS n, b::DOUBLE AS b, mean FROM s JOIN m2 USING (domain)),
k3 AS (SELECT 1 / coalesce(least(0.5, greatest(0.001, sum((b - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0))), 0.1) - 1 AS k FROM x3),
h AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(b, 0) AS b, coalesce(m2.mean, m1.mean, overall) AS prior
  FROM o LEFT JOIN (SELECT host, n, b FROM s) USING (host)
  LEFT JOIN m2 ON m2.domain = o.domain LEFT JOIN m1 ON m1.suffix = o.suffix, g),
r AS (SELECT host, n, k, (b + k * prior) / (n + k) AS rate FROM h, k3),
z AS (SELECT host, n, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) AS bound FROM r)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow' ELSE
    CASE WHEN rule IS NOT NULL OR bound > 0.2 THEN 'block' ELSE 'allow' END END AS verdict,
  n::BIGINT AS n_labelled, round(rate, 6) AS bad_rate, round(bound, 6) AS bad_bound
FROM (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN z USING (host))
"""
for _name, _part in (("{_IP}", _IP), ("{_LISTED}", _LISTED), ("{_TWO}", _TWO), ("{_SITE}", _SITE)):
    OP1_SQL = OP1_SQL.replace(_name, _part)
