"""URL filters: block and allow rules by host and path, then empirical-Bayes host reputation.

Labelled page outcomes are summed per host. Their rates shrink through beta priors from suffix to registered domain to
host; a host is blocked when the lower posterior bound on its odds of a bad page is over a multiple of those of all pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (action, host, path): the rule fits the host and its subdomains when the path begins with the rule's path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second-level labels that make a two-label suffix before a two-letter country label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
BLOCK_ODDS, Z = 3.0, 1.96
#: What of a page isn't shown: scripts, styles, comments and tags. Each part ends at the page's end if nothing else ends it, so a page is read once.
HIDDEN = r"(?is)<(?:script|style)\b.*?(?:</(?:script|style)>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>"
SYMBOLS = "#*$%&|<>"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty when it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return common.ascii_lower(host), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` text, and its action; null when none does."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)])
    return pick([h + p for _, h, p in ranked]), pick([a for a, _, _ in ranked])


def suffix_of(host: Column) -> Column:
    """The public suffix by a short rule: the last label, or the last two before a country label."""
    labels = F.split(host, r"\.")
    two = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL)
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more; a host of digits and dots is its own domain."""
    n = F.size(F.split(suffix, r"\."))
    domain = F.when(n == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(domain)


def page_outcome(html: Column) -> Column:
    """Labels a page by the quality of its shown text: bad when that has under 20 words, symbols over a tenth of its word
    characters, or under a fifth of its words distinct; null for null html."""
    text = F.regexp_replace(html, HIDDEN, " ")

    def bad(x: Column) -> Column:
        n, chars = F.size(x["words"]), F.length(F.translate(x["text"], common.SPACES, ""))
        symbols = F.length(x["text"]) - F.length(F.translate(x["text"], SYMBOLS, ""))
        return (n < 20) | (10 * symbols > chars) | (5 * F.size(F.array_distinct(x["words"])) < n)

    return F.when(html.isNotNull(), common.let(F.struct(text.alias("text")), lambda t: common.let(F.struct(t["text"].alias("text"), common.words_of(t["text"]).alias("words")), bad)))


def host_reputation(outcomes: DataFrame, z: float = Z, block_odds: float = BLOCK_ODDS) -> DataFrame:
    """``host, n_pages, n, k, bad_rate, bad_bound, blocked`` from rows of ``host`` and boolean ``bad`` (null: not labelled).

    Hosts without labels take their domain's rate, domains their suffix's, suffixes the overall one. Counts are summed
    before they are shuffled, and rates are joined back with the domains and suffixes of very many hosts spread.
    """
    counted = outcomes.groupBy("host").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("k"))
    named = counted.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = common.materialize(named.withColumn("domain", F.concat_ws("|", "suffix", "domain")), "hosts")
    domains = common.materialize(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("dn"), F.sum("k").alias("dk"), F.count("*").alias("n_hosts")), "domains")
    suffixes = common.materialize(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"), F.count("*").alias("n_domains")), "suffixes")
    top, s_suffix = common.beta_prior(suffixes, "sn", "sk")
    _, s_domain = common.beta_prior(domains, "dn", "dk")
    _, s_host = common.beta_prior(hosts, "n", "k")
    shrunk = lambda n, k, mean, s: (F.col(k) + F.lit(s) * mean) / (F.col(n) + F.lit(s))
    rates = suffixes.select("suffix", "n_domains", shrunk("sn", "sk", F.lit(top), s_suffix).alias("suffix_rate"))
    domains = common.join_back(domains, rates, "suffix", "n_domains", F.col("domain"))
    rates = common.materialize(domains.select("domain", "n_hosts", shrunk("dn", "dk", F.col("suffix_rate"), s_domain).alias("domain_rate")), "domain-rates")
    rated = common.join_back(hosts, rates, "domain", "n_hosts", F.col("host"))
    bound = common.lower_bound(F.col("n"), F.col("k"), F.col("domain_rate"), s_host, z)
    blocked = bound > common.odds_times(top, block_odds)
    return rated.select("host", "n_pages", "n", "k", shrunk("n", "k", F.col("domain_rate"), s_host).alias("bad_rate"), bound.alias("bad_bound"), blocked.alias("blocked"))


def judge_pages(pages: DataFrame, rules=RULES, outcome: Column | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, bad_rate, verdict``: the rule's action, else by the host's reputation.

    ``outcome`` labels pages (default: from their html). Null or malformed URLs share the empty host. Repeated rows are
    judged alike; columns named like the added ones are replaced; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    outcome = page_outcome(F.col("html")) if outcome is None else outcome
    parts = pages.drop("host", "path", "rule", "bad_rate", "verdict").withColumn("host", host).withColumn("path", path)
    reputation = common.materialize(host_reputation(parts.select("host", outcome.alias("bad"))), "reputation")
    judged = common.join_back(parts, reputation.select("host", "n_pages", "bad_rate", "blocked"), "host", "n_pages", F.xxhash64("page_id", "url"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("blocked"), F.lit("block")), F.lit("allow"))
    return judged.withColumn("rule", rule).withColumn("verdict", verdict).drop("blocked", "n_pages")
