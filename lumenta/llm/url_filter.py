"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (good or bad) are counted by host. Each host's rate is shrunk through beta-binomial priors: the
whole table's rate is the prior of a suffix, the suffix's posterior mean the prior of a registered domain, the domain's
the prior of a host. The strength of each prior (a number of pseudo-pages) comes from the spread of the rates on that
level, by the method of moments. A page is blocked if even the upper bound of its host's good rate is low; the
bound of a host without outcomes is that of what its domain, suffix or the table predicts for a new host.
Explicit rules come first; the longest fitting rule wins. Counts by host are written once, and domains and suffixes are
sums over them; only the four numbers that hold for the whole table (its mean and the priors' strengths) pass the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import col, durable, fresh

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEVELS = ("suffix", "domain", "host")
#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def placed(hosts: DataFrame, public: DataFrame | None = None) -> DataFrame:
    """hosts (host, ...) with its suffix and domain: the last label, and one label more.

    public (suffix) lists suffixes of two or three labels, such as co.uk; a host under one has that suffix, the longest that
    fits. Without it such suffixes count as domains of their last label, and their hosts share a prior.
    """
    labels = lambda k: F.substring_index("host", ".", -k)
    if public is None:
        return hosts.withColumns({"suffix": labels(1), "domain": labels(2)})
    known = public.select(F.lower("suffix").alias("s")).where("s is not null").distinct()
    for k in (2, 3):
        hosts = hosts.withColumn("s", labels(k)).join(known.withColumn(f"is{k}", F.lit(True)), "s", "left").drop("s")
    pick = lambda shift: F.when(F.col("is3"), labels(3 + shift)).when(F.col("is2"), labels(2 + shift)).otherwise(labels(1 + shift))
    return hosts.withColumns({"suffix": pick(0), "domain": pick(1)}).drop("is2", "is3")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (its host and path, joined) and its verdict; null if none fits. Rules are a short list."""
    rule = verdict = None
    for own, prefix, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(own + prefix)) if rule is None else rule.when(fits, F.lit(own + prefix))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


class Reputation:
    """Posteriors from rows (host, good 0/1): hosts, domains and suffixes with counts (n_, s_) and posterior means (m_), written tables.

    Rows with a null outcome don't count. A level's strength is mean·(1-mean)/variance - 1, within 1 and most, where
    variance is that of its rates around their parents' means less the binomial noise expected for their sizes.
    Only counts by host leave the map side. m_root and k (strengths by level) are numbers.
    """

    def __init__(self, outcomes: DataFrame, most: float = 1000.0, public: DataFrame | None = None):
        self.public, self.most, self.k = public, most, {}
        hosts = outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n_host"), F.sum("good").alias("s_host"))
        hosts = durable(placed(hosts, public))
        domains = durable(hosts.groupBy("domain", "suffix").agg(F.sum("n_host").alias("n_domain"), F.sum("s_host").alias("s_domain")))
        suffixes = durable(domains.groupBy("suffix").agg(F.sum("n_domain").alias("n_suffix"), F.sum("s_domain").alias("s_suffix")))
        # Jeffreys' half counts keep the root's mean off 0 and 1
        self.m_root = suffixes.agg(((F.coalesce(F.sum("s_suffix"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n_suffix"), F.lit(0)) + 1.0)).alias("m")).first().m
        self.suffixes = self._shrunk(suffixes.withColumn("m_root", F.lit(self.m_root)), "suffix", "m_root")
        self.domains = self._shrunk(durable(domains.join(self.suffixes.select("suffix", "m_suffix"), "suffix")), "domain", "m_suffix")
        self.hosts = self._shrunk(durable(hosts.join(self.domains.select("domain", "suffix", "m_domain"), ["domain", "suffix"])), "host", "m_domain")

    def _shrunk(self, rows: DataFrame, level: str, prior: str) -> DataFrame:
        n, s, m = F.col(f"n_{level}"), F.col(f"s_{level}"), F.col(prior)
        # sum n(p-m)² has expectation sum m(1-m)(1 + (n-1)/(k+1)): solved for k
        noise, pairs, seen = F.sum(m * (1 - m)), F.sum(m * (1 - m) * (n - 1)), F.sum((s - n * m) * (s - n * m) / n)
        fitted = F.round(F.least(F.lit(self.most), F.greatest(F.lit(1.0), F.coalesce(F.when(seen > noise, pairs / (seen - noise) - 1).otherwise(self.most), F.lit(self.most)))), 6)
        k = self.k[level] = rows.agg(fitted.alias("k")).first().k
        return rows.withColumn(f"m_{level}", (k * m + s) / (k + n))

    def table(self) -> DataFrame:
        """One row for each host with outcomes: n, good, prior mean and strength, posterior mean and deviation."""
        k = self.k["host"]
        a, b = k * F.col("m_domain") + F.col("s_host"), k * (1 - F.col("m_domain")) + F.col("n_host") - F.col("s_host")
        return self.hosts.select("host", F.col("n_host").alias("n"), F.col("s_host").alias("good"), F.col("m_domain").alias("prior_mean"), F.lit(k).alias("prior_strength"), F.col("m_host").alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))

    def of(self, hosts: DataFrame) -> DataFrame:
        """host, mean, deviation for each distinct host: its posterior; without outcomes, what its domain predicts for a host, else its suffix, else the whole table.

        A host of a known domain is drawn with mean m_domain and strength k_host. Above that, the spreads of the levels in
        between add up: the share of m(1-m) that is left after each level of strength k is 1 - 1/(k+1).
        """
        rows = placed(hosts.select("host").distinct(), self.public).join(self.table().select("host", "mean", "deviation"), "host", "left")
        rows = rows.join(self.domains.select("domain", "suffix", "m_domain"), ["domain", "suffix"], "left").join(self.suffixes.select("suffix", "m_suffix"), "suffix", "left")
        left = lambda *levels: 1 - math.prod(1 - 1 / (self.k[x] + 1) for x in levels)
        spread = F.when(F.col("m_domain").isNotNull(), left("host")).when(F.col("m_suffix").isNotNull(), left("host", "domain")).otherwise(left("host", "domain", "suffix"))
        m = F.coalesce("m_domain", "m_suffix", F.lit(self.m_root))
        return rows.select("host", F.coalesce("mean", m).alias("mean"), F.coalesce("deviation", F.sqrt(m * (1 - m) * spread)).alias("deviation"))


FLOOR, Z = 0.5, 1.645


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR, z: float = Z, public: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, upper for every row of pages (page_id, url).

    outcomes: (host, good). verdict is the longest fitting rule's; else block if the host's posterior mean plus z
    deviations is under floor, else allow. Hosts without a labelled page are judged by their domain, suffix or all pages.
    Null urls and urls without :// have empty host and path and fall under the same rule; null page_ids and repeated rows
    stay as they are; other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    bounds = Reputation(outcomes, public=public).of(rows).select("host", "mean", F.least(F.lit(1.0), F.col("mean") + z * F.col("deviation")).alias("upper"))
    rows = rows.join(bounds, "host", "left").withColumns({"rule": rule, "says": says})
    verdict = F.coalesce(F.col("says"), F.when(F.col("upper") < floor, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("mean", 6).alias("mean"), F.round("upper", 6).alias("upper"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of labelled pages: a page shares its id with its document's label and is good if of quality and not toxic.

    Labels without an id or a mark don't count; of repeated labels of one id the worst does, once. Repeated pages are pages of their own.
    """
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long").alias("good")).where("page_id is not null and good is not null")
    return pages.select("page_id", host_of(F.col("url")).alias("host")).join(marks.groupBy("page_id").agg(F.min("good").alias("good")), "page_id").select("host", "good")


def kept(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR, z: float = Z, public: DataFrame | None = None) -> DataFrame:
    """Rows of pages whose url is allowed, with all their columns."""
    host, upper = fresh("__host", pages), fresh("__upper", pages)
    rule, says = rule_of(F.col(host), path_of(F.col("url")), rules)
    bounds = Reputation(outcomes, public=public).of(pages.select(host_of(F.col("url")).alias("host")))
    bounds = bounds.select(F.col("host").alias(host), (F.col("mean") + z * F.col("deviation")).alias(upper))
    rows = pages.withColumn(host, host_of(F.col("url"))).join(bounds, host, "left")
    verdict = F.coalesce(says, F.when(F.col(upper) < floor, "block").otherwise("allow"))
    return rows.where(verdict == "allow").select(*[col(c) for c in pages.columns])
