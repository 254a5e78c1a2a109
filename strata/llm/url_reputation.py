"""URL filter: rules first, then empirical-Bayes reputation of the host.

Native: DataFrame functions only. Outcomes of labelled pages (1 good, 0 bad)
are summed by host, registered domain and suffix. Each level shrinks toward
the posterior mean of the level above through a beta-binomial prior whose
strength comes from the method of moments over that level's members; a host
without a label takes its domain's posterior. A page is allowed if the lower
bound of its host's posterior (mean less Z standard deviations) reaches FLOOR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.store import materialize

# Host and path pairs of the query's contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
Z, FLOOR = 1.64, 0.75
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
# Suffixes of two labels under which names are registered; others have one label.
TWO_LABELS = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk",
    "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp",
    "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ``://``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end,
    the path from there to ``?``, ``#`` or the end.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest) + 1)
    return _lower(host), F.regexp_extract(tail, r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, both null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _levels(host: Column, two_labels: tuple[str, ...] = TWO_LABELS) -> list[Column]:
    """Host, registered domain and suffix; user and port belong to neither of the last two.

    The suffix is the last label, or the last two where ``two_labels`` lists
    them; the domain has one label more. Numeric addresses are their own domain
    and suffix.
    """
    site = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(site, r"\.")

    def last(n: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")

    wide = F.when((F.size(labels) > 1) & last(F.lit(2)).isin(*two_labels), F.lit(2)).otherwise(F.lit(1))
    number = site.rlike("^[0-9.]+$")
    return [host, F.when(number, site).otherwise(last(wide + 1)), F.when(number, site).otherwise(last(wide))]


def _strength() -> Column:
    """Prior strength of a level by moments: between-member variance against binomial noise."""
    p, n = F.col("good") / F.col("n"), F.col("n")
    m = F.sum("good") / F.sum("n")
    noise = m * (1 - m)
    spread = F.sum(n * (p - F.col("overall")) * (p - F.col("overall"))) / F.sum("n")
    # E[spread] = noise * (k + share) / (k + 1) with share = members / pages.
    share = F.count("*") / F.sum("n")
    k = (noise - spread) / (spread - noise * share)
    return F.when(spread > noise * share, F.least(F.greatest(k, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))).otherwise(F.lit(MAX_STRENGTH))


def host_reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, good, posterior, bound) for every host of ``hosts``.

    ``outcomes``: (host, good) of labelled pages, good 0 or 1. Without any
    outcome the posterior is 0.5 with the weakest prior.
    """
    counts = outcomes.filter("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    known = hosts.select("host").distinct().join(counts, "host", "left").fillna(0, ["n", "good"])
    h, d, s = _levels(F.col("host"))
    tree = known.select("host", d.alias("domain"), s.alias("suffix"), "n", "good")
    tree = materialize(tree, "hosts")
    # Four numbers are fitted: the overall rate and a prior strength per level.
    overall = tree.agg(F.coalesce(F.sum("good") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.5)).alias("overall")).first()["overall"]

    def strength(level: str) -> Column:
        members = tree.filter("n > 0").groupBy(level).agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("overall", F.lit(overall))
        return F.lit(members.agg(F.coalesce(_strength(), F.lit(MIN_STRENGTH)).alias("k")).first()["k"])

    ks, kd, kh = strength("suffix"), strength("domain"), strength("host")
    suffix = tree.groupBy("suffix").agg(F.sum("n").alias("ns"), F.sum("good").alias("gs"))
    domain = tree.groupBy("domain").agg(F.sum("n").alias("nd"), F.sum("good").alias("gd"))
    all_ = tree.join(suffix, "suffix").join(domain, "domain")
    ps = (F.col("gs") + ks * F.lit(overall)) / (F.col("ns") + ks)
    pd = (F.col("gd") + kd * ps) / (F.col("nd") + kd)
    a = F.col("good") + kh * pd
    size = F.col("n") + kh
    mean = a / size
    bound = mean - F.lit(Z) * F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) / (size + 1))
    return all_.select("host", "n", "good", mean.alias("posterior"), bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, posterior, bound), one row per page row.

    ``outcomes``: (page_id, good). A rule's verdict stands; else the host's
    bound decides. Null or malformed urls share the empty host. Pages whose
    id repeats or is null are judged by their url like any other; an outcome
    counts once for each page row with its id. Other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    marked = rows.select("page_id", "host").join(outcomes.select("page_id", "good"), "page_id").select("host", "good")
    reputation = host_reputation(rows, marked).select("host", "posterior", "bound")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    earned = F.when(F.col("bound") >= FLOOR, F.lit("allow")).otherwise(F.lit("block"))
    return rows.join(reputation, "host").select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, earned).alias("verdict"), "posterior", "bound")


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): the quality label of the document a page shows.

    The document is the number after the language in the path (``/en/123``).
    """
    _, path = url_parts(F.col("url"))
    doc = F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})", 1)
    shown = pages.select("page_id", F.when(doc != "", doc.cast("long")).alias("doc_id")).distinct()
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("good"))
    return shown.join(good, "doc_id").groupBy("page_id").agg(F.min("good").alias("good"))
