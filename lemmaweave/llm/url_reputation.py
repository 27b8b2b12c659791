"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted at three levels: host, registered domain
and suffix.  Each level is a beta-binomial whose prior mean is the posterior
mean of the level above and whose prior strength is fitted by moments over all
groups of that level.  A url is blocked when the lower posterior bound of its
host's bad rate, a quantile of the Beta posterior, exceeds the bad rate of all
labelled pages: that is, when the posterior holds with a given probability that
the host is worse than that.  Hand-written rules, where one fits, win.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and takes the verdict of the root prior.  Repeated rows are judged
each on their own.  No labels at all: the root rate is its prior mean.  An
empty table gives an empty table.  Input columns other than the key and url are
not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: Two-label public suffixes known to the default settings (fixed values).
TWO_LABEL_SUFFIXES = ("co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
#: (host, path, verdict): fixed values of the production rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Reputation:
    """Settings of the method: root prior (bad, good), strength limits, and when to block.

    A host is blocked if its bad rate exceeds ratio times the root rate with the given probability, so
    the (1 - probability) quantile of its posterior is the bound.
    """

    root_bad: float = 1.0
    root_good: float = 9.0
    ratio: float = 1.0
    probability: float = 0.95
    min_strength: float = 2.0
    max_strength: float = 1000.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shrunk(groups: DataFrame, key: str, prior: Column, s: Reputation) -> DataFrame:
    """Posterior of each group; strength by the method of moments over the level.

    The strength is a one-row aggregate; it is joined by a constant key.
    """
    own = groups.withColumn("prior_mean", prior)
    mean = F.col("prior_mean")
    rate = F.col("bad") / F.col("n")
    #: Between-group variance beyond binomial noise, relative to the largest it can be.
    fit = own.where("n > 1").agg(
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread"),
        F.sum(mean * (1 - mean)).alias("noise"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("most"),
    )
    rho = (F.col("spread") - F.col("noise")) / F.nullif(F.col("most") - F.col("noise"), F.lit(0.0))
    strength = fit.select(
        F.when(rho.isNull(), F.lit(s.max_strength))
        .otherwise(F.greatest(F.lit(s.min_strength), F.least(F.lit(s.max_strength), 1 / F.greatest(rho, F.lit(1e-9)) - 1)))
        .alias("strength")
    )
    out = own.crossJoin(F.broadcast(strength))  # exactly one row
    a = F.col("strength") * mean + F.col("bad")
    b = F.col("strength") * (1 - mean) + F.col("n") - F.col("bad")
    return cut(out.select(*groups.columns, (a / (a + b)).alias(f"{key}_mean"), (a + b).alias(f"{key}_weight")))


def host_reputation(outcomes: DataFrame, settings: Reputation = Reputation()) -> dict[str, DataFrame]:
    """Posterior tables by level from outcomes(host, bad 0/1).

    One shuffle by host; what follows works on a checkpointed row per host or fewer.
    """
    s = settings
    hosts = cut(
        outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = suffixes.agg(
        ((F.coalesce(F.sum("bad"), F.lit(0.0)) + s.root_bad) / (F.coalesce(F.sum("n"), F.lit(0.0)) + s.root_bad + s.root_good)).alias("root_mean")
    )
    suffix_post = _shrunk(suffixes.crossJoin(F.broadcast(root)), "suffix", F.col("root_mean"), s)
    up = suffix_post.select("suffix", "suffix_mean")
    domain_post = _shrunk(domains.join(up, "suffix"), "domain", F.col("suffix_mean"), s)
    up = domain_post.select("domain", "domain_mean")
    host_post = _shrunk(hosts.join(up, "domain"), "host", F.col("domain_mean"), s)
    return {"root": root, "suffix": suffix_post, "domain": domain_post, "host": host_post}


#: points of a midpoint sum, and its reach in standard deviations of the log odds
POINTS, REACH = 200, 12.0


def worse_than(mean: Column, weight: Column, rate: Column) -> Column:
    """Probability that a Beta posterior of that mean and weight lies above the rate.

    On log odds u the density is exp(a u) / (1 + exp(u)) ** (a + b), one smooth hill: two midpoint
    sums, left and right of the rate, and the exponential tails beyond their reach.
    """
    a, b = mean * weight, (1 - mean) * weight
    sd, top = F.sqrt(1 / a + 1 / b), F.log(a / b)
    lo, hi = top - REACH * sd, top + REACH * sd
    cut_at = F.least(F.greatest(F.log(rate / (1 - rate)), lo), hi)
    height = lambda u: a * u - (a + b) * F.log1p(F.exp(u))
    peak = height(top)

    def part(start: Column, end: Column) -> Column:
        step = (end - start) / POINTS
        return step * F.aggregate(F.sequence(F.lit(0), F.lit(POINTS - 1)), F.lit(0.0), lambda total, i: total + F.exp(height(start + (i + 0.5) * step) - peak))

    below = part(lo, cut_at) + F.exp(height(lo) - peak) / a
    above = part(cut_at, hi) + F.exp(height(hi) - peak) / b
    return above / (above + below)


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES, settings: Reputation = Reputation(), key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and worse (the probability that the host is worse than the root rate) of every url.

    Verdicts are decided once per distinct host that has labels (or whose domain
    or suffix has) and joined back by host; the pages of a hot host are dealt.
    """
    s = settings
    posts = host_reputation(outcomes, s)
    judged = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = (
        judged.select("host").distinct()
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
        .join(posts["host"].select("host", "host_mean", "host_weight"), "host", "left")
        .join(posts["domain"].select("domain", "domain_mean", "domain_weight"), "domain", "left")
        .join(posts["suffix"].select("suffix", "suffix_mean", "suffix_weight"), "suffix", "left")
        .crossJoin(F.broadcast(posts["root"]))
    )
    mean = F.coalesce("host_mean", "domain_mean", "suffix_mean", "root_mean")
    weight = F.coalesce("host_weight", "domain_weight", "suffix_weight", F.lit(s.root_bad + s.root_good))
    hosts = hosts.select("host", mean.alias("_m"), weight.alias("_w"), F.least(s.ratio * F.col("root_mean"), F.lit(1 - 1e-9)).alias("_rate"))
    hosts = hosts.select("host", worse_than(F.col("_m"), F.col("_w"), F.col("_rate")).alias("worse"))
    fit = rule_verdict(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("worse") >= s.probability, F.lit("block")).otherwise(F.lit("allow"))
    return (
        spread_join(judged, hosts, ["host"], [key, "path"])
        .withColumn("_fit", fit)
        .select(key, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", method).alias("verdict"), "worse")
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose path carries the number of a labelled document: bad if its quality is 0."""
    number = F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]+)', 1), '') as bigint)")
    seen = pages.select(host_of(F.col("url")).alias("host"), number.alias("label_doc"))
    marks = labels.select(F.col("doc_id").alias("label_doc"), F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0).alias("bad")).where("label_doc is not null")
    return seen.join(marks, "label_doc").select("host", "bad")
