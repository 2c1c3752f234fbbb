"""URL filter: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over characters, one for accepted and one for rejected URLs, give a
log-likelihood difference, divided by the length of the URL; a threshold calibrated on the URLs decided by rules splits
it.  Everything is a DataFrame expression: counts are grouped aggregates over all decided URLs, the models tables of the grams
of each order that occur, which grow with the corpus, and shorter contexts are met by ordinary joins.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cladeframe.llm.common import free_name, stored, without

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols of folded models: letters without case, any digit, dot, slash, hyphen, any other ASCII, and all the rest (also what
#: stands before the beginning).
REST = "*"
ALPHABET = LETTERS + "0./-?" + REST
SYMBOLS = len(ALPHABET)
#: What stands before the beginning of a URL whose characters are kept: no character.
START = "\uffff"
#: Grams that make up more than one of this many places are joined by broadcast, so there are fewer of them than this.
COMMON = 2000
#: Resolution and reach of the calibration, in nats per character.
STEP, REACH = 0.01, 20.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules given for the pages table.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    h = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(h, LETTERS.upper(), LETTERS)


def path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return functools.reduce(lambda c, r: c.when(fits(r), r.name), ordered, F.when(F.lit(False), F.lit(None).cast("string")))


def symbols(url: str, order: int, folded: bool = True) -> Column:
    """A URL in symbols, or in its own characters, after ``order`` symbols for its beginning."""
    if not folded:
        return F.concat(F.lit(START * order), F.translate(F.coalesce(F.col(url), F.lit("")), START, "\ufffd"))
    plain = F.translate(F.lower(F.coalesce(F.col(url), F.lit(""))), "123456789" + REST, "0" * 9 + "?")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", REST), r"[^a-z0./?*-]", "?")
    return F.concat(F.lit(REST * order), plain)


def grams(rows: DataFrame, code: str, order: int, to: str) -> DataFrame:
    """One row per character with its gram: its context of ``order`` symbols and itself; null for an empty URL."""
    places = F.when(F.length(code) > order, F.sequence(F.lit(1), F.length(code) - order))
    return rows.withColumn(to, F.explode_outer(places)).withColumn(to, F.substring(F.col(code), F.col(to), F.lit(order + 1)))


def joined(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the corpus, sorted on both sides.

    Spark goes by the bytes of the files, where a row of places is a few and a gram one or two; left to itself it would tell
    such a table to all tasks, and the driver would hold all of it.
    """
    return a.join(b.hint("merge"), on, how)


def model(urls: DataFrame, order: int, symbols: int | None) -> DataFrame:
    """(g, n, difference, own1, own0) of every gram of ``order`` + 1 characters in ``code`` of ``urls``.

    ``difference`` is log P(accepted) - log P(rejected) of the last character after the ones before it, learnt from the URLs
    with ``accepted``; in the others it is null and only their grams count.  Each order mixes its relative frequencies with the next
    lower order's by the number of different characters seen in the context (Witten and Bell); below order 0 stands the uniform
    distribution over ``symbols`` (None: over the characters that occur).  A context that was never seen is thus judged by its
    longest seen ending.  ``own1`` and ``own0`` are the differences for a place of an accepted and a rejected URL by the counts
    without that place.
    """
    seen = grams(urls, "code", order, "g").where(F.col("g").isNotNull())
    counts = [seen.groupBy("g").agg(F.count_if("accepted").alias("c1"), F.count_if(~F.col("accepted")).alias("c0"), F.count(F.lit(1)).alias("n"))]
    counts[0] = stored(counts[0], "grams")
    for k in range(order, 0, -1):  # every place has one gram of each order, so shorter ones are sums over longer ones
        counts.insert(0, stored(counts[0].groupBy(F.substring("g", 2, k).alias("g")).agg(*[F.sum(c).alias(c) for c in ("c1", "c0", "n")]), "grams"))
    below = None
    uniform = F.lit(1.0 / (symbols or max(1, counts[0].count())))
    for k, per in enumerate(counts):
        tot = per.groupBy(F.substring("g", 1, k).alias("x")).agg(
            *[F.sum(f"c{a}").alias(f"t{a}") for a in "10"], *[F.count_if(F.col(f"c{a}") > 0).alias(f"d{a}") for a in "10"])
        rows = joined(per.withColumn("x", F.substring("g", 1, k)), tot, "x")
        if below is None:
            rows = rows.withColumns({c: uniform for c in ("p1", "p0", "q1", "q0")})
        else:
            rows = joined(rows.withColumn("l", F.substring("g", 2, k)), below.withColumnRenamed("g", "l").drop("n"), "l")
        mixed = {}
        for a in "10":
            c, t, d, p, q = (F.col(f"{x}{a}") for x in "ctdpq")
            mixed[f"p{a}"] = F.when(t > 0, (c + d * p) / (t + d)).otherwise(p)
            rest = d - (c == 1).cast("int")
            mixed[f"q{a}"] = F.when((c > 0) & (t > 1), (c - 1 + rest * q) / (t - 1 + rest)).otherwise(q)
        below = stored(rows.withColumns(mixed).select("g", "n", "p1", "p0", "q1", "q0"), "urlmodel")
    log = {c: F.log(c) for c in ("p1", "p0", "q1", "q0")}
    return below.select("g", "n", (log["p1"] - log["p0"]).alias("difference"), (log["q1"] - log["p0"]).alias("own1"), (log["p1"] - log["q0"]).alias("own0"))


def ratios(urls: DataFrame, difference: DataFrame, order: int) -> DataFrame:
    """(row, ratio, own) of the URLs that aren't empty: mean difference per character, and for decided ones that without their own places.

    The table grows with the corpus, so places are joined to it by their gram; grams that are common (fewer than ``COMMON``)
    are joined by broadcast, as all their places would meet in one task.
    """
    places = difference.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = difference.withColumn("common", F.col("n") * COMMON > places).drop("n")
    common, others = table.where("common").drop("common"), table.where("NOT common").drop("common")
    split = grams(urls, "code", order, "g").where(F.col("g").isNotNull()).select("row", "g", "accepted")
    rare = split.join(F.broadcast(common.select("g")), "g", "left_anti")
    met = split.join(F.broadcast(common), "g").unionByName(joined(rare, others, "g"))
    own = F.when(F.col("accepted"), F.col("own1")).when(~F.col("accepted"), F.col("own0"))
    # sums in another order differ in the last places, and equal URLs shall get equal verdicts
    return met.groupBy("row").agg(F.round(F.avg("difference"), 12).alias("ratio"), F.round(F.avg(own), 12).alias("own"))


def threshold(decided: DataFrame) -> DataFrame:
    """One row: the ``threshold`` from which on a ratio counts as accepted, with the least error over both classes.

    Errors are shares of each class, taken on a grid of ``STEP`` (so in bounded memory, over every decided URL); of equally good
    thresholds the one nearest to 0, then the lower.  Without URLs of both classes it is null.
    """
    bins = int(2 * REACH / STEP)
    b = F.greatest(F.least(F.floor((F.col("ratio") + REACH) / STEP), F.lit(bins - 1)), F.lit(0)).cast("int")
    seen = decided.groupBy(b.alias("b")).agg(F.sum(F.col("accepted").cast("bigint")).alias("a"), F.sum((~F.col("accepted")).cast("bigint")).alias("r"))
    every = F.collect_list(F.struct("b", "a", "r"))
    one = seen.agg(every.alias("bins"), F.sum("a").alias("na"), F.sum("r").alias("nr"))
    sums = lambda f, below: F.aggregate(F.filter("bins", below), F.lit(0).cast("bigint"), lambda s, x: s + x[f])
    cuts = F.array_union(F.transform("bins", lambda x: x["b"]), F.transform("bins", lambda x: x["b"] + 1))
    cuts = F.array_union(cuts, F.array(F.lit(round(REACH / STEP))))  # 0 itself, as it may be in a gap

    def judged(t):
        missed, passed = sums("a", lambda x: x["b"] < t), sums("r", lambda x: x["b"] >= t)
        at = t * STEP - REACH
        return F.struct((missed / F.col("na") + passed / F.col("nr")).alias("error"), F.abs(at).alias("far"), at.alias("t"))
    best = F.array_min(F.transform(cuts, judged))["t"]
    return one.select(F.when((F.col("na") > 0) & (F.col("nr") > 0), best).alias("threshold"))


def judge(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", order: int = 2, folded: bool = True) -> DataFrame:
    """All columns but a clashing one, with ``host``, ``path``, ``rule``, ``ratio`` and ``verdict`` (allow or block).

    The longest rule that fits decides, else the ratio against the calibrated threshold.  A null or empty URL is blocked.
    If the rules leave one class without a URL, the other URLs are allowed.  Contexts have up to ``order`` characters.  ``folded``
    reads characters as ``SYMBOLS`` symbols, for small tables; else they are taken as they are, and the threshold is calibrated
    on each decided URL by counts without its own places, as long contexts know what they have learnt from.
    """
    pages = without(pages, ["host", "path", "rule", "ratio", "verdict"])
    row = free_name(pages, "row")
    ruled = pages.withColumns({"host": host(url), "path": path(url), row: F.monotonically_increasing_id()})
    ruled = stored(ruled.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    allowing = [r.name for r in rules if r.verdict == "allow"]
    accepted = F.when(F.col("rule").isNotNull(), F.col("rule").isin(allowing))
    urls = ruled.select(F.col(row).alias("row"), symbols(url, order, folded).alias("code"), accepted.alias("accepted"))
    found = stored(ratios(urls, model(urls, order, SYMBOLS if folded else None), order), "ratios")
    decided = joined(urls.where(F.col("accepted").isNotNull()).select("row", "accepted"), found, "row", "left")
    cut = threshold(decided.select("accepted", F.coalesce("ratio" if folded else "own", F.lit(0.0)).alias("ratio"))).first()
    out = joined(ruled, found.select(F.col("row").alias(row), "ratio"), row, "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    passes = F.lit(True) if cut["threshold"] is None else F.col("ratio") >= cut["threshold"]
    by_model = F.when(F.coalesce(F.col(url), F.lit("")) == "", "block").when(passes, "allow").otherwise("block")
    out = out.withColumn("verdict", F.when(F.col("rule").isNull(), by_model).when(F.col("rule").isin(allowing), "allow").otherwise("block"))
    return out.select(*[f"`{c}`" for c in pages.columns], "host", "path", "rule", "ratio", "verdict")
