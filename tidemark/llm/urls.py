"""URL filter: rules by host and path, and a classifier for the URLs that no rule covers.

The classifier is a logistic regression on hashed character n-grams of host and path, fitted to
a small labelled URL table by Spark ML. Everything runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4, 5)
FEATURES = 1 << 16

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

# The labelled URL table.
BLOCKED_URLS = (
    "http://ads.trackclick.example/banner/728x90?cid=1", "https://adserver.popunder.example/serve/ad.js", "http://click.affiliate-offers.example/redirect/9981",
    "https://win-free-prizes.example/claim/iphone", "http://cheap-pills-online.example/buy/viagra", "https://casino-bonus.example/slots/free-spins",
    "http://poker-betting.example/live/odds", "https://payday-loans-fast.example/apply/now", "http://replica-watches.example/sale/rolex",
    "https://download-cracked.example/keygen/serial", "http://torrent-warez.example/download/movie", "https://xxx-cams.example/live/adult",
    "http://adult-dating.example/hookup/local", "https://pixel.tracker.example/collect/beacon.gif", "http://doubleclick-ads.example/adview/impression",
    "https://spam-seo-links.example/tag/cheap-backlinks", "http://free-download.example/setup/installer.exe", "https://login-verify-account.example/secure/password",
    "http://crypto-giveaway.example/bitcoin/double", "https://miracle-diet.example/weight-loss/pills", "http://online-casino.example/roulette/jackpot",
    "https://coupon-clicks.example/offer/redirect", "http://essay-writing-cheap.example/order/now", "https://porn-videos.example/free/adult/xxx",
    "http://popup-ads.example/banner/click", "https://lottery-winner.example/claim/prize", "http://pharmacy-discount.example/buy/pills/online",
    "https://stats.tracker.example/pixel/track", "http://bet-odds.example/sports/betting/bonus", "https://shop.cheap-replica.example/cart/checkout",
)
ALLOWED_URLS = (
    "https://en.encyclopedia.example/wiki/Graph_theory", "https://www.daily-news.example/2023/05/article.html", "https://docs.library.example/en/latest/guide.html",
    "https://blog.research.example/posts/117", "http://www.university.example/physics/lectures", "https://forum.gardening.example/topic/4411",
    "https://journal.history.example/volume/12/paper.html", "https://recipes.kitchen.example/soup/tomato", "https://museum.art.example/collection/1882",
    "https://m.weather.example/en/5521", "https://www.school.example/de/kurse/34", "https://blog.travel.example/fr/voyage/91",
    "http://wiki.software.example/manual/chapter3.html", "https://www.city.example/es/noticias/218", "https://archive.books.example/text/moby/12",
    "https://www.science.example/en/79911.html", "http://blog.teacher.example/en/1204", "https://m.magazine.example/de/5502",
    "https://www.cinema.example/review/1994", "http://www.garden.example/en/880/", "https://maths.example/proofs/pythagoras",
    "https://blog.code.example/en/python/331", "http://m.stories.example/fr/60412", "https://www.health.example/article/sleep",
    "https://data.example/tables/rainfall", "http://www.parliament.example/debates/2019/44", "https://blog.music.example/es/1203",
    "https://www.animals.example/birds/owl", "http://texts.example/en/poem/17", "https://www.railway.example/history/steam",
)


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _runs(framed: Column, mark: str, n: int) -> Column:
    """Runs of ``n`` characters with the mark in front; none if the text is shorter."""
    last = F.length(framed) - (n - 1)
    found = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))
    return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))


def _grams(text: Column, mark: str) -> Column:
    """All n-grams of a text between boundary signs, marked with their part of the URL."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    return F.flatten(F.array(*[_runs(framed, mark, n) for n in GRAMS]))


def features(rows: DataFrame, size: int = FEATURES) -> DataFrame:
    """Adds ``features``: which hashed n-grams ``host`` and ``path`` hold."""
    grams = F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p"))
    hashing = HashingTF(inputCol="_grams", outputCol="features", numFeatures=size, binary=True)
    return hashing.transform(rows.withColumn("_grams", grams)).drop("_grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, label``: the table in this module; label 1 is for URLs to block."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for y, urls in ((1, BLOCKED_URLS), (0, ALLOWED_URLS)) for u in urls]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.url", "r.label")


def fit(labelled: DataFrame, regularisation: float = 0.02, rounds: int = 40) -> LogisticRegressionModel:
    """Logistic regression on ``url`` and ``label``."""
    parts = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
    known = features(parts).select("features", "label").coalesce(1)
    return LogisticRegression(regParam=regularisation, maxIter=rounds, standardization=False).fit(known)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else null; of equally long ones block goes first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in reversed(ordered):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Verdict on every page: ``page_id, host, path, rule, verdict, score``.

    ``pages`` needs ``page_id`` and ``url``; other columns are ignored. One row per input row comes
    back, repeated rows too. A null or malformed URL has an empty host and path; no rule fits it,
    as every rule's path starts with a slash. ``score`` is the classifier's probability of
    blocking, also where a rule decides; without a rule the page is blocked from ``threshold`` on.
    An empty table gives no rows. ``labelled`` (``url``, ``label``) replaces the small built-in table.
    """
    model = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    model = model.setFeaturesCol("features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_class")
    url = F.col("url")
    parts = pick(pages, "page_id", "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.transform(features(parts))
    score = vector_to_array("_probability")[1]
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(score >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round(score, 9).alias("score"))
