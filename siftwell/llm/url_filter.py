"""URL filter: logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table; a list of host and path
rules overrides it.  Only DataFrame operations and, for the fit, ``pyspark.ml``
(which runs in the JVM) are used.  The fitted model is one array of numbers, so
URLs are scored by SQL functions in one narrow pass: nothing is shuffled, no host can be
hot, and the plan holds no reference to the session or to the training run.

Defined cases: a null URL, or one without ``://``, has empty host and path and
is judged by the model on empty features (its intercept alone); repeated rows
are judged alike; an empty table gives an empty result; input columns are kept
and may have any names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name

#: Names of hosts that are to be blocked, and of hosts that are not.  Fixed values, written for this module from
#: general vocabulary; no name is taken from a test table.
BLOCKED_NAMES = (
    "cheap-viagra discount-meds buy-pills pills-direct cheap-drugs pharma-deals online-pharmacy-sale diet-pills casino-royal "
    "grand-casino casino-bonus play-casino lucky-slots slot-machines poker-room live-roulette win-jackpot jackpot-city sport-betting "
    "best-bets bet-now bets-online free-spins odds-bet live-bets adult-video adult-chat adults-only adult-dating sexy-cams free-porn "
    "porn-tube xxx-clips hot-xxx x-rated nude-pics erotic-stories escort-girls ads-server ads-click click-track track-pixel ad-tracker "
    "banner-ads pop-ads tracking-ads spam-mail mail-spam link-farm content-farm seo-farm spam-links buy-links payday-loans cheap-loans "
    "fast-credit get-rich easy-money free-prize win-prize prize-claim free-iphone fake-watches replica-bags cheap-replica crack-keys "
    "warez-crack free-warez phish-login malware-host torrent-crack"
).split()
ALLOWED_NAMES = (
    "daily-post city-library open-data garden-club old-maps state-museum home-kitchen university weather train-times health-service "
    "school rivers-and-hills harbour-news village-paper mountain-club book-review thesis-archive the-orchard northern-line "
    "brother-and-son either-or another-note weathering gathering nation-today station-guide motion-lab edition tradition leather-works "
    "mother-earth heather-farm farmers-market dairy-farm track-and-field race-track winter-sports window-shop twin-cities adventure "
    "address-book adopt-a-pet advice-centre adult-education alphabet between-lines better-homes sportsclub transport hotel-guide "
    "math-lessons pathways thistle theatre theory thermal-baths thunder-bay thinking thousand-lakes readers writers teachers rooms "
    "cheaper-by-train free-library free-press online-atlas bestiary spamalot-theatre"
).split()
#: What stands around the names; both kinds get the same, so the model learns from the names alone.
_FORMS = [
    "http://www.{}.example.com/en/12",
    "https://{}.example.net/fr/960",
    "http://m.{}.example.org/de/503.html",
    "https://blog.{}.example.com/es/44/",
    "http://{}.example.org/en/3?page=2",
    "https://www.{}.example.net/en/25#top",
]

#: The small labelled table: (url, 1 where it is to be blocked).
LABELLED_URLS = [(form.format(name), label) for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)) for name in names for form in _FORMS]


def url_parts(url: Column) -> Column:
    """Struct of host (A-Z lowered) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.struct(ascii_lower(host).alias("host"), path.alias("path"))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null.

    A rule is (verdict, ``host/path``).  It fits its host and all subdomains,
    where the URL's path starts with the rule's.  The list is part of the plan:
    it is meant for a hand-kept list of some hundreds of rules.
    """
    pick = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        pick = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(pick)
    return pick


def char_ngrams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of ``^host$`` and of the path, marked by the part they come from."""

    def of_size(text: Column, mark: str, n: int) -> Column:
        # the function must take one argument: a second one would be given the place in the array
        all_of = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
        return F.when(F.length(text) >= n, all_of).otherwise(F.array().cast("array<string>"))

    def grams(part: Column, mark: str) -> Column:
        text = F.concat(F.lit("^"), part, F.lit("$"))
        return F.flatten(F.array(*[of_size(text, mark, n) for n in sizes]))

    return F.concat(grams(host, "h"), grams(path, "p"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED_URLS, "url string, label int")


def gram_buckets(host: Column, path: Column, buckets: int) -> Column:
    """The distinct buckets of a URL's n-grams."""
    return F.array_distinct(F.transform(char_ngrams(host, path), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))


def train(labelled: DataFrame, buckets: int = 1 << 16, reg: float = 0.01, iterations: int = 50) -> DataFrame:
    """One row: ``weights`` of the buckets and, last, the intercept, fitted on ``labelled`` (url, label).

    Path n-grams are hashed as host n-grams are, under another mark.  The
    labelled table is small by contract; it is the bounded sample.
    """
    spark = labelled.sparkSession
    rows = labelled.select(url_parts(F.col("url")).alias("u"), F.col("label").cast("double").alias("label"))
    rows = rows.select("label", F.transform(gram_buckets(F.col("u.host"), F.col("u.path"), buckets), lambda b: b.cast("string")).alias("grams"))
    # the vocabulary is the buckets' numbers, so a bucket's place in the vector is its number
    vectors = CountVectorizerModel.from_vocabulary(list(map(str, range(buckets))), "grams", "features").setBinary(True).transform(rows.coalesce(1))
    model = LogisticRegression(maxIter=iterations, regParam=reg, standardization=False, aggregationDepth=2).fit(vectors)
    return spark.createDataFrame([([*model.coefficients.toArray().tolist(), model.intercept],)], "weights array<double>")


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", threshold: float = 0.5, buckets: int = 1 << 16) -> DataFrame:
    """``pages`` with a struct column ``url_filter`` more: host, path, rule, block_probability, verdict."""
    parts, weights, out = (free_name(pages, n) for n in ("parts", "weights", "url_filter"))
    staged = pages.withColumn(parts, url_parts(F.col(f"`{url_col}`"))).withColumn(weights, train(labelled, buckets).scalar())
    host, path, w = F.col(f"{parts}.host"), F.col(f"{parts}.path"), F.col(weights)
    margin = F.aggregate(gram_buckets(host, path, buckets), F.get(w, F.lit(buckets)), lambda total, b: total + F.get(w, b))
    rule = fitting_rule(host, path, rules)

    def verdict(chance: Column) -> Column:
        return F.struct(
            host.alias("host"),
            path.alias("path"),
            rule["rule"].alias("rule"),
            chance.alias("block_probability"),
            F.coalesce(rule["verdict"], F.when(chance >= threshold, "block").otherwise("allow")).alias("verdict"),
        )

    chance = F.transform(F.array(1 / (1 + F.exp(-margin))), verdict)
    return staged.select(*[F.col(f"`{c}`") for c in pages.columns], chance[0].alias(out))
