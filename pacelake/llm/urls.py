"""Verdicts on URLs: rules on host and path, and a model for the rest, with DataFrame functions only.

The model is a logistic regression on hashed character n-grams of host and
path.  It is trained from a small labelled table of URLs, by default the one that
``labelled_urls`` makes.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sizes of the n-grams, and slots that they are hashed to.
GRAMS = (3, 4)
SLOTS = 4096

#: Words from which the labelled table is made, of general knowledge: subjects of ordinary sites, and trades that filters name; what may follow either in a host; prefixes, domains and paths.
#: Most names of hosts are no words, so two syllables each make further ordinary hosts. Paths of ordinary sites occur with hosts of both kinds.
GOOD_WORDS = """academy almanac archive astronomy atlas bakery biology birds books botany bridge carpentry chemistry choir church cinema city climate coffee college council court cycling dance design dictionary docs
energy farmers fire flowers football forest forum gallery garden geology geography grammar harbour health history hospital island journal kitchen knitting language law library literature magazine maps maths meadow museum music
nature news newspaper novel observatory ocean opera orchestra parliament pharmacy-school philosophy photo physics poetry pottery radio railway recipes research river school science sculpture seminar sewing software solar sports station
student studio support teacher tennis theatre travel university village violin weather wiki""".split()
BAD_WORDS = """adserver adult affiliate airdrop backlinks bets betting bingo bitcoin bonus bookie botnet casino cheap cialis clickbait clicks counterfeit crack crypto detox diploma escort essays forex free freebie giveaway hack hookup
investor jackpot keygen loans lottery lucky malware millionaire miracle nude ads painkiller payday phish pills poker pokies popups porn prizes ransom replica rolex roulette seo slots spam steroids sweepstakes
track traffic viagra warez webcam winner xxx""".split()
GOOD_ENDS = ["", "-society", "-house", "-today", "-guide", "lab", "-club", "-online"]
BAD_ENDS = ["", "-win", "-deals", "-online", "4u", "-vip", "-zone", "24"]
SYLLABLES = "ba bel co dan del fen gor hal jin ka lor mi nor pa quin ra sel sten ta tor ul vi wen zor".split()
PREFIXES, DOMAINS = ["", "www.", "blog.", "m."], ["com", "net", "org", "info"]
GOOD_PATHS = ["/about", "/guide/intro", "/articles/2020/index.html", "/papers/4217", "/events/summer", "/contact", "/item?id=9", "/", "/de/31", "/en/8", "/fr/205"]
BAD_PATHS = ["/claim-prize", "/bonus/50-spins", "/order/no-prescription", "/signin/confirm-identity"]
#: Paths of each host in the table.
PATHS = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, its A-Z lower-cased, and the path of a URL; both empty for null and without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``struct<verdict, rule>`` of the longest rule that fits, or null.

    A rule is (verdict, host + path).  It fits its host and all subdomains if the path starts with the
    rule's.  Of equally long rules the one that sorts first wins.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """All n-grams of ``^host$`` and ``^path$``, marked by where they stand."""

    def of(text: Column, mark: str, n: int) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))

    return F.concat(*(of(text, mark, n) for n in GRAMS for text, mark in ((host, "h"), (path, "p"))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, label`` (1: block), a row for each of ``PATHS`` paths of each host; prefix, domain and paths follow from the host."""

    def every(name: str, values: list[str]) -> Column:
        return F.explode(F.array(*map(F.lit, values))).alias(name)

    def made(label: float, words: list[str], ends: list[str], paths: list[str]) -> DataFrame:
        hosts = spark.range(1).select(every("w", words)).select("w", every("e", ends)).select(F.concat("w", "e").alias("h"))
        pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.crc32(F.concat("h", F.lit(salt), "k")) % len(values) + 1).cast("int"))
        out = hosts.select("h", every("k", [str(k) for k in range(PATHS)]))
        return out.select(F.concat(F.lit("https://"), pick(PREFIXES, "w"), "h", F.lit("."), pick(DOMAINS, "d"), pick(paths, "p")).alias("url"), F.lit(label).alias("label"))

    good = made(0.0, GOOD_WORDS, GOOD_ENDS, GOOD_PATHS).union(made(0.0, SYLLABLES, SYLLABLES, GOOD_PATHS))
    return good.union(made(1.0, BAD_WORDS, BAD_ENDS, GOOD_PATHS + BAD_PATHS))


def _features(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    found = urls.withColumn("host", host).withColumn("path", path)
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=SLOTS, binary=True).transform(found.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Fit the model to ``url, label``, a table that fits one task."""
    return LogisticRegression(maxIter=25, regParam=0.01, standardization=False).fit(_features(labelled.select("url", "label")).coalesce(1))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], model: LogisticRegressionModel) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages``.

    The verdict is that of the longest fitting rule, else ``block`` where the
    model's score is 0.5 or more and ``allow`` elsewhere.  Null, empty and malformed URLs have an empty
    host and path, fit no rule and are scored as such.  Repeated rows give repeated results; columns other than ``page_id`` and ``url`` are ignored.
    """
    scored = model.transform(_features(pages.select("page_id", "url")))
    found = scored.select("page_id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("found"), vector_to_array("probability")[1].alias("score"))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
