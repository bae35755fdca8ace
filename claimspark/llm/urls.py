"""URL filters: rules of hosts and paths, and logistic regression for urls that no rule decides.

The regression reads hashed character n-grams of the host and of the path and is trained from a small
labelled URL table. Columns and Spark ML only: a url is judged within its row, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
GRAMS = (3, 4)
REGULARISATION = 0.02
ROUNDS = 40
THRESHOLD = 0.5
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Decides urls of ``host`` and its subdomains whose path begins with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the query has to apply.
RULES = (
    Rule(ALLOW, "com"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)

#: The default labelled table, written for this library: names of hosts and words of paths to block and to keep. Both
#: kinds get the same prefixes, endings and neutral paths in turn, so that nothing is learned from those.
UNWANTED = """
best-casino casino-royal online-casino winbig live-bets sportbets freebet bets24 poker-win lucky-slots free-spins cheap-meds
pills-direct buy-pills cheap-viagra discount-pharmacy diet-pills cheapwatches replica-bags adult-videos hot-adult-dating xxx-cams
adultfinder sex-x ads-server ads-click adserver popup-ads ad-track tracker-pixel link-farm spam-links spamsite seo-farm farm-spam
content-farm payday-loans free-money get-rich-quick warez-crack free-iphone casinobonus pillsonline adult-zone trackads
"""
WANTED = """
daily-news city-herald gardening encyclopedia compiler-manual university town-library kitchen-recipes weather-office museum
cycling-forum travel-notes parliament ministry-of-health mathematics astronomy open-source bookstore railway music-review
high-court statistics letters photography cuentos farm-journal athletics children python-guide windmill better-schools pillars
hospital theatre grammar-course otter-zoo savings-bank chess-openings rivers-and-maps the-historian orchestra the-thames lectures
northern-line the-other-side thunder-bay then-and-now nation wharton heather thornton anderson stone-theory leather brother
tension-test ownership friendship noble-table thinly worthwhile enthusiast rest-area onward hereafter sonata ration edition
tintin-comics ensemble readership harvest estuary attention handbook mentor interview entry thread oriental real-estate reading
"""
UNWANTED_PATHS = "casino/bonus jackpot/win bets/odds buy/pills cheap/order xxx/free adult/video ads/redirect track/pixel spam/links"
WANTED_PATHS = "world/politics wiki/plants research/physics catalogue/history forum/thread article/report docs/manual maps/rivers"
_PREFIXES, _ENDINGS = ("", "www.", "blog.", "m."), ("com", "net", "org", "example.com", "example.net", "example.org")
_NEUTRAL = ("en/12", "fr/345", "de/67.html", "es/8901/", "en/2?page=2", "")


def _table() -> list[tuple[str, int]]:
    """Each name with a neutral path, and each name again with a path of its kind."""
    out = []
    for label, names, paths in ((1, UNWANTED.split(), UNWANTED_PATHS.split()), (0, WANTED.split(), WANTED_PATHS.split())):
        for i, name in enumerate(names):
            for k, path in ((i, _NEUTRAL[i % 6]), (i + 1, paths[i % len(paths)])):
                out.append((f"https://{_PREFIXES[k % 4]}{name}.{_ENDINGS[(k // 4 + k) % 6]}/{path}", label))
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: ``url, label`` (1: block)."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in _table()]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def host(url: Column) -> Column:
    """From after the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z in lower case; '' without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the end of the host to the next ``?`` or ``#``; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The name of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def _featured(df: DataFrame, host: Column, path: Column, *keep: Column) -> DataFrame:
    """``keep`` and ``_features``: hashed n-grams of host and path, each between two marks that tell them apart.

    A number in a path is one digit. Linear in the url.
    """
    texts = {"<": host, ">": F.regexp_replace(F.translate(path, _UPPER, _LOWER), "[0-9]+", "0")}
    rows = df.select(*keep, *(_characters(mark, text).alias(f"_chars{k}") for k, (mark, text) in enumerate(texts.items())))
    found = []
    for k, mark in enumerate(texts):
        for n in GRAMS:
            rows = NGram(n=n, inputCol=f"_chars{k}", outputCol=f"_grams{k}_{n}").transform(rows)
            found.append(_marked(mark, F.col(f"_grams{k}_{n}")))
    rows = rows.withColumn("_grams", F.concat(*found))
    rows = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features").transform(rows)
    return rows.select(*(c for c in rows.columns if not c.startswith(("_chars", "_grams"))))


def _marked(mark: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(mark), g))


def _characters(mark: str, text: Column) -> Column:
    """The characters of ``text`` between two marks; none for ''."""
    chars = F.concat(F.array(F.lit(mark)), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.array(F.lit(mark)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(chars)


class Model(NamedTuple):
    regression: object | None
    base: float  # the score where there is no regression


def learn(labelled: DataFrame, url: str = "url", label: str = "label") -> Model:
    """A regression from a small table of urls and labels (1: block), of at most some thousands of rows.

    Rows without a url or label do not count, repeated rows count each. Without labels of both
    kinds, every url has the share of blocked ones as its score, 0 for an empty table.
    """
    known = labelled.select(F.col(url).alias("_u"), (F.col(label) > 0).cast("double").alias("_label")).where("_u is not null and _label is not null")
    n, blocked = known.agg(F.count("*"), F.sum("_label")).first()
    if not n or not 0 < blocked < n:
        return Model(None, (blocked or 0.0) / max(n, 1))
    weight = F.when(F.col("_label") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked)))
    rows = _featured(known, host(F.col("_u")), path(F.col("_u")), F.col("_label"), weight.alias("_weight"))
    regression = LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", regParam=REGULARISATION, standardization=False, maxIter=ROUNDS,
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
    )
    return Model(regression.fit(rows), 0.0)


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = RULES, url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``host, path, rule, url_score, verdict``.

    The longest rule that fits decides; else the regression blocks from ``threshold`` on.
    ``url_score`` is its probability of a block, for every row. Null urls, empty ones and those without
    ``://`` have empty hosts and paths, which no rule with a host fits, and the score of a url
    without n-grams. Urls of any length are read whole, in linear time; equal urls have equal
    verdicts; an empty table gives an empty one. All other columns stay, whatever their names, but
    those named like a new one are replaced.
    """
    new = ("host", "path", "rule", "url_score", "verdict")
    keep = [c for c in pages.columns if c.lower() not in new]
    # Other columns travel as one, as the names that the model adds are fixed.
    rest = F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(0).alias("\x00")).alias("_rest")
    rows = pages.select(rest, host(F.col(url)).alias("_host"), path(F.col(url)).alias("_path"))
    if model.regression is None:
        scored = rows.withColumn("_score", F.lit(model.base))
    else:
        featured = _featured(rows, F.col("_host"), F.col("_path"), F.col("_rest"), F.col("_host"), F.col("_path"))
        scored = model.regression.transform(featured).withColumn("_score", vector_to_array("_probability")[1])
    name = rule_of(F.col("_host"), F.col("_path"), rules)
    verdicts = F.lit(None).cast("string")
    for rule in rules:
        verdicts = F.when(F.col("_rule") == rule.name, F.lit(rule.verdict)).otherwise(verdicts)
    own = F.when(F.col("_score") >= threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.withColumn("_rule", name).select(
        *(F.col("_rest").getField(c).alias(c) for c in keep), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"), F.col("_score").alias("url_score"), F.coalesce(verdicts, own).alias("verdict"),
    )
