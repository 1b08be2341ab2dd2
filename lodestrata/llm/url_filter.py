"""URL filter: host/path rules, then a logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table by Spark's own logistic
regression and applied as one SQL expression over a weight array of fixed size,
so no Python runs on executors.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that unwanted hosts are named by, of the kinds that public block lists have.
BLOCKED_WORDS = {
    "gambling": ("casino", "poker", "roulette", "blackjack", "bingo", "jackpot", "slots", "betting", "wager", "lotto", "sportsbook"),
    "medicine": ("pills", "pharmacy", "viagra", "cialis", "meds", "tablets", "steroids", "drugstore", "slimming", "painkiller"),
    "adult": ("adult", "porn", "sex", "xxx", "cams", "escorts", "nude", "erotic", "swingers", "camgirls"),
    "advertising": ("ads", "adserver", "banner", "popup", "tracker", "track", "tracking", "clicks", "affiliate", "pixel"),
    "spam": ("spam", "bulkmail", "linkfarm", "backlinks", "replica", "payday", "loans", "getrich", "doorway", "cracks"),
}
#: Words that both kinds of hosts are named by, and those of ordinary ones.
COMMON_WORDS = ("free", "best", "online", "top", "hot", "live", "my", "the", "all", "world", "city", "net", "pro", "club", "shop", "24", "365")
ALLOWED_WORDS = (
    "library museum university school hospital council weather news garden recipes history science travel music books archive maps sports health "
    "kitchen village theatre football railway astronomy physics chemistry poetry painting bicycle hiking knitting woodwork parents cinema radio "
    "journal institute academy college parish harbour forest river mountain island market bakery coffee bread cheese flowers birds horses dogs "
    "software code linux kernel compiler database network hardware robotics wiki forum blog notes diary press times post herald gazette tribune"
).split()
_SUBDOMAINS = ("", "", "www.", "www.", "m.", "blog.", "shop.", "en.", "static.", "home.")
_ENDINGS = ("com", "com", "net", "org", "info", "io", "co.uk", "de", "fr", "es", "it", "eu", "ru", "biz")
_LETTERS = ("b c d f g h j k l m n p r s t v w z ch sh th st tr br gr pl kr".split(), "a e i o u ai ea ou io ee".split(), ["", "", "n", "r", "s", "l", "m", "t", "nd", "st", "ng", "ck"])


def invented_name(rng: random.Random) -> str:
    """A pronounceable word of two to four syllables."""
    return "".join(rng.choice(part) for _ in range(rng.randint(2, 4)) for part in _LETTERS)


def labelled_rows(names: int = 3000, seed: int = 5, blocked: dict[str, tuple] = BLOCKED_WORDS, allowed: list[str] = ALLOWED_WORDS) -> list[tuple[str, int]]:
    """The built-in labelled table (url, label), ``names`` of each label; 1 is block.

    Hosts are made by rule: an unwanted one has one or two of the words of its
    kind, an ordinary one a plain word, two, or an invented name; words that both
    have may stand before or after. Endings and paths are alike for both.
    """
    rng = random.Random(seed)
    plain = [*ALLOWED_WORDS, *COMMON_WORDS]
    path = lambda: rng.choice([lambda: "", lambda: "/", lambda: "/index.html", lambda: f"/{rng.choice(plain)}", lambda: f"/{invented_name(rng)}/{rng.randrange(9999)}", lambda: f"/{rng.choice(['en', 'de', 'fr', 'es', 'it'])}/{rng.randrange(9999)}.html", lambda: f"/{rng.randrange(1995, 2026)}/{rng.randrange(1, 13):02}/{rng.choice(plain)}-{rng.choice(plain)}", lambda: f"/{rng.choice(plain)}/{rng.choice(plain)}?id={rng.randrange(99)}", lambda: f"/{rng.choice(['item', 'page', 'p', 'article'])}/{rng.randrange(99999)}#top"])()
    rows = []
    for label in (1, 0):
        for _ in range(names):
            if label:
                words = rng.choice(list(blocked.values()))
                parts = [rng.choice(words)] + ([rng.choice(words)] if rng.random() < 0.2 else [])
            else:
                draw = rng.random()
                parts = [invented_name(rng)] if draw < 0.55 else [rng.choice(allowed)] if draw < 0.8 else [rng.choice(allowed), rng.choice(allowed)]
            if rng.random() < 0.5:
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(COMMON_WORDS) if rng.random() < 0.7 else invented_name(rng)[:5])
            name = rng.choice(["", "-", "-"]).join(parts)
            rows.append((f"http{rng.choice(['', 's'])}://{rng.choice(_SUBDOMAINS)}{name}.{rng.choice(_ENDINGS)}{path()}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``labelled_rows`` as a table."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        h, slash, p = text.partition("/")
        return cls(h, slash + p, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


def matched_rule(host_col: Column, path_col: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls. Ties go to the first in order of text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host_col == r.host) | host_col.endswith("." + r.host)) & path_col.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class NgramModel:
    """Logistic regression over the hashed n-grams of host and path, each n-gram counted once."""

    weights: list[float] = field(repr=False)
    bias: float
    sizes: tuple[int, ...] = (3, 4, 5)

    def probability(self, host_col: Column, path_col: Column) -> Column:
        # one literal that folds to an array, so that the plan stays small
        weights = F.split(F.lit(" ".join(map(repr, self.weights))), " ").cast("array<double>")
        z = _once(buckets(host_col, path_col, len(self.weights), self.sizes), lambda hits: F.lit(self.bias) + _total(weights, hits) / F.sqrt(F.greatest(F.size(hits), F.lit(1)).cast("double")))
        return 1 / (1 + F.exp(-z))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, not for each element of a function within."""
    return F.get(F.transform(F.array(value), use), 0)


def _hashed(signs: Column, tag: str, n: int, dims: int) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(signs) - n, F.lit(0)))
    return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.concat(*(F.coalesce(F.get(signs, i + k), F.lit("")) for k in range(n)))), F.lit(dims)).cast("int"))


def _total(weights: Column, hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda s, k: s + F.get(weights, k))


def buckets(host_col: Column, path_col: Column, dims: int, sizes: tuple[int, ...]) -> Column:
    """Distinct buckets of the character n-grams of ``^host$`` and ``^path$``; digits of the path count as one sign."""
    whole = {"h": F.concat(F.lit("^"), host_col, F.lit("$")), "p": F.concat(F.lit("^"), F.regexp_replace(path_col, "[0-9]+", "0"), F.lit("$"))}
    # cut into signs once: a long path takes time in proportion to its length
    every = lambda tag: lambda signs: F.concat(*(_hashed(signs, tag, n, dims) for n in sizes))
    grams = (_once(F.split(text, ""), every(tag)) for tag, text in whole.items())
    return F.array_distinct(F.concat(*grams))


def train(labelled: DataFrame, dims: int = 2048, sizes: tuple[int, ...] = (3, 4, 5), steps: int = 100, l2: float = 0.001, max_rows: int = 10_000) -> NgramModel:
    """Fit by L-BFGS over a sparse row of 0/1 bucket marks a url, scaled to length 1 as in ``NgramModel``.

    ``labelled`` (url, label 0/1) must hold at most ``max_rows`` rows: it is the
    small table that the method names. Null labels are left out; without both
    labels the model has no weights to learn and says 0.5. Only the weights,
    ``dims`` numbers, come to the driver.
    """
    if labelled.count() > max_rows:
        raise ValueError(f"the labelled table has more than {max_rows} rows")
    rows = labelled.filter("label is not null").select(F.col("label").cast("double").alias("label"), buckets(host(F.col("url")), path(F.col("url")), dims, sizes).cast("array<string>").alias("hits"))
    if rows.select("label").distinct().count() < 2:
        return NgramModel([0.0] * dims, 0.0, sizes)
    marks = CountVectorizerModel.from_vocabulary([str(k) for k in range(dims)], inputCol="hits", outputCol="marks", binary=True)
    scaled = Normalizer(inputCol="marks", outputCol="features", p=2.0).transform(marks.transform(rows)).select("label", "features")
    fitted = LogisticRegression(maxIter=steps, regParam=l2, standardization=False).fit(scaled.coalesce(1))
    return NgramModel([float(x) for x in fitted.coefficients], float(fitted.intercept), sizes)


def filter_urls(pages: DataFrame, rules: list[Rule], model: NgramModel, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and is judged
    by the model. Repeated rows are judged alike; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    p = model.probability(F.col("host"), F.col("path"))
    return rows.select("*", rule.alias("rule"), verdict.alias("__ruled"), p.alias("block_probability")).select(
        "page_id", "host", "path", "rule", F.coalesce("__ruled", F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")).alias("verdict"), "block_probability"
    )
