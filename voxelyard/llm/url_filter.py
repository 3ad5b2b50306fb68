"""URL filter: allow and block rules first, then a logistic regression on hashed character n-grams.

Host and path are cut from the address by DataFrame functions, and so are the n-grams, their hashes
and the score: a row's n-grams look their weights up in one array of ``BUCKETS`` numbers, whatever
the size of the table.  The model is trained in the driver, by plain gradient descent, on a
small table of labelled addresses of at most ``MOST_LABELLED`` rows, whose features come from the
same expressions.

Defined results: a null address, or one without ``://``, has an empty host and path, no rule fits
it, and the model judges it by its bias alone; a null id is carried; repeated rows are judged alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

BUCKETS = 8192
NGRAMS = (3, 4, 5)
MOST_LABELLED = 10_000
ROUNDS, RATE, SHRINK = 200, 8.0, 1e-4
#: Probability of a bad address from which it is blocked.
BLOCK_FROM = 0.5

#: (verdict, host and path); the longest that fits wins.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_GOOD_HOSTS = (
    "news daily herald times library university garden museum science journal weather report travel notes kitchen recipes history archive school district reviews music theory records "
    "health institute math forum language course watching docs council mountain transport wiki plants orchestra there other nation station heading being theater another thinking notion "
    "motion the then either mother letter water hand stand thousand under order render heritage southern northern nature gather together weather bread fresh shore tribe table cable ether "
    "haben werden zeitung stadt garten schule nachricht berlin maison jardin ecole journal lumiere casa ciudad escuela noticias tiempo"
).split()
_BAD_WORDS = "casino slots pills viagra meds bets betting adult porn xxx ads adclick track tracking tracker spam farm links prizes winner win cheap free loan payday replica warez torrent".split()
_TAILS = ("org/en/12", "net/de/article.html", "example.org/es/77", "example.com/fr/2024/")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: addresses of good (0) and bad (1) hosts under the same endings.
    Bad hosts pair two bad words, good ones are single words or pair neighbours of the list."""
    n = len(_GOOD_HOSTS)
    good = [*_GOOD_HOSTS, *(f"{_GOOD_HOSTS[k]}-{_GOOD_HOSTS[(k + 7) % n]}" for k in range(0, n, 2))]
    m = len(_BAD_WORDS)
    bad = [f"{_BAD_WORDS[k]}-{_BAD_WORDS[(k + j) % m]}" for k in range(m) for j in (1, 4, 9)]
    return [(f"https://{('', 'www.', 'm.', 'blog.')[k % 4]}{host}.{_TAILS[k // 4 % len(_TAILS)]}", label) for label, hosts in ((0, good), (1, bad)) for k, host in enumerate(hosts)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, sign: str) -> Column:
    """Hashed n-grams of one part of the address, with marks at its ends."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    parts = [
        F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i, n=n: F.pmod(F.xxhash64(F.lit(sign), F.substring(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))).otherwise(F.array().cast("array<int>"))
        for n in NGRAMS
    ]
    return F.concat(*parts)


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of an address."""
    return F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> tuple[float, list[float]]:
    """(bias, weights) of the labelled addresses."""
    rows = labelled_urls() if labelled is None else labelled
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled addresses")
    table = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("y")) for u, y in rows])).alias("r")).select("r.*")
    host, path = host_and_path(F.col("url"))
    got = table.select(host.alias("host"), path.alias("path"), "y").select(features(F.col("host"), F.col("path")).alias("x"), "y").collect()  # at most MOST_LABELLED
    bias, weights, n = 0.0, [0.0] * BUCKETS, len(got)
    used = sorted({b for r in got for b in r.x})
    for _ in range(ROUNDS):
        slope, step = dict.fromkeys(used, 0.0), 0.0
        for r in got:
            scale = 1 / math.sqrt(max(1, len(r.x)))
            error = 1 / (1 + math.exp(-(bias + scale * sum(weights[b] for b in r.x)))) - r.y
            step += error
            for b in r.x:
                slope[b] += error * scale
        bias -= RATE * step / n
        for b in used:
            weights[b] -= RATE * (slope[b] / n + SHRINK * weights[b])
    return bias, weights


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score."""
    bias, weights = train(pages.sparkSession, labelled)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        where, _, begin = text.partition("/")
        fits = ((F.col("host") == where) | F.endswith(F.col("host"), F.lit("." + where))) & F.startswith(F.col("path"), F.lit("/" + begin))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    x = F.col("_x")
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + F.get(table, b))
    score = 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(x), F.lit(1))))))
    rows = rows.withColumn("_x", features(F.col("host"), F.col("path"))).withColumn("score", score).drop("_x")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
