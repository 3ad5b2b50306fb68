"""Quality rules: fixed base rules, then robust multivariate outliers.

Each document's statistics are computed in one pass inside its row, by DataFrame functions only.
Transformed to a vector, they are held against minimum-covariance-determinant estimates, one for
each language and source, one for each language and one for all documents.  Every estimate has two
deterministic starts: medians with absolute deviations, and mean with covariance.  Concentration
steps take the ``H`` part with the smallest Mahalanobis distances and estimate centre and covariance
from it again; of the two ends the one with the least determinant stays.  Every step is two
aggregations with map-side partials (the quantile is a mergeable sketch) over all groups at once, so
a group of a third of all rows is no more than one row a task.  The covariance has a floor a feature,
distances are scaled to their expected median, and documents beyond ``CUTOFF`` are rejected.

An estimate needs ``LEAST_ROWS`` documents that pass the base rules: a document is judged by its
language and source, else by its language, else by all documents; where even these are fewer there
is no estimate and the base rules alone decide.

Defined results: a null text has no words (and fails the base rules); null language or source count
as groups of their own; a null id is carried; repeated rows are judged once each and alike; an empty
table gives no rows; other columns are ignored by ``judge`` and carried along by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
#: Words up to which a window's hash and its position share one long (48 bits of hash and more).
MANY_WORDS = 1 << 16
H = 0.75
STEPS = 5
LEAST_ROWS = 60
#: Squared distance of rejection; the 1 - 1e-12 quantile of chi-square with as many degrees of freedom as features.
CUTOFF = 65.0
#: Expected median of the squared distance (chi-square, 5 degrees of freedom).
MEDIAN = 4.3515
#: Standard deviations that every feature has at least.
FLOORS = (0.5, 0.1, 0.05, 0.5, 0.15)
#: Groups whose estimates may be broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 100_000
P = len(FLOORS)


def _repeated(words: Column, n: Column) -> Column:
    """Words within 3-word windows that occur twice or more: windows' hashes carry their position in
    the low bits, so that one sort of plain longs brings equal windows together."""
    return F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.col("_mask")).bitwiseOR(i.cast("long")))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_t", text).withColumn("_trim", F.btrim("_t", F.lit(SPACES)))
    out = out.withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPLIT)))
    out = out.withColumn("n_words", F.size("_w").cast("long")).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    out = out.withColumn("_mask", F.expr("shiftleft(-1L, length(bin(n_words)))"))
    n = F.size("_w")
    out = out.withColumn("_s", F.when(n.between(4, MANY_WORDS), F.sort_array(_repeated(F.col("_w"), n))).otherwise(F.array().cast("array<bigint>")))
    mask, s = F.col("_mask"), F.col("_s")
    top = lambda x: x.bitwiseAND(mask)
    again = F.filter(s, lambda x, k: F.coalesce(top(x) == top(F.get(s, k - 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(s, k + 1)), F.lit(False)))
    short = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.bitwise_not(mask))))
    # too many words for one long: whole hashes beside the positions
    w, same = F.col("_w"), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    whole = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("long").alias("i")))
    out = out.withColumn("_z", F.when(n > MANY_WORDS, F.sort_array(whole)))
    twice = F.filter("_z", lambda x, k: same(x, F.get("_z", k - 1)) | same(x, F.get("_z", k + 1)))
    out = out.withColumn("_at", F.when(n > MANY_WORDS, F.sort_array(F.transform(twice, lambda x: x["i"]))).otherwise(short))
    at = F.col("_at")
    gap = F.transform(at, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(x - F.get(at, k - 1), F.lit(3).cast("long"))))
    repeat = F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = (
        out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeat)
        .withColumn("base_failed", failed)
    )
    # through a generator, past which no later filter is pushed: inlined there, the arrays would be
    # made anew for each of their elements
    made = F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    return out.select(*docs.columns, F.inline(made))


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words"), F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))), F.sqrt(F.col("n_symbols") / n), F.log1p("n_dup_lines"), F.col("n_repeat_words") / n]


def with_features(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds the vector x0.. and the keys of the estimates, the nearest first."""
    names = [f"x{k}" for k in range(P)]
    group = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (lang, source)]
    keys = (F.concat_ws("\1", F.lit("source"), *group), F.concat_ws("\1", F.lit("language"), group[0]), F.when(F.col("n_words") >= 0, F.lit("all")))
    return stats.withColumns(dict(zip(names, _features()))).withColumns({f"_key{k}": key for k, key in enumerate(keys)})


def _square(centre: str = "m", factor: str = "l") -> Column:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor."""
    z: list[Column] = []
    for j in range(P):
        rest = F.col(f"x{j}") - F.col(f"{centre}{j}")
        for i in range(j):
            rest = rest - F.col(f"{factor}{j}{i}") * z[i]
        z.append(rest / F.col(f"{factor}{j}{j}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _cholesky(est: DataFrame) -> DataFrame:
    """Adds the factor l of the covariance c plus floors; one column after the other."""
    for j in range(P):
        for i in range(j + 1):
            value = F.col(f"c{j}{i}") + (F.lit(FLOORS[j] ** 2) if i == j else F.lit(0.0))
            for k in range(i):
                value = value - F.col(f"l{j}{k}") * F.col(f"l{i}{k}")
            est = est.withColumn(f"l{j}{i}", F.sqrt(F.greatest(value, F.lit(FLOORS[j] ** 2 * 1e-3))) if i == j else value / F.col(f"l{i}{i}"))
    return est


def _with(rows: DataFrame, est: DataFrame, on: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(est) if few else est, on)


def _moments(rows: DataFrame, on: list[str]) -> DataFrame:
    """Centre m and covariance c of the differences y to the old centre o."""
    low = [(j, i) for j in range(P) for i in range(j + 1)]
    sums = rows.groupBy(*on).agg(*[F.first(f"o{k}").alias(f"o{k}") for k in range(P)], *[F.avg(f"y{k}").alias(f"a{k}") for k in range(P)], *[F.avg(F.col(f"y{j}") * F.col(f"y{i}")).alias(f"p{j}{i}") for j, i in low])
    return sums.select(*on, *[(F.col(f"o{k}") + F.col(f"a{k}")).alias(f"m{k}") for k in range(P)], *[(F.col(f"p{j}{i}") - F.col(f"a{j}") * F.col(f"a{i}")).alias(f"c{j}{i}") for j, i in low])


def _differences(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"o{k}": F.col(f"m{k}") for k in range(P)} | {f"y{k}": F.col(f"x{k}") - F.col(f"m{k}") for k in range(P)})


def estimates(features: DataFrame) -> DataFrame:
    """One row a key: centre m, factor l, and the scale of its squared distances."""
    rows = features.where("not base_failed").select(F.explode(F.array("_key0", "_key1", "_key2")).alias("key"), *[f"x{k}" for k in range(P)])
    med = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{k}", 0.5, 1000).alias(f"m{k}") for k in range(P)]).where(F.col("n") >= LEAST_ROWS)
    med = materialize(med, "medians")
    few = med.count() <= MOST_BROADCAST
    gaps = _differences(_with(rows, med, ["key"], few))
    low = [(j, i) for j in range(P) for i in range(j + 1)]
    dev = gaps.groupBy("key").agg(*[F.first(f"m{k}").alias(f"m{k}") for k in range(P)], *[F.percentile_approx(F.abs(F.col(f"y{k}")), 0.5, 1000).alias(f"d{k}") for k in range(P)])
    spread = dev.select("key", F.lit(0).alias("start"), *[f"m{k}" for k in range(P)], *[(F.pow(1.4826 * F.col(f"d{j}"), F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c{j}{i}") for j, i in low])
    est = spread.unionByName(_moments(gaps, ["key"]).withColumn("start", F.lit(1)))
    for step in range(STEPS):
        est = materialize(_cholesky(est), f"step{step}")
        near = _with(rows, est, ["key"], few).withColumn("d2", _square())
        limit = materialize(near.groupBy("key", "start").agg(F.percentile_approx("d2", H, 1000).alias("limit")), f"limit{step}")
        est = _moments(_differences(_with(near, limit, ["key", "start"], few).where("d2 <= limit")), ["key", "start"])
    # the start whose end has the least determinant
    root = F.lit(0.0)
    for k in range(P):
        root = root + F.log(f"l{k}{k}")
    est = _cholesky(est)
    names = [c for c in est.columns if c[0] in "ml"]
    est = est.groupBy("key").agg(F.min_by(F.struct(*names), F.struct(root.alias("log"), "start")).alias("e")).select("key", "e.*")
    est = materialize(est, "mcd")
    scale = _with(rows, est, ["key"], few).groupBy("key").agg(F.percentile_approx(_square(), 0.5, 1000).alias("half"))
    return materialize(est.join(scale, "key").withColumn("scale", MEDIAN / F.greatest("half", F.lit(MEDIAN))).drop("half"), "estimates")


def _verdict(features: DataFrame, est: DataFrame) -> DataFrame:
    """Adds kept, by the first of the document's keys that has an estimate."""
    few = est.count() <= MOST_BROADCAST
    for k in range(3):
        own = est.toDF(*[f"_key{k}" if c == "key" else f"_{c}" for c in est.columns])
        far = (_square("_m", "_l") * F.col("_scale")).alias(f"_far{k}")
        features = features.join(F.broadcast(own) if few else own, f"_key{k}", "left").select(*features.columns, far)
    return features.withColumn("kept", ~F.col("base_failed") & (F.coalesce("_far0", "_far1", "_far2", F.lit(0.0)) <= CUTOFF))


def _estimated(docs: DataFrame, id_col: str, text_col: str, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    stats = materialize(with_statistics(docs.select(*columns)).drop("text"), "statistics")
    rows = with_features(stats, "lang", "source")
    return rows, estimates(rows)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows, est = _estimated(docs, id_col, text_col, lang, source)
    return _verdict(rows, est).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns; texts never shuffle, since the statistics
    are computed again in their rows and only the groups' estimates move."""
    _, est = _estimated(docs, id_col, text_col, lang, source)
    names = [f"_c{k}" for k in range(len(docs.columns))]
    c = dict(zip(docs.columns, names))
    rows = with_features(with_statistics(docs.toDF(*names), c[text_col]), c[lang], c[source])
    return _verdict(rows, est).where("kept").select(*names).toDF(*docs.columns)
