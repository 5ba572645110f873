"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Per language and source a minimum-covariance-determinant (MCD) estimate of location and scatter is
fitted to transformed text statistics: from two deterministic starts (coordinate-wise robust scale,
and plain moments) concentration steps keep the share ``SUPPORT`` of rows with the smallest
Mahalanobis distances until the determinants settle; the start with the smaller determinant wins, and one
reweighting step follows. Rows whose distance to it exceeds the cutoff are rejected.

Every step is one pass over the small statistics table: moments and distance histograms are summed
per group before they are shuffled, matrices are solved per group as column expressions, and no
group's rows are ever gathered. Quantiles come from histograms of fixed bins, hence do not depend
on how rows are dealt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, join_small, settle

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SUPPORT = 0.75
#: A concentration step is taken if it lowers the log determinant by more; else the group's start has settled.
SETTLED = 0.01
#: A group below this size (three rows for each of the 5 means and 15 covariances) borrows the
#: estimate of its language, and that one's of all rows.
MIN_GROUP = 60
#: Below this size there is no estimate, and only the base rules decide.
MIN_FIT = 50
#: Chi-square quantile of the reweighting step, and tail probability of the rejection.
REWEIGHT, TAIL = 0.975, 1e-9
#: Bins per unit of log2 distance.
BINS = 32
FEATURES = ("length", "word", "symbol", "line", "repeat")
#: Scale below which differences of a feature mean nothing; its square is added to the scatter, so
#: that a feature that most of a group shares exactly has no infinite weight.
FLOOR = {"length": 0.25, "word": 0.05, "symbol": 0.02, "line": 0.15, "repeat": 0.1}
_P = len(FEATURES)


# -- statistics -----------------------------------------------------------------------------------
def with_statistics(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns to ``carry``, all if not given) and ``s``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and n_lines of the whole text, all bigint; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), text.alias("text")).select("row", "text", F.array_remove(F.split("text", SPACES), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    windows = F.transform("words", lambda x, i: F.xxhash64(x, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    cut = cut.select("row", "text", "words", "lines", F.slice(windows, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))).alias("h"))
    ordered = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    cut = cut.select("row", "text", "words", "lines", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered).alias("o"))
    twice = F.filter("o", lambda s, i: (s.x == F.get(F.col("o"), i - 1).x) | (s.x == F.get(F.col("o"), i + 1).x))
    cut = cut.select("row", "text", "words", "lines", F.sort_array(F.transform(twice, lambda s: s.i)).alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), i + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x)
    stats = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("lines"),
    }
    return cut.select("row", F.struct(*[v.cast("bigint").alias(k) for k, v in stats.items()]).alias("s"))


def base_failed(s: str = "s") -> Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{s}.n_words"))


def features(s: str = "s") -> dict[str, Column]:
    """Transformed statistics; shares go through square roots, which spread their small values."""
    n = F.greatest(F.col(f"{s}.n_words"), F.lit(1)).cast("double")
    return {
        "length": F.log(n),
        "word": F.log(F.greatest(F.col(f"{s}.word_chars"), F.lit(1)) / n),
        "symbol": F.sqrt(F.col(f"{s}.n_symbols") / F.greatest(F.col(f"{s}.word_chars"), F.lit(1))),
        "line": F.sqrt(F.col(f"{s}.n_dup_lines") / F.greatest(F.col(f"{s}.n_lines"), F.lit(1))),
        "repeat": F.sqrt(F.col(f"{s}.n_repeat_words") / n),
    }


# -- chi-square on the driver ---------------------------------------------------------------------
def chi2_cdf(x: float, dof: int) -> float:
    """Series of the regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = dof / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(tail: float, dof: int) -> float:
    """The value that a chi-square variable exceeds with probability ``tail``."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_cdf(mid, dof) > tail else (low, mid)
    return high


def consistency(share: float, dof: int = _P) -> float:
    """Factor that makes the scatter of the central ``share`` of normal rows that of all of them."""
    return share / chi2_cdf(chi2_quantile(1 - share, dof), dof + 2)


# -- groups ---------------------------------------------------------------------------------------
def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _groups(keyed: DataFrame) -> DataFrame:
    """``lang_key, source_key -> g``: the pair itself if large enough; else the small sources of the
    language together; else all rows whose language's are too few as well. What is then still too
    small for an estimate has no group. ``fitted`` says which it is: own, lang or all."""
    n = keyed.groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    small = n.where(F.col("n") < MIN_GROUP).groupBy("lang_key").agg(F.sum("n").alias("pooled"))
    own = F.concat(F.lit("s"), F.col("lang_key"), F.lit("\x01"), F.col("source_key"))
    g = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("pooled") >= MIN_GROUP, F.concat(F.lit("l"), F.col("lang_key"))).otherwise(F.lit("a"))
    named = n.join(small, "lang_key", "left").select("lang_key", "source_key", "n", g.alias("g"))
    enough = named.groupBy("g").agg(F.sum("n").alias("all")).where(F.col("all") >= MIN_FIT)
    level = F.when(F.col("g").startswith("s"), "own").when(F.col("g").startswith("l"), "lang").otherwise("all")
    return named.join(enough, "g", "left_semi").select("lang_key", "source_key", "g", level.alias("fitted"))


# -- moments and matrices per group ---------------------------------------------------------------
def _moments(x: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i in range(_P) for j in range(i, _P)]]


_SUMS = ["n", *[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i in range(_P) for j in range(i, _P)]]


def _sweep(k: int, d: Column):
    """Sweep of pivot ``k`` (value ``d``) as a function of entry and place in the flat matrix ``a``."""

    def swept(x: Column, t: Column) -> Column:
        i, j = F.floor(t / _P), t % _P
        ik, kj = F.get(F.col("a"), (i * _P + k).cast("int")), F.get(F.col("a"), (k * _P + j).cast("int"))
        return F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), x / d).otherwise(x - ik * kj / d)

    return swept


def _solve(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Location ``m``, inverse scatter ``inv`` (row by row) and log determinant ``logdet`` per key, by
    sweeping the scatter matrix pivot after pivot."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(_P)]
    floor = [FLOOR[f] ** 2 for f in FEATURES]
    cov = [[factor * (F.col(f"q{min(i, j)}{max(i, j)}") / F.col("n") - mean[i] * mean[j]) + (floor[i] if i == j else 0.0) for j in range(_P)] for i in range(_P)]
    # rounding can leave a variance of equal values just below zero; the floor keeps it positive
    flat = F.array(*[F.greatest(c, F.lit(floor[i])) if i == j else c for i, row in enumerate(cov) for j, c in enumerate(row)])
    out = sums.select(*keys, F.array(*mean).alias("m"), flat.alias("a"), F.lit(0.0).alias("logdet"))
    for k in range(_P):
        d = F.get(F.col("a"), F.lit(k * _P + k))
        out = out.select(*keys, "m", F.transform("a", _sweep(k, d)).alias("a"), (F.col("logdet") + F.log(d)).alias("logdet"))
    return out.select(*keys, "m", F.transform("a", lambda x: -x).alias("inv"), "logdet")


def _distance(x: list[Column], m: Column, inv: Column) -> Column:
    """Squared Mahalanobis distance."""
    d = [c - F.get(m, F.lit(i)) for i, c in enumerate(x)]
    total = F.lit(0.0)
    for i in range(_P):
        for j in range(i, _P):
            total = total + (1 if i == j else 2) * d[i] * d[j] * F.get(inv, F.lit(i * _P + j))
    return F.greatest(total, F.lit(0.0))


def _start(rows: DataFrame) -> DataFrame:
    """Two starts per group (``k`` 0 and 1): medians with quartile scales, and plain moments."""
    step = F.get(F.array(*[F.lit(FLOOR[f] / 16) for f in FEATURES]), F.col("f"))
    bins = rows.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(_P)])).alias("f", "v")).groupBy("g", "f", F.floor(F.col("v") / step).alias("bin")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("g", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("g", "f")))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) * F.first(step)
    each = ranked.groupBy("g", "f").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("scale"), F.first(F.get(F.array(*[F.lit(FLOOR[f]) for f in FEATURES]), F.col("f"))).alias("floor"))
    ordered = each.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("f", "mid", (1 / (F.col("scale") * F.col("scale") + F.col("floor") * F.col("floor"))).alias("w")))).alias("e"))  # one entry per feature
    inv = F.array(*[F.get(F.col("e"), F.lit(i)).w if i == j else F.lit(0.0) for i in range(_P) for j in range(_P)])
    robust = ordered.select("g", F.lit(0).alias("k"), F.transform("e", lambda s: s.mid).alias("m"), inv.alias("inv"), F.lit(float("inf")).alias("logdet"))
    plain = _solve(rows.groupBy("g").agg(*_moments([F.col(f"x{i}") for i in range(_P)])), ["g"], 1.0)
    return robust.unionAll(plain.select("g", F.lit(1).alias("k"), "m", "inv", F.lit(float("inf")).alias("logdet")))


def _per_group(params: DataFrame) -> DataFrame:
    """Both starts of a group in one row."""
    pick = lambda k: F.max(F.when(F.col("k") == k, F.struct("m", "inv"))).alias(f"p{k}")
    return params.groupBy("g").agg(pick(0), pick(1))


def _lowered(before: DataFrame, after: DataFrame) -> DataFrame:
    """The step where it lowers the determinant, what was before elsewhere; ``moved`` says which. (Ties
    in a bin change how many rows a step keeps, so that it could also raise it, and run in circles.)"""
    new = before.select("g", "k", F.struct("m", "inv", "logdet").alias("b")).join(after.select("g", "k", F.struct("m", "inv", "logdet").alias("a")), ["g", "k"])
    moved = F.col("a.logdet") < F.col("b.logdet") - SETTLED
    return new.select("g", "k", moved.alias("moved"), F.when(moved, F.col("a")).otherwise(F.col("b")).alias("p")).select("g", "k", "moved", "p.*")


def fit(rows: DataFrame) -> DataFrame:
    """``g, m, inv``: the reweighted MCD estimate of every group in ``rows`` (``id``, ``g``, ``x0``...)."""
    x = [F.col(f"x{i}") for i in range(_P)]
    params = settle(_start(rows), "mcd")
    while True:  # determinants fall by a least amount and the floor bounds them
        both = join_small(rows, _per_group(params), ["g"], "id", "inner")
        long = both.select("g", *[f"x{i}" for i in range(_P)], F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _distance(x, F.col(f"p{k}.m"), F.col(f"p{k}.inv")).alias("d")) for k in (0, 1)])).alias("e"))
        bins = long.groupBy("g", F.col("e.k").alias("k"), F.floor(BINS * F.log2(F.col("e.d") + 2.0**-20)).alias("bin")).agg(*_moments(x))
        run = Window.partitionBy("g", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = bins.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("g", "k")))
        central = ranked.where(F.col("upto") - F.col("n") < SUPPORT * F.col("all")).groupBy("g", "k").agg(*[F.sum(c).alias(c) for c in _SUMS])
        params = settle(_lowered(params, _solve(central, ["g", "k"], consistency(SUPPORT))), "mcd")
        if params.where("moved").isEmpty():
            break
    best = params.groupBy("g").agg(F.min_by(F.struct("m", "inv"), F.struct("logdet", "k")).alias("p0"))
    near = join_small(rows, best, ["g"], "id", "inner").where(_distance(x, F.col("p0.m"), F.col("p0.inv")) <= chi2_quantile(1 - REWEIGHT, _P))
    return settle(_solve(near.groupBy("g").agg(*_moments(x)), ["g"], consistency(REWEIGHT)).select("g", "m", "inv"), "mcd")


# -- verdicts -------------------------------------------------------------------------------------
def verdicts(docs: DataFrame, text_col: str = "text", tail: float = TAIL, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``, or those to ``carry``, ``lang`` and ``source`` among them), ``s`` (statistics), ``base_failed``, ``distance``, ``fitted`` (whose
    estimate it is: of the own language and source, the lang, all, or none) and ``kept``.

    Rows that fail the base rules are rejected and take no part in the estimates; other rows are
    rejected if their squared Mahalanobis distance exceeds the chi-square quantile of ``tail``. Null
    ``lang`` and ``source`` are values of their own; null and empty texts have no words and fail;
    repeated rows count as often as they occur, ties share a bin, and an empty table gives no rows.
    Column names of ``docs`` can't clash: they stay inside ``row``.
    """
    stats = settle(with_statistics(docs, text_col, carry), "statistics")
    flat = stats.select(_key(F.col("row.lang")).alias("lang_key"), _key(F.col("row.source")).alias("source_key"), base_failed().alias("base_failed"), F.struct(*[c.alias(f"x{i}") for i, c in enumerate(features().values())]).alias("x"))
    fitting = flat.where(~F.col("base_failed"))
    groups = settle(_groups(fitting), "groups")
    rows = join_small(fitting.select("lang_key", "source_key", "x.*"), groups, ["lang_key", "source_key"], "x0", "inner")
    rows = settle(rows.select("g", *[f"x{i}" for i in range(_P)]).withColumn("id", F.xxhash64(*[f"x{i}" for i in range(_P)])), "features")
    model = groups.join(fit(rows), "g")  # a row per language and source
    keyed = stats.select("*", _key(F.col("row.lang")).alias("lang_key"), _key(F.col("row.source")).alias("source_key"), F.col("s.word_chars").alias("salt_by"))
    met = join_small(keyed, model, ["lang_key", "source_key"], "salt_by")
    x = [c.cast("double") for c in features().values()]
    distance = F.when(~base_failed(), _distance(x, F.col("m"), F.col("inv")))
    return met.select("row", "s", base_failed().alias("base_failed"), distance.alias("distance"), F.coalesce("fitted", F.lit("none")).alias("fitted")).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > chi2_quantile(tail, _P), F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the five statistics, ``base_failed``, ``kept``, ``distance``, ``fitted``."""
    out = verdicts(docs, carry=["doc_id", "lang", "source"])
    return out.select(F.col("row.doc_id").alias("doc_id"), *[f"s.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "distance", "fitted")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    Null and empty texts go (they have no words); null languages and sources are groups of their own;
    repeated rows are kept or go alike; an empty table stays empty."""
    return verdicts(docs).where("kept").select("row.*")
