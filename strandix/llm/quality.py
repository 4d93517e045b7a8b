"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame operations only.

Every text becomes a vector of transformed statistics. For each (language, source) pair, each language and the
whole table, a minimum-covariance-determinant (MCD) estimate is fitted to all rows: from each of three starts,
concentration steps keep the `share` of rows nearest by Mahalanobis distance and estimate location and scatter again,
until the determinant stands still; of the three ends the one of least determinant is the group's. A pair's estimate
is then drawn towards its language's, and a language's towards the whole table's, with the weight of `prior` rows:
a pair of few rows is judged nearly as its language, one of many by its own rows. A row is rejected if its squared
distance under its pair's estimate exceeds `cutoff`.

Each concentration step is one aggregation by (group, start, distance bin) with partial sums, so that a group that
holds a third of all rows costs no more than any other. Nothing but tables of group parameters is ever broadcast, and
those only while their checked row count is at most `broadcast_rows`; beyond it rows meet them in a join dealt by
group and salt.

Defined results: null text has no words and fails the base rule; null lang or source is a group of its own;
repeated rows each get a row; an empty table gives an empty result; other columns are carried along whatever their names.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandix.llm.common import SPACE, materialize, small, table, words

#: Bits of the window position in a packed window hash, enough for the longest array; the rest holds hash bits.
POSITION_BITS = 31
#: Squared-distance quantile of chi-square with four degrees of freedom at 0.999.
CUTOFF = 18.467
#: Share of rows that a concentration step keeps, and the factor that makes its scatter consistent at the normal.
SHARE, CONSISTENCY = 0.75, 1.487
#: Least standard deviation of each transformed statistic, so that one that is constant in a group rejects no small
#: change. Each times sqrt(CUTOFF) stays below its statistic's range, log1p(50) for repeats, so each can reject alone.
FLOORS = (0.08, 0.55, 1.0, 0.85)
#: Lines and words added to a share's divisor: one repeated line among three says less than a hundred among three hundred.
FEW_LINES, FEW_WORDS = 10, 30
#: Rows that the next larger group's estimate weighs; steps at most; change of a log determinant that counts as none.
PRIOR, STEPS, STILL = 200, 12, 1e-4
#: Bins of distance for each unit of log1p: rows of one bin are kept or left together.
BINS = 256
BROADCAST_ROWS, SALTS = 50_000, 16
P = len(FLOORS)
PAIRS = list(combinations_with_replacement(range(P), 2))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat: words of w inside 3-word windows found at least twice.

    Windows are hashed; hash bits packed with the position are sorted as plain longs, equal neighbours are the
    candidates, and the few candidates are compared again by their full 64-bit hash.
    """
    mask = (1 << POSITION_BITS) - 1
    n = F.size("w")
    df = df.withColumn("h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("s", F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint")))))

    def same(arr: str, x: Column, k: Column, key) -> Column:
        here = key(x)
        return F.coalesce(key(F.get(arr, k + 1)) == here, F.lit(False)) | F.coalesce(key(F.get(arr, k - 1)) == here, F.lit(False))

    df = df.withColumn("c", F.filter("s", lambda x, k: same("s", x, k, lambda v: F.shiftright(v, POSITION_BITS))))
    df = df.withColumn("c", F.sort_array(F.transform("c", lambda x: F.struct(F.get("h", x.bitwiseAND(F.lit(mask)).cast("int")).alias("h"), x.bitwiseAND(F.lit(mask)).alias("p")))))
    df = df.withColumn("r", F.filter("c", lambda x, k: same("c", x, k, lambda v: v["h"])))
    covered = F.array_distinct(F.flatten(F.transform("r", lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    return df.withColumn("n_repeat", F.size(covered)).drop("h", "s", "c", "r")


def text_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(row, q) of every row of docs: a struct of the columns to carry, and the base counts, the vector x, and the group's lng and src."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce("text", F.lit("")).alias("t"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    df = df.withColumn("w", words(F.col("t"))).withColumn("full", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeat_words(df)
    df = df.withColumn("n", F.struct(
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint").alias("n_dup_lines"),
        F.col("n_repeat").cast("bigint").alias("n_repeat_words"),
        F.size("full").cast("bigint").alias("n_lines"),
    )).drop("w", "t", "full", "n_repeat")
    n = F.col("n")
    per = F.greatest(n["n_words"], F.lit(1)).cast("double")
    x = F.array(
        F.log(F.greatest(n["word_chars"], F.lit(1)) / per),
        F.log1p(100 * n["n_symbols"] / per),
        F.log1p(100 * n["n_dup_lines"] / (n["n_lines"] + FEW_LINES)),
        F.log1p(100 * n["n_repeat_words"] / (n["n_words"] + FEW_WORDS)),
    )
    failed = (n["n_words"] < 50) | (100 * n["n_repeat_words"] > 50 * n["n_words"])
    named = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source")]
    return df.select("row", F.struct("n.*", failed.alias("base_failed"), x.alias("x"), named[0].alias("lng"), named[1].alias("src")).alias("q"))


def _with_parameters(rows: DataFrame, params: DataFrame, on: list[str], how: str, broadcast_rows: int) -> DataFrame:
    """rows joined to the parameters of their group: broadcast while few, else dealt by group and salt, so that no group is one task."""
    if small(params, broadcast_rows):
        return rows.join(F.broadcast(params), on, how)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(params.withColumn("salt", salt), [*on, "salt"], how).drop("salt")


def _factor(df: DataFrame) -> DataFrame:
    """Adds l, the lower factor of the scatter s (one entry for each of PAIRS) as a struct of l_ij, and det, the logarithm of its determinant."""
    at, names = {p: k for k, p in enumerate(PAIRS)}, df.columns
    for j in range(P):
        left = F.get("s", F.lit(at[j, j])) - sum((F.col(f"l_{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))))
        for i in range(j + 1, P):
            rest = F.get("s", F.lit(at[j, i])) - sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l_{i}{j}", rest / F.col(f"l_{j}{j}"))
    ls = F.struct(*[F.col(f"l_{i}{j}").alias(f"l_{i}{j}") for i in range(P) for j in range(i + 1)])
    return df.select(*names, ls.alias("l"), sum((2 * F.log(f"l_{i}{i}") for i in range(P)), F.lit(0.0)).alias("det"))


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2 = |L^-1 (x - m)|^2 by forward substitution."""
    for i in range(P):
        left = F.get("x", F.lit(i)) - F.get("m", F.lit(i)) - sum((F.col(f"l.l_{i}{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z_{i}", left / F.col(f"l.l_{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z_{i}") ** 2 for i in range(P)), F.lit(0.0))).drop(*[f"z_{i}" for i in range(P)])


def _moments() -> list[Column]:
    get = [F.get("x", F.lit(i)) for i in range(P)]
    return [F.sum(get[i]).alias(f"s_{i}") for i in range(P)] + [F.sum(get[i] * get[j]).alias(f"s_{i}{j}") for i, j in PAIRS]


def _location_scatter(factor: float) -> tuple[Column, Column]:
    """m and s from the sums s_i, s_ij over n rows; the floors keep the scatter regular."""
    mean = [F.col(f"s_{i}") / F.col("n") for i in range(P)]
    return F.array(*mean), F.array(*[factor * (F.col(f"s_{i}{j}") / F.col("n") - mean[i] * mean[j]) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS])


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start, n_group, m, s): medians and quartile ranges; mean and covariance of all rows; medians and the floors."""
    # Quartiles of values rounded to 1/64 keep the exact percentile's state small whatever the group holds.
    quarts = [F.percentile(F.round(F.get("x", F.lit(i)) * 64) / 64, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}") for i in range(P)]
    tot = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *quarts, *_moments())
    medians = F.array(*[F.get(f"q_{i}", F.lit(1)) for i in range(P)])
    spread = [F.greatest((F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / 1.349, F.lit(FLOORS[i])) for i in range(P)]
    diagonal = lambda of: F.array(*[of[i] ** 2 if i == j else F.lit(0.0) for i, j in PAIRS])
    mean, cov = _location_scatter(1.0)
    ways = [(medians, diagonal(spread)), (mean, cov), (medians, diagonal([F.lit(f) for f in FLOORS]))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), m.alias("m"), s.alias("s")) for k, (m, s) in enumerate(ways)]))
    return tot.select("g", F.col("n").alias("n_group"), each.alias("e")).select("g", "n_group", "e.start", "e.m", "e.s")


def fit(stats: DataFrame, share: float = SHARE, steps: int = STEPS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """MCD estimates of every group of `stats`: columns g (level, lng, src), n_group, m, s, det.

    Rows that fail the base rule take no part. `stats` should be a written table, since each step reads it again.
    """
    q = F.col("q")
    levels = [F.struct(F.lit(k).alias("level"), lng.alias("lng"), src.alias("src")) for k, (lng, src) in enumerate(((F.lit(""), F.lit("")), (q["lng"], F.lit("")), (q["lng"], q["src"])))]
    rows = stats.filter(~q["base_failed"]).select(F.explode(F.array(*levels)).alias("g"), q["x"].alias("x"))
    active, done = materialize(_factor(_starts(rows)), "mcd"), None
    for step in range(steps):
        at = _distance(_with_parameters(rows, active, ["g"], "inner", broadcast_rows)).withColumn("bin", F.floor(F.log1p("d2") * BINS).cast("int"))
        bins = at.groupBy("g", "start", "bin").agg(F.first("n_group").alias("n_group"), F.first("det").alias("was"), F.count(F.lit(1)).alias("n"), *_moments())
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = bins.withColumn("before", before).filter(F.col("before") < share * F.col("n_group"))
        tot = near.groupBy("g", "start").agg(F.first("n_group").alias("n_group"), F.first("was").alias("was"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in [f"s_{i}" for i in range(P)] + [f"s_{i}{j}" for i, j in PAIRS]])
        m, s = _location_scatter(CONSISTENCY)
        new = materialize(_factor(tot.select("g", "n_group", "start", m.alias("m"), s.alias("s"), "was")), "mcd")
        # The first step's determinants are not compared with those of the starts, which are no concentrated scatters.
        moving = F.lit(step == 0) | (F.abs(F.col("det") - F.col("was")) > STILL)
        still = new if step + 1 == steps else new.filter(~moving)
        done = still if done is None else done.unionByName(still)
        active = new.filter(moving).drop("was")
        if active.isEmpty():
            break
    return materialize(done.groupBy("g").agg(F.min(F.struct("det", "start", "m", "s", "n_group")).alias("e")).select("g", "e.n_group", "e.m", "e.s", "e.det"), "mcd")


def _drawn(own: str, to: str, prior: float) -> Column:
    """An array of estimates drawn towards another of the same kind, which weighs as much as `prior` rows."""
    n = F.col("n_group").cast("double")
    return F.zip_with(own, to, lambda a, b: (n * a + prior * b) / (n + prior))


def shrunk(params: DataFrame, prior: float = PRIOR, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(lng, src, m, l) of each pair: its estimate drawn towards its language's, which is drawn towards that of the whole table."""
    whole = params.filter("g.level = 0").first()  # one row
    langs = params.filter("g.level = 1").select("g.lng", "n_group", "m", "s")
    if whole is not None:
        langs = langs.withColumn("m0", F.array(*[F.lit(v) for v in whole["m"]])).withColumn("s0", F.array(*[F.lit(v) for v in whole["s"]]))
        langs = langs.select("lng", _drawn("m", "m0", prior).alias("m0"), _drawn("s", "s0", prior).alias("s0"))
    else:
        langs = langs.select("lng", F.col("m").alias("m0"), F.col("s").alias("s0"))
    pairs = _with_parameters(params.filter("g.level = 2").select("g.lng", "g.src", "n_group", "m", "s"), langs, ["lng"], "inner", broadcast_rows)
    return _factor(pairs.select("lng", "src", _drawn("m", "m0", prior).alias("m"), _drawn("s", "s0", prior).alias("s"))).select("lng", "src", "m", "l")


def judge(stats: DataFrame, params: DataFrame, cutoff: float = CUTOFF, prior: float = PRIOR, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """stats with columns d2 and kept."""
    pairs = materialize(shrunk(params, prior, broadcast_rows), "mcd")
    rows = stats.select("row", "q", F.col("q.x").alias("x"), F.col("q.lng").alias("lng"), F.col("q.src").alias("src"))
    df = _distance(_with_parameters(rows, pairs, ["lng", "src"], "left", broadcast_rows))
    return df.select("row", "q", "d2", (~F.col("q.base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"))


def verdicts(docs: DataFrame, carry: list[str], **options) -> DataFrame:
    """(row, q, d2, kept) with the named columns of docs in row; texts are read once, their statistics written as a table."""
    stats = materialize(text_statistics(docs, carry), "quality")
    return judge(stats, fit(stats, **options))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that both the base rule and the outlier rule keep, with all their columns."""
    return verdicts(docs, docs.columns).filter("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents"), ["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("row.doc_id", *[F.col(f"q.{c}").alias(c) for c in names], "kept", F.round("d2", 6).alias("distance2"))
