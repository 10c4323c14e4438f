"""Quality rules: text statistics, fixed base rules, and robust multivariate outliers by minimum covariance determinant.

All of it is DataFrame functions. The statistics of a text stay inside its row. Estimates are made per pool, a (language,
source) pair; pairs with under ``min_rows`` rows join the rest of their language, small rests join the rest of all.
Null texts have no words and fail; null languages and sources are values of their own; repeated rows count each; pools too
small for an estimate reject nothing; an empty table gives no rows. Other columns are left as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.common import shielded, written

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Vectors are whole multiples of 1 / SCALE, so that sums are exact and the same however rows are dealt.
SCALE = 256
#: Least standard deviation added to each component (log words, log word length, and roots of shares of symbols, capitals,
#: repeated lines and repeated words): the size of rounding.
SOFTEN = (1 / SCALE,) * 6
P = len(SOFTEN)
#: Share of a pool's robust scale (quartile range of normal data) that is added to each component.
SOFT_SHARE = 0.5
#: Share of a pool whose determinant is made least.
COVERAGE = 0.75
#: Fixed values for six components: makes a covariance over COVERAGE consistent for normal data; 97.5 % point of chi-square.
CONSISTENCY, CHI_975 = 1.361, 14.449
#: Squared distance beyond which a document goes: the 99.999 % point of chi-square with six degrees.
CUT = 33.1
#: By component, of what a share is: (statistic, so many of it in a text of the pool's median length are no outlier yet where the
#: pool has none, largest share for which that holds). One symbol or capital is one standard deviation; five lines or windows reach CUT.
LEEWAY = {2: ("word_chars", CUT, 0.2), 3: ("word_chars", CUT, 0.2), 4: ("_lines", 5, 0.7), 5: ("n_words", 5 * 2 * WINDOW, 0.7)}
LENGTHS = ("word_chars", "_lines", "n_words")
STEPS = 8
BINS = 64


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with STATS, ``_lines`` and ``_capitals``, over whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({
        "_words": F.array_remove(F.split(text, "[ \\t-\\r]+"), ""),
        "_filled": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit("[ \\t-\\r]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "_capitals": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
    })
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_lines": F.size("_filled").cast("long"),
        "n_dup_lines": (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long"),
        "_h": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_words", "_filled")
    step = 1
    while step < WINDOW:  # hashes of runs of 1, 2, 4, then 8 words
        many = F.greatest(F.size("_h") - step, F.lit(0))
        rows = rows.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), many), F.slice("_h", F.lit(step + 1), many), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), none).otherwise(F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, j: (F.get("_s", j - 1)["h"] == x["h"]) | (F.get("_s", j + 1)["h"] == x["h"]))
    rows = rows.withColumn("_s", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_h")
    covered = F.transform("_s", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_s", j + 1) - p, F.lit(WINDOW))))
    return rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)).drop("_s")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics as whole numbers of 1 / SCALE."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "_lines"))
    parts = [F.log1p("n_words"), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("_capitals") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words)]
    return [F.round(p * SCALE).cast("long").alias(f"_x{i}") for i, p in enumerate(parts)]


def judged(docs: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, vector ``_x0`` … and the pair of language and source, null-safe."""
    rows = statistics(docs).withColumn("base_failed", base_failed())
    rows = rows.select("*", *vector())
    return rows.withColumns({k: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in (("_lang", "lang"), ("_source", "source"))})


def pools(rows: DataFrame, min_rows: int) -> DataFrame:
    """(_lang, _source, _pool) of every pair of rows that passed the base rules; one row per pair."""
    pairs = rows.groupBy("_lang", "_source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("_n"))
    small = F.col("_n") < min_rows
    rest = F.sum(F.when(small, F.col("_n")).otherwise(0)).over(Window.partitionBy("_lang"))
    pool = F.when(~small, F.concat_ws("\u0001", "_lang", "_source")).when(rest >= min_rows, F.concat_ws("\u0001", "_lang", F.lit("*"))).otherwise("*")
    return pairs.select("_lang", "_source", pool.alias("_pool"))


def _fit(moments: DataFrame, consistency: float) -> DataFrame:
    """Mean, Cholesky factor and log determinant per pool and start, from exact sums; nothing under P + 2 rows.

    Variances grow by the pool's ``_v0`` …, or by the size of rounding where ``moments`` has none.
    """
    n = F.col("_n").cast("double")
    rows = moments.filter(F.col("_n") >= P + 2).withColumns({f"_m{i}": F.col(f"_s{i}") / (n * SCALE) for i in range(P)})
    soft = [F.col(f"_v{i}") if f"_v{i}" in moments.columns else F.lit(SOFTEN[i] ** 2) for i in range(P)]
    cov = {}
    for i in range(P):
        for j in range(i + 1):
            cov[i, j] = (F.col(f"_s{j}_{i}") / (n * SCALE * SCALE) - F.col(f"_m{i}") * F.col(f"_m{j}")) * consistency + (soft[i] if i == j else 0)
    for i in range(P):
        for j in range(i + 1):
            value = cov[i, j]
            for k in range(j):
                value = value - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            rows = rows.withColumn(f"_l{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"_l{j}_{j}"))
    logdet = sum((F.log(f"_l{i}_{i}") for i in range(1, P)), F.log("_l0_0"))
    return rows.withColumn("_det", logdet).select("_pool", "_start", "_det", *[f"_m{i}" for i in range(P)], *[f"_l{i}_{j}" for i in range(P) for j in range(i + 1)])


def _distance(rows: DataFrame) -> DataFrame:
    """``_d``: squared Mahalanobis distance, by forward substitution with the Cholesky factor."""
    for i in range(P):
        value = F.col(f"_x{i}") / SCALE - F.col(f"_m{i}")
        for k in range(i):
            value = value - F.col(f"_l{i}_{k}") * F.col(f"_z{k}")
        rows = rows.withColumn(f"_z{i}", value / F.col(f"_l{i}_{i}"))
    return rows.withColumn("_d", sum((F.col(f"_z{i}") ** 2 for i in range(1, P)), F.col("_z0") ** 2))


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(P)], *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i in range(P) for j in range(i, P)]]


def _bin(d: Column) -> Column:
    return F.floor(F.log1p(d) * BINS).cast("int")


def _names() -> list[str]:
    return ["_n", *[f"_s{i}" for i in range(P)], *[f"_s{i}_{j}" for i in range(P) for j in range(i, P)]]


def _step(vectors: DataFrame, fit: DataFrame) -> DataFrame:
    """One concentration step: the estimate over the share COVERAGE of each pool that lies nearest.

    Rows are summed per (pool, start, bin of the distance); the last bin that the share needs counts whole.
    """
    binned = _distance(vectors.join(fit, "_pool")).withColumn("_bin", _bin(F.col("_d"))).groupBy("_pool", "_start", "_bin").agg(*_sums())
    upto = Window.partitionBy("_pool", "_start").orderBy("_bin")
    total = Window.partitionBy("_pool", "_start")
    near = binned.withColumns({"_upto": F.sum("_n").over(upto) - F.col("_n"), "_all": F.sum("_n").over(total)}).filter(F.col("_upto") < F.ceil(F.col("_all") * COVERAGE))
    return near.groupBy("_pool", "_start").agg(*[F.sum(c).alias(c) for c in _names()])


def _fences(vectors: DataFrame) -> DataFrame:
    """Per pool: the middle of each component, ``_q0`` …, and the variance added to it, ``_v0`` …: from its quartiles, and at
    least that of rounding, or of LEEWAY in a text of median length if ``vectors`` has LENGTHS."""
    cuts = F.array(*map(F.lit, (0.2, 0.8, 0.25, 0.75)))
    lengths = [c for c in LENGTHS if c in vectors.columns]
    rows = vectors.groupBy("_pool").agg(*[F.percentile_approx(f"_x{i}", cuts, 1000).alias(f"_q{i}") for i in range(P)], *[F.percentile_approx(c, 0.5, 1000).alias(c) for c in lengths])
    for i in range(P):
        least = [F.lit(SOFTEN[i] ** 2)]
        if i in LEEWAY and LEEWAY[i][0] in lengths:
            name, units, most = LEEWAY[i]
            least.append(F.least(units / F.greatest(F.col(name), F.lit(1)), F.lit(most)) / CUT)
        spread = (F.col(f"_q{i}")[3] - F.col(f"_q{i}")[2]) * (SOFT_SHARE / 1.349 / SCALE)
        rows = rows.withColumn(f"_v{i}", F.greatest(spread * spread, *least))
    return written(rows.drop(*lengths), "fences")


def estimates(vectors: DataFrame) -> DataFrame:
    """One reweighted minimum-covariance-determinant estimate per pool, written.

    ``vectors``: written rows (_pool, _x0 …, and LENGTHS where known) that passed the base rules. Concentration steps run from two
    starts side by side, all rows and the rows near the middle of each component; the start with the smaller determinant wins.
    """
    fences = _fences(vectors)
    soft = fences.select("_pool", *[f"_v{i}" for i in range(P)])
    inside = vectors.join(fences, "_pool")
    middle = F.lit(True)
    for i in range(2):
        middle = middle & F.col(f"_x{i}").between(F.col(f"_q{i}")[0], F.col(f"_q{i}")[1])
    starts = F.array_compact(F.array(F.lit("all"), F.when(middle, "middle")))
    first = inside.withColumn("_start", F.explode(starts)).groupBy("_pool", "_start").agg(*_sums())
    fit = written(_fit(first.join(soft, "_pool"), 1.0), "fit")
    for _ in range(STEPS):
        fit = written(_fit(_step(vectors, fit).join(soft, "_pool"), CONSISTENCY), "fit")
    best = fit.withColumn("_rank", F.row_number().over(Window.partitionBy("_pool").orderBy("_det", "_start"))).filter("_rank = 1").drop("_rank")
    near = _distance(vectors.join(written(best, "fit"), "_pool")).filter(F.col("_d") <= CHI_975)
    return written(_fit(near.groupBy("_pool", "_start").agg(*_sums()).join(soft, "_pool"), 1.0), "fit")


def assess(docs: DataFrame, min_rows: int = 200, cut: float = CUT, whole: bool = False) -> DataFrame:
    """doc_id, STATS, base_failed, distance2 and kept of every document; with ``whole`` all columns of ``docs`` and _kept.

    Without ``whole`` the slim table of statistics is read again; with it statistics are made again beside the
    texts, which are neither written nor exchanged.
    """
    own, restored = shielded(docs, ("doc_id", "text", "lang", "source"))
    slim = judged(own.select("doc_id", "text", "lang", "source")).select("doc_id", *STATS, "_lines", "base_failed", "_lang", "_source", *[f"_x{i}" for i in range(P)])
    slim = written(slim, "statistics")
    pool_of = written(pools(slim, min_rows), "pools")
    vectors = written(slim.filter("not base_failed").join(pool_of, ["_lang", "_source"]).select("_pool", *LENGTHS, *[f"_x{i}" for i in range(P)]), "vectors")
    final = estimates(vectors)
    rows = judged(own) if whole else slim
    placed = _distance(rows.join(pool_of, ["_lang", "_source"], "left").join(final, "_pool", "left"))
    out = placed.withColumn("distance2", F.when(~F.col("base_failed"), F.col("_d")))
    # one comparison: a conjunction would be split, and its cheap half pushed below the statistics, which it would repeat many times
    out = out.withColumn("kept", F.greatest(F.col("base_failed").cast("double") * 1e12, F.coalesce(F.col("_d"), F.lit(0.0))) <= cut)
    return out.select(*restored, F.col("kept").alias("_kept")) if whole else out.select("doc_id", *STATS, "base_failed", "distance2", "kept")
