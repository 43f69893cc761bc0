"""Statistics on net returns: clustered t, out-of-sample splits, rank correlation, factor grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_medians, kept, numbered, running_total, tile


def t_value(mean_of: str | Column) -> Column:
    c = F.col(mean_of) if isinstance(mean_of, str) else mean_of
    return F.avg(c) / F.nullif(F.stddev_samp(c) / F.sqrt(F.count(c).cast("double")), F.lit(0.0))


def clustered_t(rows: DataFrame, keys: list[str], measure: str, cluster: str = "ticker") -> DataFrame:
    """n, clusters and the one-sample t of the cluster means."""
    means = rows.groupBy(*keys, cluster).agg(F.avg(measure).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return means.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), F.round(t_value("_m"), 4).alias("clustered_t"))


def time_split(rows: DataFrame, share: float = 0.6, at: str = "announced", tie: str = "fingerprint") -> DataFrame:
    """Column part: train for the first ``share`` of the rows in time, else test.

    Ranks come from counts per day, summed over the days, so that only one row a day is ordered globally.
    """
    daily = rows.groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = daily.select(at, before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(at).orderBy(tie))
    return rows.join(days, at).withColumn("part", F.when(place <= F.floor(F.col("_total") * share), "train").otherwise("test")).drop("_before", "_total")


def average_ranks(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Columns rank_<c>: ranks within keys, ties sharing their mean rank.

    Ranks come from counts per distinct value, summed over ranges of values, so that no task holds a key. All columns'
    values stand in one table, so one order serves them.
    """
    rows = kept(rows)
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    counts = rows.select(*keys, F.explode(values).alias("_x")).select(*keys, "_x.*").groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, F.col("_n"), ["_c", *keys, "_v"])
    first = placed.groupBy(*keys, "_c").agg(F.min("_before").alias("_first"))
    ranks = kept(placed.join(first, [*keys, "_c"]).select(*keys, "_c", "_v", (F.col("_before") - F.col("_first") + (F.col("_n") + 1) / 2).alias("_rank")), "ranks")
    for i, c in enumerate(columns):
        own = ranks.where(F.col("_c") == i).select(*keys, F.col("_v").alias(f"_v{i}"), F.col("_rank").alias(f"rank_{c}"))
        rows = rows.withColumn(f"_v{i}", F.col(c).cast("double")).join(own, [*keys, f"_v{i}"]).drop(f"_v{i}")
    return rows


def spearman(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    ranked = average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y), [x, y], keys)
    a, b = f"rank_{x}", f"rank_{y}"
    spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))  # null where a side does not vary
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.covar_pop(a, b) / spread, 6).alias("spearman"))


def out_of_sample(rows: DataFrame, by: str, measure: str = "net", least: int = 30) -> DataFrame:
    """Per group, on the rows whose part is test: n, mean, median, hit %, mean against all rows' (vs_baseline), the train mean, and a verdict.

    EDGE is a positive mean that beats the baseline, that the train part shares, and that stays without its best row;
    PRELIMINARY lacks one of the last two; NOISE has no edge; fewer than ``least`` rows are INSUFFICIENT-N.
    """
    rows = kept(rows.where(F.col(measure).isNotNull()).select(by, "part", measure), "sample")
    test, m = rows.where("part = 'test'"), F.col(measure)
    base = test.agg(F.avg(m).alias("_base"))
    counts = [F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), F.round(100.0 * F.count_if(m > 0) / F.count(F.lit(1)), 4).alias("hit_pct"), ((F.sum(m) - F.max(m)) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("_rest")]
    now = test.groupBy(by).agg(*counts).join(exact_medians(test, [by], [measure]).withColumnRenamed(measure, "median"), by, "left")
    before = rows.where("part = 'train'").groupBy(by).agg(F.avg(m).alias("train_mean"))
    out = now.join(before, by, "left").crossJoin(F.broadcast(base))  # one row
    beats = (F.col("mean") > 0) & (F.col("mean") > F.col("_base"))
    legs = F.coalesce(F.col("train_mean") > 0, F.lit(False)).cast("int") + F.coalesce(F.col("_rest") > 0, F.lit(False)).cast("int")
    verdict = F.when(F.col("n") < least, "INSUFFICIENT-N").when(beats & (legs == 2), "EDGE").when(beats & (legs == 1), "PRELIMINARY").otherwise("NOISE")
    return out.select(by, "n", "mean", "median", "hit_pct", (F.col("mean") - F.col("_base")).alias("vs_baseline"), "train_mean", verdict.alias("verdict"))


def weighted_board(rows: DataFrame, keys: list[str], measure: str, weights: dict[str, Column], tie: str = "fingerprint") -> DataFrame:
    """Rows (keys, scheme, n, mean, median, hit_pct): each measured under every scheme of weights.

    The median is the first value, in order, at which half of the weight is reached; running sums of weight come from ranges of values.
    """
    schemes = F.explode(F.array(*[F.struct(F.lit(n).alias("scheme"), w.cast("double").alias("_w")) for n, w in weights.items()]))
    long = rows.where(F.col(measure).isNotNull()).select(*keys, tie, measure, schemes.alias("_s")).select(*keys, tie, measure, "_s.*")
    groups, m = [*keys, "scheme"], F.col(measure)
    placed = kept(running_total(kept(long, "weighted"), F.col("_w"), [*groups, measure, tie]), "placed")
    total = placed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_all"), F.min("_before").alias("_first"), (F.sum(m * F.col("_w")) / F.sum("_w")).alias("mean"), (100.0 * F.sum(F.when(m > 0, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("hit_pct")
    )
    reached = (F.col("_before") - F.col("_first") + F.col("_w")) * 2 >= F.col("_all") * (1 - 1e-12)
    middle = placed.join(total.select(*groups, "_all", "_first"), groups).where(reached).groupBy(*groups).agg(F.min(measure).alias("median"))
    return total.join(middle, groups, "left").select(*groups, "n", "mean", "median", "hit_pct")


def winsorised(rows: DataFrame, column: str, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Column w: the measure clipped at two percentiles of its key."""
    rows = kept(rows, "winsorised")
    ends = exact_medians(rows, keys, [column], low).withColumnRenamed(column, "_lo").join(exact_medians(rows, keys, [column], high).withColumnRenamed(column, "_hi"), keys)
    return rows.join(ends, keys).withColumn("w", F.least("_hi", F.greatest("_lo", column))).drop("_lo", "_hi")


def buckets(rows: DataFrame, by: str, n: int, keys: list[str], tie: str = "fingerprint") -> DataFrame:
    """Column bucket: ``n`` groups of equal size in order of a column; ``tie`` tells rows of a key apart."""
    placed = numbered(kept(rows), [by, tie], "_place", keys)
    if not keys:
        total = placed.agg(F.count(F.lit(1)).alias("_total"))
        return placed.crossJoin(F.broadcast(total)).withColumn("bucket", tile(F.col("_place"), F.col("_total"), n)).drop("_place", "_total")  # one row
    total = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return placed.join(total, keys).withColumn("bucket", tile(F.col("_place"), F.col("_total"), n)).drop("_place", "_total")


def calibration(rows: DataFrame, factors: list[str], score: str = "score", y: str = "net", key: str = "horizon", groups: int = 10) -> DataFrame:
    """The calibration report as rows (section, horizon, key, value): rank correlation, slope, top fifth, equal groups, factors and halves in time."""
    rows = kept(rows)
    out = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.col(key).alias("horizon"), name.alias("key"), value.cast("double").alias("value"))
    ranks = spearman(rows, score, y, [key])
    slope = rows.groupBy(key).agg(F.round(F.regr_slope(y, score), 8).alias("v"))
    fifths = clustered_t(buckets(rows, score, 5, [key]).where("bucket = 5"), [key], y)
    tiles = buckets(rows, score, groups, [key]).groupBy(key, "bucket").agg(F.round(F.avg(y), 6).alias("v"))
    long = rows.select(key, y, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in factors])).alias("s")).select(key, y, "s.*")
    each = spearman(long, "x", y, [key, "factor"])
    parts = time_split(rows.where(F.col("announced").isNotNull()).withColumn("_tie", F.struct("fingerprint", key)), tie="_tie").groupBy(key, "part").agg(F.round(F.avg(y), 6).alias("v"))
    sections = [
        out(ranks, "rank", F.lit("n"), F.col("n")), out(ranks, "rank", F.lit("spearman"), F.col("spearman")), out(slope, "slope", F.lit("ols"), F.col("v")),
        out(fifths, "top_fifth", F.lit("clustered_t"), F.col("clustered_t")), out(tiles, "groups", F.format_string("group_%02d", "bucket"), F.col("v")),
        out(each, "factors", F.col("factor"), F.col("spearman")), out(parts, "time", F.col("part"), F.col("v")),
    ]
    report = sections[0]
    for more in sections[1:]:
        report = report.unionByName(more)
    return report


def ols(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least squares of ``y`` on several factors: rows (factor, coefficient, t), the intercept first.

    Sums of products, (len(xs) + 2) squared numbers, come from one aggregation; the driver solves that small system.
    """
    import numpy as np

    names = ["_one", *xs]
    full = rows.select(F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_one"), *[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    columns = [*names, "_y"]
    sums = full.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    m = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))])
    xx, xy, yy, n = m[:-1, :-1], m[:-1, -1], m[-1, -1], m[0, 0]
    spark = rows.sparkSession
    schema = "factor string, coefficient double, t double"
    if n <= len(names) or np.linalg.matrix_rank(xx) < len(names):
        return spark.createDataFrame([], schema)
    inverse = np.linalg.inv(xx)
    beta = inverse @ xy
    noise = max(0.0, yy - beta @ xy) / (n - len(names))
    spread = np.sqrt(noise * inverse.diagonal())
    found = [("intercept" if x == "_one" else x, float(b), float(b / s) if s else None) for x, b, s in zip(names, beta, spread)]
    return spark.createDataFrame(found, schema)


def challenger(train: DataFrame, test: DataFrame, y: str, factors: dict[str, float], least_test: int = 30, low: float = 0.05, high: float = 0.40, ridge: float = 0.05) -> DataFrame:
    """Weights refitted on the past, judged on later rows only, as a proposal: one row per factor.

    The challenger is a regularised linear fit on known factors (unknown ones count as one half), clipped to
    ``low`` .. ``high`` and scaled to sum to one. It is proposed if its scores order the later rows' returns better
    than the champion's weights do, by more than 1.64 standard errors of a rank correlation, and there are at least
    ``least_test`` later rows; the live weights are never changed.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = list(factors)
    spark = train.sparkSession
    schema = "factor string, champion double, challenger double, n_test long, champion_rank double, challenger_rank double, proposed boolean"
    filled = lambda df: df.where(F.col(y).isNotNull()).withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.5)) for f in names})
    fitted = kept(filled(train))
    if fitted.limit(2).count() < 2:
        return spark.createDataFrame([], schema)
    vectors = VectorAssembler(inputCols=names, outputCol="_x").transform(fitted.select(*names, F.col(y).cast("double").alias("_y")))
    model = LinearRegression(featuresCol="_x", labelCol="_y", regParam=ridge, elasticNetParam=0.0, standardization=True).fit(vectors)
    raw = [max(0.0, float(c)) for c in model.coefficients]
    total = sum(raw)
    weights = [min(high, max(low, r / total)) if total else w for r, w in zip(raw, factors.values())]
    weights = [w / sum(weights) for w in weights]
    score = lambda ws: sum((F.col(f) * w for f, w in zip(names, ws)), F.lit(0.0))
    judged = filled(test).withColumns({"_old": F.round(score(factors.values()), 9), "_new": F.round(score(weights), 9), "_all": F.lit(1)})
    old = spearman(judged, "_old", y, ["_all"]).first()
    new = spearman(judged, "_new", y, ["_all"]).first()
    n = old.n if old else 0
    a, b = (old.spearman if old else None), (new.spearman if new else None)
    better = n >= least_test and a is not None and b is not None and b - a > 1.64 / max(1, n) ** 0.5
    return spark.createDataFrame([(f, float(c), float(w), n, a, b, bool(better)) for f, c, w in zip(names, factors.values(), weights)], schema)
