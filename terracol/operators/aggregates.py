"""Normalisations, statistics, histograms and scores."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, isinf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracol.functions.columns import PIXEL_AREA, nan_nonpositive, no_nan
from terracol.functions.session import materialised


def long_bands(pixels: DataFrame, *keep: str) -> DataFrame:
    return pixels.select(*keep, F.posexplode("bands").alias("band", "value"))


#: Rows of one bracket that exact_quantiles sorts, the accuracy of its sketches, and the cuts of a bracket sketched again.
SORTED_ROWS = 1 << 20
ACCURACY = 10_000
CUTS = 256


def between(a: float, b: float, share: float) -> float:
    """The place at ``share`` of the way from a to b, also where their distance is no number or beyond the largest."""
    if a == b or share == 0:
        return a
    if isinf(b - a):
        return a * (1 - share) + b * share
    return a + (b - a) * share


def exact_quantiles(values: DataFrame, probs: list[float]) -> DataFrame:
    """(band, q): the quantiles of the non-null, non-NaN ``value`` of each band, linear between neighbours; a band
    without values has no row. Infinities are the ends of the order; halfway between both of them is NaN.

    One pass sketches every band; its summaries, merged from all tasks, bracket each wanted rank with a few thousandths
    of the rows. A second pass counts what lies below a bracket and the different values inside it, which gives the
    value at the rank. A bracket of over SORTED_ROWS rows (of billions) is sketched again first. A row a band and rank
    reaches the driver, and CUTS values for a bracket sketched again.
    """
    spark = values.sparkSession
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value")).select("band", F.col("value").cast("double").alias("value"))
    slack = 4 / ACCURACY
    grid = sorted({min(max(p + off, 0.0), 1.0) for p in probs for off in (-slack, slack)})
    sketch = v.groupBy("band").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.percentile_approx("value", grid, ACCURACY).alias("at"))
    bands = {r["band"]: r for r in sketch.collect()}
    state = {}  # (band, prob) -> low, high, about how many rows between
    for band, r in bands.items():
        at = dict(zip(grid, r["at"], strict=True))
        for p in probs:
            few = 2 * slack * r["n"] < 1  # the ends of the order are brackets too
            state[band, p] = (r["low"] if few or p <= slack else at[max(p - slack, 0.0)], r["high"] if few or p >= 1 - slack else at[min(p + slack, 1.0)], 2 * slack * r["n"])
    ranks = {(band, p): (floor(p * (r["n"] - 1)), ceil(p * (r["n"] - 1))) for band, r in bands.items() for p in probs}

    def bracketed(keys: list) -> DataFrame:
        ranges = spark.createDataFrame([(band, p, state[band, p][0], state[band, p][1]) for band, p in keys], "band int, p double, low double, high double")
        return v.join(F.broadcast(ranges), "band").where("value <= high")

    wanted = spark.createDataFrame([(*k, *r) for k, r in ranks.items()], "band int, p double, first long, last long")
    ends, margin = {}, 0.5
    while open_ := [k for k in state if k not in ends]:
        while wide := [k for k in open_ if state[k][2] > SORTED_ROWS and state[k][0] < state[k][1]]:
            inside = F.col("value") >= F.col("low")
            cuts = [i / CUTS for i in range(CUTS + 1)]
            rows = bracketed(wide).groupBy("band", "p").agg(F.count_if(~inside).alias("below"), F.count_if(inside).alias("n"), F.percentile_approx(F.when(inside, F.col("value")), cuts, ACCURACY).alias("at"))
            for r in rows.collect():
                key = r["band"], r["p"]
                first, last = ((rank - r["below"]) / max(r["n"] - 1, 1) * CUTS for rank in ranks[key])
                i, j = (min(max(k, 0), CUTS) for k in (floor(first - margin), ceil(last + margin)))
                low, high, _ = state[key]
                new = (low if i == 0 else r["at"][i], high if j == CUTS else r["at"][j], r["n"] * (j - i) / CUTS)
                # a bracket that its own values leave as wide as it was is as narrow as it gets
                state[key] = new if new[:2] != (low, high) else (low, high, 0)
        x = F.when(F.col("value") >= F.col("low"), F.col("value")).alias("x")
        counts = bracketed(open_).groupBy("band", "p", x).agg(F.count("*").alias("c"))
        running = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("band", "p").orderBy(F.asc_nulls_first("x"))))
        hit = lambda rank: (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("c") <= F.col(rank)) & F.col("x").isNotNull()
        found = running.join(F.broadcast(wanted), ["band", "p"]).groupBy("band", "p").agg(*[F.max(F.when(hit(r), F.col("x"))).alias(r) for r in ("first", "last")])
        ends |= {(r["band"], r["p"]): (r["first"], r["last"]) for r in found.where("first IS NOT NULL AND last IS NOT NULL").collect()}
        margin *= 4  # a rank that a sketch put outside its bracket is looked for in the whole band, with more room
        for k in [k for k in state if k not in ends]:
            state[k] = (bands[k[0]]["low"], bands[k[0]]["high"], bands[k[0]]["n"])
    share = lambda band, p: p * (bands[band]["n"] - 1) - ranks[band, p][0]
    return spark.createDataFrame([(band, [between(*ends[band, p], share(band, p)) for p in probs]) for band in bands], "band int, q array<double>")


def band_stats(pixels: DataFrame, **aggregates) -> DataFrame:
    """One row: for each name an array over bands. One pass; band counts are small, pixels only feed partial sums."""
    per = long_bands(pixels).groupBy("band").agg(*[a.alias(k) for k, a in aggregates.items()])

    def in_order(k: str):
        return F.transform(F.array_sort(F.collect_list(F.struct("band", F.col(k)))), lambda x: x[k]).alias(k)

    return per.agg(*[in_order(k) for k in aggregates])


def normalize_bands_max(pixels: DataFrame) -> DataFrame:
    """Each band over its greatest value; values at or below 0 become null."""
    top = band_stats(pixels, top=F.max(no_nan(F.col("value"))))
    return pixels.crossJoin(F.broadcast(top)).withColumn("bands", F.zip_with("bands", "top", lambda x, m: nan_nonpositive(x / F.when(m != 0, m)))).drop("top")


def normalize_minmax(df: DataFrame, value: str = "value") -> DataFrame:
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return df.crossJoin(F.broadcast(ends)).withColumn(value, (F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))).drop("_low", "_high")


def _band_map(table: DataFrame) -> Column:
    """A literal map from band to ``q`` of a table with one row a band."""
    rows = table.select("band", "q").collect()
    if not rows:
        return F.create_map().cast("map<int,array<double>>")
    return F.create_map(*[x for r in rows for x in (F.lit(r["band"]), F.array(*[F.lit(v) for v in r["q"]]))])


def normalize_p95(pixels: DataFrame) -> DataFrame:
    """Each band over its 95th percentile (linear between values) of what is above 0, where that is above 0."""
    clean = pixels.withColumn("bands", F.transform("bands", nan_nonpositive))
    top = _band_map(exact_quantiles(long_bands(clean), [0.95]))

    def scale(x: Column, i: Column) -> Column:
        m = F.get(F.try_element_at(top, i), F.lit(0))
        return F.when(m > 0, x / m).otherwise(x)

    return clean.withColumn("bands", F.transform("bands", scale))


def normalize_zscore(pixels: DataFrame) -> DataFrame:
    s = band_stats(pixels, mean=F.avg("value"), sd=F.stddev_pop("value"))
    return pixels.crossJoin(F.broadcast(s)).withColumn("bands", F.transform("bands", lambda x, i: (x - F.get("mean", i)) / F.when(F.get("sd", i) != 0, F.get("sd", i)))).drop("mean", "sd")


def normalize_robust(pixels: DataFrame) -> DataFrame:
    """Each band less its median, over its interquartile range; null where that is 0."""
    table = _band_map(exact_quantiles(long_bands(pixels), [0.25, 0.5, 0.75]))

    def scale(x: Column, i: Column) -> Column:
        q = F.try_element_at(table, i)
        iqr = F.get(q, F.lit(2)) - F.get(q, F.lit(0))
        return (x - F.get(q, F.lit(1))) / F.when(iqr != 0, iqr)

    return pixels.withColumn("bands", F.transform("bands", scale))


def t_quantile(df: int, p: float = 0.975) -> float:
    """Quantile of Student's t by bisection on a Simpson integral of its density."""
    from math import exp, lgamma, pi, sqrt

    if df <= 0:
        return float("nan")
    scale = exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi)
    density = lambda t: scale * (1 + t * t / df) ** (-(df + 1) / 2)

    def below(x: float) -> float:
        n = 2000
        h = x / n
        return 0.5 + h / 3 * (density(0) + density(x) + sum((4 if i % 2 else 2) * density(i * h) for i in range(1, n)))

    low, high = 0.0, 2.0
    while below(high) < p and high < 1e4:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def spectral_stats(pixels: DataFrame) -> DataFrame:
    """Per band: n (null pixels too), mean, median, std, sem, margin (95 % t), iqr, min, max."""
    v = no_nan(F.col("value"))
    s = materialised(long_bands(pixels).groupBy("band").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")))
    sizes = [r["n"] for r in s.select("n").distinct().collect()]  # one number a band at most
    quantile = s.sparkSession.createDataFrame([(n, t_quantile(n - 1)) for n in sizes], "n long, t double")
    q = exact_quantiles(long_bands(pixels), [0.25, 0.5, 0.75])
    s = s.join(F.broadcast(quantile), "n").join(F.broadcast(q), "band", "left")
    sem = F.col("std") / F.sqrt("n")
    return s.select("band", "n", "mean", F.col("q")[1].alias("median"), "std", sem.alias("sem"), (sem * F.col("t")).alias("margin"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "min", "max")


def mask_values_per_band(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    return long_bands(pixels.join(cells.select("row", "col"), ["row", "col"], "left_semi"), "row", "col")


def mask_average_per_band(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    values = mask_values_per_band(pixels, cells)
    q = exact_quantiles(values, [0.5])
    return values.groupBy("band").agg(F.avg("value").alias("mean")).join(F.broadcast(q), "band", "left").select("band", "mean", F.col("q")[0].alias("median"))


def value_histogram(df: DataFrame, value: str = "value") -> DataFrame:
    """Counts of each value, null (unknown) included."""
    return df.groupBy(no_nan(F.col(value).cast("double")).alias(value)).agg(F.count("*").alias("n"))


def grouped_histogram(df: DataFrame, value: str = "value", group: float = 2.0, least: float = 1.0) -> DataFrame:
    """Values above ``least`` by nearest multiple of ``group`` (halves to even): count and area in square metres."""
    kept = df.where((F.col(value) > F.lit(least)) & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy((F.rint(F.col(value) / F.lit(float(group))) * F.lit(float(group))).alias("bin")).agg(F.count("*").alias("n"), (F.count("*") * F.lit(PIXEL_AREA)).alias("area"))


def density_histogram(pixels: DataFrame, bins: int = 50) -> DataFrame:
    """Per band a histogram of equal bins between its ends whose area is 1."""
    v = long_bands(pixels).where("value IS NOT NULL AND NOT isnan(value)")
    ends = v.groupBy("band").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("all"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    counts = v.join(F.broadcast(ends), "band").withColumn("bin", at.cast("int")).groupBy("band", "bin", "low", "high", "all").agg(F.count("*").alias("n"))
    return counts.select("band", "bin", "n", (F.col("n") / (F.col("all") * F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0) / bins)).alias("density"))


def bounding_boxes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("value").agg(F.min("row").alias("min_row"), F.min("col").alias("min_col"), (F.max("row") + 1).alias("max_row"), (F.max("col") + 1).alias("max_col"))


def smallest_region(boxes: DataFrame, key: str = "value") -> DataFrame:
    side = F.least(F.col("max_row") - F.col("min_row"), F.col("max_col") - F.col("min_col"))
    return boxes.agg(F.min_by(key, F.struct(side, F.col(key))).alias(key))


def distinct_classes(labels: DataFrame) -> DataFrame:
    return labels.where("value > 0").select("value").distinct()


def mask_removed_pct(before: DataFrame, after: DataFrame, value: str = "value") -> DataFrame:
    n = before.agg(F.count(value).alias("before")).crossJoin(after.agg(F.count(value).alias("after")))
    return n.withColumn("removed_pct", (F.col("before") - F.col("after")) * 100.0 / F.nullif(F.col("before"), F.lit(0)))


# --- scores ----------------------------------------------------------------------------------------------------
def confusion_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.where("y_true IS NOT NULL AND y_pred IS NOT NULL").groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def per_class(df: DataFrame, *by: str) -> DataFrame:
    """tp, support, predicted, precision, recall and f1 of each class; 0 where a ratio has no denominator."""
    c = confusion_counts(df, *by)
    a = c.select(*by, F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"))
    b = c.select(*by, F.col("y_pred").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp"))
    s = a.unionByName(b).groupBy(*by, "label").agg(*[F.sum(k).alias(k) for k in ("support", "predicted", "tp")])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_metrics(df: DataFrame, *by: str) -> DataFrame:
    total = F.sum("support")
    return per_class(df, *by).groupBy(*by).agg((F.sum("tp") / total).alias("accuracy"), *[(F.sum(F.col(k) * F.col("support")) / total).alias(k) for k in ("precision", "recall", "f1")])


def regression_metrics(df: DataFrame, *by: str, tolerance: float | None = None) -> DataFrame:
    """mae, mse, rmse and r2 = 1 - SSE / SST (without variance: 1 for no error, else 0); with ``tolerance``, also
    ``within``, the share of predictions at most so far off."""
    e = F.col("y_true") - F.col("y_pred")
    more = [] if tolerance is None else [F.avg((F.abs(e) <= tolerance).cast("double")).alias("within")]
    s = df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop("y_true").alias("var"), *more)
    r2 = F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return s.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), *(["within"] if more else []))


def pci_metrics(df: DataFrame, tolerance: float = 1.0, *by: str) -> DataFrame:
    """Classification and regression scores and the share of predictions within ``tolerance``, in two passes."""
    classes, errors = classification_metrics(df, *by), regression_metrics(df, *by, tolerance=tolerance)
    return classes.join(errors, list(by)) if by else classes.crossJoin(errors)


def batch_metrics(df: DataFrame, *by: str, tolerance: float = 1.0) -> DataFrame:
    """pci_metrics of each dataset (columns ``by``) with its number of predictions."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    return pci_metrics(df, tolerance, *by).join(sizes, list(by))


#: Labels that a full confusion matrix is made for, at most.
LABELS = 4096


def confusion_matrix(df: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(y_true, y_pred, n): the pairs that occur; with labels (a ``label`` column, LABELS rows at most), every pair of
    these, 0 where it doesn't occur."""
    c = confusion_counts(df)
    if labels is None:
        return c.select("y_true", "y_pred", "n")
    names = [r["label"] for r in labels.select("label").distinct().limit(LABELS + 1).collect()]
    if len(names) > LABELS:
        raise ValueError(f"a full matrix is made for {LABELS} labels at most")
    every = labels.select(F.col("label").alias("y_true")).distinct().withColumn("y_pred", F.explode(F.array(*[F.lit(v) for v in names])))
    return every.join(c, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame) -> DataFrame:
    p = per_class(df)
    rows = p.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    macro = p.agg(F.lit("macro avg").alias("label"), *[F.avg(k).alias(k) for k in ("precision", "recall", "f1")], total.alias("support"))
    weighted = p.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(k) * F.col("support")) / total).alias(k) for k in ("precision", "recall", "f1")], total.alias("support"))
    accuracy = p.agg(F.lit("accuracy").alias("label"), *[(F.sum("tp") / total).alias(k) for k in ("precision", "recall", "f1")], total.alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def data_quality(pixels: DataFrame) -> DataFrame:
    """Extent, pixel count, band count, nulls, NaNs, infinities and value range in one pass over the bands."""
    flat = pixels.select("row", "col", "bands")
    v = F.col("value")
    shape = flat.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count("*").alias("pixels"), F.min(F.size("bands")).alias("min_bands"), F.max(F.size("bands")).alias("max_bands"))
    values = long_bands(flat).agg(F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinities"), F.min(no_nan(v)).alias("low"), F.max(no_nan(v)).alias("high"))
    return shape.crossJoin(values)


def band_covariance(pixels: DataFrame) -> DataFrame:
    """(i, j, n, mean_i, mean_j, cov): the sample covariance of each pair of bands over all pixels, null and NaN as 0; all
    pixels have as many bands. One pass: a task adds up its pixels' products, less the first pixel's values, which keeps
    sums short, and sends a row a pair."""
    clean = pixels.select(F.transform("bands", lambda x: F.coalesce(no_nan(x.cast("double")), F.lit(0.0))).alias("bands"))
    first = clean.first()
    if first is None:
        return pixels.sparkSession.createDataFrame([], "i int, j int, n long, mean_i double, mean_j double, cov double")
    shift = np.array(first["bands"], dtype=float)
    size = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size) - shift
                n, total, cross = n + len(x), total + x.sum(axis=0), cross + x.T @ x
        i, j = np.divmod(np.arange(size * size if n else 0), size)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), np.full(len(i), n), total[i], total[j], cross.reshape(-1)[: len(i)])], names=["i", "j", "n", "a", "b", "c"])

    names = ("n", "a", "b", "c")
    sums = clean.mapInArrow(run, "i int, j int, n long, a double, b double, c double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    at = lambda k: F.get(F.array(*[F.lit(float(v)) for v in shift]), F.col(k))
    cov = (F.col("c") - F.col("a") * F.col("b") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return sums.select("i", "j", "n", (at("i") + F.col("a") / F.col("n")).alias("mean_i"), (at("j") + F.col("b") / F.col("n")).alias("mean_j"), cov.alias("cov"))


def false_color_pca(pixels: DataFrame, components: int = 3) -> DataFrame:
    """Three principal components, each between 0 and 1, as (pc2, pc1, pc3); a component's sign is that of its largest
    loading. One pass for the bands' covariance, a row a pair of bands of which reaches the driver, and one for all
    three ranges."""
    table = band_covariance(pixels).select("i", "j", "cov").toArrow().to_pandas()
    if not len(table):
        return pixels.withColumn("rgb", F.struct(*[F.lit(0.0).alias(c) for c in "rgb"]))
    size = int(table["i"].max()) + 1
    cov = np.zeros((size, size))
    cov[table["i"], table["j"]] = table["cov"].fillna(0.0)
    load = np.linalg.eigh(cov)[1][:, ::-1][:, :components]
    load = load * np.where(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
    dot = lambda k: F.aggregate(F.zip_with("bands", F.array(*[F.lit(float(v)) for v in load[:, k]]), lambda x, w: F.coalesce(no_nan(x.cast("double")), F.lit(0.0)) * w), F.lit(0.0), lambda a, x: a + x)
    p = pixels.select(*pixels.columns, *[dot(k).alias(f"_pc{k}") for k in range(load.shape[1])])
    ends = p.agg(*[f(f"_pc{k}").alias(f"_{n}{k}") for k in range(load.shape[1]) for n, f in (("low", F.min), ("high", F.max))])
    scaled = lambda k: (F.col(f"_pc{k}") - F.col(f"_low{k}")) / F.nullif(F.col(f"_high{k}") - F.col(f"_low{k}"), F.lit(0.0)) if k < load.shape[1] else F.lit(None).cast("double")
    rgb = F.struct(scaled(1).alias("r"), scaled(0).alias("g"), scaled(2).alias("b"))
    return p.crossJoin(F.broadcast(ends)).select(*pixels.columns, rgb.alias("rgb"))


def stack_bands(rasters: DataFrame) -> DataFrame:
    return rasters.groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda x: x["value"]).alias("bands"))

