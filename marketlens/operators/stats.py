"""Exact order statistics, splits, models, proper scores and clustered bootstrap."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import finite, logistic
from marketlens.operators.timeline import prefix_sums, running
from marketlens.session import cut_lineage

GRID = 2 ** 52


def exact_quantiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group with ``n``, ``missing`` (null, NaN, infinite) and ``mean``.

    Equal values are counted before the shuffle; ranks come from running counts over ranges of (group, value) whose borders Spark
    takes from the data, so neither a large group nor a narrow one is gathered in one task.
    """
    ok = finite(value)
    # Small next to the rows, and read by three consumers: written once.
    counts = cut_lineage(df.groupBy(*by, F.when(ok, F.col(value).cast("double")).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    known = F.col("_v").isNotNull()
    n = F.coalesce(F.sum(F.when(known, F.col("_c"))), F.lit(0))
    size = counts.groupBy(*by).agg(n.alias("n"), F.coalesce(F.sum(F.when(~known, F.col("_c"))), F.lit(0)).alias("missing"),
                                   (F.sum(F.col("_v") * F.col("_c")) / F.nullif(n, F.lit(0))).alias("mean"))
    ranked = prefix_sums(counts.filter(known), [*by, "_v"], {"_cum": F.col("_c")})
    if by:
        first = ranked.groupBy(*by).agg(F.min(F.col("_cum") - F.col("_c")).alias("_first"))
        d = ranked.join(size.join(first, by), by).withColumn("_cum", F.col("_cum") - F.col("_first"))
    else:
        d = ranked.withColumn("n", size.select("n").scalar())
    picks = []
    for name, frac in fractions.items():
        pos = (F.col("n") - 1) * F.lit(frac)
        lo, hi = F.floor(pos), F.least(F.floor(pos) + 1, F.col("n") - 1)
        at = lambda i: F.max(F.when((F.col("_cum") > i) & (F.col("_cum") - F.col("_c") <= i), F.col("_v")))
        picks += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}")]
    g = d.groupBy(*by).agg(*picks)
    if by:
        out = size.join(g, by, "left")
    else:
        g = cut_lineage(g)
        out = size.withColumns({c: g.select(c).scalar() for c in g.columns})
    return out.select(*by, "n", "missing", "mean", *[
        (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
         * ((F.col("n") - 1) * F.lit(frac) - F.floor((F.col("n") - 1) * F.lit(frac)))).alias(name)
        for name, frac in fractions.items()])


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, missing, quartiles and mean."""
    return exact_quantiles(df, by, value, QUARTILES)


def feature_contrast(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Quartiles of every feature by group, in long form."""
    longer = df.unpivot([group], features, "feature", "value")
    return exact_quantiles(longer, [group, "feature"], "value", QUARTILES)


def chronological_split(df: DataFrame, order: list[str], share: float = 0.7, until: str | None = None) -> DataFrame:
    """``split``: the first ``share`` of the rows trains, the rest tests.

    Training rows whose label time ``until`` reaches the first test decision are under embargo.
    """
    ts = order[0]
    d = prefix_sums(df, order, {"_seq": F.lit(1).cast("long")})
    n = df.agg(F.count(F.lit(1)).alias("n")).select(F.floor(F.col("n") * share)).scalar()
    d = d.withColumn("_train", F.col("_seq") <= n)
    start = d.filter(~F.col("_train")).agg(F.min(ts)).scalar()
    held = F.col("_train") & (F.col(until) >= start) if until else F.lit(False)
    return d.withColumn("split", F.when(held, "embargo").when(F.col("_train"), "train").otherwise("test")).drop("_seq", "_train")


def standardisation(train: DataFrame, features: list[str]) -> DataFrame:
    """One row with the mean and population deviation (1 where 0) of every feature."""
    return train.agg(*[F.avg(f).alias(f"mean_{f}") for f in features],
                     *[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f"scale_{f}") for f in features],
                     F.count(F.lit(1)).alias("n"))


def fit_logistic(train: DataFrame, features: list[str], label: str, most: int = 50, tol: float = 1e-12) -> dict:
    """L2-penalised logistic model on standardised features; penalty 1/n, intercept free; with standard errors.

    Newton steps: each reads the written rows once and sums loss, gradient and Hessian, k x k numbers for k features; a step that would
    raise the loss is halved. The sums hardly depend on how rows are dealt, and the optimum not at all.
    """
    s = standardisation(train, features).first()
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    rows = cut_lineage(train.select(F.col(label).cast("double").alias("_y"), *[((F.col(f) - s[f"mean_{f}"]) / s[f"scale_{f}"]).alias(f) for f in features]))
    k, n = len(x), s["n"]
    ridge = np.array([0.0] + [1.0 / n] * len(features))

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = reduce(lambda a, c: a + c, [F.lit(float(wi)) * xi for wi, xi in zip(w, x)])
        d = rows.withColumn("_z", z).withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))))
        loss = F.greatest(F.col("_z"), F.lit(0.0)) - F.col("_z") * F.col("_y") + F.log1p(F.exp(-F.abs("_z")))
        out = d.agg(F.sum(loss).alias("l"), *[F.sum((F.col("_p") - F.col("_y")) * x[i]).alias(f"g{i}") for i in range(k)],
                    *[F.sum(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
        hessian = np.array([[out[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) / n + np.diag(ridge)
        return out["l"] / n + float(ridge @ (w * w)) / 2, np.array([out[f"g{i}"] for i in range(k)]) / n + ridge * w, hessian

    w = np.zeros(k)
    loss, gradient, hessian = at(w)
    for _ in range(most):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        for _ in range(30):
            new = at(w - step)
            if new[0] <= loss + 1e-13:
                break
            step = step / 2
        w, (loss, gradient, hessian) = w - step, new
        if np.abs(step).max() < tol:
            break
    errors = np.sqrt(np.diag(np.linalg.pinv(hessian)) / n)
    return {"features": features, "mean": [s[f"mean_{f}"] for f in features], "scale": [s[f"scale_{f}"] for f in features],
            "coefficients": [float(c) for c in w], "errors": [float(c) for c in errors], "gradient": [float(c) for c in gradient], "loss": float(loss)}


def predict(df: DataFrame, model: dict) -> DataFrame:
    """``probability`` of a stored model; null with a ``predict_reason`` where an input is invalid."""
    fs = model["features"]
    ok = reduce(lambda a, z: a & z, [finite(f) for f in fs])
    z = reduce(lambda a, y: a + y, [F.lit(float(w)) * (F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, w, m, s in
                                    zip(fs, model["coefficients"][1:], model["mean"], model["scale"])],
               F.lit(float(model["coefficients"][0])))
    return (df.withColumn("probability", F.when(ok, logistic(z)))
            .withColumn("predict_reason", F.when(~ok, "invalid_features_or_entry")))


def score_probabilities(df: DataFrame, outcome: str, p: str, base: Column, by: list[str] = ()) -> DataFrame:
    """Brier score and clipped log loss of the model and of the base rate, and their paired delta."""
    y = F.col(outcome).cast("double")

    def loss(q):
        c = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), q))
        return -(y * F.ln(c) + (1 - y) * F.ln(1 - c))

    b2, m2 = (base - y) * (base - y), (F.col(p) - y) * (F.col(p) - y)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("positive_rate"), F.avg(m2).alias("brier"),
                               F.avg(loss(F.col(p))).alias("log_loss"), F.avg(b2).alias("base_brier"),
                               F.avg(loss(base)).alias("base_log_loss"), F.avg(m2 - b2).alias("brier_delta"))


def cluster_bootstrap(df: DataFrame, cluster: str, num: Column, den: Column, reps: int = 2000, seed: str = "1",
                      min_clusters: int = 10) -> DataFrame:
    """Percentile interval of ``sum(num)/sum(den)`` when whole clusters are drawn with replacement.

    The draw of repetition r at place i is the md5 of ``seed|r|i`` modulo the number of clusters. Rows
    are first reduced to one per cluster; below ``min_clusters`` no interval is given.
    """
    sums = df.groupBy(cluster).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"))
    sums = running(sums.withColumn("_o", F.col(cluster).cast("long")), [], ["_o"], 64, {"_i": ("sum", F.lit(1))})
    sums = sums.select((F.col("_i") - 1).alias("_i"), "_n", "_d")
    total = sums.agg(F.count(F.lit(1)).alias("clusters"), F.sum("_n").alias("_n"), F.sum("_d").alias("_d"))
    spark = df.sparkSession
    places = sums.select(F.col("_i").alias("_place"))
    k = total.select("clusters").scalar()
    draws = (places.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
             .withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("_rep").cast("string"), F.col("_place").cast("string"))))
             .withColumn("_i", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % k))
    rates = (draws.join(sums, "_i").groupBy("_rep").agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d"))
             .filter("_d > 0").select((F.col("_n") / F.col("_d")).alias("_r")))
    # One value per repetition: the list is as long as ``reps``.
    cut = rates.agg(F.sort_array(F.collect_list("_r")).alias("_s")).select(
        F.try_element_at("_s", (F.floor(F.size("_s") * 0.025) + 1).cast("int")).alias("p025"),
        F.try_element_at("_s", (F.least(F.size("_s") - 1, F.floor(F.size("_s") * 0.975)) + 1).cast("int")).alias("p975"))
    readable = F.col("clusters") >= min_clusters
    return total.select("clusters", (F.col("_n") / F.nullif(F.col("_d"), F.lit(0))).alias("estimate"), readable.alias("readable"),
                        F.when(readable, cut.select("p025").scalar()).alias("p025"),
                        F.when(readable, cut.select("p975").scalar()).alias("p975"))


def arm_bootstrap(df: DataFrame, cluster: str, arm: str, rates: dict[str, Column], base: str, reps: int = 2000, seed: str = "1",
                  min_clusters: int = 10) -> DataFrame:
    """Per arm and rate: the estimate, its difference to the ``base`` arm and the percentile interval over clusters drawn with
    replacement. ``rates`` are conditions; an arm without rows in a draw adds nothing to its interval.

    ``df`` has a row for each observation and arm. Draws are those of ``cluster_bootstrap``; the clusters are all that
    occur in any arm. Rows are first reduced to one per cluster and arm.
    """
    per = cut_lineage(df.groupBy(cluster, F.col(arm).alias("arm")).agg(F.count(F.lit(1)).alias("_d"), *[F.count_if(c).alias(n) for n, c in rates.items()]))
    days = running(per.select(F.col(cluster).cast("long").alias("_o")).distinct(), [], ["_o"], 64, {"_i": ("sum", F.lit(1))}).select("_o", (F.col("_i") - 1).alias("_i"))
    days = cut_lineage(days)
    k = days.count()
    draws = (days.select(F.col("_i").alias("_place")).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
             .withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("_rep").cast("string"), F.col("_place").cast("string"))))
             .select("_rep", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % max(k, 1)).alias("_i")))
    # How often each draw takes each cluster, so a cluster drawn twice costs no more than one.
    taken = draws.groupBy("_rep", "_i").agg(F.count(F.lit(1)).alias("_t"))
    names = list(rates)
    drawn = taken.join(days, "_i").join(per, F.col("_o") == F.col(cluster)).groupBy("_rep", "arm").agg(
        F.sum(F.col("_d") * F.col("_t")).alias("_d"), *[F.sum(F.col(n) * F.col("_t")).alias(n) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), (F.col(n) / F.col("_d")).alias("v")) for n in names]))
    # One value per repetition: each list is as long as ``reps``.
    cut = drawn.select("arm", each.alias("_e")).groupBy("arm", "_e.rate").agg(F.sort_array(F.collect_list("_e.v")).alias("_s"))
    at = lambda q: F.try_element_at("_s", (F.least(F.size("_s") - 1, F.floor(F.size("_s") * q)) + 1).cast("int"))
    cut = cut.select("arm", "rate", at(0.025).alias("p025"), at(0.975).alias("p975"))
    whole = per.groupBy("arm").agg(F.sum("_d").alias("_d"), *[F.sum(n).alias(n) for n in names]).select("arm", each.alias("_e")).select("arm", "_e.rate", F.col("_e.v").alias("estimate"))
    first = whole.filter(F.col("arm") == base).select("rate", F.col("estimate").alias("_b"))
    readable = F.lit(k >= min_clusters)
    d = whole.join(first, "rate", "left").join(cut, ["arm", "rate"], "left")
    return d.select("arm", "rate", F.lit(k).cast("long").alias("clusters"), readable.alias("readable"), "estimate", (F.col("estimate") - F.col("_b")).alias("difference"),
                    F.when(readable, F.col("p025")).alias("p025"), F.when(readable, F.col("p975")).alias("p975"))
