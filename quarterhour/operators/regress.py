"""Regressions from sums. Spark aggregates the cross products of each group; only those few numbers are solved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import ratio
from quarterhour.functions.stats import avg_where, count_where, intercept, quantile, slope
from quarterhour.operators.features import join_stats
from quarterhour.operators.grid import days_ago


def det(m: Sequence[Sequence[Column]]) -> Column:
    """Determinant of a matrix of up to 3 x 3 column expressions."""
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    out = None
    for j in range(3):
        minor = [[m[i][k] for k in range(3) if k != j] for i in (1, 2)]
        term = m[0][j] * det(minor)
        out = term if out is None else (out - term if j % 2 else out + term)
    return out


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], min_rows: int = 10) -> DataFrame:
    """Least squares on up to three features by Cramer's rule over covariances: intercept, one beta per feature, r2, n.

    Rows with a missing value in any variable are left out. A singular system gives NULL betas.
    """
    ok = None
    for c in (y, *xs):
        ok = F.col(c).isNotNull() if ok is None else ok & F.col(c).isNotNull()
    d = df.where(ok)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("_my"), F.var_pop(y).alias("_vy")]
    for i, a in enumerate(xs):
        aggs += [F.avg(a).alias(f"_m{i}"), F.covar_pop(a, y).alias(f"_c{i}y")]
        aggs += [F.covar_pop(a, xs[j]).alias(f"_c{i}{j}") for j in range(i, len(xs))]
    g = d.groupBy(*keys).agg(*aggs).where(F.col("n") >= min_rows)
    k = len(xs)
    cov = [[F.col(f"_c{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)]
    rhs = [F.col(f"_c{i}y") for i in range(k)]
    dd = det(cov)
    scale = F.lit(1.0)
    for i in range(k):
        scale = scale * cov[i][i]
    g = g.withColumn("_d", F.when(F.abs(dd) > 1e-12 * F.abs(scale), dd))
    for j, name in enumerate(xs):
        m = [[rhs[i] if c == j else cov[i][c] for c in range(k)] for i in range(k)]
        g = g.withColumn(f"beta_{name}", F.try_divide(det(m), F.col("_d")))
    fit = sum((F.col(f"beta_{n}") * F.col(f"_m{i}") for i, n in enumerate(xs)), F.lit(0.0))
    expl = sum((F.col(f"beta_{n}") * rhs[i] for i, n in enumerate(xs)), F.lit(0.0))
    return g.select(*keys, (F.col("_my") - fit).alias("intercept"), *[f"beta_{n}" for n in xs], ratio(expl, F.col("_vy")).alias("r2"), "n")


def temperature_curve(df: DataFrame, cdd: float = 22.0, hdd: float = 15.0, bins: int = 25, feature: str = "load") -> DataFrame:
    """Cooling and heating slopes on degree terms (rows beyond the base only) and the temperature bin of least load."""
    c, h = F.greatest(F.col("temperature") - cdd, F.lit(0.0)), F.greatest(hdd - F.col("temperature"), F.lit(0.0))
    d = df.withColumn("_c", F.when(F.col("temperature") > cdd, c)).withColumn("_h", F.when(F.col("temperature") < hdd, h))
    s = d.groupBy("state").agg(slope(feature, "_c").alias("cooling_slope"), slope(feature, "_h").alias("heating_slope"))
    b = temperature_bins(df, bins, feature)
    best = b.groupBy("state").agg(F.min_by("temp_mean", F.struct("load_mean", "bin")).alias("optimum_temp"), F.min("load_mean").alias("optimum_load"))
    return s.join(best, "state")


def temperature_bins(df: DataFrame, bins: int = 25, feature: str = "load") -> DataFrame:
    from quarterhour.operators.select import equal_width_bins
    b = equal_width_bins(df, "temperature", bins).where("bin is not null")
    return b.groupBy("state", "bin").agg(F.avg(feature).alias("load_mean"), F.stddev_samp(feature).alias("load_std"), F.count(F.lit(1)).alias("n"), F.avg("temperature").alias("temp_mean"))


def day_sensitivity(df: DataFrame, cdd: float = 24.0, hdd: float = 18.0, feature: str = "load") -> DataFrame:
    """Day-level regression on CDD, HDD and humidity, leaving out constant columns, plus the simple slope and humid / dry amplification."""
    d = df.groupBy("state", "date").agg(F.avg(feature).alias("y"), F.avg("temperature").alias("t"), F.avg("humidity").alias("hum"))
    d = d.withColumn("cdd", F.greatest(F.col("t") - cdd, F.lit(0.0))).withColumn("hdd", F.greatest(hdd - F.col("t"), F.lit(0.0))).where("y is not null and t is not null and hum is not null")
    full = ols(d, "y", ["cdd", "hdd", "hum"], ["state"], 5).select("state", F.col("beta_cdd").alias("f1"), F.col("beta_hdd").alias("f2"), F.col("beta_hum").alias("f3"))
    no_h = ols(d, "y", ["cdd", "hum"], ["state"], 5).select("state", F.col("beta_cdd").alias("c1"), F.col("beta_hum").alias("c3"))
    no_c = ols(d, "y", ["hdd", "hum"], ["state"], 5).select("state", F.col("beta_hdd").alias("h2"), F.col("beta_hum").alias("h3"))
    hum = d.groupBy("state").agg(slope("y", "hum").alias("o3"), slope("y", "t").alias("temperature_sensitivity"), F.median("hum").alias("_mh"), F.count(F.lit(1)).alias("n_days"))
    h = d.join(hum.select("state", "_mh"), "state")
    side = lambda c: F.when(c, F.col("cdd"))
    humid, dry = F.col("hum") > F.col("_mh"), F.col("hum") <= F.col("_mh")
    q = h.groupBy("state").agg(slope("y", side(humid)).alias("_sh"), slope("y", side(dry)).alias("_sd"), count_where(humid).alias("_nh"), count_where(dry).alias("_nd"))
    ok = (F.least("_nh", "_nd") >= 4) & (F.col("_sd") > 1e-6) & (F.col("_sh") > 0)
    j = hum.join(full, "state", "left").join(no_h, "state", "left").join(no_c, "state", "left").join(q, "state")
    z = F.lit(0.0)
    return j.select("state", F.greatest(F.coalesce("f1", "c1", z), z).alias("cooling_sensitivity"),
                    F.greatest(F.coalesce("f2", F.when(F.col("c1").isNull(), F.col("h2")), z), z).alias("heating_sensitivity"),
                    F.coalesce("f3", "c3", "h3", "o3", z).alias("humidity_sensitivity"), "temperature_sensitivity",
                    F.when(ok, F.col("_sh") / F.col("_sd")).alias("humidity_amplification"), "n_days")


# --- general systems: cross products in Spark, tiny solves in Python ----------------------------------------------


def cross_products(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Sums per group: n, sum of y and y^2, arrays of sums x_i, x_i*y and x_i*x_j (upper triangle, row by row)."""
    ok = F.col(y).isNotNull()
    for c in xs:
        ok = ok & F.col(c).isNotNull()
    w = F.lit(1.0) if weight is None else weight
    x = [F.col(c).cast("double") for c in xs]
    yy = F.col(y).cast("double")
    tri = [F.sum(w * x[i] * x[j]) for i in range(len(xs)) for j in range(i, len(xs))]
    return df.where(ok).groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * yy).alias("sy"), F.sum(w * yy * yy).alias("syy"), F.array(*[F.sum(w * c) for c in x]).alias("sx"),
                                           F.array(*[F.sum(w * c * yy) for c in x]).alias("sxy"), F.array(*tri).alias("sxx"))


def _centred(n: float, sy: float, sx: np.ndarray, sxy: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(sx)
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = tri
    a = a + np.triu(a, 1).T
    return a / n - np.outer(sx, sx) / n**2, sxy / n - sx * sy / n**2


def ridge_beta(n, sy, sx, sxy, tri, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on standardised features with an unpenalised intercept, returned in the original units."""
    c, b = _centred(n, sy, sx, sxy, tri)
    sd = np.sqrt(np.clip(np.diag(c), 0, None))
    sd = np.where(sd > 1e-9, sd, 1.0)
    s = c / np.outer(sd, sd)
    beta = np.linalg.lstsq(s + alpha / n * np.eye(len(sx)), b / sd, rcond=None)[0] / sd
    return beta, float(sy / n - beta @ sx / n)


def elastic_net(c: np.ndarray, b: np.ndarray, alpha: np.ndarray, l1_ratio: float, rounds: int = 200) -> np.ndarray:
    """Elastic net by coordinate descent for a stack of problems given as centred moments (m x k x k and m x k)."""
    sd = np.sqrt(np.clip(np.einsum("mii->mi", c), 0, None))
    live = sd > 1e-9
    sd = np.where(live, sd, 1.0)
    s, r = c / (sd[:, :, None] * sd[:, None, :]), b / sd
    w = np.zeros_like(b)
    for _ in range(rounds):
        old = w.copy()
        for i in range(b.shape[1]):
            g = r[:, i] - np.einsum("mj,mj->m", s[:, i, :], w) + s[:, i, i] * w[:, i]
            step = np.sign(g) * np.maximum(np.abs(g) - alpha * l1_ratio, 0.0) / (s[:, i, i] + alpha * (1 - l1_ratio) + 1e-12)
            w[:, i] = np.where(live[:, i], step, 0.0)
        if np.max(np.abs(w - old), initial=0.0) < 1e-10:
            break
    return w / sd


def solve_ridge(products: DataFrame, xs: Sequence[str], keys: Sequence[str], alpha: float = 0.0, min_rows: int = 10) -> DataFrame:
    """One small solve per row of ``cross_products``; rows stay where they are, no shuffle."""
    fields = {f.name: f.dataType.simpleString() for f in products.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], "intercept double", *[f"beta_{x} double" for x in xs], "r2 double", "n double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.n < min_rows:
                    continue
                sx, sxy, tri = np.asarray(r.sx), np.asarray(r.sxy), np.asarray(r.sxx)
                beta, b0 = ridge_beta(r.n, r.sy, sx, sxy, tri, alpha)
                _, b = _centred(r.n, r.sy, sx, sxy, tri)
                vy = r.syy / r.n - (r.sy / r.n) ** 2
                c, _ = _centred(r.n, r.sy, sx, sxy, tri)
                r2 = float((2 * beta @ b - beta @ c @ beta) / vy) if vy > 0 else None
                rows.append([*[getattr(r, k) for k in keys], b0, *map(float, beta), r2, float(r.n)])
            yield pd.DataFrame(rows, columns=[*keys, "intercept", *[f"beta_{x}" for x in xs], "r2", "n"])

    return products.mapInPandas(run, schema)


def location_weights(df: DataFrame, xs: Sequence[str], alpha: float = 1.0, holdout: float = 0.2, min_rows: int = 200, lookback_days: int = 120) -> DataFrame:
    """Learned location weights: ridge of (load - block mean) on a location's weather, scored on its last rows.

    ``df`` holds state, location, date, block, load and weather. Train and test are summed separately in Spark, the
    held-out R2 follows from the two sets of sums. Weights are R2 normalised per state, equal if none has signal.
    """
    last = df.groupBy("state").agg(F.max("date").alias("_last"))
    d = df.join(last, "state").where(F.col("date") > F.date_sub("_last", lookback_days))
    bm = d.select("state", "date", "block", "load").distinct().groupBy("state", "block").agg(F.avg("load").alias("_bm"))
    d = d.join(bm, ["state", "block"]).withColumn("resid", F.col("load") - F.col("_bm")).where(F.col("resid").isNotNull())
    for x in xs:
        d = d.where(F.col(x).isNotNull())
    # the split date: rows per day are counted first, so no location series is sorted as a whole
    per_day = d.groupBy("state", "location", "date").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("state", "location")
    per_day = per_day.withColumn("_tot", F.sum("_n").over(w)).withColumn("_after", F.sum("_n").over(w.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)))
    part = per_day.select("state", "location", "date", (F.col("_after") <= F.greatest(F.round(F.col("_tot") * holdout), F.lit(10.0))).alias("test"))
    d = d.join(part, ["state", "location", "date"])
    products = cross_products(d, "resid", xs, ["state", "location", "test"])
    cols = ["n", "sy", "syy", "sx", "sxy", "sxx"]
    tr = products.where(~F.col("test")).select("state", "location", *[F.col(c).alias(f"tr_{c}") for c in cols])
    te = products.where("test").select("state", "location", *[F.col(c).alias(f"te_{c}") for c in cols])
    pairs = tr.join(te, ["state", "location"], "left")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                r2 = 0.0
                if r.tr_n + (r.te_n or 0) >= min_rows and r.te_n and r.te_n == r.te_n:
                    beta, b0 = ridge_beta(r.tr_n, r.tr_sy, np.asarray(r.tr_sx), np.asarray(r.tr_sxy), np.asarray(r.tr_sxx), alpha)
                    k, sx, sxy = len(beta), np.asarray(r.te_sx), np.asarray(r.te_sxy)
                    a = np.zeros((k, k))
                    a[np.triu_indices(k)] = np.asarray(r.te_sxx)
                    a = a + np.triu(a, 1).T
                    res = r.te_syy - 2 * b0 * r.te_sy - 2 * beta @ sxy + r.te_n * b0**2 + 2 * b0 * beta @ sx + beta @ a @ beta
                    tot = r.te_syy - r.te_sy**2 / r.te_n
                    r2 = max(0.0, 1.0 - res / tot) if tot > 1e-9 else 0.0
                rows.append([r.state, r.location, float(r2)])
            yield pd.DataFrame(rows, columns=["state", "location", "r2"])

    s = pairs.mapInPandas(score, "state string, location string, r2 double")
    s = join_stats(s, ["state"], _t=F.sum("r2"), _n=F.count(F.lit(1)))
    return s.select("state", "location", "r2", F.when(F.col("_t") > 0, F.col("r2") / F.col("_t")).otherwise(1.0 / F.col("_n")).alias("weight"))


DRIVERS = ("temperature", "humidity", "precipitation", "wind_speed_10m")


def driver_weights(df: DataFrame, xs: Sequence[str] = DRIVERS, min_rows: int = 8) -> DataFrame:
    """Per-block driver weights: regression betas over the block mean, with weekend and holiday ratios."""
    from quarterhour.operators.features import impute_median
    d = impute_median(df, xs)
    b = solve_ridge(cross_products(d, "load", xs, ["state", "block"]), xs, ["state", "block"], min_rows=min_rows)
    r = driver_ratios(df)
    j = r.join(b, ["state", "block"], "left")
    return j.select("state", "block", "block_mean", *[F.coalesce(ratio(f"beta_{x}", "block_mean"), F.lit(0.0)).alias(f"{x}_weight") for x in xs], "weekend_weight", "holiday_weight", "n")


def driver_ratios(df: DataFrame) -> DataFrame:
    """Block mean and relative weekend and holiday effects (0 where a side has no rows)."""
    def rel(flag: str) -> Column:
        on, off = avg_where(F.col(flag) == 1, "load"), avg_where(F.col(flag) == 0, "load")
        return F.coalesce(ratio(on - off, off), F.lit(0.0))
    return df.groupBy("state", "block").agg(F.avg("load").alias("block_mean"), rel("is_weekend").alias("weekend_weight"), rel("is_holiday").alias("holiday_weight"))


def elastic_net_weights(df: DataFrame, xs: Sequence[str], alphas: Sequence[float] = (0.001, 0.01, 0.1, 0.5), l1_ratio: float = 0.5, folds: int = 5, min_rows: int = 20,
                        smooth: int = 5) -> DataFrame:
    """Per-block elastic net of load on drivers, alpha by cross-validation, relative to the block mean.

    Folds are day number modulo k. Spark sums the cross products per (state, block, fold); one row per (state, block)
    then carries its few fold sums, so training without a fold and scoring on it need sums alone, and a batch of such
    rows is solved together. Weights come with a confidence (cross-validated fit times n / (n + 20)) and a version
    smoothed over neighbouring blocks.
    """
    from quarterhour.functions.blocks import day_number
    from quarterhour.operators.decompose import circular_smooth
    d = df.withColumn("fold", F.pmod(day_number("date"), F.lit(folds)))
    cols = ["n", "sy", "syy", "sx", "sxy", "sxx"]
    p = cross_products(d, "load", xs, ["state", "block", "fold"]).groupBy("state", "block").agg(F.array_sort(F.collect_list(F.struct("fold", *cols))).alias("f"))
    k, na = len(xs), len(alphas)
    names = ["state", "block", *[f"{x}_weight" for x in xs], "confidence", "alpha", "n"]
    schema = "state string, block int, " + ", ".join(f"{x}_weight double" for x in xs) + ", confidence double, alpha double, n double"
    iu = np.triu_indices(k)

    def square(tri: np.ndarray) -> np.ndarray:
        a = np.zeros((*tri.shape[:-1], k, k))
        a[..., iu[0], iu[1]] = tri
        a[..., iu[1], iu[0]] = tri
        return a

    def fit_all(sums: dict[str, np.ndarray], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sums["n"][:, None]
        c = square(sums["sxx"]) / n[:, :, None] - np.einsum("mi,mj->mij", sums["sx"], sums["sx"]) / n[:, :, None] ** 2
        b = sums["sxy"] / n - sums["sx"] * sums["sy"][:, None] / n**2
        beta = elastic_net(c, b, alpha, l1_ratio)
        return beta, (sums["sy"] - np.einsum("mi,mi->m", beta, sums["sx"])) / sums["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = len(pdf)
            fold = {c: np.zeros((g, folds, *((k,) if c in ("sx", "sxy") else (len(iu[0]),) if c == "sxx" else ()))) for c in cols}
            for i, rows in enumerate(pdf["f"]):
                for r in rows:
                    for c in cols:
                        fold[c][i, int(r["fold"])] = r[c]
            total = {c: x.sum(axis=1) for c, x in fold.items()}
            rep = {c: (total[c][:, None] - fold[c]) for c in cols}
            flat = {c: np.repeat(x.reshape(g * folds, *x.shape[2:]), na, axis=0) for c, x in rep.items()}
            flat["n"] = np.maximum(flat["n"], 1e-9)
            beta, b0 = fit_all(flat, np.tile(np.asarray(alphas), g * folds))
            t = {c: np.repeat(x.reshape(g * folds, *x.shape[2:]), na, axis=0) for c, x in fold.items()}
            sse = (t["syy"] - 2 * b0 * t["sy"] - 2 * np.einsum("mi,mi->m", beta, t["sxy"]) + t["n"] * b0**2 + 2 * b0 * np.einsum("mi,mi->m", beta, t["sx"])
                   + np.einsum("mi,mij,mj->m", beta, square(t["sxx"]), beta)).reshape(g, folds, na).sum(axis=1)
            pick = np.argmin(np.round(sse, 6), axis=1)
            total["n"] = np.maximum(total["n"], 1e-9)
            best, _ = fit_all(total, np.asarray(alphas)[pick])
            var = total["syy"] - total["sy"] ** 2 / total["n"]
            r2 = np.clip(1.0 - sse[np.arange(g), pick] / np.where(var > 0, var, 1.0), 0.0, None) * (var > 0)
            mean = total["sy"] / total["n"]
            out = pd.DataFrame({"state": pdf["state"], "block": pdf["block"], **{f"{x}_weight": best[:, i] / np.where(mean == 0, 1.0, mean) for i, x in enumerate(xs)},
                                "confidence": r2 * total["n"] / (total["n"] + 20.0), "alpha": np.asarray(alphas)[pick], "n": total["n"]})[names]
            yield out[out["n"] >= min_rows]

    out = p.mapInPandas(run, schema)
    for x in xs:
        out = circular_smooth(out, f"{x}_weight", smooth, ["state"])
    return out


def temperature_steps(df: DataFrame, window: int = 7, prior_up: float = 0.01, prior_down: float = 0.008, ridge: float = 20.0, min_step: float = 0.5) -> DataFrame:
    """Asymmetric temperature response per block: relative load change per degree above and below the recent mean.

    The median of ratios trimmed to the interquartile fences, shrunk toward the prior by n / (n + ridge).
    """
    w = days_ago(("state", "block"), window, 1)
    d = df.withColumns({"dt": F.col("temperature") - F.avg("temperature").over(w), "dl": ratio(F.col("load") - F.avg("load").over(w), F.avg("load").over(w))})
    d = d.where((F.abs("dt") >= min_step) & F.col("dl").isNotNull()).withColumn("direction", F.when(F.col("dt") > 0, "up").otherwise("down")).withColumn("slope", F.col("dl") / F.col("dt"))
    k = ["state", "block", "direction"]
    q = d.groupBy(*k).agg(quantile("slope", 0.25).alias("_a"), quantile("slope", 0.75).alias("_b"))
    d = d.join(q, k)
    iqr = F.col("_b") - F.col("_a")
    kept = d.where(F.col("slope").between(F.col("_a") - 1.5 * iqr, F.col("_b") + 1.5 * iqr))
    s = kept.groupBy(*k).agg(F.median("slope").alias("median_slope"), F.count(F.lit(1)).alias("n"))
    prior = F.when(F.col("direction") == "up", prior_up).otherwise(prior_down)
    wgt = F.col("n") / (F.col("n") + ridge)
    return s.withColumn("coefficient", wgt * F.col("median_slope") + (1 - wgt) * prior)


def block_year_ols(df: DataFrame, xs: Sequence[str], storm: DataFrame, min_rows: int = 10) -> DataFrame:
    """Regression per block and year without storm days."""
    clear = df.join(storm.where("storm").select("state", "date"), ["state", "date"], "left_anti").withColumn("year", F.year("date"))
    k = ["state", "block", "year"]
    return solve_ridge(cross_products(clear, "load", xs, k), xs, k, min_rows=min_rows)


def yearly_drift(coeffs: DataFrame, xs: Sequence[str]) -> DataFrame:
    return coeffs.groupBy("state", "year").agg(*[F.avg(f"beta_{x}").alias(f"avg_{x}") for x in xs], F.count(F.lit(1)).alias("blocks"))


def residual_trend(df: DataFrame, value: str = "residual") -> DataFrame:
    """Straight-line trend of a residual over the blocks of a day."""
    g = df.groupBy("state", "date").agg(slope(value, "block").alias("slope"), intercept(value, "block").alias("intercept"), count_where(F.col(value).isNotNull()).alias("n"))
    return g
