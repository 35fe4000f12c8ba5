"""Causal features and rolling baselines: day t sees days before t alone.

All windows share one partitioning and order, so one exchange and one sort serve
every feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.functions.exprs import cyclic

LAGS = (1, 7, 14, 30, 60, 90)
SPANS = (30, 60, 90)
ALPHAS = (0.3, 0.5, 0.7)
#: Days that a chunk of an exponential mean holds while it is folded.
EWM_CHUNK = 64
EPS = 1e-6
BASELINES = ("Naive", "SeasonalNaive", "HistoricMean")


def _w() -> WindowSpec:
    return Window.partitionBy("sku_id").orderBy("date")


def calendar_features(panel: DataFrame) -> DataFrame:
    """Calendar columns; weekday counts from Monday, month start and end are the first and last days about it."""
    dow, month = F.weekday("date"), F.month("date")
    sin_m, cos_m = cyclic(month.cast("double"), 12)
    sin_d, cos_d = cyclic(dow.cast("double"), 7)
    day = F.dayofmonth("date")
    first_year = panel.agg(F.year(F.min("date")).alias("first_year"))
    rows = panel.crossJoin(F.broadcast(first_year))  # one row
    return rows.withColumns({
        "month": month, "quarter": F.quarter("date"), "year": F.year("date"), "dayofweek": dow, "day": day,
        "is_weekend": (dow >= 5).cast("int"), "is_month_start": (day <= 5).cast("int"), "is_month_end": (day >= 25).cast("int"),
        "month_sin": sin_m, "month_cos": cos_m, "dow_sin": sin_d, "dow_cos": cos_d,
        "month_index": (F.year("date") - F.col("first_year")) * 12 + month,
    }).drop("first_year")


def lag_features(panel: DataFrame) -> DataFrame:
    return panel.withColumns({f"lag_{k}": F.lag("demand", k).over(_w()) for k in LAGS})


def _full(agg: Column, days: int) -> Column:
    """An aggregate of the days before, NULL until there are enough."""
    before = _w().rowsBetween(-days, -1)
    return F.when(F.count("demand").over(before) == days, agg.over(before))


def rolling_features(panel: DataFrame) -> DataFrame:
    rolled = panel.withColumns({f"roll_mean_{n}": _full(F.avg("demand"), n) for n in SPANS} | {f"roll_std_{n}": _full(F.stddev_samp("demand"), n) for n in SPANS})
    return rolled.withColumns({f"roll_cv_{n}": F.col(f"roll_std_{n}") / (F.col(f"roll_mean_{n}") + EPS) for n in SPANS})


def trend_features(features: DataFrame) -> DataFrame:
    """Differences and growth ratios of lags and rolling means."""
    c = F.col
    return features.withColumns({
        "diff_1_7": c("lag_1") - c("lag_7"), "diff_7_30": c("lag_7") - c("lag_30"), "mean_diff_30_90": c("roll_mean_30") - c("roll_mean_90"),
        "growth_7": c("lag_1") / (c("lag_7") + EPS), "growth_30": c("lag_7") / (c("lag_30") + EPS), "growth_mean": c("roll_mean_30") / (c("roll_mean_90") + EPS),
    })


def ewm_features(panel: DataFrame) -> DataFrame:
    """Exponential means of earlier demand: y = (1 - a) y + a x, from the first day seen; missing days are passed over.

    A SKU's days are folded one after another, by the same operations as in SQL, so
    that even a mean half way between two printed numbers is the same.  They are
    gathered in a row for that, in chunks, so that adding a day copies one chunk at most.
    """
    x = lambda day: day["rest"]["demand"].cast("double")
    rest = F.struct(*[c for c in panel.columns if c not in ("sku_id", "date")])
    rows = panel.groupBy("sku_id").agg(F.sort_array(F.collect_list(F.struct("date", rest.alias("rest")))).alias("_days"))
    starts = F.sequence(F.lit(1), F.size("_days"), F.lit(EWM_CHUNK))
    means = lambda y, day: F.array(*[F.when(x(day).isNull(), y[n]).when(y[n].isNull(), x(day)).otherwise(y[n] * F.lit(round(1 - a, 12)) + x(day) * F.lit(a)) for n, a in enumerate(ALPHAS)])
    pair = lambda y, seen: F.struct(y.alias("y"), seen.alias("seen"))

    def chunk(carried: Column, start: Column) -> Column:
        """The means before each day of a chunk, and the mean after it."""
        none = F.array().cast("array<array<double>>")
        own = F.aggregate(F.slice("_days", start, EWM_CHUNK), pair(carried["y"], none), lambda s, day: pair(means(s["y"], day), F.concat(s["seen"], F.array(s["y"]))))
        return F.transform(F.array(own), lambda o: pair(o["y"], F.concat(carried["seen"], F.array(o["seen"]))))[0]

    first = pair(F.array(*[F.lit(None).cast("double")] * len(ALPHAS)), F.array().cast("array<array<array<double>>>"))
    rows = rows.select("sku_id", "_days", F.aggregate(starts, first, chunk, lambda s: F.flatten(s["seen"])).alias("_means"))
    rows = rows.select("sku_id", F.explode(F.arrays_zip("_days", "_means")).alias("_at"))
    own = {c: F.col("_at._days.date") if c == "date" else F.col("sku_id") if c == "sku_id" else F.col("_at._days.rest")[c] for c in panel.columns}
    return rows.select(*[v.alias(c) for c, v in own.items()], *[F.col("_at._means")[n].alias(f"ewm_{int(a * 10)}") for n, a in enumerate(ALPHAS)])


def create_features(panel: DataFrame) -> DataFrame:
    """Keys, demand and the 37 derived features; early rows keep their NULLs."""
    keys = ewm_features(panel.select("sku_id", "date", "demand"))  # first, as it gathers the rows of a SKU
    found = trend_features(rolling_features(lag_features(calendar_features(keys))))
    means = [f"ewm_{int(a * 10)}" for a in ALPHAS]
    return found.select(*[c for c in found.columns if c not in means], *means)


def feature_names(features: DataFrame) -> list[str]:
    """What a model may see: all but the day and the target.  The SKU is a feature."""
    return [c for c in features.columns if c not in ("date", "demand")]


def baseline_forecasts(panel: DataFrame, season: int = 365) -> DataFrame:
    """Each row with the three one-day-ahead baselines."""
    return panel.withColumns({
        "Naive": F.lag("demand").over(_w()).cast("double"),
        "SeasonalNaive": F.lag("demand", season).over(_w()).cast("double"),
        "HistoricMean": F.avg("demand").over(_w().rowsBetween(Window.unboundedPreceding, -1)),
    })
