"""The feature store, the split into datasets, target encodings, engineered features and scaling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.functions.columns import BUCKETS, NUMERIC, STORED
from adloom.operators.warehouse import unpivot
from adloom.sources.work import saved

CODES = [f"{c}_bucket_code" for c in NUMERIC]
BUCKET_LIFTS = [f"{c}_bucket_ctr_lift" for c in NUMERIC]
VALUE_LIFTS = [f"{c}_ctr_lift" for c in STORED]
SUPPORT = [f"{c}_feature_impressions" for c in STORED]
LOGS = [f"{c}_log_scale" for c in NUMERIC]
ENCODED = [*STORED, *CODES]
NOT_FEATURES = ["dataset_split", "raw_event_id", "batch_id", "label", "click_flag", "impression_count", "click_count"]
PRIOR = 50.0
#: Rows of a lookup table that is sent to all tasks, at most; and of how many rows more than one makes a value a frequent one.
BROADCAST_ROWS, HOT = 100_000, 4096
#: Rows of a lookup table that is a literal of the plan, at most. A map is searched value by value, so it is for short tables.
MAP_ROWS = 1024


def measured(staged: DataFrame) -> DataFrame:
    """The columns of the feature store that come from an event's own row: measures, flags, logs and bucket codes."""
    return staged.select(
        "raw_event_id", "batch_id", "label", "event_day_number", "event_batch", "click_flag", "impression_count", "click_count", "missing_numeric_count", "missing_categorical_count",
        *missing_flags(),
        *NUMERIC,
        *(X.log_scale(c).alias(f"{c}_log_scale") for c in NUMERIC),
        *STORED,
        *(X.bucket_code(c).alias(f"{c}_bucket_code") for c in NUMERIC),
    )


def feature_store(staged: DataFrame, buckets: DataFrame, values: DataFrame, total: DataFrame, recorded_at: Column | None = None) -> DataFrame:
    """One wide row an event: what `measured` gives, and the lift and support of its buckets and values.

    The overall rate and the lifts of the 91 buckets become literals of the expression; those of values come from `looked_up`.
    """
    base = measured(staged)
    lifts = _few(buckets.select("feature_name", "bucket_code", "ctr_lift_vs_overall"))
    table = values.where(F.col("feature_name").isin(STORED)).select("feature_name", "feature_value", F.col("impressions").alias("n"), F.col("ctr_lift_vs_overall").alias("lift"), F.col("impressions").alias("shown"))
    out = looked_up(base, "raw_event_id", table, {c: F.col(c) for c in STORED}, ["lift", "shown"])
    return out.select(
        *base.columns,
        *(_by_number(c, lifts.get(c, {}), F.lit(0.0)).alias(f"{c}_bucket_ctr_lift") for c in NUMERIC),
        *(F.coalesce(f"_{c}_lift", F.lit(0.0)).alias(f"{c}_ctr_lift") for c in STORED),
        *(F.coalesce(f"_{c}_shown", F.lit(0)).cast("long").alias(f"{c}_feature_impressions") for c in STORED),
        _one(total, "ctr").alias("overall_ctr"),
        *([recorded_at.alias("feature_recorded_at")] if recorded_at is not None else []),
    )


def missing_flags() -> list[Column]:
    numeric, categorical = F.col("missing_numeric_count"), F.col("missing_categorical_count")
    return [(numeric > 0).cast("int").alias("has_missing_numeric"), (categorical > 0).cast("int").alias("has_missing_categorical"), (numeric + categorical >= 5).cast("int").alias("high_missingness_flag")]


def _few(table: DataFrame) -> dict[str, dict[str, tuple]]:
    """column -> code -> values of a table (column, code, values ...) with a row for each bucket of each numeric column, 91 at most."""
    out: dict[str, dict[str, tuple]] = {}
    for name, code, *values in table.collect():
        out.setdefault(name, {})[code] = tuple(values)
    return out


def _maps(table: DataFrame, columns: list[str], found: list[str]) -> dict[str, dict[str, Callable[[Column], Column]]]:
    """column -> name in found -> how a value is looked up, in a literal map. table (feature_name, feature_value, found ...) has MAP_ROWS rows at most."""
    rows, kinds = table.select("feature_name", "feature_value", *found).collect(), dict(table.dtypes)

    def of(c: str, x: str) -> Callable[[Column], Column]:
        pairs = [e for r in rows if r["feature_name"] == c and r["feature_value"] is not None for e in (F.lit(r["feature_value"]), F.lit(r[x]).cast(kinds[x]))]
        return (lambda value: F.element_at(F.create_map(*pairs), value)) if pairs else (lambda value: F.lit(None).cast(kinds[x]))

    return {c: {x: of(c, x) for x in found} for c in columns}


def _one(table: DataFrame, c: str) -> Column:
    """The value of a table of one row, as a literal."""
    return F.lit(table.select(c).first()[0]).cast(table.schema[c].dataType)


def _by_number(c: str, values: dict[str, tuple], default: Column) -> Column:
    """The first of the values of a number's bucket, the default where there is none."""
    lifts = {code: F.lit(found[0]) for code, found in values.items() if found[0] is not None}
    return X.bucket_value(c, [lifts.get(b[0], default) for b in BUCKETS])


def _by_code(code: str, values: dict[str, tuple], i: int, default: Column) -> Column:
    """The i-th value of a row's bucket, the default where there is none."""
    out = None
    for key, found in values.items():
        if found[i] is not None:
            out = F.when(F.col(code) == key, F.lit(found[i])) if out is None else out.when(F.col(code) == key, F.lit(found[i]))
    return default if out is None else out.otherwise(default)


def looked_up(frame: DataFrame, row_id: str, table: DataFrame, columns: dict[str, Column], found: list[str]) -> DataFrame:
    """frame with `_<column>_<name>` for each column and each name in found: what table (feature_name, feature_value, n, found ...) holds for the
    column's value, null where it holds nothing. row_id is unique; n counts a value's rows in the frame, or in one like it.

    A table of at most MAP_ROWS rows becomes a literal map for each column: a wide row isn't copied once a join, and what a query doesn't read of it isn't
    looked up. One of at most BROADCAST_ROWS rows is sent to all tasks. Beyond that rows are looked up by their ids: a narrow row for each row and
    column meets the table, frequent values (fewer than HOT) by a broadcast and others by a shuffle, and what was found is put back
    together by id, so wide rows are shuffled once and not for each column.
    """
    table = saved(table, "lookup")
    size = table.count()
    if size <= min(MAP_ROWS, BROADCAST_ROWS):
        maps = _maps(table, list(columns), found)
        return frame.select("*", *(maps[c][x](value).alias(f"_{c}_{x}") for c, value in columns.items() for x in found))
    if size <= BROADCAST_ROWS:
        for c, value in columns.items():
            one = table.where(F.col("feature_name") == c).select(F.col("feature_value").alias(f"_{c}_value"), *(F.col(x).alias(f"_{c}_{x}") for x in found))
            frame = frame.join(F.broadcast(one), value == F.col(f"_{c}_value"), "left").drop(f"_{c}_value")
        return frame
    pairs = F.array(*(F.struct(F.lit(c).alias("feature_name"), value.alias("feature_value")) for c, value in columns.items()))
    long = frame.select(row_id, F.inline(pairs))
    limit = table.agg(F.sum("n")).first()[0] or 0
    keys = ["feature_name", "feature_value"]
    few, many = table.where(F.col("n") * HOT > limit).drop("n"), table.where(F.col("n") * HOT <= limit).drop("n")
    met = long.join(F.broadcast(few), keys).unionByName(long.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys))
    back = met.groupBy(row_id).agg(*(F.max(F.when(F.col("feature_name") == c, F.col(x))).alias(f"_{c}_{x}") for c in columns for x in found))
    return frame.join(back, row_id, "left")


def parse_days(text: str) -> frozenset[int]:
    """The day numbers of a list such as "1,2,5"; they are from 1 to 7."""
    days = frozenset(int(x) for x in text.split(",") if x.strip())
    if not days or not days <= set(range(1, 8)):
        raise ValueError(f"days must be from 1 to 7: {text}")
    return days


def split_lookup(train: frozenset[int], validation: frozenset[int], test: frozenset[int]) -> dict[int, str]:
    if train & validation or train & test or validation & test:
        raise ValueError("a day can be in one split only")
    return {d: name for name, days in (("train", train), ("validation", validation), ("test", test)) for d in days}


def with_split(features: DataFrame, lookup: dict[int, str]) -> DataFrame:
    """Adds dataset_split by event day; other days are dropped."""
    by_name: dict[str, list[int]] = {}
    for day, name in sorted(lookup.items()):
        by_name.setdefault(name, []).append(day)
    split = F.coalesce(*(F.when(F.col("event_day_number").isin(days), name) for name, days in by_name.items()))
    return features.withColumn("dataset_split", split).where("dataset_split is not null")


def manifest(split: DataFrame) -> DataFrame:
    """(dataset_split, row_count, split_days, feature_columns): what a dataset holds."""
    columns = [c for c in split.columns if c not in NOT_FEATURES]
    rows = split.groupBy("dataset_split").agg(F.count(F.lit(1)).alias("row_count"), F.array_join(F.array_sort(F.collect_set("event_day_number")), ",").alias("split_days"))
    return rows.withColumn("feature_columns", F.lit(",".join(columns)))


def global_ctr(train: DataFrame) -> DataFrame:
    return train.agg(F.avg("label").alias("global_ctr"), F.count(F.lit(1)).alias("train_rows"))


def encodings(train: DataFrame, prior: float = PRIOR, columns: list[str] = ENCODED) -> DataFrame:
    """(column_name, value, smoothed_ctr, frequency, log_count), learned from the rows given, which should be the training split."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns]
    long = unpivot(train.select("label", *cells), columns, ["label"])
    return _encoded(long.groupBy("feature_name", "feature_value").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("clicks")), global_ctr(train), prior)


def encodings_of(buckets: DataFrame, values: DataFrame, prior: float = PRIOR) -> tuple[DataFrame, DataFrame]:
    """What `encodings` and `global_ctr` give for the ENCODED columns, from the training days' rows of `marts.day_buckets` and `marts.day_values` of STORED, so
    that events aren't read again."""
    n, clicks = F.sum("impressions"), F.sum("clicks")
    whole = buckets.where(F.col("feature_name") == NUMERIC[0]).agg((clicks / n).alias("global_ctr"), F.coalesce(n, F.lit(0)).alias("train_rows"))
    both = buckets.withColumn("feature_name", F.concat("feature_name", F.lit("_bucket_code"))).unionByName(values)
    return _encoded(both.groupBy("feature_name", "feature_value").agg(n.alias("n"), clicks.alias("clicks")), whole, prior), whole


def _encoded(counts: DataFrame, total: DataFrame, prior: float) -> DataFrame:
    e = counts.crossJoin(F.broadcast(total))
    return e.select(F.col("feature_name").alias("column_name"), F.col("feature_value").alias("value"), ((F.col("clicks") + F.col("global_ctr") * prior) / (F.col("n") + prior)).alias("smoothed_ctr"), (F.col("n") / F.col("train_rows")).alias("frequency"), F.log1p(F.col("n").cast("double")).alias("log_count"))


def apply_encodings(frame: DataFrame, encoding: DataFrame, total: DataFrame, columns: list[str] = ENCODED, row_id: str = "raw_event_id") -> DataFrame:
    """Adds for each column its encoded rate, the lift over the global rate and the log count; unseen values get the global rate and 0.
    Bucket codes have seven values, so their encodings become literals; those of categorical values come from `looked_up`."""
    small, large = [c for c in columns if c in CODES], [c for c in columns if c not in CODES]
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns}
    few = _few(encoding.where(F.col("column_name").isin(small)).select("column_name", "value", "smoothed_ctr", "log_count")) if small else {}
    out = frame.withColumn("_global", _one(total, "global_ctr"))
    if large:
        table = encoding.where(F.col("column_name").isin(large)).select(F.col("column_name").alias("feature_name"), F.col("value").alias("feature_value"), F.expm1("log_count").alias("n"), F.col("smoothed_ctr").alias("rate"), F.col("log_count").alias("count"))
        out = looked_up(out, row_id, table, {c: text[c] for c in large}, ["rate", "count"])
    added: list[Column] = []
    for c in columns:
        if c in small:
            rate, count = (_by_code(c, few.get(c, {}), i, default) for i, default in enumerate((F.col("_global"), F.lit(0.0))))
        else:
            rate, count = F.coalesce(f"_{c}_rate", "_global"), F.col(f"_{c}_count")
        added += [rate.alias(f"{c}_enc_ctr"), (rate - F.col("_global")).alias(f"{c}_enc_ctr_lift"), F.coalesce(count, F.lit(0.0)).alias(f"{c}_enc_log_count")]
    return out.select(*frame.columns, *added)


def number(c: str) -> Column:
    """A column as a double; what isn't a number, and null, is 0."""
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


CORE = ["event_day_number", "missing_numeric_count", "missing_categorical_count", "has_missing_numeric", "has_missing_categorical", "high_missingness_flag", *NUMERIC, *LOGS, *BUCKET_LIFTS, *VALUE_LIFTS, "overall_ctr"]


def aggregates() -> dict[str, Column]:
    """Sums, means, extremes and products over a row's features, by name."""
    bucket, value = [number(c) for c in BUCKET_LIFTS], [number(c) for c in VALUE_LIFTS]
    support = [F.log1p(F.greatest(number(c), F.lit(0.0))) for c in SUPPORT]
    logs = [number(c) for c in LOGS]
    out = {f"{c}_log1p": s for c, s in zip(SUPPORT, support)}
    out |= {
        "bucket_lift_sum": _sum(bucket),
        "bucket_lift_mean": _sum(bucket) / len(bucket),
        "bucket_lift_max": F.greatest(*bucket),
        "bucket_lift_positive_count": _sum([(b > 0).cast("double") for b in bucket]),
        "bucket_lift_negative_count": _sum([(b < 0).cast("double") for b in bucket]),
        "categorical_lift_sum": _sum(value),
        "categorical_lift_mean": _sum(value) / len(value),
        "categorical_lift_max": F.greatest(*value),
        "categorical_support_log_sum": _sum(support),
        "categorical_support_log_mean": _sum(support) / len(support),
        "numeric_log_sum": _sum(logs),
        "numeric_log_mean": _sum(logs) / len(logs),
        "numeric_log_max": F.greatest(*logs),
    }
    total = number("missing_numeric_count") + number("missing_categorical_count")
    out |= {
        "total_missing_count": total,
        "missing_ratio": total / 39.0,
        "event_day_x_bucket_lift_mean": number("event_day_number") * out["bucket_lift_mean"],
        "high_missing_x_bucket_lift_mean": number("high_missingness_flag") * out["bucket_lift_mean"],
        "missing_ratio_x_categorical_lift_mean": total / 39.0 * out["categorical_lift_mean"],
    }
    return out


def engineered(frame: DataFrame, encoding: DataFrame, total: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and all engineered features as floats, without nulls."""
    encoded = apply_encodings(frame, encoding, total)
    parts = {c: number(c) for c in CORE} | aggregates()
    parts |= {f"{c}{s}": F.col(f"{c}{s}") for c in ENCODED for s in ("_enc_ctr", "_enc_ctr_lift", "_enc_log_count")}
    return encoded.select(*keep, *(F.coalesce(e, F.lit(0.0)).cast("float").alias(n) for n, e in parts.items()))


def scaler(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mean, scale): population deviation, at least 1e-4, from sums and sums of squares in one pass."""
    sums = frame.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in columns), *(F.sum(F.col(c).cast("double") * F.col(c).cast("double")).alias(f"q_{c}") for c in columns))
    n = F.greatest("n", F.lit(1))

    def of(c: str) -> Column:
        mean = F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) / n
        variance = F.coalesce(F.col(f"q_{c}"), F.lit(0.0)) / n - mean * mean
        return F.struct(F.lit(c).alias("column_name"), mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(1e-8))).alias("scale"))

    return sums.select(F.inline(F.array(*(of(c) for c in columns))))


def scale(frame: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """frame with (x - mean) / scale for each column. The statistics, one row a column, travel as one small map."""
    packed = stats.agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("mean", "scale")))).alias("_stats"))
    rest = [c for c in frame.columns if c not in columns]
    joined = frame.crossJoin(F.broadcast(packed))
    return joined.select(*rest, *(((F.col(c) - F.col("_stats")[c]["mean"]) / F.col("_stats")[c]["scale"]).alias(c) for c in columns))


def class_weights(frame: DataFrame) -> DataFrame:
    """(label, weight): n / (2 n_c); 1 for both where a class is empty."""
    counts = frame.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    total = F.col("n0") + F.col("n1")
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    row = lambda k: F.struct(F.lit(k).alias("label"), F.when(both, total / (2.0 * F.col(f"n{k}"))).otherwise(1.0).alias("weight"))
    return counts.select(F.inline(F.array(row(0), row(1))))


def positive_weight(frame: DataFrame) -> DataFrame:
    """One row: negatives over positives; 1 where a class is empty."""
    n0, n1 = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    return frame.agg(F.when((n0 > 0) & (n1 > 0), n0 / n1).otherwise(1.0).alias("scale_pos_weight"))
