"""Profiles of tables: statistics, roles, quality issues, correlations and personal-data columns."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenta.sources.durable import running

PENALTY = {"low": 1.0, "medium": 4.0, "high": 10.0, "critical": 20.0}
NEVER_NEGATIVE = ("amount", "price", "revenue", "qty", "quantity")

# Names that mark a column's role.
ID_SUFFIXES = ("_id", "_key", "_uuid", "_code")
MEASURE_MARKERS = ("amount", "total", "revenue", "cost", "price", "count", "qty", "quantity", "score", "hours", "rate", "value")
NUMERIC_MARKERS = ("int", "numeric", "decimal", "float", "real", "double", "money")
TEXT_MARKERS = ("char", "text", "string", "clob", "varchar", "json", "uuid")

# Column names of personal data, most specific first.
NAME_PATTERNS = [
    (r"(^|_)(ssn|social_security|nin|national_id)($|_)", "government_id"),
    (r"(^|_)(passport|driver_licen[cs]e)($|_)", "government_id"),
    (r"(^|_)(card_number|pan|cvv|iban|account_number|routing)($|_)", "financial"),
    (r"(^|_)(password|secret|api_key|token|hash)($|_)", "credential"),
    (r"(^|_)(email|e_mail)($|_)", "email"),
    (r"(^|_)(phone|mobile|telephone|msisdn)($|_)", "phone"),
    (r"(^|_)(dob|date_of_birth|birth_date|birthday)($|_)", "date_of_birth"),
    (r"(^|_)(first_name|last_name|full_name|surname|given_name)($|_)", "name"),
    (r"(^|_)(address|street|postcode|postal_code|zip|zipcode)($|_)", "address"),
    (r"(^|_)(latitude|longitude|lat|lng|geo)($|_)", "location"),
    (r"(^|_)(ip_address|ip_addr|user_agent|device_id)($|_)", "device"),
]
# Whole values of personal data, and an address within a text.
VALUE_PATTERNS = [
    (r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", "email"),
    (r"^\d{3}-\d{2}-\d{4}$", "government_id"),
    (r"^\+?(?!\d{4}-\d{2}-\d{2}$)(?=(?:\D*\d){9,15}\D*$)[\d][\d\s().-]{7,18}\d$", "phone"),
    (r"^(?:\d[ -]?){13,19}$", "financial"),
]
EMAIL_WITHIN = r"\b[\w.+-]+@[\w-]+\.[A-Za-z]{2,}\b"
SAMPLE_ROWS, LEAST_VALUES, VALUE_SHARE, WITHIN_SHARE = 200, 5, 0.30, 0.20


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType)]


def _stacked(frame: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """One row for each column from one wide row of aggregates named <field>__<column>."""
    cells = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{f}__{c}`").cast(t).alias(f) for f, t in fields.items()]) for c in columns]
    return frame.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def nulls(frame: DataFrame) -> DataFrame:
    """column_name, row_count, non_null, null_pct, unique_count. Each column is counted on its own, from a scan of that column alone: rows are never multiplied by columns."""
    own = [frame.agg(F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.count(col(c)).alias("non_null"), F.countDistinct(col(c)).alias("unique_count")) for c in frame.columns]
    share = F.coalesce(1 - F.col("non_null") / F.nullif(F.col("row_count"), F.lit(0)), F.lit(0.0))
    return reduce(DataFrame.unionByName, own).select("column_name", "row_count", "non_null", share.alias("null_pct"), "unique_count")


def quantiles(frame: DataFrame, columns: list[str], shares: tuple[float, ...]) -> DataFrame:
    """column_name and q0, q1, ...: exact quantiles, interpolated between the two values around each place.

    Values are counted, and the rows before each distinct value added up over sorted ranges, so no task holds a column's
    values. NaN is no value here.
    """
    cells = [frame.select(F.lit(c).alias("column_name"), col(c).cast("double").alias("x")) for c in columns]
    counts = reduce(DataFrame.unionByName, cells).where("x is not null and not isnan(x)").groupBy("column_name", "x").agg(F.count("*").alias("c"))
    placed = running(counts, ["column_name", "x"], {"before": "c"})
    sizes = placed.groupBy("column_name").agg(F.sum("c").alias("n"), F.min("before").alias("first"))  # one row for each column
    rows = placed.join(F.broadcast(sizes), "column_name").withColumn("before", F.col("before") - F.col("first"))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("c"))
    value = lambda k: F.max(F.when(holds(k), F.col("x")))
    ends = [(value(F.floor(place(p))), value(F.ceil(place(p)))) for p in shares]
    own = rows.groupBy("column_name").agg(F.first("n").alias("n"), *[c.alias(f"{side}{i}") for i, pair in enumerate(ends) for side, c in zip(("a", "b"), pair, strict=True)])
    mixed = lambda i, p: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (place(p) - F.floor(place(p)))
    return own.select("column_name", *[mixed(i, p).alias(f"q{i}") for i, p in enumerate(shares)])


def numeric(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, min, max, mean, std, p25, median, p75, p95, zeros, negatives; quantiles are exact and interpolated."""
    columns = columns or numeric_columns(frame)
    aggs = []
    for c in columns:
        x = col(c).cast("double")
        aggs += [F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}"), F.sum((x == 0).cast("long")).alias(f"zeros__{c}"), F.sum((x < 0).cast("long")).alias(f"negatives__{c}")]
    sums = _stacked(frame.agg(*aggs), columns, {"min": "double", "max": "double", "mean": "double", "std": "double", "zeros": "long", "negatives": "long"})
    parts = quantiles(frame, columns, (0.25, 0.5, 0.75, 0.95)).select("column_name", F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), F.col("q3").alias("p95"))
    out = sums.join(F.broadcast(parts), "column_name", "left")  # one row for each column
    return out.select("column_name", "min", "max", "mean", "std", "p25", "median", "p75", "p95", "zeros", "negatives")


def outliers(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, lower, upper, outlier_count beyond 1.5 interquartile ranges. The fences, two numbers for each column, are made first."""
    columns = columns or numeric_columns(frame)
    fences = {r.column_name: (r.q0 - 1.5 * (r.q1 - r.q0), r.q1 + 1.5 * (r.q1 - r.q0)) for r in quantiles(frame, columns, (0.25, 0.75)).collect()}
    at = lambda c, i: F.lit(fences[c][i] if c in fences else None).cast("double")
    aggs = [a for c in columns for a in (at(c, 0).alias(f"lower__{c}"), at(c, 1).alias(f"upper__{c}"), F.sum(((col(c) < at(c, 0)) | (col(c) > at(c, 1))).cast("long")).alias(f"outlier_count__{c}"))]
    return _stacked(frame.agg(*aggs), columns, {"lower": "double", "upper": "double", "outlier_count": "long"})


def top_values(frame: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """column_name, value, count of each column's n most frequent values; ties by value."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("cell")
    counts = frame.select(cells).where("cell.value is not null").groupBy("cell.column_name", "cell.value").agg(F.count("*").alias("count"))
    from pyspark.sql import Window

    order = Window.partitionBy("column_name").orderBy(F.col("count").desc(), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def duplicates(frame: DataFrame) -> DataFrame:
    """row_count, distinct_rows, duplicate_rows; null equals null."""
    groups = frame.groupBy(*[F.col(f"`{c}`") for c in frame.columns]).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.count("*").alias("distinct_rows")).withColumn("duplicate_rows", F.col("row_count") - F.col("distinct_rows"))


def key_repeats(frame: DataFrame, keys: list[str]) -> DataFrame:
    """row_count, distinct_keys, repeated, is_unique."""
    groups = frame.groupBy(*keys).agg(F.count("*").alias("__n"))
    out = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.count("*").alias("distinct_keys"))
    return out.select("row_count", "distinct_keys", (F.col("row_count") - F.col("distinct_keys")).alias("repeated"), (F.col("row_count") == F.col("distinct_keys")).alias("is_unique"))


def correlations(frame: DataFrame, columns: list[str] | None = None, least: float = 0.5, n: int = 20) -> DataFrame:
    """a, b, pearson_r, strength of the n strongest pairs; all pairs come from one pass."""
    columns = columns or numeric_columns(frame)
    pairs = list(combinations(columns, 2))
    wide = frame.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("pearson_r")) for i, (a, b) in enumerate(pairs)])
    out = wide.select(F.explode(cells).alias("r")).select("r.*").where(F.abs("pearson_r") >= least)
    return out.withColumn("strength", F.when(F.abs("pearson_r") >= 0.8, "strong").otherwise("moderate")).orderBy(F.abs("pearson_r").desc(), "a", "b").limit(n)


def roles(frame: DataFrame) -> DataFrame:
    """column_name, role by the data: temporal, identifier, measure, dimension or text."""
    kinds = {f.name: "temporal" if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType) else "numeric" if isinstance(f.dataType, T.NumericType) else "other" for f in frame.schema}
    kind = reduce(lambda w, kv: w.when(F.col("column_name") == kv[0], kv[1]), kinds.items(), F.when(F.lit(False), ""))
    named = F.lower("column_name").endswith("_id") | (F.lower("column_name") == "id")
    u, n = F.col("unique_count"), F.col("row_count")
    role = F.when(kind == "temporal", "temporal").when((n > 0) & (u == n) | named, "identifier").when(kind == "numeric", F.when(u > 20, "measure").otherwise("dimension")).when(u <= F.greatest(F.lit(50.0), n * 0.05), "dimension").otherwise("text")
    return nulls(frame).select("column_name", role.alias("role"))


def named_role(name: str, data_type: str) -> str:
    """Role by name and type alone, as a crawl suggests it."""
    low, kind = name.lower(), data_type.lower()
    if any(m in kind for m in ("date", "time", "timestamp")):
        return "time"
    if low == "id" or low.endswith(ID_SUFFIXES):
        return "identifier"
    numeric_type = any(m in kind for m in NUMERIC_MARKERS)
    return "measure" if numeric_type and any(m in low for m in MEASURE_MARKERS) else "dimension"


def issues(frame: DataFrame, keys: list[list[str]] | None = None, null_warn: float = 0.05, null_high: float = 0.30) -> DataFrame:
    """code, severity, column_name, affected_rows, penalty."""
    spark = frame.sparkSession
    n = nulls(frame)
    missing = n.where(F.col("null_pct") >= null_warn).select(F.when(F.col("null_pct") >= null_high, "high_null_rate").otherwise("missing_values").alias("code"), F.when(F.col("null_pct") >= null_high, "high").otherwise("medium").alias("severity"), "column_name", (F.col("row_count") - F.col("non_null")).alias("affected_rows"))
    d = duplicates(frame)
    repeated = d.where("duplicate_rows > 0").select(F.lit("duplicate_rows").alias("code"), F.when(F.col("duplicate_rows") / F.col("row_count") > 0.02, "high").otherwise("medium").alias("severity"), F.lit(None).cast("string").alias("column_name"), F.col("duplicate_rows").alias("affected_rows"))
    out = missing.unionByName(repeated)
    money = [c for c in numeric_columns(frame) if any(m in c.lower() for m in NEVER_NEGATIVE)]
    if money:
        out = out.unionByName(numeric(frame, money).where("negatives > 0").select(F.lit("impossible_value").alias("code"), F.lit("high").alias("severity"), "column_name", F.col("negatives").alias("affected_rows")))
    for f in frame.schema:
        if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            late = frame.agg(F.sum((F.col(f"`{f.name}`").cast("timestamp") > F.current_timestamp()).cast("long")).alias("n"))
            out = out.unionByName(late.where("n > 0").select(F.lit("invalid_date").alias("code"), F.lit("medium").alias("severity"), F.lit(f.name).alias("column_name"), F.col("n").alias("affected_rows")))
    for key in keys or []:
        out = out.unionByName(key_repeats(frame, key).where("repeated > 0").select(F.lit("key_not_unique").alias("code"), F.lit("critical").alias("severity"), F.lit(",".join(key)).alias("column_name"), F.col("repeated").alias("affected_rows")))
    penalties = spark.createDataFrame(list(PENALTY.items()), "severity string, penalty double")
    return out.join(F.broadcast(penalties), "severity").select("code", "severity", "column_name", "affected_rows", "penalty")


def quality(found: DataFrame) -> DataFrame:
    """quality_score: 100 less the penalties, 0 at least."""
    return found.agg(F.greatest(F.lit(0.0), 100 - F.coalesce(F.sum("penalty"), F.lit(0.0))).alias("quality_score"), F.count("*").alias("n_issues"))


def classify_names(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda w, p: w.when(low.rlike(p[0]), p[1]), NAME_PATTERNS, F.when(F.lit(False), ""))


def personal_columns(frame: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """column_name, category, basis (name or sampled_values) of columns that hold personal data.

    A name decides first. Values are looked at in the first sample rows of text columns, with five or more values.
    """
    texts = [f.name for f in frame.schema if any(m in f.dataType.simpleString() for m in TEXT_MARKERS) and isinstance(f.dataType, T.StringType)]
    rows = frame.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in texts]).limit(sample) if texts else None
    checks = [*VALUE_PATTERNS, (EMAIL_WITHIN, "email")]
    schema = frame.sparkSession.createDataFrame([(c,) for c in frame.columns], "column_name string")
    if rows is None:
        shares = None
    else:
        aggs = [a for c in texts for a in (F.count(F.nullif(F.col(f"`{c}`"), F.lit(""))).alias(f"n__{c}"), *[F.coalesce(F.sum(F.col(f"`{c}`").rlike(p).cast("long")), F.lit(0)).alias(f"m{i}__{c}") for i, (p, _) in enumerate(checks)])]
        shares = _stacked(rows.agg(*aggs), texts, {"n": "long", **{f"m{i}": "long" for i in range(len(checks))}})
    by_value = F.when(F.lit(False), "")
    for i, (_, category) in enumerate(checks):
        by_value = by_value.when((F.col("n") >= LEAST_VALUES) & (F.col(f"m{i}") / F.col("n") >= (WITHIN_SHARE if i == len(VALUE_PATTERNS) else VALUE_SHARE)), category)
    out = schema if shares is None else schema.join(shares, "column_name", "left")
    by_name = classify_names(F.col("column_name"))
    value = by_value if shares is not None else F.lit(None).cast("string")
    return out.select("column_name", F.coalesce(by_name, value).alias("category"), F.when(by_name.isNotNull(), "name").when(value.isNotNull(), "sampled_values").alias("basis")).where("category is not null")
