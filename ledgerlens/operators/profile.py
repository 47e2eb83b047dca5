"""Column profiles over whole tables.

Everything rests on one long table ``values(table_name, column_name, value, cnt)``: a single unpivot per table whose
map-side counts collapse repeated values before the shuffle, so a value that fills a third of a table travels as a few rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.ordering import exact_quantiles

TOP_N = 10
HISTOGRAM_BINS = 10
PREVIEW_VALUES = 24
DICTIONARY_LIMIT = 32
PATTERN_SHARE = 0.8
NUMERIC_SHARE = 0.9

# Value patterns and the semantic type each of them stands for.
VALUE_PATTERNS = [
    ("email_pattern", r"^[\w.+-]+@[\w-]+\.[\w.-]+$", "email_address"),
    ("url_pattern", r"^https?://", "url"),
    ("date_pattern", r"^\d{4}-\d{2}-\d{2}$", "date"),
    ("datetime_pattern", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", "datetime"),
    ("uuid_pattern", r"^[\da-f]{8}-[\da-f]{4}-[\da-f]{4}-[\da-f]{4}-[\da-f]{12}$", "uuid"),
    ("phone_pattern", r"^\+?\d[\d\s\-().]{7,}$", "phone_number"),
    ("zip_pattern", r"^\d{5}(-\d{4})?$", "postal_code"),
]

# Column-name patterns and their semantic type, first match wins.
NAME_RULES = [
    (r"^[\w.+-]+@[\w-]+\.[\w.-]+$", "email_address"),
    (r"^\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}$", "phone_number"),
    (r"^https?://[\w./-]+$", "url"),
    (r"^\d{4}-\d{2}-\d{2}$", "date_iso"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", "datetime_iso"),
    (r"^[A-Z]{2,3}[-\d]+$", "identifier_code"),
    (r"^\d+\.\d{2}$", "monetary_value"),
    (r"^[\w-]+_id$", "identifier"),
    (r"^id$", "identifier"),
    (r".*_id$", "identifier"),
    (r".*_name$", "person_name"),
    (r"^name$", "person_name"),
    (r".*_date$", "timestamp"),
    (r".*_time$", "timestamp"),
    (r".*_amount$", "monetary_value"),
    (r"^amount$", "monetary_value"),
    (r"^value$", "monetary_value"),
    (r".*_price$", "monetary_value"),
    (r".*_cost$", "monetary_value"),
    (r".*_rate$", "rate_percentage"),
    (r".*_count$", "count"),
    (r".*_percent", "rate_percentage"),
    (r".*_status$", "status_enum"),
    (r"^status$", "status_enum"),
    (r".*_type$", "type_enum"),
    (r".*_category$", "category_enum"),
    (r".*_email$", "email_address"),
    (r".*_phone$", "phone_number"),
    (r".*_address$", "physical_address"),
    (r".*_city$", "city_name"),
    (r".*_country$", "country_name"),
    (r".*_zip$", "postal_code"),
    (r".*_url$", "url"),
]

# Placeholder texts, opaque tokens and dictionary-like names.
SENTINEL = r"(?i)^(?:n/?a|null|none|unknown|undefined|--?|0+|123-456-7890|1234567890)$"
OPAQUE = (
    r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32,}|\d{15,20})$"
)
DICTIONARY_NAME = r"(?i)(?:^|_)(?:enable|enabled|status|state|flag|mode|type|kind|category|level|gender|yn|switch)$"
BOOLEAN_NAME = r"(?i)^(?:is|has|can)_[a-z0-9_]+$"
BOOLEAN_TEXT = r"(?i)^(?:y|n|yes|no|true|false|0|1|on|off)$"
TEMPORAL_NAME = r"(?i)(?:^|_)(?:date|time|datetime|timestamp)s?$|(?:^|_)(?:at|on)$"
LARGE_TYPE = r"(?i)^(?:array|map|struct|binary|variant)"

#: Longer values are counted and compared by their digest, so that no long text becomes a shuffle key.
DIGEST_OVER = 64
#: Bits a character that make a long text look encrypted.
CIPHER_ENTROPY = 4.5

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(data_type: T.DataType) -> str:
    """Physical family of a column type."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, _NUMERIC):
        return "integer"
    if isinstance(data_type, _TEMPORAL):
        return "datetime"
    return "string"


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns whose values have a plain text form."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with a number type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    """Columns with text."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def unpivoted(df: DataFrame, columns: list[str], as_type: str = "string") -> DataFrame:
    """Rows (column_name, value) of the named columns, nulls included."""
    picked = df.select(*[F.col(f"`{c}`").cast(as_type).alias(c) for c in columns])
    return picked.unpivot([], columns, "column_name", "value")


def long_values(tables: Mapping[str, DataFrame], columns: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Every distinct value of every column with its count; the null count is the row whose value is null."""
    parts = []
    for name, df in tables.items():
        cols = columns[name] if columns else scalar_columns(df)
        cells = unpivoted(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
        parts.append(cells.select(F.lit(name).alias("table_name"), "column_name", "value", "cnt"))
    return reduce(DataFrame.unionByName, parts)


def short_value(text: Column) -> Column:
    """The text itself, or the md5 of a long one with its outer spaces kept."""
    inner = F.trim(text)
    lead = F.length(text) - F.length(F.ltrim(text))
    digest = F.concat(F.repeat(F.lit(" "), lead), F.lit("#"), F.md5(inner), F.repeat(F.lit(" "), F.length(text) - F.length(F.rtrim(text))))
    # characters are only counted where the bytes leave it open
    return F.when(F.octet_length(text) <= DIGEST_OVER, text).when(F.length(inner) > DIGEST_OVER, digest).otherwise(text)


KEY = ["table_name", "column_name"]


def _cell_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column from one aggregate over the rows as they are: counts, bounds and lengths; nothing but one row a task is shuffled.

    Columns with a number type are never turned into text.
    """
    facts = []
    for c in columns:
        kind, column = df.schema[c].dataType, F.col(f"`{c}`")
        # a float's text names another double than the float itself
        typed = isinstance(kind, _NUMERIC) and not isinstance(kind, T.FloatType)
        text = column.cast("string")
        number = column.cast("double") if typed else text.try_cast("double")
        none = F.lit(None)
        size = F.length(text) if isinstance(kind, T.StringType) else None
        facts.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(column).alias("filled"),
                F.count(number).alias("numbers"),
                *[(none.cast("string") if typed else f(text)).alias(n) for f, n in ((F.min, "min_text"), (F.max, "max_text"))],
                F.min(number).alias("min_number"),
                F.max(number).alias("max_number"),
                *[(none.cast("int") if size is None else f(size)).alias(n) for f, n in ((F.min, "min_length"), (F.max, "max_length"))],
                (none.cast("double") if size is None else F.avg(size)).alias("avg_length"),
            )
        )
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def table_stats(tables: Mapping[str, DataFrame], columns: Mapping[str, list[str]] | None = None) -> DataFrame:
    """The facts of :func:`column_stats`, and for text columns those of :func:`text_stats`, straight from tables; all scalar columns by default.

    Distinct values are counted on short values; whole texts stay where they are read. Columns of an empty table are there with zeros.
    """
    chosen = {n: columns[n] if columns else scalar_columns(df) for n, df in tables.items()}
    facts = [_cell_facts(df, chosen[n]).select(F.lit(n).alias("table_name"), "*") for n, df in tables.items()]
    cells = []
    for n, df in tables.items():
        texts = set(string_columns(df))
        short = df.select(*[short_value(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in chosen[n]])
        cells.append(unpivoted(short, chosen[n]).select(F.lit(n).alias("table_name"), "*"))
    distinct = reduce(DataFrame.unionByName, cells).where("value is not null").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_distinct"))
    numeric = (F.col("numbers") == F.col("filled")) & (F.col("filled") > 0)
    return reduce(DataFrame.unionByName, facts).join(distinct, KEY, "left").select(
        *KEY,
        "n_rows",
        "filled",
        F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"),
        *[F.when(~numeric, F.col(c)).alias(c) for c in ("min_text", "max_text")],
        *[F.when(numeric, F.col(c)).alias(c) for c in ("min_number", "max_number")],
        F.when(F.col("n_rows") > 0, (F.col("n_rows") - F.col("filled")) / F.col("n_rows")).otherwise(0.0).alias("null_rate"),
        "min_length",
        "max_length",
        "avg_length",
    )


def column_types(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (table_name, column_name, data_type, kind) read off the schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (n, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for n, df in tables.items() for f in df.schema.fields
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, kind string")


def column_stats(values: DataFrame) -> DataFrame:
    """Rows, filled, distinct, null rate, text bounds and (where all values parse) number bounds per column."""
    number = F.expr("try_cast(value as double)")
    filled = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))), F.lit(0))
    agg = values.groupBy(*KEY).agg(
        F.sum("cnt").alias("n_rows"),
        filled.alias("filled"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
        F.count(number).alias("_numbers"),
        F.min(number).alias("_min"),
        F.max(number).alias("_max"),
    )
    numeric = (F.col("_numbers") == F.col("n_distinct")) & (F.col("n_distinct") > 0)
    return agg.select(
        *KEY,
        "n_rows",
        "filled",
        "n_distinct",
        F.when(~numeric, F.col("min_text")).alias("min_text"),
        F.when(~numeric, F.col("max_text")).alias("max_text"),
        F.when(numeric, F.col("_min")).alias("min_number"),
        F.when(numeric, F.col("_max")).alias("max_number"),
        F.when(F.col("n_rows") > 0, (F.col("n_rows") - F.col("filled")) / F.col("n_rows")).otherwise(0.0).alias("null_rate"),
    )


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Min, max, mean, sample deviation (0 for one value) and median per numeric column."""
    cols = columns or numeric_columns(df)
    # moments need no unpivot: one aggregation over the wide rows, turned into a row per column afterwards
    facts = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        std = F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))
        facts.append(
            F.struct(F.lit(c).alias("column_name"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg(x).alias("mean_value"), std.alias("std_value"))
        )
    moments = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    long = unpivoted(df, cols, "double").where("value is not null")
    median = exact_quantiles(long, ["column_name"], "value", [0.5]).select(
        "column_name", F.col("quantile").alias("median_value")
    )
    return moments.join(median, "column_name", "left")


def text_stats(values: DataFrame) -> DataFrame:
    """Shortest, longest and average length per column."""
    present = values.where("value is not null")
    return present.groupBy(*KEY).agg(
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        (F.sum(F.length("value") * F.col("cnt")) / F.sum("cnt")).alias("avg_length"),
    )


def top_values(values: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` most frequent values per column with their share of the filled rows; ties by value."""
    present = values.where("value is not null")
    filled = present.groupBy(*KEY).agg(F.sum("cnt").alias("_filled"))
    order = W.partitionBy(*KEY).orderBy(F.col("cnt").desc(), F.col("value").asc())
    # the rank filter is applied per partition before the shuffle, so a wide column sends n rows per task
    ranked = present.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.join(filled, KEY).select(*KEY, "rank", "value", "cnt", (F.col("cnt") / F.col("_filled")).alias("fraction"))


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins per numeric column, the last bin closed; constant columns use a bin of width one around them."""
    cols = columns or numeric_columns(df)
    bounds = df.agg(
        F.struct(
            *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
            *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols],
        ).alias("b")
    ).scalar()
    lows, widths, picks = {}, {}, []
    for c in cols:
        lo, hi = bounds.getField(f"lo_{c}"), bounds.getField(f"hi_{c}")
        flat = lo == hi
        lows[c] = F.when(flat, lo - 0.5).otherwise(lo)
        widths[c] = F.when(flat, F.lit(1.0)).otherwise(hi - lo) / bins
        place = F.floor((F.col(c).cast("double") - lows[c]) / widths[c])
        # least() skips nulls, so missing values must be kept out by hand
        picks.append(F.when(place.isNotNull(), F.least(place, F.lit(bins - 1))).cast("int").alias(c))
    binned = df.select(*picks).unpivot([], cols, "column_name", "bin").where("bin is not null")
    counted = binned.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    lo = F.coalesce(*[F.when(F.col("column_name") == c, lows[c]) for c in cols])
    width = F.coalesce(*[F.when(F.col("column_name") == c, widths[c]) for c in cols])
    return counted.select(
        "column_name", "bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"), "cnt"
    )


def value_census(values: DataFrame) -> DataFrame:
    """Trimmed, non-empty values with count and share of their column."""
    trimmed = values.select(*KEY, F.trim("value").alias("value"), "cnt").where("value <> ''")
    merged = trimmed.groupBy(*KEY, "value").agg(F.sum("cnt").alias("cnt"))
    total = merged.groupBy(*KEY).agg(F.sum("cnt").alias("_total"))
    return merged.join(total, KEY).select(*KEY, "value", "cnt", (F.col("cnt") / F.col("_total")).alias("share"))


def _items(value: Column) -> Column:
    """Items of a JSON array of short strings, else null."""
    text = F.trim(value)
    parsed = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")
    kept = F.filter(F.transform(parsed, F.trim), lambda x: F.length(x) > 0)
    usable = (
        text.startswith("[")
        & text.endswith("]")
        & parsed.isNotNull()
        & F.forall(parsed, lambda x: x.isNotNull() & (F.length(x) <= 48))
        & (F.size(kept) > 0)
    )
    return F.when(usable, kept)


def list_census(values: DataFrame, preview: int = PREVIEW_VALUES) -> DataFrame:
    """Census in which columns of JSON-array text are counted item by item.

    A column is split when at least half of its ``preview`` most frequent values are such arrays and the values are short.
    """
    present = values.where("value is not null")
    order = W.partitionBy(*KEY).orderBy(F.col("cnt").desc(), F.col("value").asc())
    head = present.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= preview)
    rule = head.groupBy(*KEY).agg(
        ((F.avg(F.length("value")) <= 80) & (F.avg(_items(F.col("value")).isNotNull().cast("int")) >= 0.5)).alias("_split")
    )
    parts = F.when(F.col("_split"), F.coalesce(_items(F.col("value")), F.array("value"))).otherwise(F.array("value"))
    exploded = present.join(rule, KEY).select(*KEY, "cnt", F.explode(parts).alias("value"))
    return exploded.groupBy(*KEY, "value").agg(F.sum("cnt").alias("cnt"))


def table_class(tables: Mapping[str, DataFrame], keys: Mapping[str, str | None]) -> DataFrame:
    """dimension (no user key), one_to_one (unique key) or one_to_many, per table."""
    parts = []
    for name, df in tables.items():
        key = keys.get(name)
        if key is None:
            agg = df.agg(F.count(F.lit(1)).alias("total_rows"), F.lit(None).cast("bigint").alias("unique_keys"))
        else:
            per_key = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            agg = per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("k").alias("unique_keys")
            )
        parts.append(agg.select(F.lit(name).alias("table_name"), "total_rows", "unique_keys"))
    out = reduce(DataFrame.unionByName, parts)
    label = (
        F.when(F.col("unique_keys").isNull(), "dimension")
        .when(F.col("unique_keys") == F.col("total_rows"), "one_to_one")
        .otherwise("one_to_many")
    )
    return out.withColumn("classification", label)


def cleaning_profile(values: DataFrame, samples: int = 5) -> DataFrame:
    """Missing percentage (empty text counts as missing), distinct values and the first few values in order."""
    missing = F.col("value").isNull() | (F.col("value") == "")
    stats = values.groupBy(*KEY).agg(
        (F.sum(F.when(missing, F.col("cnt")).otherwise(0)) * 100.0 / F.sum("cnt")).alias("missing_pct"),
        F.count(F.when(~missing, F.col("value"))).alias("n_unique"),
    )
    order = W.partitionBy(*KEY).orderBy("value")
    head = values.where(~missing).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= samples)
    joined = head.groupBy(*KEY).agg(F.concat_ws(",", F.array_sort(F.collect_list("value"))).alias("sample_values"))
    return stats.join(joined, KEY, "left")


def key_validation(df: DataFrame, key: str) -> DataFrame:
    """Null rate, uniqueness and the largest number of rows behind one key."""
    per_key = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count("k").alias("n_keys"),
        (F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_rate"),
        F.max(F.when(F.col("k").isNotNull(), F.col("n"))).alias("max_duplication"),
    ).withColumn("is_unique", F.col("max_duplication") == 1)


def label_gate(df: DataFrame, user: str, label: str) -> DataFrame:
    """Rows, users, missing and invalid labels, both classes."""
    text = F.col("label").cast("string")
    per_user = df.groupBy(F.col(user).alias("u"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    empty = F.col("label").isNull() | (text == "")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return per_user.agg(
        F.sum("n").alias("n_rows"),
        F.countDistinct("u").alias("n_users"),
        count(empty).alias("n_label_missing"),
        count(~empty & ~text.isin("0", "1")).alias("n_label_invalid"),
        count(text == "0").alias("n_negative"),
        count(text == "1").alias("n_positive"),
    )


def char_entropy(values: DataFrame) -> DataFrame:
    """Shannon entropy (bits) of the characters of each column's distinct values."""
    chars = values.where("value <> ''").select(*KEY, F.explode(F.split("value", "")).alias("ch")).where("ch <> ''")
    counted = chars.groupBy(*KEY, "ch").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*KEY).agg(
        F.sum("n").alias("_t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_s")
    )
    # -sum(p*log2 p) with p = n/t equals log2 t - sum(n*log2 n)/t
    return totals.select(*KEY, (F.log2(F.col("_t").cast("double")) - F.col("_s") / F.col("_t")).alias("entropy"))


def approx_distinct(df: DataFrame, columns: list[str], rsd: float = 0.02) -> DataFrame:
    """Sketch-based distinct counts, one pass and constant memory, for columns too wide to count exactly."""
    row = df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])
    return row.unpivot([], columns, "column_name", "approx_distinct")


def pattern_shares(values: DataFrame) -> DataFrame:
    """Share of filled rows that match each value pattern, for every column; found above 0.8."""
    present = values.where("value is not null")
    names = [n for n, _, _ in VALUE_PATTERNS]
    shares = present.groupBy(*KEY).agg(
        *[
            (F.sum(F.when(F.col("value").rlike(rx), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias(n)
            for n, rx, _ in VALUE_PATTERNS
        ]
    )
    return shares.unpivot(KEY, names, "pattern", "share").withColumn("found", F.col("share") > PATTERN_SHARE)


def inferred_types(values: DataFrame, types: DataFrame) -> DataFrame:
    """Logical type: booleans in disguise, and text that is mostly numbers or dates (above 0.9)."""
    number = F.expr("try_cast(value as double)")
    # only text is read as a time
    moment = F.when(F.col("kind") == "string", F.expr("try_cast(value as timestamp)"))
    present = values.where("value is not null").join(types.select(*KEY, "kind"), KEY)
    share = lambda c: F.sum(F.when(c, F.col("cnt")).otherwise(0)) / F.sum("cnt")
    facts = present.groupBy(*KEY).agg(
        share(number.isNotNull()).alias("_num"),
        share(moment.isNotNull()).alias("_date"),
        F.bool_and(F.coalesce(number == F.floor(number), F.lit(True))).alias("_whole"),
        F.bool_and(F.coalesce(number.isin(0.0, 1.0), F.lit(False))).alias("_binary"),
        F.bool_and(F.coalesce(number.isin(0.0, 1.0), F.lit(True))).alias("_binary_numbers"),
    )
    numeric_text = F.col("_num") > NUMERIC_SHARE
    logical = (
        F.when(F.col("_num").isNull(), "unknown")
        .when(F.col("kind").isin("boolean", "datetime"), F.col("kind"))
        .when(F.col("kind") == "integer", F.when(F.col("_binary"), "integer_boolean").otherwise("integer"))
        .when(F.col("kind") == "float", F.when(F.col("_binary"), "float_boolean").otherwise("float"))
        .when(numeric_text & F.col("_whole") & F.col("_binary_numbers"), "integer_boolean")
        .when(numeric_text & F.col("_whole"), "integer")
        .when(numeric_text, "float")
        .when(F.col("_date") > NUMERIC_SHARE, "datetime")
        .otherwise("string")
    )
    return types.join(facts, KEY, "left").select(*KEY, "data_type", logical.alias("dtype"))


def semantic_types(stats: DataFrame, patterns: DataFrame, types: DataFrame) -> DataFrame:
    """Meaning of a column: value pattern first, then its name, then type and uniqueness."""
    rank = F.coalesce(*[F.when(F.col("pattern") == n, F.lit(i)) for i, (n, _, _) in enumerate(VALUE_PATTERNS)])
    meaning = F.coalesce(*[F.when(F.col("pattern") == n, F.lit(m)) for n, _, m in VALUE_PATTERNS])
    found = patterns.where("found").groupBy(*KEY).agg(F.min_by(meaning, rank).alias("_pattern"))
    lowered = F.lower("column_name")
    by_name = F.coalesce(*[F.when(lowered.rlike(rx if rx.startswith("^") else "^" + rx), F.lit(m)) for rx, m in NAME_RULES])
    unique = F.when(F.col("filled") > 0, F.col("n_distinct") / F.col("filled")).otherwise(0.0)
    by_type = (
        F.when(F.col("dtype").isin("boolean", "integer_boolean", "float_boolean"), "boolean_flag")
        .when(F.col("dtype") == "datetime", "timestamp")
        .when((unique > 0.9) & F.col("dtype").isin("integer", "string"), "identifier")
        .otherwise("unknown")
    )
    joined = stats.join(types, KEY).join(found, KEY, "left")
    # value patterns are only looked for in text columns
    text = F.when(F.col("data_type") == "string", F.col("_pattern"))
    return joined.select(*KEY, "dtype", F.coalesce(text, by_name, by_type).alias("semantic_type"))


def looks_cipher(text: Column) -> Column:
    """An opaque token or an unbroken run of base64 letters."""
    # the shortest opaque token has 15 characters
    return (F.octet_length(text) >= 15) & (text.rlike(OPAQUE) | text.rlike(r"^[A-Za-z0-9+/=]{32,}$"))


def looks_secret(text: Column) -> Column:
    """A private key or a salted password hash."""
    return (F.contains(text, F.lit("-----BEGIN ")) & text.rlike("-----BEGIN (?:RSA |EC )?PRIVATE KEY-----")) | (F.startswith(text, F.lit("$2")) & text.rlike(r"^\$2[aby]\$"))


def is_temporal(column: str, data_type: str) -> bool:
    """A column of dates or times by its type or its name."""
    return bool(re.search("(?i)date|time", data_type) or re.search(TEMPORAL_NAME, column))


def is_large(data_type: str) -> bool:
    """A type whose values have no plain text form."""
    return bool(re.search(LARGE_TYPE, data_type))


def column_lanes(values: DataFrame, stats: DataFrame, types: DataFrame, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """skip (large or encrypted), range (temporal, running or opaque ids) or domain, per column."""
    present = values.where("value <> ''")
    facts = present.groupBy(*KEY).agg(
        F.avg(F.trim("value").rlike(OPAQUE).cast("int")).alias("opaque_share"),
        F.avg(looks_cipher(F.trim("value")).cast("int")).alias("_cipher"),
        F.avg(F.length(F.trim("value"))).alias("avg_length"),
        F.bool_or(looks_secret(F.col("value"))).alias("_secret"),
        F.bool_and(F.col("value").rlike(r"^\d{1,14}$")).alias("_digits"),
    )
    joined = types.join(stats, KEY).join(facts, KEY, "left").join(char_entropy(values), KEY, "left")
    is_key = F.lit(False)
    for table, column in keys:
        is_key = is_key | ((F.col("table_name") == table) & (F.col("column_name") == column))
    distinct_ratio = F.col("n_distinct") / F.greatest("n_rows", "n_distinct")
    encrypted = F.coalesce(F.col("_secret"), F.lit(False)) | (
        (F.col("avg_length") >= 24) & (F.col("entropy") >= CIPHER_ENTROPY) & ((F.col("_cipher") >= 0.8) | (F.col("avg_length") >= 40))
        & (F.col("_cipher") >= 0.5)
    )
    token_name = F.col("column_name").rlike(r"(?i)(?:^|_)(?:code|no|uuid|token|key|sn)$")
    opaque = (F.col("opaque_share") >= 0.8) | ((F.col("n_distinct") >= 50) & token_name & (F.col("opaque_share") >= 0.5))
    temporal = F.col("data_type").rlike("(?i)date|time") | F.col("column_name").rlike(TEMPORAL_NAME)
    running = is_key & F.col("data_type").rlike("(?i)int") & F.coalesce(F.col("_digits"), F.lit(False)) & (distinct_ratio >= 0.98)
    lane = (
        F.when(F.col("data_type").rlike(LARGE_TYPE) | F.coalesce(encrypted, F.lit(False)), "skip")
        .when(running | temporal | F.coalesce(opaque, F.lit(False)), "range")
        .otherwise("domain")
    )
    return joined.select(*KEY, "data_type", "opaque_share", lane.alias("lane"))


def value_forms(values: DataFrame) -> DataFrame:
    """Character class, common prefix (two characters or more) and placeholder texts per column."""
    present = values.where("trim(value) <> ''").select(*KEY, F.trim("value").alias("value"))
    facts = present.groupBy(*KEY).agg(
        F.bool_and(F.col("value").rlike(r"^\d+$")).alias("_digit"),
        F.bool_or(F.col("value").rlike(r"[一-鿿]")).alias("_cjk"),
        F.bool_and(F.col("value").rlike(r"^[\x00-\x7f]+$")).alias("_ascii"),
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("value").rlike(SENTINEL)).alias("n_sentinels"),
    )
    charset = F.when(F.col("_digit"), "digit").when(F.col("_cjk"), "cjk").when(F.col("_ascii"), "ascii").otherwise("mixed")
    # the common prefix of all values is the common prefix of the smallest and the largest one
    size = F.length("_lo")
    same = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.left("_lo", i) != F.left("_hi", i))
    length = F.when(F.size(same) == 0, size).otherwise(F.array_min(same) - 1)
    prefix = F.when((F.col("_n") >= 2) & (length >= 2), F.left("_lo", length))
    return facts.select(*KEY, charset.alias("charset"), prefix.alias("prefix"), "n_sentinels")


def closed_domains(values: DataFrame, lanes: DataFrame, stats: DataFrame) -> DataFrame:
    """Whether a column is a closed dictionary and whether its values form a closed code set."""
    present = values.where("trim(value) <> ''").select(*KEY, F.trim("value").alias("value"))
    facts = present.groupBy(*KEY).agg(
        F.bool_and(F.col("value").rlike(BOOLEAN_TEXT)).alias("_bool"),
        F.bool_and(F.col("value").rlike(r"^[A-Za-z0-9_-]{1,8}$")).alias("_short"),
        F.bool_and(F.col("value").rlike(r"^[A-Za-z0-9_.:-]{1,16}$")).alias("_code"),
        F.bool_and(F.col("value").rlike(r"^\d+$")).alias("_digits"),
        F.count(F.lit(1)).alias("_n"),
    )
    j = stats.join(lanes.select(*KEY, "lane"), KEY).join(facts, KEY, "left")
    published = (F.col("lane") == "domain") & (F.col("n_distinct") > 0) & (F.col("null_rate") < 0.999)
    named = F.col("column_name").rlike(DICTIONARY_NAME) | F.col("column_name").rlike(BOOLEAN_NAME)
    dictionary = (
        published & (F.col("n_distinct") <= DICTIONARY_LIMIT) & (named | F.col("_bool") | ((F.col("n_distinct") <= 8) & F.col("_short")))
    )
    codes = F.col("_n").between(2, DICTIONARY_LIMIT) & F.col("_code") & (~F.col("_digits") | (F.col("_n") <= 12))
    return j.select(
        *KEY,
        F.coalesce(dictionary, F.lit(False)).alias("closed_dictionary"),
        F.coalesce(codes, F.lit(False)).alias("closed_codes"),
    )


# A code, a separator and its label, as written in column comments.
CODE_PAIR = r"([A-Za-z0-9_-]{1,16})\s*[-:：=]\s*([^\s,;，；|/]+)"


def comment_codes(df: DataFrame, key: str, comment: str) -> DataFrame:
    """Code and label pairs written in comments; the last label of a code counts."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(comment, F.lit(CODE_PAIR), 1).alias("code"),
        F.regexp_extract_all(comment, F.lit(CODE_PAIR), 2).alias("label"),
    )
    rows = df.select(key, F.posexplode(pairs).alias("pos", "p")).select(
        key, "pos", F.col("p.code").alias("code"), F.col("p.label").alias("label")
    )
    return rows.where("code <> label").groupBy(key, "code").agg(F.max_by("label", "pos").alias("label"))


def list_delimiter(values: DataFrame) -> DataFrame:
    """'#' or '^' when a column's texts hold it, else null."""
    return values.groupBy(*KEY).agg(
        F.when(F.coalesce(F.bool_or(F.contains("value", F.lit("#"))), F.lit(False)), "#")
        .when(F.coalesce(F.bool_or(F.contains("value", F.lit("^"))), F.lit(False)), "^")
        .alias("delimiter")
    )
