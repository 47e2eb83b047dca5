"""File and JDBC readers."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import allow_charset

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def has_quoted_breaks(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether a quoted field may run over a line's end: the line it starts on then holds an odd number of quotes.

    Lines are read as bytes, in splits; a stray quote also answers yes, which only costs speed. In charsets of two bytes a letter a byte of a letter may look like a
    quote, so these answer yes at once.
    """
    if encoding.upper().startswith(("UTF-16", "UTF-32")):
        return True
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", multiline: bool | None = None) -> DataFrame:
    """CSV with a header row; a column is DOUBLE when all its values are numbers, else text.

    Types come from all rows, so a late text value never breaks the read. Files are read in splits unless ``multiline`` is set or, when it is None, quoted fields
    hold line breaks.
    """
    if multiline is None:
        multiline = has_quoted_breaks(spark, path, encoding)
    options = {"header": True, "encoding": allow_charset(spark, encoding), "multiLine": multiline, "quote": '"', "escape": '"'}
    typed = spark.read.options(**options, inferSchema=True).csv(path).schema
    fields = [
        T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, _NUMERIC) else T.StringType(), True)
        for f in typed.fields
    ]
    return spark.read.options(**options).schema(T.StructType(fields)).csv(path)


def read_directory(spark: SparkSession, path: str, fmt: str = "parquet", register: bool = False) -> dict[str, DataFrame]:
    """One lazily read table per file (or table folder) of a directory, named by its stem. Only names of tables reach the driver."""
    base = urlparse(path.rstrip("/")).path
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    local = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    entry = F.split_part(F.substring(local, F.lit(len(base) + 2), F.length(local)), F.lit("/"), F.lit(1))
    entries = [r.entry for r in listing.select(entry.alias("entry")).distinct().collect()]
    tables = {}
    for entry in sorted(e for e in entries if e.endswith(f".{fmt}")):
        name = entry.rsplit(".", 1)[0]
        full = f"{path.rstrip('/')}/{entry}"
        tables[name] = read_csv(spark, full) if fmt == "csv" else spark.read.format(fmt).load(full)
        if register:
            tables[name].createOrReplaceTempView(name)
    return tables


def read_documents(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """JSON lines. Field types come from all lines, or from ``sample`` of them; nested values are kept as their JSON text."""
    if sample is None:
        inferred = spark.read.json(path).schema
    else:
        lines = [r.value for r in spark.read.text(path).limit(sample).collect()]
        inferred = spark.read.json(spark.sparkContext.parallelize(lines, 1)).schema
    fields = [
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else f.dataType)
        for f in inferred.fields
    ]
    return spark.read.schema(T.StructType(fields)).json(path)


# The database kinds users connect to, with their public JDBC driver class and URL form.
JDBC_KINDS = {
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "gaussdb": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 8000),
    "greenplum": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}:{port}/{database}", 5439),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "mariadb": ("org.mariadb.jdbc.Driver", "jdbc:mariadb://{host}:{port}/{database}", 3306),
    "tidb": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 4000),
    "oceanbase": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 2881),
    "doris": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 9030),
    "starrocks": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 9030),
    "sqlserver": (
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        1433,
    ),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}", 1521),
    "trino": ("io.trino.jdbc.TrinoDriver", "jdbc:trino://{host}:{port}/{database}", 8080),
    "presto": ("com.facebook.presto.jdbc.PrestoDriver", "jdbc:presto://{host}:{port}/{database}", 8080),
    "databricks": ("com.databricks.client.jdbc.Driver", "jdbc:databricks://{host}:{port}/{database}", 443),
    "hive": ("org.apache.hive.jdbc.HiveDriver", "jdbc:hive2://{host}:{port}/{database}", 10000),
    "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse://{host}:{port}/{database}", 8123),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}/?db={database}", 443),
    "bigquery": (
        "com.simba.googlebigquery.jdbc.Driver",
        "jdbc:bigquery://https://{host}:{port};ProjectId={database}",
        443,
    ),
}


def jdbc_options(
    kind: str,
    host: str,
    database: str,
    table: str,
    port: int | None = None,
    user: str | None = None,
    password: str | None = None,
    split: tuple[str, object, object, int] | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options of one source kind; ``split`` = (column, lower, upper, partitions) reads in parallel."""
    if kind not in JDBC_KINDS:
        raise ValueError(f"unsupported source kind: {kind}")
    driver, url, default_port = JDBC_KINDS[kind]
    options = {
        "driver": driver,
        "url": url.format(host=host, port=port or default_port, database=database),
        "dbtable": table,
        "fetchsize": str(fetch_size),
        "pushDownPredicate": "true",
        "pushDownAggregate": "true",
        "pushDownLimit": "true",
    }
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if split:
        column, lower, upper, parts = split
        options.update(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return options


def read_jdbc(spark: SparkSession, kind: str, **where) -> DataFrame:
    """Read one table over JDBC; filters, columns, limits and aggregates are pushed to the source by Spark."""
    return spark.read.format("jdbc").options(**jdbc_options(kind, **where)).load()


def hash_sample(df: DataFrame, key, n: int) -> DataFrame:
    """A repeatable sample of ``n`` rows: the smallest md5 of the key, the key itself breaking ties."""
    key_col = F.col(key) if isinstance(key, str) else key
    return df.orderBy(F.md5(key_col.cast("string")), key_col).limit(n)
