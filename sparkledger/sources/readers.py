"""Log sources: CSV, free text with line numbers, JSON batches, tables, JDBC."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract
from . import scratch
from .scratch import delete as delete_folder
from .scratch import exists
from ..schemas import ALIASES, FIELDS, NULL_TOKENS, REQUIRED

BROADCAST_BLOCKS = 100_000


def standard_columns(df: DataFrame) -> DataFrame:
    """Aliases renamed, required columns added as null. Two inputs for one name are an error."""
    names = [ALIASES.get(c, c) for c in df.columns]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"more than one column for {sorted(twice)}")
    df = df.toDF(*names)
    return df.withColumns({c: F.lit(None).cast("string") for c in REQUIRED if c not in names})


def read_csv(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> DataFrame:
    """CSV with a header; all columns text, null tokens null; `timestamp` typed, its text kept as timestamp_text."""
    df = spark.read.csv(paths, header=True, escape='"', inferSchema=False, multiLine=multi_line)
    df = standard_columns(df.select([F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns]))
    return df.withColumn("timestamp_text", F.col("timestamp").cast("string")).withColumn("timestamp", extract.typed_timestamp(F.col("timestamp_text")))


def _blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, and of its file block: input_file, block (its first byte), at (rises by one from line to line of a block)."""
    return spark.read.text(paths).select(
        F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("input_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )


#: How Spark cuts files into blocks, and deals these to tasks.
SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionNum", "spark.sql.leafNodeDefaultParallelism")


def _splits(spark: SparkSession, lines: DataFrame) -> str:
    return "; ".join([*(f"{k}={spark.conf.get(k, None)}" for k in SPLITS), f"parallelism={spark.sparkContext.defaultParallelism}", f"tasks={lines.rdd.getNumPartitions()}"])


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row per file: its name, length and time of change. Lists folders; reads no file."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")


def _count_blocks(lines: DataFrame, path: str) -> None:
    blocks = lines.groupBy("input_file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("input_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).write.mode("overwrite").parquet(f"{path}/counts")


def index_blocks(spark: SparkSession, paths: str | list[str], path: str) -> None:
    """The side table of numbered_lines(): for each block of these files how many lines stand before it, below `counts`; the files
    and the settings that this holds for, below `files` and `splits`. `splits` comes last: without it the index is not there."""
    delete_folder(spark, f"{path}/splits")
    lines = _blocks(spark, paths)
    _count_blocks(lines, path)
    _files(spark, paths).write.mode("overwrite").parquet(f"{path}/files")
    spark.createDataFrame([(_splits(spark, lines),)], "splits string").coalesce(1).write.mode("overwrite").parquet(f"{path}/splits")


def index_holds(spark: SparkSession, paths: str | list[str], path: str) -> bool:
    """Whether an index was made of just these files, as they are now, under the settings of now."""
    if not exists(spark, f"{path}/splits") or spark.read.parquet(f"{path}/splits").first()["splits"] != _splits(spark, _blocks(spark, paths)):
        return False
    then, now = spark.read.parquet(f"{path}/files"), _files(spark, paths)
    return then.exceptAll(now).isEmpty() and now.exceptAll(then).isEmpty()


def numbered_lines(spark: SparkSession, paths: str | list[str], index: str | None = None) -> DataFrame:
    """value, input_file, line_number: the 1-based number of the physical line, blank lines counted.

    Lines are numbered within their file block, and blocks by the counts of those before them; there is no sort of lines.
    The counts take a scan of their own. With `index`, a path, they are kept there: another read of the same files under the same
    settings scans once, and where files or settings are others the index is made anew. A line that doesn't belong where
    its block's counts say is an error, never a wrong number: so are files that change between the scans."""
    kept = index or scratch.new(spark, "line-blocks")
    if not index:
        _count_blocks(_blocks(spark, paths), kept)
    elif not index_holds(spark, paths, kept):
        index_blocks(spark, paths, kept)
    blocks = spark.read.schema("input_file string, block long, n long, first long, before long").parquet(f"{kept}/counts")
    if blocks.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    found = _blocks(spark, paths).join(blocks, ["input_file", "block"], "left")
    place = F.col("at") - F.col("first")
    known = F.coalesce((place >= 0) & (place < F.col("n")), F.lit(False))
    number = F.when(known, F.col("before") + place + 1).otherwise(F.raise_error(F.lit("the line counts are not those of the files as they are read now")).cast("long"))
    return found.select("value", "input_file", number.alias("line_number"))


def read_ordered_text(spark: SparkSession, path: str) -> DataFrame:
    """line_number, value of a folder that sinks.write_ordered_text() wrote: numbered through all its files, in the order of their parts."""
    lines = numbered_lines(spark, path)
    part = F.lpad(F.regexp_extract("input_file", r"/part-(\d+)[^/]*$", 1), 12, "0")
    sizes = scratch.table(spark, lines.groupBy("input_file").agg(F.max("line_number").alias("n")), "file-sizes")  # a row per file
    before = F.coalesce(F.sum("n").over(Window.orderBy(part, "input_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("input_file", before.alias("start"))
    return lines.join(starts, "input_file").select((F.col("start") + F.col("line_number")).alias("line_number"), "value")


def read_text(spark: SparkSession, paths: str | list[str], year: int = 1970, index: str | None = None, address: str = extract.IPV4) -> DataFrame:
    """A row per non-blank line with its fields, input_file and line_number. `index`: see numbered_lines(); `address`: extract.ip_address()."""
    return extract.parse_lines(numbered_lines(spark, paths, index), "value", year, address)


def read_logs(spark: SparkSession, paths: Iterable[str], fmt: str = "auto", year: int = 1970, address: str = extract.IPV4) -> DataFrame:
    """By suffix: .csv in any case is CSV, all else text; or all as `fmt` says. `address`, of text: see extract.ip_address()."""
    paths = list(paths)
    if fmt not in ("auto", "csv", "text"):
        raise ValueError(f"no format {fmt}")
    csv = [p for p in paths if fmt == "csv" or fmt == "auto" and p.lower().endswith(".csv")]
    text = [p for p in paths if p not in csv]
    parts = ([read_csv(spark, csv)] if csv else []) + ([read_text(spark, text, year, address=address)] if text else [])
    if not parts:
        raise ValueError("no input")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


_JSON = "id bigint, timestamp timestamp_ntz, ipAddress string, username string, operation string, operationResult string, detail string, severity string, sourceFile string, createdAt timestamp_ntz"
_SNAKE = {"ipAddress": "ip_address", "operationResult": "operation_result", "sourceFile": "source_file", "createdAt": "created_at"}


def read_json_batch(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Arrays (or lines) of objects with camel-case names."""
    return spark.read.schema(_JSON).json(paths, multiLine=multi_line).withColumnsRenamed(_SNAKE)


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def read_jdbc(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, **properties: str) -> DataFrame:
    """One query per predicate, in parallel; without predicates a single one."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties) if predicates else spark.read.jdbc(url, table, properties=properties)


def log_fields(df: DataFrame) -> DataFrame:
    """The eight log fields, those that are absent as null."""
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in FIELDS])
