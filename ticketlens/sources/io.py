"""Readers and writers (S1-S12). Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions.text import col_of, trim_u
from ticketlens.schemas import ANNOTATION_CSV, TWEETS, TWEETS_CSV

# Fixed value: the tweet timestamp layout after the weekday ("Tue ") is dropped.
TWITTER_TS = "MMM dd HH:mm:ss Z yyyy"


def parse_created_at(c: Column | str, strict: bool = False) -> Column:
    """S3: Twitter layout (weekday dropped — Spark cannot parse 'EEE'), else ISO; UTC. A text that is
    neither fails the job with ``strict`` and is null without it (``unparsed_timestamps`` lists them)."""
    c = col_of(c)
    at = F.coalesce(F.try_to_timestamp(F.substring(c, 5, 99), F.lit(TWITTER_TS)),
                    F.try_to_timestamp(c))
    if not strict:
        return at
    return F.when(c.isNotNull() & at.isNull(), F.raise_error(F.concat(F.lit("not a timestamp: "), c)).cast("timestamp")).otherwise(at)


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S3: raw tweets CSV (header, quoted multi-line cells) -> T1. A row that does not fit the schema, a date
    that is none and a reply-to id that is no number fail the read.

    Cells may hold line breaks, so a file cannot be split: it is read by one task. Many files are read in
    parallel; for one large export run ``convert_tweets`` once and work on the Parquet table."""
    raw = (spark.read.schema(TWEETS_CSV).option("header", True).option("multiLine", True)
           .option("escape", '"').option("mode", "FAILFAST").csv(path))
    # ids are written as "123.0" where some are missing; a decimal holds all of their digits
    reply_to = F.col("in_response_to_tweet_id").cast("decimal(20,0)").cast("long")
    return raw.select("tweet_id", "author_id", "inbound",
                      parse_created_at("created_at", strict=True).alias("created_at"), "text",
                      reply_to.alias("in_response_to_tweet_id"))


def convert_tweets(spark: SparkSession, csv_path: str, parquet_path: str, files: int | None = None) -> DataFrame:
    """S1 at scale: the one-off job that turns the raw export into a splittable Parquet table (of ``files`` files, if given)
    and returns it."""
    tweets = read_tweets(spark, csv_path)
    write_parquet(tweets.repartition(files) if files else tweets, parquet_path)
    return spark.read.schema(TWEETS).parquet(parquet_path)


def unparsed_timestamps(raw: DataFrame, col: str = "created_at") -> DataFrame:
    """S3 report: rows whose non-null timestamp text did not parse."""
    return raw.filter(F.col(col).isNotNull() & parse_created_at(col).isNull())


def first_rows(df: DataFrame, n: int, order_cols: list) -> DataFrame:
    """The first ``n`` rows by an explicit key (file order is not a Spark notion)."""
    return df.orderBy(*order_cols).limit(n)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S4."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; the column list is pruned into the scan by Catalyst."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_annotations(spark: SparkSession, path: str, with_source: bool = False) -> DataFrame:
    """S8 (+S10): annotated CSV(s): BOM stripped, '#' comment lines skipped, header row; a row with other columns fails the read.
    ``path`` may be a directory or glob; ``with_source`` adds the file name per row."""
    df = (spark.read.schema(ANNOTATION_CSV).option("header", True).option("comment", "#")
          .option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
          .option("pathGlobFilter", "*.{csv,txt}").csv(path))
    if with_source:
        df = df.withColumn("source_file", F.regexp_extract(F.col("_metadata.file_name"),
                                                           r"^(.*?)(\.csv|\.txt)?$", 1))
    return df


def annotation_template(golden: DataFrame) -> DataFrame:
    """Rows for annotators: tweet newlines -> space, '"' -> "'", stripped; gold columns blank."""
    tweet = trim_u(F.translate(F.regexp_replace(F.col("input_tweet"), "[\r\n]", " "), '"', "'"))
    blank = F.lit("")
    return golden.select(F.col("test_id").cast("string").alias("test_id"), tweet.alias("input_tweet"),
                         "expected_language", blank.alias("gold_intent"), blank.alias("gold_decision"),
                         blank.alias("gold_reason"), blank.alias("required_routing"),
                         blank.alias("forbidden_elements"), blank.alias("agent_notes"),
                         "source_intent")


# Our own wording; callers pass theirs.
ANNOTATION_INSTRUCTIONS = [
    "Please fill in the gold columns of every row.", "gold_decision is AUTO_REPLY or ESCALATE, gold_reason says why in a few words or NONE.",
    "required_routing and forbidden_elements are lists with commas between their items.",
    "Leave test_id, input_tweet, expected_language and source_intent as they are."]


def write_annotation_template(df: DataFrame, path: str, instructions: list[str] = ANNOTATION_INSTRUCTIONS) -> None:
    """S9 sink: one CSV file that begins with a byte order mark (for spreadsheets) and the instructions as ``#`` lines,
    then the header, then the rows by test id. A template goes to people, so it is as small as their time is."""
    spark = df.sparkSession
    row = F.to_csv(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns]), {"escape": '"', "emptyValue": ""})
    head = ["# " + line for line in instructions] + [",".join(df.columns)]
    head[0] = "\ufeff" + head[0]
    lines = spark.createDataFrame(list(enumerate(head, -len(head))), "at long, value string").unionByName(
        df.select(F.coalesce(F.col("test_id").cast("long"), F.lit(0)).alias("at"), row.alias("value")))
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def convert_annotations(spark: SparkSession, in_dir: str, out_dir: str) -> None:
    """Every CSV (named .csv, or .txt as Spark names text files) in ``in_dir`` -> normalised JSON lines, one output folder per input file."""
    from ticketlens.operators.gold import normalise_annotations
    df = read_annotations(spark, in_dir, with_source=True)
    (normalise_annotations(df, keep=["source_file"]).write.mode("overwrite")
     .option("ignoreNullFields", False).partitionBy("source_file").json(out_dir))


def write_scorecard(df: DataFrame, path: str) -> None:
    """One-row scorecard as a single JSON file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def calibration_report_lines(agreement: DataFrame) -> DataFrame:
    """S12: 'key=value' lines, 4 decimals (the calibration report format)."""
    cols = ["brand_voice_kappa", "policy_kappa", "pii_accuracy", "lang_accuracy"]
    lines = [F.concat(F.lit("n="), F.col("n").cast("string"))] + [
        F.concat(F.lit(f"{c}="), F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("nan")))
        for c in cols]
    return agreement.select(F.explode(F.array(*lines)).alias("value"))


def write_report(agreement: DataFrame, path: str) -> None:
    """S12 sink."""
    calibration_report_lines(agreement).coalesce(1).write.mode("overwrite").text(path)


__all__ = ["parse_created_at", "read_tweets", "convert_tweets", "unparsed_timestamps", "first_rows", "write_parquet",
           "read_parquet", "read_jsonl", "write_jsonl", "read_annotations", "annotation_template",
           "write_annotation_template", "convert_annotations", "write_scorecard",
           "calibration_report_lines", "write_report", "TWEETS"]
