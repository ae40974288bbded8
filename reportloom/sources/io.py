"""Readers and writers of report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.functions.cells import LEVELS, strip
from reportloom.operators.analytics import DISPLAY_COLUMNS
from reportloom.operators.pages import non_text_flag
from reportloom.operators.unify import UNIFIED_COLUMNS

#: Columns of each report file.
REPORT_COLUMNS = {
    "Text": ["Text_ID", "Source", "Raw_Text", "Sentiment", "Entities", "Topic"],
    "Audio": ["Incident_ID", "Call_ID", "Transcript", "Extracted_Event", "Location", "Sentiment", "Urgency_Score"],
    "Video": ["Timestamp", "Frame_ID", "Event_Detected", "Objects", "Confidence"],
    "Image": ["Image_ID", "Scene_Type", "Objects_Detected", "Text_Extracted", "Confidence_Score"],
    "PDF": ["Report_ID", "Incident_Type", "Date", "Location", "Officer", "Summary", "Suspect_Description", "Outcome"],
}
#: Cells that the analytics read as missing.
NA_TOKENS = ["", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
PAGE_COLUMNS = ["page", "method", "conf", "rotation", "non_text", "text"]
PAGE = "struct<page:int,method:string,conf:double,rotation:int,non_text:boolean,text:string>"
PAGE_START = '{"page":'
INCIDENT = ", ".join(f"{c} {'double' if c == 'Severity_Score' else 'string'}" for c in UNIFIED_COLUMNS)
POST = "struct<id:string,text:string,created_at:string,user:struct<screen_name:string,name:string>>"


def read_report(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A report file as strings, no cell read as missing; a path that does not exist fails at once."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REPORT_COLUMNS[source]])
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', emptyValue="", nullValue="\x00")
    return df.fillna("")


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, block, at, value) of each line, and (file, block, first, before) of each split of a file.

    A line's number, from 1 in its file, is at - first + before + 1: its place among the lines of its split, after those of the
    splits before it, however the file was split. Runs no job; the second table has a row for each split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    return lines, splits.select("file", "block", "first", before.alias("before"))


def parse_posts(lines: DataFrame) -> DataFrame:
    """``lines`` (with a column ``value``) with ``post``, its fields, and ``malformed``; blank lines are left out.

    A line is a post if it is one JSON object, whatever its fields (``{}`` is one). Anything else is malformed.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    read = lines.where(strip(F.col("value")) != "").withColumn("post", F.from_json("value", f"{POST[:-1]},corrupt:string>", options))
    object_ = F.col("value").rlike(r"(?s)^\s*\{")
    return read.withColumn("malformed", ~object_ | F.col("post").isNull() | F.col("post.corrupt").isNotNull())


def post_rows(parsed: DataFrame, number: Column) -> DataFrame:
    """The five columns of posts with defaults for missing fields; ``number`` is the line number for those without an id."""
    name = F.coalesce("post.user.screen_name", F.lit("Unknown"))
    return parsed.select(
        F.coalesce("post.id", F.concat(F.lit("line_"), number.cast("string"))).alias("tweet_id"), name.alias("screen_name"), F.coalesce("post.user.name", name).alias("display_name"),
        F.coalesce("post.text", F.lit("")).alias("raw_text"), F.coalesce("post.created_at", F.lit("")).alias("created_at"))


def read_posts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(posts, counts): the good lines of JSON-lines files with defaults for missing fields; one row of line counts.

    Only posts without an id need their line number, so only they are joined with the splits.
    """
    lines, splits = numbered_lines(spark, path)
    parsed = parse_posts(lines)
    good = parsed.where(~F.col("malformed"))
    named = post_rows(good.where(F.col("post.id").isNotNull()), F.lit(0))
    unnamed = post_rows(good.where(F.col("post.id").isNull()).join(splits, ["file", "block"]), F.col("at") - F.col("first") + F.col("before") + 1)
    return named.union(unnamed), parsed.agg(F.count_if(~F.col("malformed")).alias("read"), F.count_if("malformed").alias("malformed"))


def write_page_cache(pages: DataFrame, path: str, parts: list[str], version: Column) -> None:
    """One cache file for each value of ``parts``: {"version": ..., "pages": [...]}, a line a page, never a whole file in memory.

    Files lie in folders by a hash of ``parts``: a number, since the writer would sort rows anew by text columns and lose
    the order of lines.
    """
    body = pages.select(*parts, F.col("page").alias("line_no"), F.to_json(F.struct(*PAGE_COLUMNS)).alias("line"))
    # A comma goes before every page but the first of its file.
    first = body.groupBy(*parts).agg(F.min("line_no").alias("first"), version.alias("version"))
    marked = body.join(first, parts).select(*parts, "line_no", F.concat(F.when(F.col("line_no") > F.col("first"), ",").otherwise(""), F.col("line")).alias("line"))
    heads = first.select(*parts, F.lit(None).cast("int").alias("line_no"), F.concat(F.lit('{"version": '), F.col("version"), F.lit(', "pages": [')).alias("line"))
    feet = first.select(*parts, F.lit((1 << 31) - 1).alias("line_no"), F.lit("]}").alias("line"))
    rows = heads.union(marked).union(feet).select(F.xxhash64(*parts).alias("cache"), "line_no", "line")
    rows.repartition("cache").sortWithinPartitions("cache", F.col("line_no").asc_nulls_first()).drop("line_no").write.partitionBy("cache").text(path)


def read_page_cache(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Pages of the cache files of the right version, a row each; none of any other. non_text of scanned pages is worked out anew.

    Files are read page by page, cut where a page begins: ``{"page":`` has bare quotes, which no JSON string has inside. What
    stands before the first page tells the version; pages of other versions are left out before they are parsed. A file
    whose pages begin with another field is one piece, and read as a whole.
    """
    pieces = spark.read.option("lineSep", PAGE_START).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    head = r'^\s*\{\s*"version"\s*:\s*(-?\d+)\s*,\s*"pages"\s*:\s*\['
    is_head = F.col("value").rlike(head)
    right = pieces.where(is_head & (F.expr(f"try_cast(regexp_extract(value, '{head.replace(chr(92), chr(92) * 2)}', 1) as bigint)") == version))
    page = F.concat(F.lit(PAGE_START), F.regexp_replace("value", r"\}\s*(?:,|\]\s*\}?)\s*\z", "}"))
    rows = pieces.where(~is_head).join(right.select("file"), "file", "left_semi").select(F.from_json(page, PAGE).alias("row"))
    whole = right.where(~F.col("value").rlike(r"\[\s*\z")).select(F.explode(F.from_json("value", f"struct<version:bigint,pages:array<{PAGE}>>")["pages"]).alias("row"))
    return rows.union(whole).select("row.*").withColumn("non_text", F.when(F.col("method") == "ocr", non_text_flag(F.col("method"), F.col("conf"), F.col("text"))).otherwise(F.col("non_text")))


def list_files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path, stem of the files with one of the extensions (whatever their case), by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    kept = files.where(F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1)).isin([e.lower() for e in extensions]))
    return kept.select("path", F.regexp_replace(name, r"\.[^.]*\z", "").alias("stem")).orderBy("path")


def coerce_master(df: DataFrame) -> DataFrame:
    """Strings of the unified table made ready for analytics: missing ones null, scores numbers (0 where none), levels known ones or null."""
    null = lambda c: F.when(~F.col(c).isin(NA_TOKENS), F.col(c)).alias(c)
    own = {"Severity_Score": F.coalesce(F.expr("try_cast(Severity_Score as double)"), F.lit(0.0)).alias("Severity_Score"), "Severity_Level": F.when(F.col("Severity_Level").isin(LEVELS), F.col("Severity_Level")).alias("Severity_Level")}
    return df.select(*[own.get(c, null(c)) for c in df.columns])


def read_master(spark: SparkSession, path: str) -> DataFrame:
    return coerce_master(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in their order with a header; further columns are left out. Executors write the parts."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').csv(path)


def write_incidents(df: DataFrame, path: str) -> None:
    """Parquet by source, so that filters on it read its folders alone.

    Only the folders of sources in ``df`` are written anew; those of other sources stay. Rows of a source are spread over as
    many files as tasks have them.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Source").parquet(path)


def read_incidents(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """The table that ``write_incidents`` wrote; with ``sources`` only their folders are listed and read."""
    df = spark.read.schema(INCIDENT).parquet(path)
    return (df if sources is None else df.where(F.col("Source").isin(sources))).select(*UNIFIED_COLUMNS)


def write_segments(df: DataFrame, path: str) -> None:
    df.drop("text").write.mode("overwrite").json(path)


def write_filtered(df: DataFrame, path: str) -> None:
    write_csv(df, path, DISPLAY_COLUMNS)
