"""Report files and posts as streams: files that arrive in a folder, the row-level operators on them, files of incidents.

Only operators that look at a row alone have a place here (cleaning, severity, the rows of the unified table); they keep no
state, so late files need no watermark. Ids, which number whole tables, are left to batch jobs over what a stream wrote.
A stream that is started again with the same checkpoint folder goes on where it stopped and writes no file twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reportloom.operators.text import clean_text
from reportloom.operators.unify import incident_rows
from reportloom.sources.io import REPORT_COLUMNS, parse_posts, post_rows


def report_stream(spark: SparkSession, path: str, source: str, files: int = 100) -> DataFrame:
    """Report files of a source as strings, ``files`` of them in a batch at most; the same cells as ``read_report`` gives."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REPORT_COLUMNS[source]])
    read = spark.readStream.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', emptyValue="", nullValue="\x00", maxFilesPerTrigger=files)
    return read.csv(path).fillna("")


def post_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Posts of JSON-lines files with their cleaned text; malformed lines are left out.

    A stream does not know how many lines a file's earlier splits have, so posts without an id have none (null).
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    posts = post_rows(parse_posts(lines).where(~F.col("malformed")), F.lit(None))
    return posts.withColumn("cleaned_text", clean_text(F.col("raw_text")))


def incident_stream(reports: DataFrame, source: str) -> DataFrame:
    """The unified columns (but the id) of a stream of reports."""
    return incident_rows(reports, source)


def write_stream(rows: DataFrame, path: str, checkpoint: str, partition_by: list[str] = ()) -> StreamingQuery:
    """All files that are there now, written as Parquet in as many batches as they need; ends by itself."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()
