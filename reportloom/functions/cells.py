"""Column expressions shared by all modalities: cleaning, casing, truncation, ids, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.shared import checkpointed, fresh

NA = "N/A"
#: Cells that count as missing, lower case.
MISSING = ["", "nan", "none", "unknown", "unknown location"]
LEVELS = ["Low", "Medium", "High"]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_cell(c: Column) -> Column:
    """A missing value becomes ``N/A``; others are stripped and their white space collapsed."""
    c = c.cast("string")
    return F.when(c.isNull() | F.lower(strip(c)).isin(MISSING), F.lit(NA)).otherwise(collapse(c))


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case after letters."""
    parts = F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def truncate_details(c: Column, limit: int = 160) -> Column:
    """Texts over ``limit`` characters are cut back to a word and marked with dots."""
    head = F.substring(c, 1, limit)
    word = F.regexp_replace(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*\z", "")).otherwise(head), r"[ ,.;:]+\z", "")
    return F.when(F.length(c) > limit, F.concat(word, F.lit(" ..."))).otherwise(c)


def text_locations(c: Column) -> Column:
    """Distinct names marked ``(Location)`` in their order, joined by ``; ``; ``N/A`` if there is none."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)([A-Za-z][\w'’.\- ]+?)\s*\(Location\)"), F.lit(1))
    names = F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))
    return F.when(F.size(names) > 0, F.array_join(names, "; ")).otherwise(F.lit(NA))


def severity_score(confidence: Column) -> Column:
    """Confidence held to 0..1, times ten, to two decimals. NaN counts as 1."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * 10, 2)


def severity_level(score: Column) -> Column:
    return F.when(score < 3, "Low").when(score < 7, "Medium").otherwise("High")


def level_rank(c: Column) -> Column:
    """1 to 3 for Low to High, null for others."""
    return F.when(c == "Low", 1).when(c == "Medium", 2).when(c == "High", 3)


def dense_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, 1 to n in the order of the columns ``order``, without sorting in one task.

    Runs jobs. Rows of ``order`` alone are range-partitioned, sorted and numbered: a row's number is its place in its
    partition plus the sizes of the partitions before, of which there are few enough to broadcast. The numbers are joined
    back by ``order``; rows equal in it are numbered in any order. Where no two rows are equal in it (one count of the slim keys
    tells), wide rows are shuffled once, for this join.
    """
    return _numbered(df, order, out)[0]


def _numbered(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    keys = [fresh(df, f"key{i}_") for i in range(len(order))]
    slim = df.select(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    ranged = checkpointed(slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for p, n in sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect()):  # a row for each partition
        offsets.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(offsets, "part long, before long")
    placed = ranged.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("number", F.col("before") + place + 1)
    number, twin = fresh(df, "number_"), fresh(df, "twin_")
    numbers = placed.select(*keys, F.col("number").alias(number))
    same = lambda left: [left[c].eqNullSafe(numbers[k]) for c, k in zip(order, keys, strict=True)]
    if ranged.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        joined = df.join(numbers, same(df))
    else:  # equal keys are told apart by their place among themselves
        again = lambda c: F.row_number().over(Window.partitionBy(*c).orderBy(F.lit(1)))
        numbers = numbers.withColumn(twin + "_", again(keys))
        own = df.withColumn(twin, again([F.col(c) for c in order]))
        joined = own.join(numbers, [*same(own), F.col(twin) == F.col(twin + "_")]).drop(twin, twin + "_")
    return joined.drop(*keys).withColumnRenamed(number, out), before


def assign_ids(df: DataFrame, prefix: str, order: list[str], out: str = "Incident_ID", sep: str = "-", least: int = 3) -> DataFrame:
    """``PREFIX-001`` and so on; the width is that of the number of rows, ``least`` digits at least. Runs jobs."""
    name = fresh(df, "n_")
    numbered, rows = _numbered(df, order, name)
    return numbered.withColumn(out, F.format_string(f"{prefix}{sep}%0{max(least, len(str(rows)))}d", F.col(name))).drop(name)
