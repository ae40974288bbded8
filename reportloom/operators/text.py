"""Social posts: cleaning, tokens, entities, labels, the text report."""

from __future__ import annotations

import html
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.functions.cells import assign_ids, strip
from reportloom.functions.stem import porter

#: Fixed values.
LABEL_MAP = {"PERSON": "Person", "GPE": "Location", "LOC": "Location", "FAC": "Location", "ORG": "Organization", "DATE": "Date", "TIME": "Date"}
TOPICS = ["Theft / Robbery", "Assault / Violence", "Fire / Arson", "Traffic Accident", "Public Disturbance", "Other"]
TOPIC_THRESHOLD = 0.25
#: Common English function words; a parameter of ``tokenize``.
STOPWORDS = "a an and are as at be but by for from had has have he her his i if in is it its me my not of on or our she so that the their them then there they this to us was we were what when which who will with you your".split()


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Character references decoded. The helper gets the texts with an ampersand only, nulls for all others."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def clean_text(c: Column, unescape: bool = True) -> Column:
    """Decoded; without a leading RT, links and mentions; hashtags without their mark; white space collapsed."""
    if unescape:
        c = html_unescape(c)
    for pattern, by in ((r"(?iU)^RT\s+", ""), (r"(?U)https?://\S+|www\.\S+", ""), (r"(?U)@\w+", ""), (r"(?U)#(\w+)", "$1"), (r"(?U)\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def tokenize(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case word tokens of two characters or more that are no stopwords."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+(?:'\w+)?)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: [_stem(t) for t in ts], na_action="ignore")


@lru_cache(1 << 18)
def _stem(token: str) -> str:
    """One word's stem; a worker remembers the words that it met last."""
    return porter(token)


def stem_tokens(df: DataFrame, tokens: str, out: str = "stems") -> DataFrame:
    """``df`` with the stems of an array column, in order, null for null. Words are stemmed where they lie, without a shuffle."""
    return df.withColumn(out, _stems(F.col(tokens)))


def format_entities(text: Column, entities: Column, label_map: dict[str, str] = LABEL_MAP) -> Column:
    """``name (Category); …`` in order, each once; ``None`` without any; empty for a blank text."""
    kinds = F.create_map(*[F.lit(x) for kv in label_map.items() for x in kv])
    named = F.transform(entities, lambda e: F.concat(strip(e["text"]), F.lit(" ("), kinds[e["label"]], F.lit(")")))
    kept = F.array_distinct(F.filter(named, lambda x: x.isNotNull()))
    return F.when(strip(text) == "", "").when(F.size(kept) > 0, F.array_join(kept, "; ")).otherwise("None")


def sentiment_label(text: Column, label: Column) -> Column:
    return F.when(strip(text) == "", "Neutral").otherwise(F.initcap(label))


def topic_argmax(scores: DataFrame, key: str = "tweet_id", threshold: float = TOPIC_THRESHOLD, topics: list[str] = TOPICS) -> DataFrame:
    """key, topic: the label of the highest score, the first of equal ones; ``Other`` below the threshold."""
    best = scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("b"))
    names = F.array(*[F.lit(t) for t in topics])
    return best.select(key, F.when(F.col("b.score") >= threshold, F.element_at(names, -F.col("b.back").cast("int"))).otherwise("Other").alias("topic"))


def text_report(posts: DataFrame, order: list[str]) -> DataFrame:
    """The six report columns of posts with screen_name, raw_text, sentiment, entities and topic."""
    numbered = assign_ids(posts, "TXT", order, "Text_ID", "_")
    source = F.when(F.col("screen_name") == "Unknown", "CrimeReport").otherwise(F.concat(F.lit("@"), F.col("screen_name")))
    return numbered.select("Text_ID", source.alias("Source"), F.col("raw_text").alias("Raw_Text"), F.col("sentiment").alias("Sentiment"), F.col("entities").alias("Entities"), F.col("topic").alias("Topic"))


def label_breakdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """kind, label, rows for each of the columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("label")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.kind", "p.label").agg(F.count("*").alias("rows"))


def entity_coverage(df: DataFrame) -> DataFrame:
    """with_entities, total, percent (one decimal)"""
    n = F.count_if(F.col("Entities") != "None")
    return df.agg(n.alias("with_entities"), F.count("*").alias("total"), F.bround(n * 100.0 / F.count("*"), 1).alias("percent"))
