"""Scanned pages: words to lines, the best of several readings, cleaning, page text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reportloom.functions.cells import strip

#: Fixed values.
TEXT_MIN, NONTEXT_CONF, NONTEXT_ALNUM, RETRY_BELOW = 50, 50, 400, 60
VARIANT = ["bundle_id", "page", "rotation", "psm"]
PAGE, LINE = VARIANT[:2], ["block_num", "par_num", "line_num"]
#: Words that a task holds before it packs them, or puts them in order; a page is held whole.
HELD = 1 << 18


def _codes(c: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, -1 for null."""
    return pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1).to_numpy()


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Rows that differ from the one before, the first row included."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def _packed(own: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of a page that a task meets together as one compressed cell: what its readings share is stored about once."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.Table.from_batches(held)
        places = [_codes(words.column(c)) for c in VARIANT]
        order = np.lexsort(places[::-1])  # readings one after the other, so that a later one repeats the first
        words, first = words.take(pa.array(order)), _changes([c[order] for c in places[: len(PAGE)]])
        rest = words.select(own.names).cast(own).combine_chunks().to_batches()[0]
        sizes, cells = [], []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            part = rest.slice(lo, hi - lo)
            text = part.column("text").dictionary_encode()
            parts = [part.set_column(part.schema.get_field_index("text"), "text", text.indices).serialize(), pa.record_batch([text.dictionary], ["text"]).serialize()]
            sizes.append([x.size for x in parts])
            cells.append(pa.compress(b"".join(parts), "zstd", asbytes=True))
        packed = [pa.array(sizes, pa.list_(pa.int64())), pa.array(cells, pa.binary())]
        yield from pa.table([*words.select(PAGE).take(pa.array(first)).columns, *packed], [*PAGE, "sizes", "words"]).combine_chunks().to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return pack


def _texts(own: pa.Schema, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The text of every reading, from cells of words sorted by page."""

    def joined(texts: pa.Array, first: np.ndarray, by: str) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([*first.tolist(), len(texts)], pa.int32()), texts), by)

    coded = own.set(own.get_field_index("text"), pa.field("text", pa.int32()))

    def unpacked(sizes: list[int], cell: bytes) -> pa.RecordBatch:
        whole = pa.py_buffer(pa.decompress(cell, sum(sizes), "zstd", asbytes=True))
        part, text = pa.ipc.read_record_batch(whole.slice(0, sizes[0]), coded), pa.ipc.read_record_batch(whole.slice(sizes[0]), pa.schema([("text", pa.string())]))
        return part.set_column(own.get_field_index("text"), "text", text.column(0).take(part.column("text")))

    def flush(keys: list[tuple], held: list[pa.RecordBatch]) -> pa.RecordBatch:
        words = pa.Table.from_batches(held).combine_chunks()
        new = _changes([_codes(pa.chunked_array([pa.array([k[i] for k in keys], out.field(i).type)])) for i in range(len(PAGE))])
        page = np.repeat(np.searchsorted(new, np.arange(len(keys)), side="right") - 1, [b.num_rows for b in held])
        column = lambda c: [words.column(c).is_valid().to_numpy(), pc.fill_null(words.column(c), 0).to_numpy()]  # noqa: E731  nulls come first
        reading = [page, *column("rotation"), *column("psm")]
        line = [*reading, *(x for c in LINE for x in column(c))]
        place = [*line, *column("word_num")][::-1]
        order = np.lexsort(place)
        if len(_changes([c[order] for c in place])) < len(order):  # words of one number go by their texts
            order = np.lexsort([pc.rank(words.column("text").combine_chunks(), tiebreaker="dense").to_numpy(), *place])
        of_line, of_reading = (_changes([c[order] for c in columns]) for columns in (line, reading))
        lines = joined(words.column("text").combine_chunks().take(pa.array(order)), of_line, " ")
        texts = joined(lines, np.searchsorted(of_line, of_reading), "\n")
        first = order[of_reading]
        at = new[page[first]].tolist()
        turned = [words.column(c).combine_chunks().take(pa.array(first)) for c in VARIANT[2:]]
        return pa.RecordBatch.from_arrays([*(pa.array([keys[k][i] for k in at], out.field(i).type) for i in range(len(PAGE))), *turned, texts], schema=out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, n = [], [], 0
        for b in batches:
            for bundle, page, sizes, cell in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n >= HELD and (bundle, page) != keys[-1]:
                    yield flush(keys, held)
                    keys, held, n = [], [], 0
                keys.append((bundle, page))
                held.append(unpacked(sizes, cell))
                n += held[-1].num_rows
        if n:
            yield flush(keys, held)

    return read


def ocr_lines(words: DataFrame) -> DataFrame:
    """One text for each reading of a page: words of a line in order, lines by block, paragraph and line number.

    Words are packed by page where they are, so that a page is shuffled in a few compressed cells and not word by word.
    """
    rest = [*VARIANT[2:], *LINE, "word_num", "text"]
    kept = words.where(F.col("text").rlike(r"(?U)\S") & (F.col("conf") >= 0)).select(*PAGE, *rest)
    own = to_arrow_schema(T.StructType([kept.schema[c] for c in rest]))
    pages = T.StructType([kept.schema[c] for c in PAGE])
    texts = T.StructType([kept.schema[c] for c in VARIANT] + [T.StructField("text", T.StringType())])
    packed = kept.mapInArrow(_packed(own), T.StructType([*pages.fields, T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())]))
    return packed.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(_texts(own, to_arrow_schema(texts)), texts)


def ocr_mean_conf(words: DataFrame) -> DataFrame:
    """Mean confidence of a reading over words of 0 or more, 0 without any."""
    return words.groupBy(*VARIANT).agg(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf").cast("double"))), F.lit(0.0)).alias("conf"))


def ocr_best_variant(words: DataFrame, retry_below: float = RETRY_BELOW) -> DataFrame:
    """bundle_id, page, rotation, psm, conf of the best reading.

    Turned readings count only if no upright one reaches ``retry_below``; equal ones go by rotation 0, 180, 90, 270, then psm.
    """
    conf = ocr_mean_conf(words)
    page = Window.partitionBy("bundle_id", "page")
    upright = F.max(F.when(F.col("rotation") == 0, F.col("conf"))).over(page)
    tried = F.array_position(F.array(*[F.lit(r) for r in (0, 180, 90, 270)]), F.col("rotation"))
    allowed = conf.withColumns({"__up": upright, "__t": tried}).where((F.col("rotation") == 0) | (F.col("__up") < retry_below))
    first = F.row_number().over(page.orderBy(F.desc("conf"), "__t", "psm"))
    return allowed.withColumn("__n", first).where("__n = 1").select(*VARIANT, "conf")


def clean_ocr(c: Column) -> Column:
    """Without lines that are less than half letters, digits and spaces; three or more line ends become two."""
    stripped = lambda x: strip(x)
    good = lambda x: (stripped(x) == "") | (F.regexp_count(stripped(x), F.lit(r"[\p{L}\p{N}\s]")) * 2 >= F.length(stripped(x)))
    return strip(F.regexp_replace(F.array_join(F.filter(F.split(c, "\n"), good), "\n"), r"\n{3,}", "\n\n"))


def table_text(tables: Column) -> Column:
    """Rows of non-blank trimmed cells joined by bars, a row a line; empty rows are left out."""
    rows = F.transform(F.flatten(tables), lambda r: F.array_join(F.filter(F.transform(r, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""), " | "))
    return F.array_join(F.filter(rows, lambda r: r != ""), "\n")


def page_text(native: DataFrame, ocr: DataFrame, min_chars: int = TEXT_MIN) -> DataFrame:
    """bundle_id, page, method, conf, text: native text of enough characters with its tables, else the reading's.

    ``native``: bundle_id, page, text, tables; ``ocr``: bundle_id, page, text, conf.
    """
    own = F.length(strip(F.col("n.text"))) >= min_chars
    tables = table_text(F.col("n.tables"))
    full = F.concat(F.col("n.text"), F.when(tables != "", F.concat(F.lit("\n[TABLE]\n"), tables)).otherwise(F.lit("")))
    return native.alias("n").join(ocr.alias("o"), ["bundle_id", "page"], "left").select(
        "bundle_id", "page", F.when(own, "text").otherwise("ocr").alias("method"), F.when(own, 100.0).otherwise(F.coalesce("o.conf", F.lit(0.0))).alias("conf"),
        F.when(own, full).otherwise(F.coalesce("o.text", F.lit(""))).alias("text"))


def non_text_flag(method: Column, conf: Column, text: Column) -> Column:
    """A read page of low confidence with few letters and digits, which are counted no further than to the limit."""
    enough = rf"\A[^\p{{L}}\p{{N}}]*+(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{{NONTEXT_ALNUM}}}"
    return (method == "ocr") & (conf < NONTEXT_CONF) & ~text.rlike(enough)
