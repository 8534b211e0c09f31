"""Files of an object store as documents."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

PATH = "_metadata.file_path"


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes below ``path``; contents are not read."""
    return spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(path).select("path", "length")


def first_files(spark: SparkSession, path: str, limit: int) -> DataFrame:
    return list_files(spark, path).orderBy("path").limit(limit).select("path")


def _documents(rows: DataFrame, content: Column, kind: str) -> DataFrame:
    return rows.select(
        content.alias("content"),
        F.create_map(F.lit("key"), F.col("_path"), F.lit("format"), F.lit(kind)).alias("metadata"),
        F.col("_path").alias("source_ref"),
    )


def _limited(rows: DataFrame, spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    """``limit`` counts files, not rows."""
    if limit is None:
        return rows
    chosen = first_files(spark, path, limit).withColumnRenamed("path", "_path")
    return rows.join(chosen, "_path", "left_semi")


#: Bytes of CSV files that one task takes, about.
PART_BYTES = 16 << 20

# A CSV field, and the rest of a line that begins inside a quoted one. The loops are possessive, so they neither recurse nor turn back.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_QUOTED}"[^,]*+|(?!")[^,]*+)'
_CLOSED_LINE = rf"^\ufeff?+{_FIELD}(?:,{_FIELD})*+\z"
_CLOSING_LINE = rf'^{_QUOTED}"[^,]*+(?:,{_FIELD})*+\z'


def _csv_values(record: Column) -> Column:
    """The fields of a CSV record; quotes may enclose commas and line breaks, doubled quotes stand for one. A quote inside an unquoted
    field is a letter, and so is what follows a closing quote; a field that is never closed reaches to the end."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf',("{_QUOTED}"?+[^,]*+|[^,]*+)'), 1)
    parts = rf'(?s)^"({_QUOTED})"?+(.*)\z'

    def plain(field: Column) -> Column:
        body = F.replace(F.regexp_extract(field, parts, 1), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(field, F.lit('"')), F.concat(body, F.regexp_extract(field, parts, 2))).otherwise(field)

    return F.transform(fields, plain)


def _csv_lines(spark: SparkSession, path: str, pattern: str, limit: int | None) -> DataFrame:
    """Lines with their place and what they do to the reader: ``_opens``, whether a field is open after the line if none was before it,
    and ``_stays``, the same if one was. A carriage return ends a line too, and stays with it."""
    lines = spark.read.options(recursiveFileLookup="true", pathGlobFilter=pattern, lineSep="\n").text(path)
    lines = lines.select(F.col(PATH).alias("_path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line"), "value")
    pieces = F.when(F.col("value").rlike(r"\r(?!\z)"), F.split("value", r"(?<=\r)(?!\z)")).otherwise(F.array("value"))
    lines = _limited(lines, spark, path, limit).select("_path", "_split", "_line", F.posexplode(pieces).alias("_piece", "value"), F.size(pieces).alias("_pieces"))
    return lines.select(
        "_path",
        "_split",
        F.struct(F.col("_split"), F.col("_line"), F.col("_piece")).alias("_place"),
        "value",
        F.when(F.col("_piece") == F.col("_pieces") - 1, "\n").otherwise("").alias("_end"),
    ).withColumns({"_opens": ~F.col("value").rlike(_CLOSED_LINE), "_stays": ~F.col("value").rlike(_CLOSING_LINE)})


def _state_before(opens: Column, stays: Column, order: WindowSpec) -> Column:
    """Whether a field is open before each row if none was open before the first, and if one was: a struct (closed, opened).

    A row sets the state, keeps it or turns it round. So the state is what the last setting row made it, turned round as often as
    rows have turned it since; sums and a last value tell it, and no row waits for another.
    """
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((opens & ~stays).cast("long")).over(earlier), F.lit(0))
    last = F.last(F.when(opens == stays, F.struct(opens.alias("open"), F.col("_turns").alias("turns"))), ignorenulls=True).over(earlier)

    def state(start: bool) -> Column:
        begin = F.coalesce(last["open"], F.lit(start))
        return begin != ((turns - F.coalesce(last["turns"], F.lit(0))) % 2 == 1)

    return F.struct(state(False).alias("closed"), state(True).alias("opened"))


def _with_state(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """Adds ``_before``; see _state_before."""
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_turns", F.sum((F.col("_opens") & ~F.col("_stays")).cast("long")).over(so_far))
    return rows.withColumn("_before", _state_before(F.col("_opens"), F.col("_stays"), order)).drop("_turns")


def _quoted_records(lines: DataFrame, parts: int) -> DataFrame:
    """Records of files with line breaks inside quotes: _path, _place (of the first line), record. A field that is never closed ends
    with the file, which is taken to end with a line break.

    Every split scans its own lines and says what it does to the state, as a line does. A window over the splits of a file, one row each,
    gives the state at each split's start, and its lines take theirs from it. A record begins at a line before which no field is open. Splits, and then records, are dealt to ``parts``
    tasks, so that a task holds a few splits at most however large the files are.
    """
    within = Window.partitionBy("_path", "_split").orderBy("_place")
    over_splits = Window.partitionBy("_path").orderBy("_split")
    earlier_splits = over_splits.rowsBetween(Window.unboundedPreceding, -1)
    scanned = _with_state(lines.repartition(parts, "_path", "_split"), within)

    def after(state: Column) -> Column:
        return F.when(state, F.col("_stays")).otherwise(F.col("_opens"))

    ends = F.struct(after(F.col("_before.closed")).alias("opens"), after(F.col("_before.opened")).alias("stays"))
    splits = scanned.groupBy("_path", "_split").agg(
        F.max_by(ends, "_place").alias("_ends"),
        F.max(F.when(~F.col("_before.closed"), F.col("_place"))).alias("_last_closed"),
        F.max(F.when(~F.col("_before.opened"), F.col("_place"))).alias("_last_opened"),
    )
    splits = splits.withColumns({"_opens": F.col("_ends.opens"), "_stays": F.col("_ends.stays")})
    splits = _with_state(splits, over_splits).withColumn("_open", F.col("_before.closed"))
    last = F.when(F.col("_open"), F.col("_last_opened")).otherwise(F.col("_last_closed"))
    splits = splits.withColumn("_from", F.last(last, ignorenulls=True).over(earlier_splits))
    known = scanned.join(splits.select("_path", "_split", "_open", "_from"), ["_path", "_split"])
    known = known.withColumn("_inside", F.when(F.col("_open"), F.col("_before.opened")).otherwise(F.col("_before.closed")))
    first = F.last(F.when(~F.col("_inside"), F.col("_place")), ignorenulls=True).over(within)
    named = known.withColumn("_first", F.coalesce(first, F.col("_from")))
    pieces = F.sort_array(F.collect_list(F.struct("_place", F.concat("value", "_end").alias("text"))))
    text, unclosed = F.array_join(pieces["text"], ""), F.max_by(after(F.col("_inside")), "_place")
    named = named.select("_path", "_first", "_place", "value", "_end", "_inside", "_opens", "_stays").repartition(parts, "_path", "_first")
    records = named.groupBy("_path", F.col("_first").alias("_place")).agg(text.alias("record"), unclosed.alias("_unclosed"))
    return records.withColumn("record", F.when(F.col("_unclosed"), F.col("record")).otherwise(_without_end(F.col("record")))).drop("_unclosed")


def _without_end(record: Column) -> Column:
    return F.regexp_replace(record, r"\r?\n?\z", "")


def csv_rows(spark: SparkSession, path: str, *, limit: int | None = None, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Rows (_path, header, values) and headers (_path, header) of CSV files, each by its own first record.

    Files are read as lines and stay splittable. Where a line leaves a quoted field open, the file's splits are scanned for the state at each
    line (see _quoted_records); the lines of all other files are their records. Empty records are passed over, records shorter
    than the header are filled with empty texts, further values are dropped.
    """
    lines = _csv_lines(spark, path, pattern, limit)
    size = list_files(spark, path, pattern).agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, int(size // PART_BYTES) + 1)
    marked = F.broadcast(lines.where("_opens").select("_path").distinct())  # a row per file
    plain = lines.join(marked, "_path", "left_anti").select("_path", "_place", _without_end(F.col("value")).alias("record"))
    records = plain.unionByName(_quoted_records(lines.join(marked, "_path", "left_semi"), parts))
    records = records.where("record <> ''")
    first = records.groupBy("_path").agg(F.min("_place").alias("_first"), F.min_by("record", "_place").alias("_header"))
    headers = first.select("_path", "_first", _csv_values(F.regexp_replace("_header", "^\ufeff", "")).alias("header"))
    rows = records.join(F.broadcast(headers), "_path").where(F.col("_place") > F.col("_first"))
    missing = F.array_repeat(F.lit(""), F.size("header"))
    values = F.slice(F.concat(_csv_values(F.col("record")), missing), 1, F.size("header"))
    return rows.select("_path", "header", values.alias("values")), headers.select("_path", "header")


def csv_documents(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """One JSON document per CSV row, under the names of its file's header."""
    rows, _ = csv_rows(spark, path, limit=limit)

    def quoted(text: Column) -> Column:
        listed = F.to_json(F.array(text))
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    pairs = F.zip_with("header", "values", lambda name, value: F.concat(quoted(name), F.lit(":"), quoted(value)))
    return _documents(rows, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), "csv")


def csv_file_summary(spark: SparkSession, path: str) -> DataFrame:
    """Header and number of rows per CSV file."""
    rows, headers = csv_rows(spark, path)
    counts = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("rows"))
    return headers.join(counts, "_path", "left").select(
        F.col("_path").alias("source_ref"), F.array_join("header", ",").alias("headers"), F.coalesce("rows", F.lit(0).cast("long")).alias("row_count")
    )


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as plain comma-joined text, one document per row; the header is in the summary."""
    rows, _ = csv_rows(spark, path)
    return _documents(rows, F.array_join("values", ","), "csv")


def _whole_files(spark: SparkSession, path: str, limit: int | None, **options: str) -> DataFrame:
    texts = spark.read.options(recursiveFileLookup="true", **options).text(path, wholetext=True)
    return _limited(texts.withColumn("_path", F.col(PATH)), spark, path, limit)


def json_items(rows: DataFrame, content: str = "value") -> DataFrame:
    """One row per item of JSON texts: the elements of a list, else the text's one value. Text that
    is no JSON comes through unchanged, with format ``text``."""
    parsed = rows.withColumn("_json", F.try_parse_json(content))
    is_list = F.startswith(F.schema_of_variant("_json"), F.lit("ARRAY"))
    elements = F.when(is_list, F.variant_get("_json", "$", "array<variant>")).otherwise(F.array("_json"))
    listed = parsed.withColumn("_item", F.explode(elements))
    return listed.select(
        *[c for c in rows.columns if c != content],
        F.when(F.col("_json").isNull(), F.col(content)).otherwise(F.to_json("_item")).alias("content"),
        F.when(F.col("_json").isNull(), "text").otherwise("json").alias("format"),
    )


def json_documents(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    items = json_items(_whole_files(spark, path, limit, pathGlobFilter="*.json"))
    return items.select(
        "content",
        F.create_map(F.lit("key"), F.col("_path"), F.lit("format"), F.col("format")).alias("metadata"),
        F.col("_path").alias("source_ref"),
    )


def text_documents(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """Files that are neither CSV nor JSON, each as one document."""
    texts = _whole_files(spark, path, limit)
    return _documents(texts.where(~extension(F.col("_path")).isin("csv", "json")), F.col("value"), "text")


def object_documents(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """All files below ``path``, each kind in its own way."""
    kinds = list_files(spark, path).select(extension(F.col("path")).alias("kind"))
    has = {kind: not kinds.where(F.col("kind") == kind).isEmpty() for kind in ("csv", "json")}
    result = text_documents(spark, path, limit=limit)
    if has["csv"]:
        result = result.unionByName(csv_documents(spark, path, limit=limit))
    if has["json"]:
        result = result.unionByName(json_documents(spark, path, limit=limit))
    return result


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_INLINE = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}


def _paragraphs(content: bytes) -> list[str]:
    """Texts of the body's paragraphs, runs and linked runs alike."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    texts = []
    for paragraph in body.findall(f"{_WORD}p"):
        parts = []
        for run in paragraph.iter(f"{_WORD}r"):
            for child in run:
                parts.append((child.text or "") if child.tag == f"{_WORD}t" else _INLINE.get(child.tag, ""))
        texts.append("".join(parts))
    return texts


@F.pandas_udf(
    T.StructType([T.StructField("content", T.StringType()), T.StructField("paragraph_count", T.IntegerType())])
)
def docx_text(files: pd.Series) -> pd.DataFrame:
    paragraphs = files.map(_paragraphs)
    return pd.DataFrame({"content": paragraphs.map("\n".join), "paragraph_count": paragraphs.map(len)})


def docx_documents(files: DataFrame) -> DataFrame:
    """Word files (path, content as ``binaryFile`` gives them) as documents."""
    read = files.withColumn("_text", docx_text("content"))
    return read.select(
        F.col("_text.content").alias("content"),
        F.create_map(F.lit("paragraph_count"), F.col("_text.paragraph_count").cast("string")).alias("metadata"),
        F.col("path").alias("source_ref"),
    )


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return docx_documents(files)
