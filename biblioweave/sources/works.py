"""Readers for work records: line files, array files, archives, API pages.

Every reader returns one row per record with the raw ``json`` text, the flag
``invalid`` for text that is no JSON object, the typed fields, and ``seq``: the
place of the record (file, part of the file, line), by which later records win.
"""

from __future__ import annotations

import codecs
import gzip
import json
import lzma
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions.dates import YEAR_SOURCES, year_of_date_parts
from biblioweave.functions.text import not_blank
from biblioweave.schemas import WORK_JSON

# How the first two lines of an array file start.
ARRAY_FIRST_LINE = '{"items":['
ARRAY_SECOND_LINES = ('"items": [', '"items" : [')

RECORD_FILES = (".gz", ".xz", ".json")
LINES_PER_BATCH = 2000
HEAD_BYTES = 256


def _titles(c: Column) -> Column:
    """Title member as an array, whether it was text or an array."""
    many = F.from_json(c, "array<string>")
    return F.when(c.startswith("[") & many.isNotNull(), many).otherwise(
        F.when(c.isNotNull(), F.array(c))
    )


def parse_works(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed fields of the work records in a text column."""
    work = F.from_json(
        F.col(column), WORK_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    place = ["seq"] if "seq" in lines.columns else []
    parsed = lines.filter(not_blank(F.col(column))).select(
        F.col(column).alias("json"), work.alias("w"), *place
    )
    year = F.coalesce(*[year_of_date_parts(F.col("w")[name]) for name in YEAR_SOURCES])
    return parsed.select(
        "json",
        (F.col("w._bad").isNotNull() | ~F.ltrim("json").startswith("{")).alias("invalid"),
        F.col("w.DOI").alias("doi"),
        F.col("w.halId").alias("hal_id"),
        F.col("w.source").alias("source"),
        F.col("w.type").alias("type"),
        _titles(F.col("w.title")).alias("title"),
        F.col("w.author").alias("author"),
        F.col("w")["container-title"].alias("container_title"),
        F.col("w")["short-container-title"].alias("short_container_title"),
        F.col("w.publisher").alias("publisher"),
        F.col("w.volume").alias("volume"),
        F.col("w.issue").alias("issue"),
        F.col("w.page").alias("page"),
        year.alias("year"),
        F.try_to_timestamp(F.col("w.indexed")["date-time"]).alias("indexed_ts"),
        *place,
    )


def place_of(part: Column, line: Column) -> Column:
    """``seq`` of a row of a file source: file, part and line, in reading order."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        part.cast("long").alias("part"),
        line.cast("long").alias("line"),
    ).alias("seq")


def line_place() -> Column:
    """``seq`` of a line: splits of a file are told apart by where they begin, and
    within a split, which one task reads, the row ids increase."""
    return place_of(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_works_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One record per line, plain or gzip."""
    return parse_works(spark.read.text(path).select("value", line_place()))


API_PAGE = "message struct<`next-cursor`:string,items:array<string>>"


def _whole_objects(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Each file, plain or gzip, as one JSON object, nested objects as the text they are.

    A file is one record that ends with a NUL, which no JSON has, so its bytes are parsed
    from memory: the multi-line reader goes back to the file for every nested object.
    """
    return spark.read.schema(schema).option("lineSep", "\u0000").json(path)


def read_works_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that are one object with an ``items`` array."""
    items = _whole_objects(spark, path, "items array<string>").select(
        place_of(F.lit(0), F.lit(0)).alias("file"), F.posexplode("items").alias("line", "value")
    )
    return parse_works(_placed_items(items))


def _placed_items(items: DataFrame) -> DataFrame:
    """The position in the array becomes the line of ``seq``."""
    return items.select("value", F.col("file").withField("line", F.col("line").cast("long")).alias("seq"))


def read_api_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed pages of the update API: ``message.items`` of each file."""
    items = _whole_objects(spark, path, API_PAGE).select(
        place_of(F.lit(0), F.lit(0)).alias("file"),
        F.posexplode("message.items").alias("line", "value"),
    )
    return parse_works(_placed_items(items))


def page_cursors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per ``message.next-cursor`` of landed update pages: how many pages and items
    have it, their files in order, and whether it is repeated.

    A chain of pages has each cursor once; a repeated one was landed twice or did not go on.
    """
    message = F.col("message")
    pages = _whole_objects(spark, path, API_PAGE).select(
        message["next-cursor"].alias("next_cursor"), F.coalesce(F.size(message["items"]), F.lit(0)).alias("items"),
        F.col("_metadata.file_path").alias("file"),
    )
    return pages.groupBy("next_cursor").agg(
        F.count("*").alias("pages"), F.sum("items").alias("items"), F.sort_array(F.collect_list("file")).alias("files"),
        (F.count("*") > 1).alias("repeated"),
    )


def _open(path: str):
    """Byte stream of a file on any file system the workers can reach."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[len("file:"):]
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


def _decoded(path: str):
    stream = _open(path)
    lowered = path.lower()
    if lowered.endswith(".xz"):
        return lzma.open(stream)
    if lowered.endswith(".gz"):
        return gzip.open(stream)
    return stream


def is_array_text(first: str, second: str) -> bool:
    """True when the first two lines are those of an array file, white space in the first aside."""
    return "".join(first.split()).startswith(ARRAY_FIRST_LINE) or second.strip().startswith(ARRAY_SECOND_LINES)


def first_two_lines(stream) -> tuple[str, str, bytes]:
    """How the first two lines start (HEAD_BYTES each), and all that was read for it.

    A file of one long line is not read further than that line's start if this
    already tells an array.
    """
    head = b""
    while True:
        line_end = head.find(b"\n")
        first = head[:HEAD_BYTES].split(b"\n")[0].decode("utf-8", "replace")
        second = head[line_end + 1 :] if line_end >= 0 else b""
        settled = b"\n" in second or len(second.lstrip()) >= HEAD_BYTES
        if settled or len(head) >= HEAD_BYTES and is_array_text(first, ""):
            break
        chunk = stream.read(1 << 20)
        if not chunk:
            break
        head += chunk
    return first, second.lstrip()[:HEAD_BYTES].split(b"\n")[0].decode("utf-8", "replace"), head


def _formats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            lowered = path.lower()
            if lowered.endswith((".tar.gz", ".xz")):
                rows.append((path, "packed"))
                continue
            with _decoded(path) as stream:
                first, second, _ = first_two_lines(stream)
            rows.append((path, "array" if is_array_text(first, second) else "lines"))
        yield pd.DataFrame(rows, columns=["path", "format"])


def detect_works_format(spark: SparkSession, path: str) -> DataFrame:
    """``(path, format)`` per record file: ``lines``, ``array`` or ``packed``.

    Only the first two lines of each file are read, on the executors.
    """
    files = (
        spark.read.format("binaryFile").load(path).select("path")
        .filter(F.lower("path").rlike(r"\.(gz|xz|json)$"))
    )
    return files.mapInPandas(_formats, "path string, format string")


class _Text:
    """Text of a stream, read on demand; what is done with is dropped."""

    def __init__(self, head: bytes, stream):
        self.stream, self.decode = stream, codecs.getincrementaldecoder("utf-8")("replace").decode
        self.text, self.at, self.ended = self.decode(head), 0, False

    def more(self) -> bool:
        chunk = self.stream.read(1 << 20)
        self.ended = not chunk
        self.text, self.at = self.text[self.at :] + self.decode(chunk, not chunk), 0
        return bool(chunk)

    def peek(self) -> str:
        """The next character that is no white space, "" at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at].isspace():
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def value(self):
        """The next JSON value; a number is complete only with what follows it."""
        self.peek()
        while True:
            try:
                found, end = json.JSONDecoder().raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    self.at = end
                    return found
            except ValueError:
                if self.ended:
                    raise
            self.more()


def _array_items(text: _Text) -> Iterator[str]:
    """Elements of the top-level ``items`` array of one object, read one by one."""
    if text.peek() == "{":
        text.at += 1
    while text.peek() not in ("", "}"):
        name = text.value()
        if text.peek() == ":":
            text.at += 1
        if name == "items" and text.peek() == "[":
            text.at += 1
            while text.peek() not in ("", "]"):
                yield json.dumps(text.value(), ensure_ascii=False)
                if text.peek() == ",":
                    text.at += 1
            text.at += 1
        else:
            text.value()
        if text.peek() == ",":
            text.at += 1


def _member_lines(stream) -> Iterator[str]:
    first, second, head = first_two_lines(stream)
    if is_array_text(first, second):
        yield from _array_items(_Text(head, stream))
        return
    rest = head
    while True:
        *lines, rest = rest.split(b"\n")
        for line in lines:
            yield line.decode("utf-8", "replace")
        chunk = stream.read(1 << 20)
        if not chunk:
            break
        rest += chunk
    if rest:
        yield rest.decode("utf-8", "replace")


def _packed_lines(path: str) -> Iterator[str]:
    if path.lower().endswith(".tar.gz"):
        with tarfile.open(fileobj=_open(path), mode="r|gz") as archive:
            for member in archive:
                if member.isfile() and member.name.lower().endswith(RECORD_FILES):
                    data = archive.extractfile(member)
                    name = member.name.lower()
                    if name.endswith(".gz"):
                        data = gzip.open(data)
                    elif name.endswith(".xz"):
                        data = lzma.open(data)
                    yield from _member_lines(data)
    else:
        with _decoded(path) as stream:
            yield from _member_lines(stream)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            lines: list[str] = []
            done = 0
            for line in _packed_lines(path):
                lines.append(line)
                if len(lines) == LINES_PER_BATCH:
                    yield _numbered(path, lines, done)
                    done, lines = done + len(lines), []
            if lines:
                yield _numbered(path, lines, done)


def _numbered(path: str, lines: list[str], before: int) -> pd.DataFrame:
    return pd.DataFrame({"value": lines, "file": path, "line": range(before, before + len(lines))})


def read_works_packed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of ``.xz`` files and ``.tar.gz`` archives.

    These streams cannot be split, so one file is decoded by one task in small
    batches and the lines are spread out before they are parsed.  Array files
    within them are read element by element.
    """
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    lines = files.mapInPandas(_unpack, "value string, file string, line long")
    placed = lines.repartition(F.xxhash64("value", "line")).select(
        "value", F.struct("file", F.lit(0).cast("long").alias("part"), "line").alias("seq")
    )
    return parse_works(placed)


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """A record file, or all record files of a directory, in any known format."""
    found = {"lines": [], "array": [], "packed": []}
    # one short row per input file: the list Spark's own file listing keeps too
    for row in detect_works_format(spark, path).toLocalIterator():
        found[row["format"]].append(row["path"])
    readers = {
        "lines": read_works_jsonl, "array": read_works_array, "packed": read_works_packed,
    }
    parts = [readers[kind](spark, sorted(paths)) for kind, paths in found.items() if paths]
    if not parts:
        return parse_works(
            spark.createDataFrame([], "value string, seq struct<file:string,part:long,line:long>")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
