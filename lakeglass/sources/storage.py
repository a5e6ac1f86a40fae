"""Files: a text file's encoding and delimiter, CSV and XLSX scans, frames as Parquet, versions with a manifest.

Paths go to Spark's own readers, so any store that Spark knows will do. The driver reads no more than the head of a text file.
"""

from __future__ import annotations

import atexit
import csv
import io
import json
import math
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import NUMBER_SHAPE
from ..plans.requests import need

# Encodings in the order in which they are tried, delimiters, and the texts that count as missing.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
HEAD = 64 * 1024
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Rows of a sheet that go from a task to Spark at a time.
SHEET_BATCH = 5000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Only a local session that names none gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="lakeglass-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = "file://" + made
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/frames/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def detect_encoding(data: bytes) -> str:
    """The first encoding that decodes the head of a file; a character cut off at its end does not count against one."""
    for name in ENCODINGS:
        if name == "utf-8-sig" and not data.startswith(b"\xef\xbb\xbf"):
            continue
        try:
            data.decode(name)
        except UnicodeDecodeError as e:
            if not (name.startswith("utf-8") and len(data) >= HEAD and e.start >= len(data) - 4):
                continue
        return name
    return ENCODINGS[-1]


def detect_delimiter(text: str) -> str:
    """The delimiter by the shape of the first lines; a comma if none stands out."""
    need(text.strip(), "the file is empty")
    try:
        return csv.Sniffer().sniff(text[:8192], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def null_missing(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*MISSING), c)


def typed(df: DataFrame) -> DataFrame:
    """Text columns as bigint, double or boolean where all their values are; one pass decides for all columns."""
    names = [c for c, kind in df.dtypes if kind == "string"]
    if not names:
        return df
    tests = []
    for i, c in enumerate(names):
        v = F.trim(F.col(f"`{c}`"))
        tests += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(r"^[-+]?\d{1,18}$")).alias(f"i{i}"), F.count_if(v.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")).alias(f"d{i}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}")]
    r = df.agg(*tests).first()
    made = {}
    for i, c in enumerate(names):
        kind = next((k for k, t in (("i", "bigint"), ("d", "double"), ("b", "boolean")) if r[f"n{i}"] and r[f"{k}{i}"] == r[f"n{i}"]), None)
        if kind:
            made[c] = F.trim(F.col(f"`{c}`")).try_cast({"i": "bigint", "d": "double", "b": "boolean"}[kind])
    return df.withColumns(made) if made else df


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some line leaves a quote open, by a scan of all of them."""
    return not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()


def quoted_records(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """record (text) and head (whether it is its file's first) of CSV files with newlines in quotes, read by as many tasks as there are splits.

    Whether a line begins inside quotes depends on how many there are before it, in its split and in all before. Splits give the parity of their own; a prefix over
    these, a row each, gives the parity at which each begins. From there each split finds its lines' records. Only records of several lines are
    brought together. Line ends in quotes come back as newlines. A file that ends inside quotes is refused.
    """
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), F.lit(charset))
    lines = written(spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")))
    lines = lines.withColumn("odd", F.regexp_count("value", F.lit('"')) % 2)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"))
    need(splits.groupBy("file").agg((F.sum("odd") % 2).alias("left")).where("left = 1").isEmpty(), "a quote is never closed")
    starts = splits.select("file", "block", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("inside"))
    own = Window.partitionBy("file", "block").orderBy("seq")  # the lines of one split
    at = lines.join(starts, ["file", "block"])
    at = at.withColumn("inside", (F.col("inside") + F.coalesce(F.sum("odd").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2)
    at = at.withColumn("first", F.when(F.col("inside") == 0, F.col("seq"))).withColumn("head", (F.col("block") == 0) & (F.row_number().over(own) == 1))
    at = at.withColumn("record", F.last("first", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    alone = (F.col("inside") == 0) & (F.col("odd") == 0)
    # what a split begins with, inside quotes, belongs to the last record that began before
    last = at.groupBy("file", "block").agg(F.max("first").alias("last"))
    carried = last.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    rest = at.where(~alone).join(carried, ["file", "block"]).withColumn("record", F.coalesce("record", "carried"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq", "value"))), lambda x: x["value"]), "\n")
    whole = rest.groupBy("file", "record").agg(text.alias("text"), F.max("head").alias("head"))
    return at.where(alone).select(F.col("value").alias("text"), "head").unionByName(whole.select("text", "head"))


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    """A CSV file with header: encoding and delimiter are found out, missing-value texts are null, types are those of all rows.

    Newlines in quotes do not keep a file from being split (see quoted_records); multi_line says whether there are any, None: find out.
    """
    data = head(spark, path)
    name = detect_encoding(data)
    text = data.decode(name, "replace")
    sep = detect_delimiter(text)
    # Spark reads no cp1252: it is read as latin-1, and the bytes that differ are put right afterwards
    charset = "UTF-8" if name.startswith("utf-8") else "ISO-8859-1"
    if has_quoted_newlines(spark, path) if multi_line is None else multi_line:
        names = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        records = quoted_records(spark, path, charset).where("NOT head AND text != ''")
        df = records.select(F.from_csv("text", schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*").toDF(*(names if len(set(names)) == len(names) else [f"{n}{i}" for i, n in enumerate(names)]))
    else:
        df = spark.read.csv(path, header=True, sep=sep, encoding=charset, escape='"', mode="PERMISSIVE", enforceSchema=True)
    need(df.columns, "the file has no columns")
    clean = [c.lstrip("﻿").strip() or f"column_{i + 1}" for i, c in enumerate(df.columns)]
    other = bytes(b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
    fix = (lambda c: F.translate(c, other.decode("latin-1"), other.decode("cp1252"))) if name == "cp1252" else (lambda c: c)
    df = df.toDF(*clean).select(*(null_missing(fix(F.col(f"`{c}`"))).alias(c) for c in clean))
    return typed(df) if infer else df


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes) -> Iterator[list[Any]]:
    """The rows of a workbook's first sheet, one after the other: the sheet is never held as a whole."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if item.tag == f"{_NS}si":
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
                item.clear()
    dated: set[int] = set()
    if "xl/styles.xml" in book.namelist():
        styles = ElementTree.fromstring(book.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")}
        for i, x in enumerate(styles.findall(f"{_NS}cellXfs/{_NS}xf")):
            code = int(x.get("numFmtId", 0))
            if 14 <= code <= 22 or re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(code, "")), re.I):
                dated.add(i)
    sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    need(sheets, "the workbook has no sheet")

    def value_of(c: ElementTree.Element) -> Any:
        value, kind = c.find(f"{_NS}v"), c.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
        if value is None or value.text is None or kind == "e":
            return None
        if kind in ("s", "str", "b"):
            return {"s": lambda x: shared[int(x)], "str": str, "b": lambda x: x == "1"}[kind](value.text)
        number = float(value.text)
        return datetime(1899, 12, 30) + timedelta(days=number) if int(c.get("s", 0)) in dated else number

    held: ElementTree.Element | None = None
    for event, row in ElementTree.iterparse(book.open(sheets[0]), ("start", "end")):
        if row.tag == f"{_NS}sheetData":
            held = row
        if event == "start" or row.tag != f"{_NS}row":
            continue
        cells: dict[int, Any] = {}
        for c in row.findall(f"{_NS}c"):
            at = 0
            for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                at = at * 26 + ord(ch) - 64
            cells[(at or len(cells) + 1) - 1] = value_of(c)
        if held is not None:
            held.clear()  # rows that were read
        yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


_UNREADABLE = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError)


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each workbook a row for each column: its name and the kinds of its values; or one row with what is wrong."""
    for batch in batches:
        for content in batch.column(0):
            try:
                rows = sheet_rows(content.as_py())
                header = next(rows, [])
                need(any(x is not None for x in header), "the sheet has no header")
                kinds: list[set[str]] = [set() for _ in header]
                for r in rows:
                    for i, x in enumerate(r[: len(header)]):
                        if x is not None:
                            kinds[i].add("whole" if isinstance(x, float) and x.is_integer() else type(x).__name__)
                made = [(i, str(x) if x is not None else f"column_{i + 1}", sorted(k), None) for i, (x, k) in enumerate(zip(header, kinds, strict=True))]
            except _UNREADABLE as e:
                made = [(-1, None, [], f"the workbook cannot be read: {e}")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()), strict=True)], names=["i", "name", "kinds", "wrong"])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of one or more workbooks (a file, a folder or a pattern), which have one header.

    A workbook is a compressed stream, so one task reads it, row by row; several are read in parallel. The driver sees names and kinds of columns only. Types
    are those of all rows of all workbooks: a column of whole numbers is bigint, of mixed kinds text.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(_survey, "i int, name string, kinds array<string>, wrong string").distinct().collect()  # a row a column and kind of workbook
    for r in found:
        need(r["wrong"] is None, r["wrong"])
    names: dict[int, str] = {}
    kinds: dict[int, set[str]] = {}
    for r in sorted(found, key=lambda r: (r["i"], r["name"])):
        need(names.setdefault(r["i"], r["name"]) == r["name"], "the workbooks have different headers")
        kinds.setdefault(r["i"], set()).update(r["kinds"])
    need(names, "there is no workbook")

    def type_of(k: set[str]) -> T.DataType:
        one = {frozenset({"whole"}): T.LongType(), frozenset({"float"}): T.DoubleType(), frozenset({"whole", "float"}): T.DoubleType(), frozenset({"bool"}): T.BooleanType(), frozenset({"datetime"}): T.TimestampType()}
        return one.get(frozenset(k), T.StringType())

    fields = [T.StructField(names[i], type_of(kinds[i])) for i in sorted(names)]
    plain = [f.dataType.simpleString() for f in fields]
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC"), "string": pa.string()}
    as_kind = {"bigint": int, "double": float, "boolean": bool, "timestamp": lambda x: x, "string": str}

    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[list[Any]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([None if r[i] is None else as_kind[k](r[i]) for r in rows], arrow[k]) for i, k in enumerate(plain)], names=[f.name for f in fields])

        for batch in batches:
            for content in batch.column(0):
                rows, held = sheet_rows(content.as_py()), []
                next(rows, None)
                for r in rows:
                    held.append((r + [None] * len(plain))[: len(plain)])
                    if len(held) == SHEET_BATCH:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    return files.mapInArrow(body, T.StructType(fields))


def write_xlsx(sheets: dict[str, list[list[Any]]]) -> bytes:
    """A workbook of small tables, a sheet each, rows of texts and numbers. Texts are inline and never run as formulas."""

    def cell(x: Any) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, bool):
            return f'<c t="b"><v>{int(x)}</v></c>'
        if isinstance(x, int | float) and math.isfinite(x):
            return f"<c><v>{x!r}</v></c>"
        text = "".join(ch for ch in str(x) if ch in "\t\n\r" or ch >= " ")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    main, office, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    names: list[str] = []
    for name in sheets:
        short = (re.sub(r"[\[\]:*?/\\]", " ", name).strip("' ") or "Sheet")[:28]
        names.append(short if short not in names else f"{short}_{len(names)}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """A frame by the ending of its path: .csv, .xlsx, otherwise Parquet."""
    lower = path.lower()
    return read_csv(spark, path) if lower.endswith(".csv") else read_xlsx(spark, path) if lower.endswith(".xlsx") else spark.read.parquet(path)


def metadata(df: DataFrame) -> dict[str, Any]:
    """row_count, column_count and for each column name, type (of five) and nullable."""

    def kind(t: str) -> str:
        if t in ("tinyint", "smallint", "int", "bigint"):
            return "integer"
        if t in ("float", "double") or t.startswith("decimal"):
            return "float"
        return {"boolean": "boolean", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}.get(t, "string")

    r = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns))).first()
    columns = [{"name": c, "type": kind(t), "nullable": r[f"n{i}"] > 0} for i, (c, t) in enumerate(df.dtypes)]
    return {"row_count": r["n"], "column_count": len(columns), "columns": columns}


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").csv(path, header=True)


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A path and its file system, as Hadoop has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file, whole, unless it is there: of several writers exactly one gets True.

    The text goes to a file of its own first. On a local disk a hard link gives it its name, elsewhere a rename that does not overwrite; both are one
    step that fails if the name is taken. (A store whose rename is a copy gives no such promise.)
    """
    where, fs = _hadoop(spark, path)
    made, _ = _hadoop(spark, f"{where.getParent().toString()}/_{uuid.uuid4().hex}")
    out = fs.create(made)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(made.toUri().getPath(), where.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(made, where, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(where):
                return False
            raise
        return True
    finally:
        fs.delete(made, False)


def read_lines(spark: SparkSession, folder: str) -> list[dict[str, Any]]:
    """The JSON objects in a folder's files, one a line; none if there is no folder. For small bookkeeping only."""
    where, fs = _hadoop(spark, folder)
    return [json.loads(r["value"]) for r in spark.read.text(folder).collect()] if fs.exists(where) else []


class Versions:
    """Immutable versions of a dataset: Parquet in <root>/versions/<unique name>, and for each number a manifest with lineage and operations.

    Writers do not wait for each other. Data comes first, under a name of its own; the version exists from the moment its manifest does, and a number goes to the first who
    commits it. The others take the next.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def list(self) -> list[dict[str, Any]]:
        return sorted(read_lines(self.spark, f"{self.root}/manifest"), key=lambda r: r["version"])  # a line for each version

    def add(self, df: DataFrame, operations: list[dict[str, Any]], source: int | None = None) -> int:
        """Write a frame as a new version, and say which it became."""
        need(source is None or any(r["version"] == source for r in self.list()), f"there is no version {source}")
        name = uuid.uuid4().hex
        df.write.mode("error").parquet(f"{self.root}/versions/{name}")
        row = {"source": source, "operations": operations, "schema": json.loads(df.schema.json()), "data": name}
        number = max((r["version"] for r in self.list()), default=0)
        while True:
            number += 1
            if commit_once(self.spark, f"{self.root}/manifest/{number:08d}.json", json.dumps({"version": number} | row) + "\n"):
                return number

    def get(self, number: int | None = None) -> dict[str, Any]:
        """The manifest of a version, of the latest if no number is given."""
        known = {r["version"]: r for r in self.list()}
        need(known, "there is no version yet")
        wanted = max(known) if number is None else number
        need(wanted in known, f"there is no version {wanted}")
        return known[wanted]

    def read(self, number: int | None = None) -> DataFrame:
        row = self.get(number)
        return self.spark.read.parquet(f"{self.root}/versions/{row.get('data', row['version'])}")

    def lineage(self, number: int | None = None) -> list[int]:
        """A version's number, that of its source, and so on back to the first."""
        row, out = self.get(number), []
        while True:
            out.append(row["version"])
            if row["source"] is None:
                return out
            row = self.get(row["source"])


class Datasets:
    """Datasets by name under one folder: where each was uploaded, and its versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str) -> str:
        need(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name), f"{name!r} is no name of a dataset")
        return f"{self.root}/{name}"

    def register(self, name: str, path: str) -> None:
        """Name an uploaded file or folder; a name is given once."""
        taken = not commit_once(self.spark, f"{self._folder(name)}/source/source.json", json.dumps({"path": path}) + "\n")
        need(not taken, f"there is a dataset {name!r} already")

    def versions(self, name: str) -> Versions:
        return Versions(self.spark, self._folder(name))

    def resolve(self, name: str, version: int | None = None) -> tuple[DataFrame, dict[str, Any] | None]:
        """The upload's frame and None, or that of one of its versions and its manifest."""
        source = read_lines(self.spark, f"{self._folder(name)}/source")
        need(source, f"there is no dataset {name!r}")
        if version is None:
            return read_frame(self.spark, source[0]["path"]), None
        held = self.versions(name)
        return held.read(version), held.get(version)


__all__ = ["NUMBER_SHAPE", "Datasets", "Versions", "commit_once", "detect_delimiter", "detect_encoding", "export_csv", "metadata", "read_csv", "read_frame", "read_lines", "read_xlsx", "shared_dir", "write_xlsx", "written"]
