"""Reading and writing: delimited text, Parquet, ORC, JSON, .dta, workbooks.

Text is read as text first; a column is a number only if every cell is one, so nothing is
lost to early guesses. A workbook or .dta file cannot be split: each is parsed by the task that
reads it, never on the driver, so a folder of them is read by as many tasks as there are files;
a .dta table is written as a folder of files of at most ``DTA_ROWS`` rows.
"""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.operators.prep import DataError, label

#: Files up to which a list of them, one short row each, is broadcast.
MAX_FILES = 100_000
#: Rows of one written .dta file; a task holds that many at once.
DTA_ROWS = 500_000
#: Rows handed on at once by the task that parses a file.
CHUNK = 10_000
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def legal_names(header: list[str | None], case: str = "lower", letters: bool = False) -> list[str]:
    """Names from a header: illegal characters dropped, case applied; empty, digit-first and repeated names become v<position> (or the column letter)."""
    out: list[str] = []
    for i, h in enumerate(header):
        n = re.sub(r"[^A-Za-z0-9_]", "", h or "")[:32]
        n = n.lower() if case == "lower" else n.upper() if case == "upper" else n
        if not n or n[0].isdigit() or n in out:
            n = column_letter(i) if letters else f"v{i + 1}"
        while n in out:
            n += "_2"
        out.append(n)
    return out


def column_letter(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def typed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns whose filled cells are all numbers become double; '.' and empty cells are missing there."""
    columns = columns or df.columns
    blank = lambda c: F.coalesce(F.btrim(F.col(f"`{c}`")), F.lit("")).isin("", ".")
    bad = df.agg(*[F.count_if(~blank(c) & ~F.btrim(F.col(f"`{c}`")).rlike(NUMBER)).alias(c) for c in columns]).first().asDict()
    new = {c: F.when(~blank(c), F.btrim(F.col(f"`{c}`")).try_cast("double")) if not bad[c] else F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns}
    return df.withColumns(new)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, case: str = "lower", rows: tuple[int, int | None] | None = None, cols: tuple[int, int | None] | None = None, infer: bool = True, multiline: bool | None = None) -> DataFrame:
    """RFC 4180 text; ``rows`` and ``cols`` cut a 1-based rectangle of every file, whose first row is the header.

    Lines are read as they stand, blank ones included, and numbered within their file; cells
    are split after the cut, so no line above it decides the number of columns. Of several
    files each gives up its own header; the names are those of the first file, and cells beyond
    them become v<position>. Files are split among tasks, unless a line with an odd number of
    quotes shows (or ``multiline`` says) that quoted cells hold line breaks: then a file is one
    task, and of at most 2 GB.
    """
    lo, hi = rows or (1, None)
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = not spark.read.option("lineSep", "\n").text(path).filter(quotes % 2 == 1).isEmpty()
    lines = _records(spark, path, multiline)
    if rows is None and not multiline:  # no line is lost to the cut, so the header is the first line of each file and needs no numbers
        lines = lines.withColumn("n", F.when(F.col("start"), 1).otherwise(2))
    else:
        lines = lines if multiline else _numbered(lines)
    lines = lines.filter(F.col("n") >= lo)
    if hi is not None:
        lines = lines.filter(F.col("n") <= hi)
    d = re.escape(delimiter)
    cell = rf'{d}((?:"[^"]*+(?:""[^"]*+)*+"|[^"{d}])*+)'
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), "line"), F.lit(cell), F.lit(1))
    inner = lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    table = lines.select("file", "n", F.transform(raw, inner).alias("cells")).filter((F.size("cells") > 1) | (F.get("cells", F.lit(0)) != ""))
    if cols:
        first, last = cols
        table = table.withColumn("cells", F.slice("cells", F.lit(first), F.greatest(F.lit(0), F.size("cells") - (first - 1)) if last is None else F.lit(last - first + 1)))
    head = table.filter(F.col("n") == lo).orderBy("file").first() if header else None
    body = table.filter(F.col("n") > lo) if header else table
    width = max(body.agg(F.max(F.size("cells"))).first()[0] or 0, len(head["cells"]) if head else 0)
    cells = (list(head["cells"]) if head else []) + [None] * width
    names = legal_names(cells[:width], case) if header else [f"v{i + 1}" for i in range(width)]
    raw = body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]) if width else body.select()
    return typed(raw) if infer and width else raw


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with n, their number in their file from 1: counted within each split, after the lines of the splits before it."""
    lines = lines.withColumn("block", F.col("at.block"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("m"))  # one row per split
    before = sizes.select("file", "block", (F.sum("m").over(W.partitionBy("file").orderBy("block")) - F.col("m")).alias("before"))
    return lines.join(before, ["file", "block"]).withColumn("n", F.col("before") + F.row_number().over(W.partitionBy("file", "block").orderBy("at")))


def _records(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """(file, at, start, line) of lines, at ascending within a file and start marking its first; with ``multiline`` (file, n, line) of records, a line break inside quotes not ending one."""
    if not multiline:
        # one partition per file split; the place of a line is its split's start and its order there
        t = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
        t = t.withColumn("at", F.struct("block", "id"))
        first = t.groupBy("file").agg(F.min("at").alias("first"))
        t = t.join(F.broadcast(first) if first.limit(MAX_FILES + 1).count() <= MAX_FILES else first, "file").withColumn("start", F.col("at") == F.col("first"))
        return t.select("file", "at", "start", F.when(F.col("start"), F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line")).alias("line"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held, open_, n, out = [], False, 0, []
                for line in io.TextIOWrapper(io.BytesIO(data.as_buffer()), "utf-8-sig", newline="\n"):
                    held.append(line)
                    open_ ^= line.count('"') % 2 == 1
                    if not open_:
                        n += 1
                        out.append((file, n, "".join(held).removesuffix("\n").removesuffix("\r")))
                        held = []
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "n", "line"])
                        out = []
                if held:
                    out.append((file, n + 1, "".join(held)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "n", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "file string, n bigint, line string")


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", replace: bool = False) -> None:
    """Full precision, RFC 4180 quotes, one file per partition."""
    df.write.mode("overwrite" if replace else "errorifexists").csv(path, sep=delimiter, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def use(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Reads by extension: .parquet .orc .json .csv .tsv .txt .dta .xlsx .ods; columns and filter reach the scan."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    readers = {".parquet": spark.read.parquet, ".orc": spark.read.orc, ".json": spark.read.json, ".csv": lambda p: read_delimited(spark, p), ".tsv": lambda p: read_delimited(spark, p, "\t"), ".txt": lambda p: read_delimited(spark, p, "\t"), ".dta": lambda p: read_dta(spark, p), ".xlsx": lambda p: read_workbook(spark, p), ".ods": lambda p: read_workbook(spark, p)}
    df = readers.get(ext, spark.read.parquet)(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def save(df: DataFrame, path: str, replace: bool = False) -> None:
    """Writes by extension: .parquet (default), .orc, .json, .csv, .tsv, .dta."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    mode = "overwrite" if replace else "errorifexists"
    if ext == ".dta":
        write_dta(df, path, replace)
    elif ext in (".csv", ".tsv"):
        write_delimited(df, path, "," if ext == ".csv" else "\t", replace)
    elif ext in (".orc", ".json"):
        getattr(df.write.mode(mode), ext[1:])(path)
    else:
        df.write.mode(mode).parquet(path)


def read_dta(spark: SparkSession, path: str) -> DataFrame:
    """A .dta file or a folder of them, parsed in tasks: numbers as doubles, labels as column metadata.

    Columns are those of all files, in the order of the first that has them, with its labels; a
    column that is text in one file and numbers in another is text, and one that a file lacks is
    missing there. Files without rows give their columns only. A file is one task and of at most
    2 GB.
    """
    import pandas as pd

    source = spark.read.format("binaryFile").load(path).select("path", "content")
    plain = {"convert_categoricals": False, "convert_dates": False}

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for file, content in zip(files["path"], files["content"], strict=True):
                with pd.read_stata(io.BytesIO(content), iterator=True, **plain) as reader:
                    texts, values = reader.variable_labels(), reader.value_labels()
                    try:
                        part = reader.read(1)
                    except StopIteration:
                        part = pd.read_stata(io.BytesIO(content), **plain)
                rows = [(file, i, c, part[c].dtype == object, texts.get(c) or None, json.dumps({str(k): v for k, v in values[c].items()}) if c in values else None) for i, c in enumerate(part.columns)]
                yield pd.DataFrame(rows, columns=["file", "pos", "name", "is_text", "label", "labels"])

    heads = source.mapInPandas(head, "file string, pos int, name string, is_text boolean, label string, labels string")
    at = F.struct("file", "pos")
    fields = heads.groupBy("name").agg(F.min(at).alias("at"), F.max("is_text").alias("is_text"), F.min_by("label", at).alias("label"), F.min_by("labels", at).alias("labels")).orderBy("at").collect()  # one row per column
    if not fields:
        raise DataError(601, f"no .dta file in {path}")
    text = {f["name"]: f["is_text"] for f in fields}

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                with pd.read_stata(io.BytesIO(content), iterator=True, **plain) as reader:
                    while True:
                        try:
                            part = reader.read(CHUNK)
                        except StopIteration:
                            break
                        if not len(part):
                            break
                        gone = pd.Series([None] * len(part), dtype=object)
                        cells = {c: part[c].reset_index(drop=True) if c in part else gone for c in text}
                        yield pd.DataFrame({c: v.map(lambda x: "" if x is None or x != x else str(x)) if text[c] else pd.to_numeric(v).astype("float64") for c, v in cells.items()})

    out = source.mapInPandas(body, ", ".join(f"`{c}` {'string' if t else 'double'}" for c, t in text.items()))
    for f in fields:
        c = f["name"]
        if not text[c]:
            out = out.withColumn(c, F.when(~F.isnan(c), F.col(c)))
        out = label(out, c, f["label"], values=json.loads(f["labels"]) if f["labels"] else None)
    return out


def write_dta(df: DataFrame, path: str, replace: bool = False) -> None:
    """A folder of .dta files of format 118, columns in their smallest types, written by the tasks.

    ``path`` is a folder that driver and executors share as a file system. Each partition writes
    files of at most ``DTA_ROWS`` rows under names of its own, so a task that runs again replaces
    its files; they are moved to ``path`` when all are there. A table without rows is one file.
    """
    if os.path.exists(path) and not replace:
        raise DataError(602, f"{path} exists")
    import pandas as pd

    texts = {f.name: f.metadata["label"] for f in df.schema if "label" in f.metadata}
    values = {f.name: {int(float(k)): v for k, v in f.metadata["values"].items()} for f in df.schema if "values" in f.metadata}
    parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    os.makedirs(parts)

    def put(p: pd.DataFrame, name: str) -> None:
        for c in p.columns:
            if p[c].dtype == object:
                p[c] = p[c].fillna("").astype(str)
            elif p[c].isna().any():
                p[c] = p[c].astype("float64")
            else:
                p[c] = pd.to_numeric(p[c], downcast="integer") if str(p[c].dtype).startswith(("int", "float")) else p[c]
                p[c] = p[c].astype("float64") if str(p[c].dtype) == "int64" else p[c]
        kept = {c: v for c, v in values.items() if p[c].dtype != object}
        own = f"{parts}/.{name}-{uuid.uuid4().hex}"
        p.to_stata(own, write_index=False, version=118, variable_labels=texts, value_labels=kept)
        os.replace(own, f"{parts}/{name}.dta")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, n, files = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            while len(b):
                taken, b = b.iloc[: DTA_ROWS - n], b.iloc[DTA_ROWS - n :]
                held, n = [*held, taken], n + len(taken)
                if n == DTA_ROWS:
                    put(pd.concat(held, ignore_index=True), f"part-{task:05d}-{files:05d}")
                    held, n, files = [], 0, files + 1
        if n:
            put(pd.concat(held, ignore_index=True), f"part-{task:05d}-{files:05d}")
            files += 1
        yield pd.DataFrame({"files": [files]})

    if not df.mapInPandas(work, "files int").agg(F.sum("files")).first()[0]:
        put(df.limit(0).toPandas(), "part-00000-00000")
    if os.path.isdir(path):
        shutil.rmtree(path)
    elif os.path.exists(path):
        os.remove(path)
    os.replace(parts, path)


def _xlsx_rows(data: bytes, sheet: str | int) -> dict[int, dict[int, str]]:
    """Filled rows by their number from 0, each its cells by column."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = book.findall("m:sheets/m:sheet", ns)
        one = sheets[sheet] if isinstance(sheet, int) else next((s for s in sheets if s.get("name") == sheet), None)
        if one is None:
            raise DataError(601, f"no sheet {sheet}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[one.get(rel)].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        rows: dict[int, dict[int, str]] = {}
        for r in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{ns['m']}}}row"):
            cells = {}
            for c in r:
                v, kind = c.find("m:v", ns), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else "" if v is None else v.text or ""
                cells[cell_at(c.get("r"))[1]] = shared[int(text)] if kind == "s" and text else text
            rows[int(r.get("r") or len(rows) + 1) - 1] = cells
        return rows


def _ods_rows(data: bytes, sheet: str | int) -> dict[int, dict[int, str]]:
    """Filled rows by their number from 0, each its cells by column; repeats and covered cells count in full."""
    t, o, x = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % k for k in ("table", "office", "text"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tables = list(ElementTree.fromstring(z.read("content.xml")).iter(f"{t}table"))
    one = tables[sheet] if isinstance(sheet, int) else next((s for s in tables if s.get(f"{t}name") == sheet), None)
    if one is None:
        raise DataError(601, f"no sheet {sheet}")
    rows: dict[int, dict[int, str]] = {}
    row = 0
    for r in one.iter(f"{t}table-row"):
        cells, at = {}, 0
        for c in r:
            if c.tag not in (f"{t}table-cell", f"{t}covered-table-cell"):
                continue
            again = int(c.get(f"{t}number-columns-repeated", "1"))
            value = c.get(f"{o}value") or "\n".join("".join(p.itertext()) for p in c.findall(f"{x}p"))
            if value:
                cells |= {at + k: value for k in range(again)}
            at += again
        again = int(r.get(f"{t}number-rows-repeated", "1"))
        if cells:
            rows |= {row + k: cells for k in range(again)}
        row += again
    return rows


def cell_at(name: str) -> tuple[int, int]:
    """A1 to (row, column), from 0."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)", name)
    col = 0
    for ch in m[1].upper():
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0, cellrange: str | None = None, firstrow: bool = True, case: str = "preserve") -> DataFrame:
    """One sheet of an .xlsx or .ods workbook, or of each workbook of a folder, parsed in tasks.

    Rows stand where their numbers say, blank ones included; of several workbooks each gives up
    its own first row, and the names are those of the first. A workbook, which holds about a
    million rows at most, is one task.
    """
    ends = [cell_at(e) for e in cellrange.split(":")] if cellrange else [(0, 0)]
    (r0, c0), (r1, c1) = ends[0], ends[1] if len(ends) == 2 else (None, None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("file", pa.string()), ("n", pa.int64()), ("cells", pa.list_(pa.string()))])
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = (_ods_rows if file.lower().endswith(".ods") else _xlsx_rows)(content.as_py(), sheet)
                last = max(rows, default=-1) if r1 is None else min(r1, max(rows, default=-1))
                right = max((max(r) for r in rows.values() if r), default=0) if c1 is None else c1
                for start in range(r0, last + 1, CHUNK):
                    at = range(start, min(start + CHUNK, last + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(at)), pa.array(at, pa.int64()), pa.array([[rows.get(r, {}).get(c, "") for c in range(c0, right + 1)] for r in at], pa.list_(pa.string()))], schema=kind)

    grid = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "file string, n bigint, cells array<string>")
    width = grid.agg(F.max(F.size("cells"))).first()[0] or (1 if c1 is None else c1 - c0 + 1)
    head = grid.filter(F.col("n") == r0).orderBy("file").first() if firstrow else None
    names = legal_names([*head["cells"], *[None] * (width - len(head["cells"]))], case, letters=True) if head else [column_letter(c0 + i) for i in range(width)]
    body = grid.filter(F.col("n") > r0) if head else grid
    return typed(body.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]))
