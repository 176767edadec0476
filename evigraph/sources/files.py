"""Files to blocks: one row per heading, paragraph or data row, in document order.

CSV is read by Spark's reader, other text files whole and parsed with DataFrame functions;
workbooks, which are zip archives of XML, are parsed by a small function in mapInPandas.

    document_id, source_filename, block_seq, section_seq, section_title, section_level,
    parent_section_seq, type, level, content, page, start_char, end_char, metadata
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.text import is_heading_line

BLOCKS = "document_id string, source_filename string, block_seq int, section_seq int, section_title string, section_level int, parent_section_seq int, type string, level int, content string, page int, start_char int, end_char int, metadata map<string,string>"
COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]


def _named(rows: DataFrame, path: str = "path") -> DataFrame:
    name = F.element_at(F.split(path, "/"), -1)
    return rows.withColumn("source_filename", name).withColumn("document_id", F.sha2(F.col(path), 256))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return _named(rows)


def markdown_blocks(files: DataFrame) -> DataFrame:
    """files: document_id, source_filename, value. Headings open sections, nested by level; blank lines
    end paragraphs; offsets count characters, a line's end as one. All window work is within a document."""
    line = F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n"))
    rows = files.select("document_id", "source_filename", line.alias("n", "line"))
    doc = Window.partitionBy("document_id").orderBy("n")
    running = doc.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("mark", F.length(F.regexp_extract("line", r"^(#{1,6})\s+.+$", 1))).withColumn("blank", F.trim("line") == "")
    rows = rows.withColumn("section_seq", F.sum((F.col("mark") > 0).cast("int")).over(running))
    # a paragraph ends at a blank line or a heading
    rows = rows.withColumn("para", F.sum(((F.col("mark") > 0) | F.col("blank")).cast("int")).over(running))
    rows = rows.filter(~F.col("blank"))
    rows = rows.withColumn("group", F.concat_ws(":", F.when(F.col("mark") > 0, "h").otherwise("p"), "para"))
    blocks = rows.groupBy("document_id", "source_filename", "section_seq", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("raw"), F.min("start").alias("start_char"), F.min("n").alias("n"), F.max("mark").alias("mark"))
    heading = F.col("mark") > 0
    blocks = blocks.withColumn("content", F.when(heading, F.trim(F.regexp_replace("raw", r"^#{1,6}\s+", ""))).otherwise(F.trim("raw")))
    # the parent is the last earlier heading of a lower level: of six levels, the last of each so far
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("mark") == n, F.col("section_seq"))).over(before) for n in range(1, 6)]
    parent = F.when(heading, F.greatest(*[F.when(F.col("mark") > n, last[n - 1]) for n in range(1, 6)]))
    # a section's first block is its heading; all stays where its document is, so texts are shuffled once
    first = Window.partitionBy("document_id", "section_seq").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    of_section = {"section_title": F.when(heading, F.col("content")), "section_level": F.when(heading, F.col("mark")), "parent_section_seq": F.col("_parent")}
    out = blocks.withColumns({"_seq": F.row_number().over(doc), "_parent": parent}).withColumns({k: F.first(v).over(first) for k, v in of_section.items()})
    seq = F.col("_seq") - 1
    return out.select("document_id", "source_filename", seq.cast("int").alias("block_seq"), F.col("section_seq").cast("int"), F.coalesce("section_title", _stem(F.col("source_filename"))).alias("section_title"), F.coalesce("section_level", F.lit(0)).alias("section_level"), F.col("parent_section_seq").cast("int"), F.when(heading, "heading").otherwise("paragraph").alias("type"), F.when(heading, F.col("mark")).alias("level"), "content", F.lit(1).alias("page"), F.col("start_char").cast("int"), (F.col("start_char") + F.length("raw")).cast("int").alias("end_char"), F.lit(None).cast("map<string,string>").alias("metadata"))


def _data_rows(files: DataFrame, parse: Callable[[str], Iterator[tuple[str, int, int, list[tuple[str, str]], str]]], column: str = "value") -> DataFrame:
    """Blocks of what parse gives for each file: sheet, sheet number, row number, cells and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, name, value in zip(b["document_id"], b["source_filename"], b[column], strict=True):
                stem = re.sub(r"\.[^.]*$", "", name)
                for seq, (sheet, k, row, cells, text) in enumerate(parse(value)):
                    out.append((doc, name, seq, k, sheet or stem, 1, None, "data_row", None, text, k + 1, row * 100, (row + 1) * 100, dict(cells)))
            yield pd.DataFrame(out, columns=COLUMNS).astype({"parent_section_seq": "Int32", "level": "Int32"})

    return files.select("document_id", "source_filename", column).mapInPandas(run, BLOCKS)


_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def parse_xlsx(data: bytes):
    """A section per sheet; the first row names the columns, col{i} where it is blank; empty rows and sheets are left out."""
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_CELL}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_CELL}sheet")):
            rows = []
            for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(_REL)].removeprefix("/xl/"))).iter(f"{_CELL}row"):
                cells: dict[int, str] = {}
                for at, c in enumerate(row.iter(f"{_CELL}c")):
                    col = 0
                    for ch in re.sub(r"\d", "", c.get("r") or ""):
                        col = col * 26 + ord(ch) - 64
                    v = c.find(f"{_CELL}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_CELL}t"))
                    text = shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else "") or ""
                    cells[col - 1 if col else at] = text
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            if not rows:
                continue
            head = [h.strip() or f"col{i}" for i, h in enumerate(rows[0])]
            for n, r in enumerate(rows[1:]):
                if any(r):
                    cells = list(zip([*head, *(f"col{i}" for i in range(len(head), len(r)))], r, strict=False))
                    yield sheet.get("name"), k, n, cells, ", ".join(f"{h}: {v}" for h, v in cells if v != "")


def json_blocks(files: DataFrame) -> DataFrame:
    """Arrays give a data row per element (nulls left out of its text), objects a section per key,
    anything else one paragraph. Nested values are JSON."""
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    rows = files.withColumn("kind", F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("scalar"))
    base = ["document_id", "source_filename"]
    stem = _stem(F.col("source_filename"))

    elements = rows.filter("kind = 'array'").select(*base, F.posexplode(F.from_json("value", "array<string>")).alias("k", "e"))
    cells = F.coalesce(F.from_json("e", "map<string,string>"), F.create_map(F.lit("value"), F.col("e")))
    elements = elements.withColumn("m", cells)
    shown = F.transform(F.filter(F.map_entries("m"), lambda x: x["value"].isNotNull()), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    null_int = F.lit(None).cast("int")
    a = elements.select(*base, F.col("k").alias("block_seq"), F.lit(0).alias("section_seq"), stem.alias("section_title"), F.lit(1).alias("section_level"), null_int.alias("parent_section_seq"), F.lit("data_row").alias("type"), null_int.alias("level"), F.array_join(shown, ", ").alias("content"), F.lit(1).alias("page"), (F.col("k") * 100).alias("start_char"), (F.col("k") * 100 + 100).alias("end_char"), F.transform_values("m", lambda _, x: F.coalesce(x, F.lit(""))).alias("metadata"))
    members = rows.filter("kind = 'object'").select(*base, F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("k", "x")).select(*base, "k", F.col("x.key").alias("key"), F.coalesce(F.col("x.value"), F.lit("null")).alias("content"))
    none = F.lit(None).cast("map<string,string>").alias("metadata")
    b = members.select(*base, F.col("k").alias("block_seq"), F.col("k").alias("section_seq"), F.col("key").alias("section_title"), F.lit(1).alias("section_level"), null_int.alias("parent_section_seq"), F.lit("paragraph").alias("type"), null_int.alias("level"), "content", F.lit(1).alias("page"), (F.col("k") * 200).alias("start_char"), (F.col("k") * 200 + F.least(F.length("content"), F.lit(200))).alias("end_char"), none)
    c = rows.filter("kind = 'scalar'").select(*base, F.lit(0).alias("block_seq"), F.lit(0).alias("section_seq"), stem.alias("section_title"), F.lit(1).alias("section_level"), null_int.alias("parent_section_seq"), F.lit("paragraph").alias("type"), null_int.alias("level"), F.trim("value").alias("content"), F.lit(1).alias("page"), F.lit(0).alias("start_char"), F.length(F.trim("value")).alias("end_char"), none)
    return a.unionByName(b).unionByName(c)


def read_markdown(spark: SparkSession, paths: list[str]) -> DataFrame:
    return markdown_blocks(whole_files(spark, paths))


def read_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    return json_blocks(whole_files(spark, paths))


def read_csv(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """A data row for each row, by Spark's own reader; paths may have different headers. Rows without any value are
    left out; empty values stay in the metadata but not in the text. Values may hold line ends, for which a file
    has to be read by one task from end to end; without multi_line large files are split."""
    out = None
    for path in paths:
        rows = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)
        columns = rows.columns
        values = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]
        cells = F.array(*[F.struct(F.lit(c).alias("k"), v.alias("v")) for c, v in zip(columns, values, strict=True)]) if columns else F.array().cast("array<struct<k:string,v:string>>")
        full = F.filter(cells, lambda x: x["v"] != "")
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), cells.alias("cells"), full.alias("full")).filter(F.size("full") > 0)
        out = rows if out is None else out.unionByName(rows)
    out = _named(out)
    # a row's place in its file: its place in its part of it, and the rows of the parts before, of which there are few
    parts = out.groupBy("document_id", "block", F.shiftright("m", 33).alias("part")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("document_id").orderBy("block", "part")
    bases = parts.select("document_id", "block", "part", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("document_id", "block", "part").orderBy("m")
    rows = out.withColumn("part", F.shiftright("m", 33)).withColumn("k", F.row_number().over(inside) - 1).join(bases, ["document_id", "block", "part"])
    k = (F.col("base") + F.col("k")).cast("int")
    text = F.array_join(F.transform("full", lambda x: F.concat(x["k"], F.lit(": "), x["v"])), ", ")
    null_int = F.lit(None).cast("int")
    return rows.select("document_id", "source_filename", k.alias("block_seq"), F.lit(0).alias("section_seq"), _stem(F.col("source_filename")).alias("section_title"), F.lit(1).alias("section_level"), null_int.alias("parent_section_seq"), F.lit("data_row").alias("type"), null_int.alias("level"), text.alias("content"), F.lit(1).alias("page"), (k * 100).alias("start_char"), ((k + 1) * 100).alias("end_char"), F.map_from_entries(F.transform("cells", lambda x: F.struct(x["k"], x["v"]))).alias("metadata"))


def read_xlsx(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("value"))
    return _data_rows(_named(rows), parse_xlsx)


#: Readers by extension; register(ext, reader) adds one.
READERS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {"md": read_markdown, "markdown": read_markdown, "json": read_json, "csv": read_csv, "xlsx": read_xlsx}


def register(ext: str, reader: Callable[[SparkSession, list[str]], DataFrame]) -> None:
    READERS[ext.lower().lstrip(".")] = reader


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Blocks of files of any known kind; files of one kind are read together."""
    by: dict[str, list[str]] = {}
    for p in paths:
        ext = p.rsplit(".", 1)[-1].lower() if "." in p else ""
        if ext not in READERS:
            raise ValueError(f"unsupported format {ext!r}; supported: {', '.join(sorted(READERS))}")
        by.setdefault(ext, []).append(p)
    out = None
    for ext, some in sorted(by.items()):
        rows = READERS[ext](spark, some).select(*COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


def pdf_lines(items: DataFrame) -> DataFrame:
    """items: doc_id, page, seq, x, y, str, as a PDF library extracts them. Items of one rounded height
    are a line; lines go down the page. doc_id, page, line_no (in the document), line, start_char."""
    lines = items.withColumn("row", F.round("y")).groupBy("doc_id", "page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "str"))), lambda x: x["str"]), " ").alias("line"))
    order = Window.partitionBy("doc_id").orderBy("page", F.desc("row"))
    return lines.select("doc_id", "page", (F.row_number().over(order) - 1).alias("line_no"), "line", F.coalesce(F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_char"))


def section_tree(lines: DataFrame) -> DataFrame:
    """Lines with the section they are in: 0 before the first heading, else the number of headings so far."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = is_heading_line(F.col("line"))
    return lines.withColumn("is_heading", heading).withColumn("section_seq", F.sum(heading.cast("int")).over(so_far))


def full_text(blocks: DataFrame, doc: str = "document_id", seq: str = "block_seq", content: str = "content") -> DataFrame:
    return blocks.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(content).alias("c")))), lambda x: x["c"]), "\n").alias("full_text"))
