"""Parsers on small files written here."""

import io
import zipfile

import pytest

from evigraph.sources import files
from evigraph.streaming.ingest import ingest_files, windowed_events


def rows(df):
    return df.orderBy("block_seq").collect()


def test_markdown(spark, tmp_path):
    text = "before\n\n# One\npara a\nmore\n\n### Deep\r\nx\n## Two\n\n\nlast line"
    p = tmp_path / "doc.md"
    p.write_bytes(text.encode())
    got = rows(files.read_documents(spark, [str(p)]))
    assert [(r["type"], r["content"]) for r in got] == [("paragraph", "before"), ("heading", "One"), ("paragraph", "para a\nmore"), ("heading", "Deep"), ("paragraph", "x"), ("heading", "Two"), ("paragraph", "last line")]
    assert [r["section_title"] for r in got] == ["doc", "One", "One", "Deep", "Deep", "Two", "Two"]
    assert [(r["section_seq"], r["parent_section_seq"]) for r in got][-4:] == [(2, 1), (2, 1), (3, 1), (3, 1)]
    plain = text.replace("\r\n", "\n")
    for r in got:
        if r["type"] == "paragraph":
            assert plain[r["start_char"] : r["end_char"]].strip() == r["content"]
    (tmp_path / "empty.md").write_text("")
    assert files.read_documents(spark, [str(tmp_path / "empty.md")]).count() == 0


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b\n1,\n\n"x,y","two\nlines"\n')
    got = rows(files.read_documents(spark, [str(p)]))
    assert [r["content"] for r in got] == ["a: 1", "a: x,y, b: two\nlines"]
    assert got[0]["metadata"] == {"a": "1", "b": ""} and (got[1]["start_char"], got[1]["end_char"]) == (100, 200)
    (tmp_path / "h.csv").write_text("a,b\n")
    assert files.read_documents(spark, [str(tmp_path / "h.csv")]).count() == 0


def test_csv_files_of_several_headers_and_parts(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    rows_ = "".join(f"r{k},{'x' * 50}\n" for k in range(4000))
    (tmp_path / "two.csv").write_text("c,d\n" + rows_)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = files.read_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], multi_line=False)
        two = rows(got.filter("source_filename = 'two.csv'"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["block_seq"] for r in two] == list(range(4000)) and [r["metadata"]["c"] for r in two] == [f"r{k}" for k in range(4000)]


def test_json(spark, tmp_path):
    for name, text in (("a", '[{"k": null, "v": ""}, 5]'), ("o", '{"x": {"y": 1}, "z": "t"}'), ("s", '"word"')):
        (tmp_path / f"{name}.json").write_text(text)
    got = rows(files.read_documents(spark, [str(tmp_path / "a.json")]))
    assert [r["content"] for r in got] == ["v: ", "value: 5"] and got[0]["metadata"] == {"k": "", "v": ""}
    got = rows(files.read_documents(spark, [str(tmp_path / "o.json")]))
    assert [(r["section_title"], r["content"]) for r in got] == [("x", '{"y":1}'), ("z", "t")]
    assert files.read_documents(spark, [str(tmp_path / "s.json")]).first()["type"] == "paragraph"


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="First" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>2</v></c></row><row/></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    p = tmp_path / "b.xlsx"
    p.write_bytes(data.getvalue())
    got = rows(files.read_documents(spark, [str(p)]))
    assert [(r["section_title"], r["content"], r["page"]) for r in got] == [("First", "name: 1, col1: 2", 1)]


def test_the_registry_needs_no_session():
    import os
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-W", "error::SyntaxWarning", "-c", "import __spark_entry__ as e; print(set(e.oracle_sql()) <= set(e.queries()))"], cwd=here, capture_output=True, text=True, check=False)
    assert said.stdout.strip() == "True", said.stderr


def test_unknown_kinds_are_refused(spark):
    with pytest.raises(ValueError, match="csv, json"):
        files.read_documents(spark, ["x.pdf"])


def test_pdf_items(spark):
    items = spark.createDataFrame([(1, 1, 0, 0.0, 700.2, "REPORT"), (1, 1, 1, 9.0, 699.9, "TITLE"), (1, 1, 2, 0.0, 650.0, "words here"), (1, 2, 0, 0.0, 10.0, "more")], "doc_id int, page int, seq int, x double, y double, str string")
    lines = files.pdf_lines(items)
    got = files.section_tree(lines).orderBy("line_no").collect()
    assert [(r["line"], r["start_char"], r["section_seq"]) for r in got] == [("REPORT TITLE", 0, 1), ("words here", 12, 1), ("more", 22, 1)]


def test_streams(spark, tmp_path):
    from evigraph.schema import complete
    from evigraph.sources.snapshots import read_store

    folder = tmp_path / "in"
    folder.mkdir()
    to_graph = lambda b: complete(spark, {"Report": b.selectExpr("document_id as report_id", "source_filename as title", "source_filename", "cast(null as string) as date", "1 as num_pages")}, spark.createDataFrame([], "edge_id string, source_id string, target_id string, type string, description string, confidence double, source_text string"))
    for n in range(2):
        (folder / f"{n}.md").write_text("x")
        ingest_files(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), to_graph).awaitTermination()
    assert read_store(spark, str(tmp_path / "out"))["Report"].count() == 2
    events = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type, 1.5 as value union all select timestamp'2024-01-01 01:10:00', 'a', 2.0")
    assert sorted(r["total"] for r in windowed_events(events).collect()) == [1.5, 2.0]
