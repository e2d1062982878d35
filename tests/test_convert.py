import struct

import pytest
from pyspark.sql import functions as F

from docloom.functions import detect, render, sql
from docloom.operators import convert
from docloom.operators.registry import UNSUPPORTED, Converter, Registry, builtins
from docloom.plans.samples import archive, compound, pdf, pptx, xls, xlsx
from docloom.sources import files
from docloom.streaming import convert_stream

W = 'xmlns:w="w" xmlns:r="r"'


def msg():
    t = lambda s: s.encode("utf-16-le")
    kind = lambda k: b"\0" * 8 + struct.pack("<II8s", 0x0C150003, 0, struct.pack("<Q", k))
    return compound({
        "__substg1.0_0037001F": t("S"), "__substg1.0_0C1A001F": t("N"), "__substg1.0_0C1F001F": t("e@x"), "__substg1.0_1000001F": t(" hi\r\nyo "),
        "__properties_version1.0": b"\0" * 32,
        "__recip_version1.0_#00000000": {"__substg1.0_3003001F": t("a@x"), "__properties_version1.0": kind(1)},
        "__recip_version1.0_#00000001": {"__substg1.0_3001001F": t("Bob"), "__properties_version1.0": kind(1)},
        "__recip_version1.0_#00000002": {"__substg1.0_3003001F": t("c@x"), "__properties_version1.0": kind(2)},
    })


def docx():
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = '<w:numPr><w:numId w:val="1"/></w:numPr>'
    body = p("T", '<w:pStyle w:val="Heading1"/>') + p("a &lt; b") + p("x", item) + p("y", item) + f"<w:tbl><w:tr><w:tc>{p('c')}</w:tc><w:tc>{p('d')}</w:tc></w:tr></w:tbl>"
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


DOCUMENTS = {
    "a.html": (b"\xef\xbb\xbf<title> T </title><p>x\xff</p>", "x�\n\n", "T"),
    "a.docx": (docx(), "# T\n\na < b\n\n1. x\n2. y\n\n| c | d |\n| --- | --- |\n\n", "a.docx"),
    "one.pptx": (pptx([(1, ["T", " b "], True)]), "## Slide 1\n\nT\n\nb", "one.pptx"),
    "many.pptx": (pptx([(1, ["a"], True), (2, ["b"], True), (10, ["c"], True)]), "## Slide 1\n\na\n\n## Slide 2\n\nc\n\n## Slide 3\n\nb", "many.pptx"),
    "gap.pptx": (pptx([(1, ["z"], False), (2, ["b"], True)]), "## Slide 2\n\nb", "gap.pptx"),
    "none.pptx": (pptx([]), render.NO_SLIDES, "none.pptx"),
    "s.xlsx": (xlsx([("S", '<row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>p|q</t></is></c></row><row><c><v>1</v></c><c><v>0</v></c><c><v>1.5e3</v></c></row>')], ["h"]), "| h | p\\|q |  |\n| --- | --- | --- |\n| 1 |  | 1500 |", "s.xlsx"),
    "two.xlsx": (xlsx([("S1", '<row r="1"><c r="A1" t="str"><v>a</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c></row>'), ("S2", "")]), "## S1\n\n| a |\n| --- |\n|  |\n| true |", "two.xlsx"),
    "empty.xlsx": (xlsx([("S", "")]), render.NO_SHEETS, "empty.xlsx"),
    "one.pdf": (pdf([["Hello", " ", "W\\(o\\)rld"]]), "Hello W(o)rld", "one.pdf"),
    "three.pdf": (pdf([["A"], [], ["C"]], deflate=True), "## Page 1\n\nA\n\n## Page 3\n\nC", "three.pdf"),
    "none.pdf": (pdf([[]]), render.NO_PAGES, "none.pdf"),
    "m.msg": (msg(), "# Email Message\n\n**Subject:** S\n**From:** N <e@x>\n**To:** a@x; Bob\n**Cc:** c@x\n\n## Content\n\nhi\nyo", "S"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    for name, (content, *_) in DOCUMENTS.items():
        (d / name).write_bytes(content)
    (d / "notes.csv").write_bytes(b"a,b")
    (d / "bad.docx").write_bytes(b"not a zip")
    return str(d)


def test_every_format(spark, folder):
    got = {r.filename: r for r in convert.converted(files.read_files(spark, folder)).collect()}
    assert len(got) == len(DOCUMENTS) + 2
    for name, (_, markdown, title) in DOCUMENTS.items():
        assert (got[name].markdown, got[name].title, got[name].error) == (markdown, title, None), name
    assert got["notes.csv"].error == UNSUPPORTED and got["notes.csv"].status == "Failed"
    assert got["bad.docx"].error == "All converters failed: DocxConverter: File is not a zip file"
    assert got["bad.docx"].error_kind == "FileConversionException"
    assert got["one.pdf"].status == "13 characters"


def test_markdown_of_every_format_may_go_to_a_python_function(spark, folder):
    size = F.udf(lambda m: None if m is None else len(m), "int", useArrow=True)
    got = convert.converted(files.read_files(spark, folder)).select("filename", size("markdown").alias("n")).collect()
    assert {r.filename: r.n for r in got if r.n is not None} == {k: len(v[1]) for k, v in DOCUMENTS.items()}


def test_conversion_in_sql_gives_the_same_rows(spark, folder):
    sql.register(spark)
    names = ["filename", "extension", "mimetype", "converter", "markdown", "title", "status", "error_kind", "error", "attempts"]
    for found in (files.read_files(spark, folder), spark.createDataFrame([(None, b"x"), ("n.html", None)], "filename string, content binary")):
        found.createOrReplaceTempView("docloom_files")
        got = spark.sql("select filename, d.* from (select filename, convert_document(filename, content, null) as d from docloom_files)").select(names)
        assert sorted(map(str, got.collect())) == sorted(map(str, convert.converted(found).select(names).collect()))


def test_accepted_only(spark, folder):
    assert files.read_files(spark, folder, accepted_only=True).where("filename = 'notes.csv'").count() == 0


def test_fallback(spark):
    rows = [("lie.docx", "text/html", b"<p>x</p>"), ("m.xlsm", "application/vnd.ms-excel.sheet.macroEnabled.12", b"z"), ("n", None, b"z"), ("n.html", None, None)]
    got = {r.filename: r for r in convert.converted(spark.createDataFrame(rows, "filename string, declared string, content binary"), declared="declared").collect()}
    assert got["lie.docx"].markdown == "x\n\n" and [a.converter for a in got["lie.docx"].attempts] == ["DocxConverter"]
    assert got["m.xlsm"].error.startswith("All converters failed: XlsxConverter: ")
    assert got["n"].error == UNSUPPORTED and got["n.html"].error == UNSUPPORTED


def test_registry(spark):
    assert builtins().names() == ["HtmlConverter", "DocxConverter", "PdfConverter", "XlsxConverter", "PptxConverter", "OutlookMsgConverter"]
    assert [c.name for c in builtins().ordered()] == ["DocxConverter", "PdfConverter", "XlsxConverter", "PptxConverter", "OutlookMsgConverter", "HtmlConverter"]
    shout = Converter("Shout", (".html",), (), lambda b: {"markdown": b.decode().upper()})
    rows = spark.createDataFrame([("a.html", b"x")], "filename string, content binary")
    assert convert.converted(rows, builtins().register(shout)).first().markdown == "X"
    assert convert.converted(rows, builtins().register(shout, 20.0)).first().converter == "HtmlConverter"
    assert convert.converted(rows, Registry()).first().error == UNSUPPORTED


def test_detection(spark):
    cases = [("Report.DOCX", "", ".docx", detect.MIME_TYPES[".docx"]), ("a.tar.gz", "", ".gz", "application/octet-stream"), (".html", "", ".html", "text/html"), ("foo.", "", ".", "application/octet-stream"), ("README", "", "", "application/octet-stream"), ("x.html", "text/plain", ".html", "text/plain")]
    got = spark.createDataFrame(cases, "f string, d string, e string, m string").select(detect.extension(F.col("f")).alias("x"), "e", detect.mimetype(F.col("f"), F.col("d")).alias("y"), "m").collect()
    assert all(r.x == r.e and r.y == r.m for r in got)
    names = spark.createDataFrame([("a.b.docx", "a.b.md"), (".html", ".md"), ("noext", "noext.md"), ("foo.", "foo..md")], "f string, w string")
    assert all(r.n == r.w for r in names.select(detect.output_name(F.col("f")).alias("n"), "w").collect())


def test_batches(spark):
    b = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, x string")
    assert sorted(map(tuple, convert.removed(b, 1).collect())) == [(0, "a"), (1, "c")]
    assert sorted(map(tuple, convert.appended(b, b.limit(1)).collect()))[-1] == (3, "a")
    assert convert.appended(b.limit(0), b).count() == 3
    assert convert.file_count(b.limit(1)).first().label == "1 file"
    s = spark.createDataFrame([("\U0001f600" * 1000, None, None), (None, "E", None), (None, None, True), (None, None, None)], "m string, e string, l boolean")
    assert [r[0] for r in s.select(convert.status(F.col("m"), F.col("e"), F.col("l"))).collect()] == ["2,000 characters", "Failed", "Converting...", "Pending"]


def test_sink_and_stream(spark, folder, tmp_path):
    done = convert.converted(files.read_files(spark, folder))
    twice = done.select("path", "filename", "markdown").union(done.select(F.concat(F.lit("other/"), "path"), "filename", F.concat("markdown", F.lit("!"))))
    twice = twice.union(done.limit(1).select(F.lit("p"), F.lit("a b.docx"), F.lit("x\n")))
    for _ in range(2):  # writing again replaces
        files.write_markdown(twice, str(tmp_path / "out"))
    back = files.read_markdown(spark, str(tmp_path / "out")).collect()
    assert len(back) == 2 * len(DOCUMENTS) + 1 and len({r.folder for r in back}) == len(back)
    texts = {(r.output_name, r.markdown) for r in back}
    assert {("two.md", DOCUMENTS["two.xlsx"][1]), ("a.md", DOCUMENTS["a.docx"][1]), ("a.md", DOCUMENTS["a.html"][1] + "!"), ("a b.md", "x\n")} <= texts
    assert not list((tmp_path / "out").rglob("*.tmp"))
    for _ in range(2):
        convert_stream(spark, folder, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == len(DOCUMENTS) + 2


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select normalize_markdown(html_to_markdown('<h1>a</h1><p>b</p>')) m, markdown_to_html('# a') h, normalize_markdown(concat('a \\n\\n\\n\\n', 'b')) n").first()
    assert tuple(row) == ("# a\n\nb\n\n", "<h1>a</h1>\n", "a\n\nb")
    assert spark.sql("select html_to_markdown('<p>x  \n\n\n y</p><p></p>') m").first().m == "x\n\n y\n\n"


def test_hooks_for_images_and_audio(spark):
    class Counting:
        def describe_image(self, data):
            return f"an image of {len(data)} bytes"

        def transcribe_audio(self, data):
            return f"{len(data)} words"

    sql.register(spark, Counting())
    assert tuple(spark.sql("select describe_image(x'010203') a, transcribe_audio(x'01') b, describe_image(null) c").first()) == ("an image of 3 bytes", "1 words", None)
    sql.register(spark)
    with pytest.raises(Exception, match="LLM client not configured"):
        spark.sql("select describe_image(x'01')").collect()


def test_hard_files(spark):
    wide = xlsx([("S", '<row r="1"><c r="A1" t="str"><v>a</v></c></row><row r="400"><c r="XFD400" t="str"><v>b</v></c></row>')])
    sparse = xlsx([("S", '<row r="1"><c r="B1" t="str"><v>a</v></c></row><row r="3"><c r="C3" t="str"><v>b</v></c></row>')])
    math = archive({"ppt/slides/slide1.xml": '<p xmlns:a="a" xmlns:m="m"><m:t>no</m:t><a:t>yes</a:t></p>'})
    page = b"%%PDF-1.4\n1 0 obj\n<< /Type /Pages /Kids [2 0 R] /Count 1 >>\nendobj\n2 0 obj\n<< /Type /Page /Parent 1 0 R /Resources << /Font << /F1 4 0 R >> >> /Contents 3 0 R >>\nendobj\n3 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n4 0 obj\n<< /Type /Font /Subtype /Type0 %s >>\nendobj\n5 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n"
    shown = b"BT /F1 12 Tf <00010002> Tj (endobj /Encrypt 1 0 R) ET"
    cmap = b"begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0002> <0003> <0021> endbfrange"
    mapped = page % (len(shown), shown, b"/ToUnicode 5 0 R", len(cmap), cmap)
    unmapped = page % (len(shown), shown, b"", len(cmap), cmap)
    notes = archive({
        "word/document.xml": f'<w:document {W}><w:body>'
        + "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for k, t in ((0, "a"), (1, "b"), (0, "c")))
        + '<w:p><w:r><w:t>n</w:t><w:footnoteReference w:id="2"/></w:r></w:p></w:body></w:document>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>told</w:t></w:r></w:p></w:footnote></w:footnotes>',
    })
    old = compound({"__substg1.0_0037001E": "é".encode("cp1252"), "__properties_version1.0": b"\0" * 32 + struct.pack("<II8s", 0x3FFD0003, 0, struct.pack("<Q", 1252))})
    rows = [("wide.xlsx", wide), ("sparse.xlsx", sparse), ("math.pptx", math), ("mapped.pdf", mapped), ("unmapped.pdf", unmapped), ("notes.docx", notes), ("old.msg", old), ("locked.pdf", unmapped + b"trailer << /Encrypt 9 0 R >> startxref")]
    got = {r.filename: r for r in convert.converted(spark.createDataFrame(rows, "filename string, content binary")).collect()}
    assert got["wide.xlsx"].error == "All converters failed: XlsxConverter: Sheet S spans more than 4000000 cells"
    assert got["sparse.xlsx"].markdown == "| a |  |\n| --- | --- |\n|  |  |\n|  | b |"
    assert got["math.pptx"].markdown == "## Slide 1\n\nyes"
    assert got["mapped.pdf"].markdown == "Hi!"
    assert "no map to Unicode" in got["unmapped.pdf"].error and "No password given" in got["locked.pdf"].error
    assert got["notes.docx"].markdown == "1. ab\n2. c\n\nn[1]\n\n1. told ↑\n\n"
    assert got["old.msg"].title == "é"


def test_charset_time_limit_and_default_message(spark):
    import time

    def slow(content):
        time.sleep(30)

    def mute(content):
        raise ValueError

    r = builtins().register(Converter("Slow", (".slow",), (), slow)).register(Converter("Mute", (".mute",), (), mute))
    rows = spark.createDataFrame([("a.html", "latin1", "<p>é".encode("cp1252")), ("b.html", "nonsense", b"x"), ("c.slow", None, b"x"), ("d.mute", None, b"x")], "filename string, charset string, content binary")
    got = {x.filename: x for x in convert.converted(rows, r, charset="charset", seconds=1.0).collect()}
    assert got["a.html"].markdown == "é\n\n" and got["b.html"].error.startswith("All converters failed: HtmlConverter: unknown encoding")
    assert got["c.slow"].error == "All converters failed: Slow: Operation timed out after 1 s"
    assert got["d.mute"].error == "All converters failed: Mute: Conversion failed"
    assert spark.range(1).select(convert.error_text(F.lit(None).cast("string"))).first()[0] == "Conversion failed"


def test_old_workbooks():
    from docloom.sources import xls as reader

    book = xls([("S", [(1, 1, [1]), (1, 2, [0]), (3, 1, -7), (3, 2, 0.125), (3, 4, "f é"), (4, 1, False)]), ("T", [])], ["short", "中 文"])
    assert reader.sheets(book) == [{"name": "S", "rows": [["中 文", "short"], [], ["-7", "0.125", "", "f é"], [""]]}, {"name": "T", "rows": []}]
    parts = [b"\0" * 8 + struct.pack("<HB", 5, 0) + b"ab", b"\1" + "cdé".encode("utf-16-le") + struct.pack("<HBH", 1, 8, 1) + b"z", b"\0\0\0\0"]
    r = reader._Reader(parts, 8)
    assert [r.text(struct.unpack("<H", r.take(2))[0]) for _ in range(2)] == ["abcdé", "z"]  # goes on in wide letters; formats are passed over
    assert reader._rk(struct.pack("<i", 12345 << 2 | 3)) == 123.45
    with pytest.raises(ValueError):
        reader.sheets(compound({"Book": b"x"}))


def rows_of(spark, files_, **options):
    return {r.filename: r for r in convert.converted(spark.createDataFrame(files_, "filename string, content binary"), **options).collect()}


def test_tables_of_sectors_without_end(spark):
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIIII", 0, 1, 0, 0, 4096, 0xFFFFFFFE, 0, 0, 1, 0) + b"\xff" * 436
    loop = head[:512] + struct.pack("<128I", *[0] * 127, 0) + b"\0" * 512
    lists = compound({"a": b"x", "b": b"y"})
    own = lists.replace(struct.pack("<III", 0xFFFFFFFF, 2, 0xFFFFFFFF), struct.pack("<III", 1, 1, 1))
    got = rows_of(spark, [("loop.msg", loop), ("loop.xls", loop), ("own.msg", own)])
    assert "has no end" in got["loop.msg"].error and "has no end" in got["loop.xls"].error and got["own.msg"].converter == "OutlookMsgConverter"


def test_bounds_of_a_reader_are_on_by_default(spark):
    def greedy(content):
        return {"markdown": str(len(bytearray(8 << 30)))}

    def endless(content):
        while True:
            pass

    r = builtins().register(Converter("Greedy", (".big",), (), greedy)).register(Converter("Endless", (".slow",), (), endless))
    got = rows_of(spark, [("a.big", b"x"), ("b.html", b"<p>fine</p>")], registry=r)
    assert got["a.big"].error == "All converters failed: Greedy: Operation took more than 2048 MB" and got["b.html"].markdown == "fine\n\n"
    assert "timed out after 0.5 s" in rows_of(spark, [("a.slow", b"x")], registry=r, seconds=0.5)["a.slow"].error
    assert convert.converted.__defaults__[-2:] == (300, 2048)


def test_names_of_files(spark, tmp_path):
    names = ["a b#c", "100%", "x+y", "é", "q%20r"]
    rows = spark.createDataFrame([(f"{n}.html", n) for n in names], "filename string, markdown string")
    files.write_markdown(rows, str(tmp_path / "out"))
    want = {(f"{n}.md", n) for n in names}
    assert {(r.output_name, r.markdown) for r in files.read_markdown(spark, str(tmp_path / "out")).collect()} == want
    assert {(r.filename, bytes(r.content).decode()) for r in files.read_files(spark, str(tmp_path / "out"), recursive=True).collect()} == want


def test_word_styles(spark):
    style = lambda key, name, base="", outline="": f'<w:style w:type="paragraph" w:styleId="{key}"><w:name w:val="{name}"/>' + (f'<w:basedOn w:val="{base}"/>' if base else "") + (f'<w:pPr><w:outlineLvl w:val="{outline}"/></w:pPr>' if outline else "") + "</w:style>"
    styles = style("berschrift1", "heading 1") + style("Own", "My title", "Mid") + style("Mid", "Between", "berschrift1") + style("Lined", "Lined", outline="2") + style("Loop", "Loop", "Pool") + style("Pool", "Pool", "Loop") + style("Deep", "Deep", outline="9") + style("Heading2", "Normal text")
    keys = ["berschrift1", "Own", "Lined", "Loop", "Deep", "Heading2", "Heading3", "None"]
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{k}"/></w:pPr><w:r><w:t>{k}</w:t></w:r></w:p>' for k in keys)
    made = archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>"})
    marks = {"berschrift1": "# ", "Own": "# ", "Lined": "### ", "Heading2": "## ", "Heading3": "### "}
    assert rows_of(spark, [("a.docx", made)])["a.docx"].markdown == "".join(f"{marks.get(k, '')}{k}\n\n" for k in keys)


def test_workbooks_by_their_first_bytes(spark):
    phonetic = archive({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r0"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r0" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>base</t><rPh><t>PHON</t></rPh></si><si><r><t>a</t></r><r><t> b</t></r></si></sst>", "xl/worksheets/s.xml": '<x:worksheet xmlns:x="x"><x:sheetData><x:row><x:c t="s"><x:v>0</x:v></x:c><x:c t="s"><x:v>1</x:v></x:c></x:row></x:sheetData></x:worksheet>',
    })
    got = rows_of(spark, [
        ("p.xlsx", phonetic), ("c.xls", b"a,b\r\n1.50,\"x, \"\"y\"\"\nz\"\r\n0,TRUE\r\nfalse,-3e2\r\n"), ("t.xls", "é\tü\n1\t2".encode("utf-16")), ("w.xlsx", "é;1".encode("cp1252")), ("one.xls", b"a\nb"), ("long.xls", b"a;b\n" + b"x" * 200_000),
        ("h.xls", b"<html><body>t<table><tr><td>a<td colspan=2>b|c</tr><tr><td>0<td>2.0</table><table><tr><td>x</table>"), ("none.xls", b"<html><p>x"), ("word.xls", b"hello"), ("bytes.xls", b"a,b\0c"),
    ])
    assert got["p.xlsx"].markdown == "| base | a b |\n| --- | --- |"
    assert got["c.xls"].markdown == '| a | b |\n| --- | --- |\n| 1.5 | x, "y" z |\n|  | true |\n|  | -300 |'
    assert got["t.xls"].markdown == "| é | ü |\n| --- | --- |\n| 1 | 2 |" and got["w.xlsx"].markdown == "| é | 1 |\n| --- | --- |" and len(got["long.xls"].markdown) > 200_000 and got["one.xls"].markdown == "| a |\n| --- |\n| b |"
    assert got["h.xls"].markdown == "## Sheet1\n\n| a | b\\|c |  |\n| --- | --- | --- |\n|  | 2 |  |\n\n## Sheet2\n\n| x |\n| --- |"
    assert "could not find <table>" in got["none.xls"].error and "not a zip file" in got["word.xls"].error and "not a zip file" in got["bytes.xls"].error


def test_a_large_sheet_takes_little_memory(tmp_path):
    """200 MB of XML, read in a process of its own that reports its peak."""
    import subprocess
    import sys

    program = """
import io, resource, sys, zipfile
from docloom.sources import office
out = io.BytesIO()
row = "<row>" + "".join(f'<c t="n" s="1"><f>A1+{k}</f><v>{k}.25</v></c>' + " " * 150 for k in range(40)) + "</row>"
with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
    z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r0"/></sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r0" Target="worksheets/s.xml"/></Relationships>')
    with z.open("xl/worksheets/s.xml", "w") as f:
        f.write(b"<worksheet><sheetData>")
        n = (200 << 20) // len(row)
        for _ in range(n):
            f.write(row.encode())
        f.write(b"</sheetData></worksheet>")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = office.sheets(out.getvalue())
assert len(found[0]["rows"]) == n and found[0]["rows"][-1][1] == "1.25"
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) / 1024)
"""
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=300, cwd=__file__.rpartition("/tests/")[0])
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 300
