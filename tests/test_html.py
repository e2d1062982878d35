import pytest

from docloom.functions import render, sql
from docloom.functions.text import html_title, normalize
from docloom.operators import convert
from docloom.sources.html import MAX_LEVELS, blocks, decoded, nodes, parse
from docloom.operators.preview import to_html
from pyspark.sql import functions as F



def rendered(spark, bodies, strip=True):
    """Markdown before its line ends are normalized, and by the normalizing functions of columns and of SQL."""
    sql.register(spark)
    rows = spark.createDataFrame(list(enumerate(bodies)), "k int, h string")
    found = F.udf(lambda h: blocks(h, strip), render.BLOCKS, useArrow=True)("h")
    got = rows.withColumn("b", found).select("k", render.blocks(F.col("b")).alias("m"), convert.html_to_markdown(F.col("h")).alias("n"), F.expr("html_to_markdown(h)").alias("q")).orderBy("k").collect()
    assert all(r.n == r.q for r in got)
    return [r.m for r in got]


BODIES = [
    ("<h1> A </h1><h6>B</h6>", "# A\n\n###### B\n\n"),
    ("<p>a <b>b</b></p>", "a b\n\n"),
    ("<p>a<br>b</p>", "ab\n\n"),
    ("x <b>y</b> z", "x **y**z "),
    ("<i>q</i><em>r</em>", "*q**r*"),
    ('<a href="/u">t</a>', "[t](/u)"),
    ('<a href="">t</a>', "t"),
    ("<ul>x<li>a</li><li>b<ul><li>c</li></ul></li></ul>", "- a\n- bc\n\n"),
    ('<ol start="5"><li>a<li>b</ol>', "1. a\n2. b\n\n"),
    ("<div><li>a</li></div>", ""),
    ("<table><tr><th>h1</th><th>h2</th></tr><tr><td>x|y</td></tr></table>", "| h1 | h2 |\n| --- | --- |\n| x|y |\n\n"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "| a | b |\n| --- | --- |\n| c |\n\nd "),
    ("<table><tr></tr></table>", "|  |\n|  |\n\n"),
    ("<blockquote>a\nb</blockquote>", "> a\nb\n\n"),
    ("<code>x</code>", "`x`"),
    ("<pre>  a\n b</pre>", "```\na\n b\n```\n\n"),
    ('<img src="i.png">', "![](i.png)\n\n"),
    ('<img alt="z">', ""),
    ("<section><h2>t</h2></section>", "## t\n\n"),
    ('<nav><a href="/1">a</a><a href="/2">b</a></nav>', "ab"),
    ("<span> s </span>t", "st "),
    ("<hr>", ""),
    ("<script>s</script><style>c</style>k", "k "),
    ("<!-- c -->k", "k "),
    ("<p><b>x<br><p>y</p><footer>z</footer>", "x\n\ny\n\n**z**"),
    ("<b><p>x</b>y</p>", "****xy\n\n"),
    ("<b></b><h2></h2>", "****## \n\n"),
    ("a&amp;b &copy; &quot;", 'a&b © " '),
]


def test_walk(spark):
    bodies, want = zip(*BODIES)
    assert rendered(spark, bodies) == list(want)
    assert rendered(spark, [f"<!DOCTYPE html><html><head><title>T</title></head><body>{b}</body></html>" for b in bodies]) == list(want)


def test_lone_end_tag_and_word_scripts(spark):
    assert rendered(spark, ["<body></p>k", "</p>k", ""]) == ["\n\nk ", "k ", ""]
    assert rendered(spark, ["<body><script>s</script></body>"], strip=False) == ["s"]


def test_titles_and_normalization(spark):
    titles = [("<title> A &amp; B </title>", "A &amp; B"), ("<p>", None), ("<title></title>", ""), ("<TITLE id=1>x</TITLE>", "x")]
    got = spark.createDataFrame(titles, "h string, w string").select(html_title(F.col("h")).alias("t"), "w").collect()
    assert all(r.t == r.w for r in got)
    cases = [("a  \nb", "a\nb"), ("a\r\nb", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("a\n \n \nb", "a\n\nb"), ("a\n\n", "a\n\n"), ("  a", "  a"), ("a 　﻿", "a"), ("a\u0085", "a\u0085"), (" \n", "\n"), ("a \r \n\t b  c \n", "a\n\t b  c\n"), (" " * 9 + "x" + " " * 9, " " * 9 + "x"), ("", ""), (" ", "")]
    got = spark.createDataFrame(cases, "m string, w string").select(normalize(F.col("m")).alias("n"), "w", normalize(normalize(F.col("m"))).alias("again")).collect()
    assert all(r.n == r.w == r.again for r in got)


def test_preview():
    assert to_html("# A\n\nx **y**\nz\n\n- a\n- b\n") == "<h1>A</h1>\n<p>x <strong>y</strong><br>z</p>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"
    inline = [
        ("a ~~b~~ c", "a <del>b</del> c"), ("***x***", "<em><strong>x</strong></em>"), ("**a *b* c**", "<strong>a <em>b</em> c</strong>"), ("_x_ __y__ a_b_c", "<em>x</em> <strong>y</strong> a_b_c"),
        ('[t](/u "T") ![i](s.png)', '<a href="/u" title="T">t</a> <img src="s.png" alt="i">'), ("see https://x.org/a.", 'see <a href="https://x.org/a">https://x.org/a</a>.'), ("<https://x.org>", '<a href="https://x.org">https://x.org</a>'),
        ("`a*b*` \\*c\\*", "<code>a*b*</code> *c*"), ("x <u>y</u> & z", "x <u>y</u> &amp; z"), ("1 < 2 > 0", "1 &lt; 2 &gt; 0"),
    ]
    for text, want in inline:
        assert to_html(text) == f"<p>{want}</p>\n", text
    assert to_html("- a\n  - b\n  - c\n- d\n\n3. x\n4. y") == "<ul>\n<li>a\n<ul>\n<li>b</li>\n<li>c</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n<ol start=\"3\">\n<li>x</li>\n<li>y</li>\n</ol>\n"
    assert to_html("a\n\n---\n\n* b") == "<p>a</p>\n<hr>\n<ul>\n<li>b</li>\n</ul>\n"
    assert "<td>1</td>" in to_html("| a |\n| --- |\n| 1 |\n") and to_html("```\n<x>\n```") == "<pre><code>&lt;x&gt;\n</code></pre>\n"


MORE = [
    ('<a href="/x?a=1&copy=2&amp;b=3&copy;&para">t</a>', "[t](/x?a=1&copy=2&b=3©¶)"),
    ("<a href=/u&regx title='q&quot;'>t</a>", "[t](/u&regx)"),
    ("<table>foo<tr><td>a</table>", "foo | a |\n| --- |\n\n"),
    ("b<table>foo<p>bar</p><tr><td>a</table>", "bfoo bar\n\n| a |\n| --- |\n\n"),
    ("<table><tr><td>a</td><b>x</b></tr></table>y", "**x**| a |\n| --- |\n\ny "),
    ("<textarea><b>x</b>&amp;</textarea>", "<b>x</b>&"),
    ("<div><xmp><i>a</i>&amp;</xmp></div>", "<i>a</i>&amp;"),
    ("<iframe><p>x</p></iframe>k", "<p>x</p>k "),
    ("1<2", "1<2 "),
    ("a<!-- c -->b", "a b "),
    ("<pre>\na\n</pre>", "```\na\n```\n\n"),
    ("<p>x<textarea>never", "xnever\n\n"),
]


def test_standard_details(spark):
    bodies, want = zip(*MORE)
    assert rendered(spark, [f"<body>{b}" for b in bodies]) == list(want)
    assert rendered(spark, ["<title>a<b>c</b></title>x"]) == ["x "]


def test_charsets():
    assert decoded("é€".encode("cp1252"), "ISO-8859-1") == "é€" and decoded("é".encode("utf-16-le"), "utf-16le") == "é" and decoded(b"\xef\xbb\xbfx\xff") == "x�"
    with pytest.raises(LookupError):
        decoded(b"x", "no-such-charset")


def test_odd_tables_end():
    for body in ("<table><b><div>x</b>y</table>z", "<table><tr><b><p>x</b>y<td>c</table>", "<table><table><tr><td>a", "<tr>x<td>y", "<table><a><a>x</table>"):
        assert all(c in parse(body).text() for c in body if c in "xyzc" and f"<{c}" not in body)


def test_deep_trees_are_cut_to_the_bound_of_browsers():
    for tag in ("div", "b", "span", "ul><li"):
        html = f"<{tag}>x" * 8000
        levels, deepest = {}, 0
        for k, parent, *_ in nodes(html):
            levels[k] = levels.get(parent, -1) + 1
            deepest = max(deepest, levels[k])
        assert deepest <= MAX_LEVELS and parse(html).text().count("x") == 8000


def shape(html):
    """The tree as tags."""

    def one(n):
        return n if isinstance(n, str) else f"<{n.tag}>{''.join(map(one, n.children))}</{n.tag}>"

    return "".join(map(one, parse("<body>" + html).children))


TREES = [
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<a>1<p>2</a>3</p>", "<a>1</a><p><a>2</a>3</p>"),
    ("<a>1<div>2<div>3</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>"),
    ("<b>1<i>2<p>3</b>4", "<b>1<i>2</i></b><i><p><b>3</b>4</p></i>"),
    ("<b><em><foo><foob><aside></b></em>x", "<b><em><foo><foob></foob></foo></em></b><em></em><aside><em><b></b></em>x</aside>"),
    ("<table><a>1<p>2</a>3</p>", "<a>1</a><p><a>2</a>3</p><table></table>"),
    ("<b><button>x</b>y</button>z", "<b><button>xy</button>z</b>"),
    ("<svg/>a<p>b</p>", "<svg></svg>a<p>b</p>"),
    ("<svg><g/><path>t</path></svg><p>b</p>", "<svg><g></g><path>t</path></svg><p>b</p>"),
    ("<svg><g><p>out</p>x", "<svg><g></g></svg><p>out</p>x"),
    ("<svg><title>a<b>c</b></title></svg>d", "<svg><title>a<b>c</b></title></svg>d"),
    ("<svg><foreignObject><p>in</p></foreignObject><g></g></svg>d", "<svg><foreignobject><p>in</p></foreignobject><g></g></svg>d"),
    ("<svg><style><g></g></style></svg><i>x</i>", "<svg><style><g></g></style></svg><i>x</i>"),
    ("<math><mi>x</mi><mo>=</mo></math>y", "<math><mi>x</mi><mo>=</mo></math>y"),
    ("<svg><![CDATA[a<b]]></svg>", "<svg>a<b</svg>"),
]


def test_trees_of_the_standard():
    for html, want in TREES:
        assert shape(html) == want, html


def test_pages_of_frames_have_no_body(spark):
    assert rendered(spark, ["<html><head><title>t</title></head><frameset><frame src=a><noframes><p>x</noframes></frameset>", "<p>a<frameset>b"]) == ["", "ab\n\n"]
    assert parse("<template><p>in</p></template>").text() == ""


def test_nodes_as_rows(spark):
    html = "<p id=1 class='a'>x<b>y</b></p><!-- c -->z"
    want = [(0, None, "body", None, {}), (1, 0, "p", None, {"id": "1", "class": "a"}), (2, 1, "#text", "x", {}), (3, 1, "b", None, {}), (4, 3, "#text", "y", {}), (5, 0, "#comment", None, {}), (6, 0, "#text", "z", {})]
    assert list(nodes(html)) == want
    sql.register(spark)
    rows = spark.createDataFrame([(1, html), (2, None)], "k int, h string")
    rows.createOrReplaceTempView("htmls")
    got = spark.sql("select k, n.* from htmls, lateral html_nodes(h) n order by k, node_id").collect()
    assert [tuple(r)[1:] for r in got if r.k == 1] == want and [r.tag for r in got if r.k == 2] == ["body"]
    assert rows.lateralJoin(sql.html_nodes()(F.col("h").outer())).count() == 8
