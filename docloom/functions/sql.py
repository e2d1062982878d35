"""The converters as SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docloom.functions import render, text

NODES = "node_id int, parent_id int, tag string, text string, attrs map<string,string>"


class HtmlNodes:
    """html_nodes(html): a row for each element and text of the body, in document order; a null or empty text has the body alone."""

    def eval(self, html: str):
        from docloom.sources.html import nodes

        yield from nodes(html or "")


def html_nodes():
    """The table function itself, for `DataFrame.lateralJoin(html_nodes()(F.col("html").outer()))`."""
    return F.udtf(HtmlNodes, returnType=NODES, useArrow=True)


#: Strings, which stay, and operators that are called like functions.
_TOKENS = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`'])(<=>|[<>=!]=|[-+*/%<>=!&|^~]|and|or|not)(?=\()", re.S)


def as_sql(column: Column) -> str:
    """The SQL text of a column expression, so that a function of SQL and one of columns are one expression."""
    return _TOKENS.sub(lambda m: m[0] if m[1] is None else f"`{m[1]}`", column._jc.node().sql())


def register(spark: SparkSession, llm=None, registry=None) -> None:
    """The functions below for SQL. What they compute natively is taken from the column functions of the same names.

    html_to_markdown, markdown_to_html, normalize_markdown, html_blocks; the table function html_nodes; and
    convert_document(filename, content, declared), a struct of what `converted` adds for one document, by the
    converters of `registry` (the built-in ones). Spark 4.1 can't plan the latter right above a UNION. describe_image and transcribe_audio call the methods of those names
    of `llm`; without one they fail.
    """
    from docloom.functions import detect
    from docloom.operators import convert
    from docloom.operators.preview import to_html
    from docloom.operators.registry import UNSUPPORTED, builtins
    from docloom.sources.html import blocks

    registry = registry or builtins()
    spark.udf.register("html_blocks", convert.each_row(lambda h: None if h is None else blocks(h), render.BLOCKS))
    spark.udf.register("markdown_to_html", convert.each_row(lambda m: None if m is None else to_html(m), "string"))
    spark.udf.register("read_document", convert._reader(registry, 300, 2048))
    llm = llm or convert.UnconfiguredLLM()
    for name in ("describe_image", "transcribe_audio"):
        spark.udf.register(name, F.udf(lambda data, ask=getattr(llm, name): None if data is None else ask(bytes(data)), "string", useArrow=True))
    spark.udtf.register("html_nodes", html_nodes())

    col, name = F.col, F.coalesce(F.col("filename"), F.lit(""))
    outcome = convert.document(col("parsed"), col("filename"))
    tried = F.size("candidates") > 0
    kind = F.when(tried & col("has_content"), outcome["error_kind"]).otherwise("UnsupportedFormatException")
    error = F.when(tried & col("has_content"), outcome["error"]).otherwise(UNSUPPORTED)
    markdown = outcome["markdown"]
    made = F.struct(
        detect.extension(name).alias("extension"), detect.mimetype(name, col("declared")).alias("mimetype"), outcome["converter"].alias("converter"), markdown.alias("markdown"), outcome["title"].alias("title"),
        kind.alias("error_kind"), error.alias("error"), F.coalesce(outcome["attempts"], F.array().cast("array<struct<converter:string,error:string>>")).alias("attempts"), convert.status(markdown, error).alias("status"),
    )
    parsed = f"struct<{', '.join(f'{c}:{t}' for c, t in _fields(convert.PARSED))}>"
    result = "struct<extension:string,mimetype:string,converter:string,markdown:string,title:string,error_kind:string,error:string,attempts:array<struct<converter:string,error:string>>,status:string>"
    for function, arguments, returns, body in (
        ("normalize_markdown", "m string", "string", as_sql(text.normalize(col("m")))),
        ("blocks_to_markdown", f"b {render.BLOCKS}", "string", as_sql(render.blocks(col("b")))),
        ("html_to_markdown", "h string", "string", "normalize_markdown(blocks_to_markdown(html_blocks(h)))"),
        ("document_candidates", "filename string, declared string", "array<string>", as_sql(registry.candidates(detect.extension(name), detect.mimetype(name, col("declared"))))),
        ("document_outcome", f"filename string, declared string, candidates array<string>, has_content boolean, parsed {parsed}", result, as_sql(made)),
        ("convert_candidates", "filename string, content binary, declared string, candidates array<string>", result, "document_outcome(filename, declared, candidates, content is not null, read_document(if(content is null, cast(array() as array<string>), candidates), coalesce(content, x''), cast(null as string)))"),
        ("convert_document", "filename string, content binary, declared string", result, "convert_candidates(filename, content, declared, document_candidates(filename, declared))"),
    ):
        spark.sql(f"create or replace temporary function {function}({arguments}) returns {returns} return {body}")


def _fields(ddl: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl).fields]
