from docloom.functions import render
from pyspark.sql import functions as F


def test_pages_and_tables_are_made_once(spark):
    """What makes them stands once in the expression, so no page makes all pages again to know their number."""
    pages = F.transform(F.split("text", "\n"), lambda x, k: F.struct((k + 1).alias("n"), F.split(x, " ").alias("items")))
    rows = spark.createDataFrame([(0, "a  b\n\n \nc"), (1, "one "), (2, ""), (3, None), (4, " \n")], "k int, text string")
    found = render.pages(pages)
    assert str(found).count("split(text") == 1
    got = {r.k: r.m for r in rows.select("k", found.alias("m")).collect()}
    assert got == {0: "## Page 1\n\na b\n\n## Page 4\n\nc", 1: "one", 2: render.NO_PAGES, 3: render.NO_PAGES, 4: render.NO_PAGES}
    assert str(render.table(F.col("rows"))).count("zip_with") == 1
