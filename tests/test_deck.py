import os

import pytest
from pyspark.sql import functions as F

from docloom.functions import render
from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't here")
def test_decks_have_the_text_of_every_turn(spark):
    lines = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    decks = catalogue.queries()["deck_markdown"](spark, SF)
    assert lines.join(decks, "conv_id").where(~F.contains("markdown", F.trim("line"))).isEmpty()


def test_empty_slides_and_decks(spark):
    deck = "array(struct('ppt/slides/slide2.xml' as name, array('a ') as texts), struct('ppt/slides/slide10.xml' as name, array(' ', '') as texts))"
    rows = spark.sql(f"select {deck} as full, slice({deck}, 2, 1) as blank").select(render.deck(F.col("full")).alias("full"), render.deck(F.col("blank")).alias("blank")).first()
    assert rows.full == "## Slide 2\n\na" and rows.blank == render.NO_SLIDES
