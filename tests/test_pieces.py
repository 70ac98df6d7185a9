"""Pre-token counts by way of pieces equal those of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import bytelevel as bl
from glyphmill.operators import bpe

TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n    A[Check Order] --> B{Stock Low}\n\n", "it's  don't\t x \r\n y",
    "x  y", "x  y", "　 z", "café é 1 22 ٣ a1", "! ?", "\U0001f600 a \U0001f600", "a <|endoftext|> b", "   \n  ", "tail \n",
]


def test_pieces_hold_the_pretokens_of_the_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    joined = F.flatten(F.transform(bl.pieces(F.col("text")), lambda p: bl.pretokens(p)))
    rows = df.select("text", joined.alias("by_pieces"), bl.pretokens(F.col("text")).alias("whole")).collect()
    assert all(r["by_pieces"] == r["whole"] for r in rows)


def test_frequencies_are_counted_over_pieces(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string")
    whole = df.select(F.explode(bl.pretokens(F.col("text"))).alias("pretoken")).groupBy("pretoken").count()
    assert {tuple(r) for r in bpe.pretoken_frequencies(df).collect()} == {tuple(r) for r in whole.collect()}
