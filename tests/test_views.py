"""Texts as bases."""

from pyspark.sql import functions as F

from strandweave import views


def test_letters_become_bases_without_a_pattern(spark, capsys):
    texts = ["abcXYZ", "KKſé z-9\n", "", None, "\U0001f600a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    made = rows.select("i", views.to_bases("text").alias("seq"))
    made.explain()
    assert "regexp" not in capsys.readouterr().out
    plain = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), views.LETTERS, views.BASES)
    want = rows.select("i", plain.alias("seq"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
