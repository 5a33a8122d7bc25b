"""Vectors that differ in rare terms only are mined as one pattern; many pieces are one flat filter."""

from pyspark.sql import functions as F

from gleaner.operators import mining, terms
from gleaner.operators.ledger import among


def test_vectors_that_differ_in_rare_terms_are_one_pattern(spark, monkeypatch):
    lines = [["some", "common", "words", f"id{i}"] for i in range(100)] + [["lone"], []]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, tokens array<string>")
    mined, real = [], mining.ordered
    monkeypatch.setattr(mining, "ordered", lambda vecs, *more: mined.append(vecs.count()) or real(vecs, *more))
    for most in (mining.MOST_LISTED, 0):  # common terms in a list, and by a join
        monkeypatch.setattr(mining, "MOST_LISTED", most)
        found = mining.mine(df, terms.term_counts(df), 50).collect()
        assert len(found) == 102 and {r.phrase for r in found} == {"some common words *", "lone", ""}
        assert {tuple(r.hidden) for r in found} == {(f"id{i}",) for i in range(100)} | {()}
    assert mined == [3, 3]


def test_many_pieces_are_a_flat_filter(spark):
    rows = spark.range(4000).select(F.lit(0).cast("long").alias("block"), F.col("id").cast("int").alias("piece"))
    assert rows.where(among([(0, p) for p in range(0, 4000, 2)] + [(1, 1)])).count() == 2000
