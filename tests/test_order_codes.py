"""Places as longs: what is aggregated by them is hashed, not sorted, and comes out the same."""

from pyspark.sql import functions as F

from gleaner.operators import terms
from gleaner.operators.ledger import Ledger
from gleaner.plans.miner import Miner, Settings
from gleaner.sources.logs import spread

_ROWS = "first struct<seq: struct<a: long, b: int, at: long>>, tokens array<string>, w long"


def rows(*places):
    return [(((a, b, at),), ["x", "y"], 1) for a, b, at in places]


def test_codes_order_as_structs_do(spark):
    places = [(5, 0, 9), (5, 1, -3), (-7, 2, 0), (5, 0, 8), (6, 0, 0)]
    df = spark.createDataFrame(rows(*places), _ROWS)
    (code,) = terms.order_codes(df, "first.seq", room=F.max(F.size("tokens")))
    got = df.select("first.seq.*", code.alias("c")).orderBy("c").collect()
    assert [(r.a, r.b, r.at) for r in got] == sorted(places)
    assert all(y.c - x.c >= 2 for x, y in zip(got, got[1:]))
    far = rows((0, 0, 0), (1 << 40, 1, 1 << 40))
    assert terms.order_codes(spark.createDataFrame(far, _ROWS), "first.seq") is None
    assert terms.order_codes(spark.createDataFrame(rows((1, None, 2)), _ROWS), "first.seq") is None
    assert terms.order_codes(spark.createDataFrame([], _ROWS), "first.seq") is None


def test_terms_of_vectors_are_hashed(spark):
    df = spark.createDataFrame(rows((1, 2, 3), (1, 1, 9)), _ROWS)
    codes = terms.order_codes(df, "first.seq", room=F.max(F.size("tokens")))
    hashed, sorted_ = terms.vector_terms(df, "first.seq", codes[0]), terms.vector_terms(df, "first.seq", None)
    assert "SortAggregate" not in hashed._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in sorted_._jdf.queryExecution().executedPlan().toString()
    order = lambda t: [(r.term, r.cnt) for r in t.orderBy("first").collect()]
    assert order(hashed) == order(sorted_) == [("x", 2), ("y", 2)]


def test_feeds_are_the_same_with_codes_and_without(spark, tmp_path, monkeypatch):
    lines = [("f", 100 + i % 7, i % 3, i, f"Some common words id{i % 40}x of kind{i % 4}") for i in range(400)]
    df = spark.createDataFrame(lines, "file string, mtime long, part long, at long, value string")

    def fed(name):
        m = Miner(spark, str(tmp_path / name), Settings(border=50))
        for n in (0, 1):
            m.feed(lines=df.where(F.col("at") % 2 == n))
        m.remine()
        found = m.detect(lines=df.where("at < 9"))
        return [sorted(map(tuple, t.collect())) for t in (m.phrases(), m.terms(), m.store.read("terms"), found)]

    with_codes = fed("a")
    assert len(with_codes[0]) == 4
    monkeypatch.setattr(terms, "order_codes", lambda *_, **__: None)
    assert fed("b") == with_codes


def test_rows_of_one_place_stay_where_they_are(spark, tmp_path):
    store = Ledger(spark, str(tmp_path))
    df = spark.range(90).repartition(3).select("id", F.lit(7).cast("long").alias("block"), F.lit(2).alias("piece"))
    df._place = (7, 2)
    part = store.write_part("t", df)
    assert part["rows"] == 90 and part["blocks"] == ["7.2"] and part["pieces"] == 2
    assert len(list(tmp_path.glob("t/part=*/block=7/piece=2/*.parquet"))) == 3
    parts, schemas = store.added(store.head(), {"t": part}, {})
    store.commit(store.head(), parts, {"7.2": {"last_epoch": 0, "lines": 90}}, {}, schemas)
    assert sorted(map(tuple, store.read("t").collect())) == [(i, 7, 2) for i in range(90)]


def test_few_partitions_are_dealt(spark):
    """A scan with a partition for each core may have fewer row groups."""
    got = spread(spark.range(0, 1000, 1, 4))
    assert got.rdd.getNumPartitions() == 8 and got.agg(F.sum("id")).first()[0] == 499500
    assert spread(spark.range(0, 1000, 1, 16)).rdd.getNumPartitions() == 16
