"""Tables, counts and templates: fixtures, brute force, and all queries against DuckDB."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.functions import scalars
from gleaner.functions.tokens import tokens
from gleaner.operators import mining, ring, table, terms
from gleaner.plans import log_queries

DATA = "/root/testdata/sf0.001"


def test_table_changes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"user{i}", f"class{i % 3}") for i in range(1, 8)], "id int, name string, class string")
    assert table.total(df, "id").first()[0] == 28
    assert table.extremes(df, "id", F.col("id") < 6).first()["most"] == 5
    assert table.extremes(df, "id", F.col("id") > 1).first()["least"] == 2
    assert tuple(table.extremes(df, "id", F.col("id") > 100).first()) == (0, 0)
    left = table.delete(df, (F.col("class") == "class1") & (F.col("id") < 5) | (F.col("name") == "user7"))
    assert left.count() == 4
    assert table.upsert(left, {"id": 50, "name": "n"}, F.col("id") == 50).where("class = ''").count() == 1
    assert table.upsert(left, {"name": "n"}, F.col("id") == 2).where("name = 'n'").count() == 1
    assert table.delete(left).isEmpty()
    with pytest.raises(LookupError):
        table.first_match(df, F.col("id") == 99)
    store = table.Store(spark, str(tmp_path / "db"))
    store.create("t", "id int, name string, class string")
    with pytest.raises(ValueError):
        store.create("t", "id int")
    store.append("t", df)
    store.write("t", table.update(store.read("t"), {"name": "x"}, F.col("id") <= 2))
    assert store.read("t").where("name = 'x'").count() == 2
    store.truncate("t")
    assert store.read("t").isEmpty() and store.tables("t") == ["t"]
    store.drop("t")
    assert not store.exists("t")


def test_order_by(spark):
    rows = [(1, 9, 1.1), (2, 9, 2.1), (3, 9, 3.1), (4, 8, 3.2), (5, 8, 2.2), (6, 8, 1.2), (7, 7, 2.3), (8, 7, 3.3), (9, 7, 1.3)]
    df = spark.createDataFrame(rows, "id int, a int, b double")
    up = table.order_by(df, ["a", "b"], ["int", "float64"])
    down = table.order_by(df, ["a", "b"], ["int", "float64"], descending=True)
    assert [r.id for r in up.collect()] == [9, 7, 8, 6, 5, 4, 1, 2, 3]
    assert [r.id for r in down.collect()] == [3, 2, 1, 4, 5, 6, 8, 7, 9]


def test_border(spark):
    df = spark.createDataFrame([(f"t{i}", c) for i, c in enumerate([5, 5, 5, 2, 2] + [1] * 6)], "term string, cnt int")
    assert terms.border_of(df, 0.1) == 5 and terms.border_of(df, 0.9) == 2 and terms.border_of(df, 0.9, 7) == 7
    assert terms.border_of(df.limit(0), 0.5) == 0


def test_scalars(spark):
    row = spark.sql("select 1.25D x, -1.25D y, 2.0D z").select(
        scalars.round_away(F.col("x"), 1), scalars.round_away(F.col("y"), 1), scalars.round_away(F.col("z")), scalars.round_down(F.col("y"), 1),
        scalars.to_long(F.lit("x")), scalars.is_int(F.lit("012")), scalars.is_int(F.lit("0")), scalars.is_numeric(F.lit("1e3")),
    ).first()
    assert tuple(row) == (1.3, -1.3, 3.0, -1.2, 0, False, True, True)


def test_tokens(spark):
    line = r"The A the: ERROR. x=12345 code 404 0123 é ab\nlong.. [Über] . a"
    got = spark.createDataFrame([(line,)], "v string").select(tokens(F.col("v"), ["a"], ["code"])).first()[0]
    assert got == ["the", "*", "error", "*", "404", "0123", "long.", "über", "*", "a"]


def brute_templates(lines, border, min_rate, max_rate):
    """A plain statement of the rules, a line at a time."""
    cnt, first = Counter(), {}
    for i, line in enumerate(lines):
        for j, t in enumerate(line):
            if t != "*":
                cnt[t] += 1
                first.setdefault(t, (i, j))
    tree, paths = Counter(), []
    for line in lines:
        path = sorted((t for t in line if t != "*"), key=lambda t: (-cnt[t], first[t]))
        paths.append(path)
        for k in range(len(path)):
            tree[tuple(path[: k + 1])] += 1
    out = []
    for line, path in zip(lines, paths):
        n = len(line)
        least, most = 3, 0
        if n > 3:
            least = int(n * min_rate) if min_rate > 0 else 3
            most = int(n * max_rate)
        search, stop, low = least or 3, -1, cnt[path[-1]] if path else 0
        for k in range(n):
            before = cnt[path[k - 1]] if k else 0
            if k >= len(path):
                stop, low = k, before
                break
            if (tree[tuple(path[: k + 1])] <= 1 or cnt[path[k]] < border) and k + 1 > search:
                stop, low = k, before
                break
            if most >= search and k + 1 >= most:
                stop, low = k, cnt[path[k]]
                break
        kept = [t if t != "*" and cnt[t] >= low and cnt[t] >= border else "*" for t in line]
        use = stop >= least and sum(t != "*" for t in kept) >= least
        out.append(" ".join(kept if use else line))
    return out


@pytest.mark.parametrize("seed,min_rate,max_rate", [(1, 0.6, 0.0), (2, 0.5, 0.8), (3, 0.0, 0.9), (4, 0.2, 0.0)])
def test_templates_match_brute_force(spark, seed, min_rate, max_rate):
    rng = random.Random(seed)
    lines = [[rng.choice(["*", *(f"t{int(rng.expovariate(0.25))}" for _ in range(6))]) for _ in range(rng.randint(1, 9))] for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, tokens array<string>")
    found = mining.mine(df, terms.term_counts(df), 4, min_rate, max_rate)
    got = df.join(found.drop("w"), "tokens").orderBy("seq").collect()
    assert [r.phrase for r in got] == brute_templates(lines, 4, min_rate, max_rate)


def test_ring_sizing():
    assert ring.sizing(2999, 3) == (10_000, 3) and ring.sizing(30_000, 2) == (100_000, 2) and ring.sizing(2_500_000, 2) == (1_000_000, 6)


def test_retained(spark):
    b = spark.createDataFrame([(i, 1722438000 + 86400 * i) for i in range(5)], "block_seq long, last_epoch long")
    assert sorted(r.block_seq for r in ring.retained(b, 3, "day").collect()) == [2, 3, 4]


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return Counter(tuple(None if x is None or x != x else float(x) if isinstance(x, (int, float)) else x for x in r) for r in df.values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(log_queries.QUERIES))
def test_queries_match_duckdb(spark, duck, name):
    got = log_queries.QUERIES[name](spark, DATA).toPandas()
    if name in log_queries.ORACLE_SQL:
        assert _rows(got) == _rows(duck.execute(log_queries.ORACLE_SQL[name]).df())
    else:
        assert len(got)
