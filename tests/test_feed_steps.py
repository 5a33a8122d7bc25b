"""What a feed does once: vectors are written where they stay, and read once for the lines that end phrases."""

import pytest
from pyspark.sql import functions as F

from gleaner.plans import miner
from gleaner.plans.miner import Miner, Settings
from gleaner.session import small


def log(spark):
    lines = [("f", 86_400 * (i % 3), 0, i, f"Some common words id{i % 40}x of kind{i % 4}") for i in range(400)]
    return spark.createDataFrame(lines, "file string, mtime long, part long, at long, value string")


@pytest.mark.parametrize("frequency", ["", "day"])
def test_vectors_are_written_once(spark, tmp_path, monkeypatch, frequency):
    tables, real, scans = [], miner.written, []
    monkeypatch.setattr(miner, "written", lambda df: tables.append(df.columns) or real(df))
    mined = Miner._mined

    def counted(*args):
        out = mined(*args)
        some = out._some
        out._some = lambda keep: scans.append(1) or some(keep)
        return out

    monkeypatch.setattr(Miner, "_mined", counted)
    m = Miner(spark, str(tmp_path / "store"), Settings(border=50, frequency=frequency, max_blocks=2 if frequency else 0))
    for n in (0, 1):
        m.feed(lines=log(spark).where(F.col("at") % 2 == n))
    assert not [c for c in tables if "tokens" in c and "first" in c] and len(scans) == 2
    kept = 2 if frequency else 1
    assert len(m.store.head()["status"]) == kept and m.store.read("vectors").select("block").distinct().count() == kept
    lines = log(spark).where("mtime > 0") if frequency else log(spark)
    assert m.store.read("vectors").agg(F.sum("w")).first()[0] == lines.count()
    want = {}
    for r in lines.orderBy("mtime", "at").collect():
        want[r.at % 4] = (want.get(r.at % 4, (0,))[0] + 1, r.value)
    assert sorted((r.cnt, r.last_value) for r in m.phrases().collect()) == sorted(want.values())


def test_detection_exchanges_no_lines_but_to_sort_them(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "store"), Settings(border=50))
    m.feed(lines=log(spark).where("at < 200"))
    for custom, least in ([], 0), (["* common * * * kind1"], 60):
        m.settings.custom_phrases = custom
        found = m.detect(lines=log(spark).where("at >= 200"), least=least)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        got = [(r.value, r.cnt) for r in found.collect()]
        lines = [r.value for r in log(spark).where("at >= 200").orderBy("mtime", "at").collect()]
        assert got == [(v, 100) for v in lines]


def test_small_tables_start_no_python_worker(spark):
    df = small(spark, [(1, "a", None), (2, "b", 5)], "x long, y string, z int")
    assert sorted(map(tuple, df.collect())) == [(1, "a", None), (2, "b", 5)]
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert small(spark, [], "x long").count() == 0
