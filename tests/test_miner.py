"""Golden results of the log miner."""

import gzip
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner import cli, config
from gleaner.plans.miner import Miner, Settings
from gleaner.sources import logs
from gleaner.streaming import feed

FORMAT = r"^(?P<timestamp>\w+ \d+ \d+:\d+:\d+) (?P<message>.+)$"
LAYOUT = "Jan 2 15:04:05"
NOW = 1735689000  # 2024-12-31


def write(path, lines, mtime):
    path.write_text("".join(x + "\n" for x in lines))
    os.utime(path, (mtime, mtime))
    return str(path)


def comterms(stamp, parts, first):
    words = " ".join(["Comterm1", *(f"comterm{i}" for i in range(2, 9))])
    return [f"{stamp}:{i + 10:02d} {words} part{p:03d} uniq{first + i:03d}" for i, p in enumerate(parts)]


OLD = comterms("Jul 31 20:24", [1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 5, 6, 6, 6, 6, 6], 1)
MORE = comterms("Aug 01 10:24", [7, 7, 8, 8, 8], 21)
NEW = [*comterms("Aug 02 10:24", [7, 7, 9], 31), "Aug 02 10:25:10 Expected that this message never appeared before"]


def settings(**more):
    return Settings(log_format=FORMAT, layout=LAYOUT, **more)


def test_feed_resume_detect(spark, tmp_path):
    old = write(tmp_path / "a.log.1", OLD, 1_722_000_000)
    m = Miner(spark, str(tmp_path / "data"), settings(), now=NOW)
    assert m.feed(old) == {"lines": 20, "border": 2, "phrases": 6}
    words = "comterm1 comterm2 comterm3 comterm4 comterm5 comterm6 comterm7 comterm8"
    assert {r.phrase: r.cnt for r in m.phrases().collect()}[f"{words} part006 *"] == 5
    write(tmp_path / "a.log.2", MORE, 1_722_000_100)
    m = Miner(spark, str(tmp_path / "data"), now=NOW)
    assert m.feed(str(tmp_path / "a.log.*"))["lines"] == 5
    assert m.phrases().count() == 8
    assert m.feed(str(tmp_path / "a.log.*"))["lines"] == 0
    write(tmp_path / "a.log.3", NEW, 1_722_000_200)
    found = m.detect(str(tmp_path / "a.log.*"), rate=0.5).collect()
    assert [r.cnt for r in found] == [28, 28, 28, 1]
    phrase, counts = m.analyze_line(OLD[0])
    assert phrase == f"{words} part001 uniq001" and {r.term: r.cnt for r in counts.collect()}["comterm1"] == 25
    m.clean()
    assert m.phrases().isEmpty()


def test_most_terms(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "data"), settings(max_rate=0.8), now=NOW)
    m.feed(write(tmp_path / "a.log", OLD, 1_722_000_000))
    assert [(r.cnt, r.phrase.split()[-2:]) for r in m.phrases().collect()] == [(20, ["*", "*"])]


def test_top_n(spark, tmp_path):
    new = ["Aug 02 10:24:10 Expected that this message never appeared before", "Aug 02 10:24:11 Comterm1 comterm2 comterm3 Abnormal message with some common words", "Aug 02 10:24:12 comterm4 comterm5 comterm6 Abnormal message"]
    write(tmp_path / "s.1", OLD, 1_722_000_000)
    write(tmp_path / "s.2", new, 1_722_000_100)
    m = Miner(spark, str(tmp_path / "data"), settings(), now=NOW)
    m.feed(str(tmp_path / "s.*"))
    top = m.top_n(10, 20).collect()
    assert len(top) == 9 and top[0].cnt == 1 and top[4].cnt == 4
    assert [round(r.score, 3) for r in top[:5]] == [6.241, 4.213, 3.626, 3.581, 3.549]
    again = m.top_n(10, 20, rate=0.5).collect()
    assert len(again) == 4 and again[3].cnt == 20


def changeable():
    out = []
    for i in range(100):
        u = [f"uniq{4 * i + k:03d}x" for k in range(4)]
        out.append(f"Com1, grp{'abcdefghij'[i // 10]}10 Com2 {u[0]} grp{'ab'[i // 50]}50 {u[1]} <coM3> {u[2]} grp{'abcde'[i // 20]}20 {u[3]}")
    return out


def test_rearranged_and_subjects(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "data"), Settings(min_rate=0.0), now=NOW)
    m.feed(write(tmp_path / "c.log", changeable(), 1_722_000_000))
    assert sorted(r.cnt for r in m.phrases().collect()) == [10] * 10
    for rate, counts in ((0.8, [10] * 10), (0.6, [10, 10, 20, 20, 20, 20]), (0.5, [50, 50])):
        assert sorted(r.cnt for r in m.rearranged(rate).collect()) == counts
    subjects = {r.Member for r in m.output_phrases(0).collect()}
    assert "Com1, grpa10 Com2 * grpa50 * <coM3> * grpa20 *" in subjects
    m.settings.custom_phrases = ["Com1, * Com2 * grpa50 * <coM3> * grpa20 *"]
    got = {r.phrase: r.cnt for r in m.rearranged(border=21).collect()}
    assert sum(got.values()) == 100 and got["com1 * com2 * grpa50 * com3 * grpa20 *"] == 20


HOURLY = [f"2024-09-15 {h:02d}:{i:02d}:00 " + " ".join(f"grp{k}{g}" for k in range(1, 6)) + f" uniq{4 * h + i:03d}" for h, g in ((0, "a"), (1, "b")) for i in range(4)]


def test_blocks_and_history(spark, tmp_path):
    s = Settings(log_format=r"^(?P<timestamp>\d+\-\d+\-\d+ \d+:\d+:\d+)\ (?P<message>.+)$", layout="2006-01-02 15:04:05", frequency="hour", retention=10)
    m = Miner(spark, str(tmp_path / "data"), s, now=NOW)
    m.feed(write(tmp_path / "h.log", HOURLY, 1_726_400_000))
    assert sorted(r.block for r in m.store.read("phrases").select("block").distinct().collect()) == [202425900, 202425901]
    assert [r.Count for r in m.output_phrases().collect()] == [4, 4]
    ranked, grid = m.history()
    rows = grid.collect()
    assert len(ranked) == 2 and [r.time for r in rows] == ["2024-09-15 00", "2024-09-15 01"]
    assert Counter(x for r in rows for x in r[1:]) == {4: 2, None: 2}


def test_retention_keeps_recent_days(spark, tmp_path):
    days = [f"Jul {d} 10:{i:02d}:01 year2024 month01 day{d} t10{i:02d}01" for d, n in zip(range(10, 16), (2, 4, 2, 1, 1, 1)) for i in range(n)]
    m = Miner(spark, str(tmp_path / "data"), settings(frequency="day", retention=5), now=NOW)
    m.feed(write(tmp_path / "y.log", days, 1_722_000_000))
    assert m.store.read("phrases").select("block").distinct().count() == 5


def test_keywords_and_ignorewords(spark, tmp_path):
    s = Settings(keywords=["uniq003", "uniq007"], ignorewords=["grp1a", "grp1b"], border=4)
    m = Miner(spark, str(tmp_path / "data"), s, now=NOW)
    m.feed(write(tmp_path / "k.log", [x[20:] for x in HOURLY], 1_722_000_000))
    got = {r.phrase for r in m.phrases().collect()}
    assert "* grp2b grp3b grp4b grp5b uniq007" in got and len(got) == 4


def test_filters_and_command_line(spark, tmp_path, capsys):
    lines = [f"Aug 01 1{i % 10}:00:20 [{100 + i}][ERROR] MariaDB connection refused by server PID={100 + i}" for i in range(7)]
    lines += ["Aug 01 12:00:20 [200][ERROR] deadlock found while waiting for lock PID=200", "Aug 01 12:01:20 [201][ERROR] this always occurs", "Aug 01 12:02:20 [202][INFO] started"]
    path = write(tmp_path / "v.log", lines, 1_722_000_000)
    (tmp_path / "c.yaml").write_text(f"dataDir: '{tmp_path}/data'\nlogPath: {path}\nsearchString:\n  - ERROR\nexcludeString:\n  - always\nlogFormat: '{FORMAT}'\ntimestampLayout: '{LAYOUT}'\n")
    assert cli.main(["-c", str(tmp_path / "c.yaml"), "-m", "topN", "-N", "5", "-M", "10"]) == 0
    out = [x for x in capsys.readouterr().out.splitlines() if x]
    assert sorted(int(x.split(",")[0]) for x in out) == [1, 7]
    assert cli.main(["-d", f"{tmp_path}/data", "-m", "outputPhrases", "-o", f"{tmp_path}/p.csv", "-delim", ";"]) == 0
    assert (tmp_path / "p.csv").read_text().splitlines()[0] == "Created;Updated;Count;Member"
    for _ in range(2):
        assert cli.main(["-d", f"{tmp_path}/data", "-m", "outputPhrases", "-silent"]) == 0
    assert capsys.readouterr().out.count("Created,Updated,Count,Member") == 2
    assert cli.main(["-d", f"{tmp_path}/data", "-m", "outputPhrases", "-b", "8", "-o", f"{tmp_path}/q.csv"]) == 0
    assert len((tmp_path / "q.csv").read_text().splitlines()) <= len((tmp_path / "p.csv").read_text().splitlines())
    assert cli.main(["-d", f"{tmp_path}/data", "-m", "outputPhrasesHistory", "-o", f"{tmp_path}/h"]) == 0
    assert (tmp_path / "h" / "history.csv").read_text().splitlines()[0] == "time,1(7),2(1)"
    assert [x.split(",")[0] for x in (tmp_path / "h" / "subjects.txt").read_text().splitlines()] == ["1(7)", "2(1)"]


def test_feed_counts_wholly_or_not_at_all(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "a.log.1", OLD, 1_722_000_000)
    m = Miner(spark, str(tmp_path / "data"), settings(), now=NOW)
    m.feed(path)
    write(tmp_path / "a.log.2", MORE, 1_722_000_100)
    both = str(tmp_path / "a.log.*")
    whole = m.store.write_part
    for broken in ("terms", "phrases"):

        def fails(table, df, broken=broken):
            if table == broken:
                raise OSError("lost")
            return whole(table, df)

        monkeypatch.setattr(m.store, "write_part", fails)
        with pytest.raises(OSError):
            m.feed(both)
        assert m.phrases().agg(F.sum("cnt")).first()[0] == 20 and m.status()["feeds"] == 1
    monkeypatch.setattr(m.store, "write_part", whole)
    monkeypatch.setattr(m.store, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        m.feed(both)
    monkeypatch.undo()
    assert m.phrases().agg(F.sum("cnt")).first()[0] == 20
    assert m.feed(both)["lines"] == 5
    assert m.phrases().agg(F.sum("cnt")).first()[0] == 25 and m.terms().where("term = 'comterm1'").first().cnt == 25
    assert m.store.vacuum() > 0 and m.phrases().agg(F.sum("cnt")).first()[0] == 25
    with pytest.raises(RuntimeError):
        m.store.commit({"number": m.store.head()["number"] - 1}, {}, {}, {})


def test_batches_of_a_stream_count_once(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "data"), settings(), now=NOW)
    lines = logs.lines_of(spark, OLD)
    assert [m.feed(lines=lines, batch_of=("s", k))["lines"] for k in (0, 0, 1, 0)] == [20, 0, 20, 0]
    assert m.phrases().agg(F.sum("cnt")).first()[0] == 40


def test_parts_are_folded_and_pruned(spark, tmp_path, monkeypatch):
    from gleaner.plans import miner as module

    monkeypatch.setattr(module, "MOST_PARTS", 2)
    s = Settings(log_format=r"^(?P<timestamp>\d+\-\d+\-\d+ \d+:\d+:\d+)\ (?P<message>.+)$", layout="2006-01-02 15:04:05", frequency="hour")
    m = Miner(spark, str(tmp_path / "data"), s, now=NOW)
    for k in range(4):
        m.feed(lines=logs.lines_of(spark, HOURLY[2 * k : 2 * k + 2]))
    assert len(m.store.head()["parts"]["terms"]) <= 2
    assert m.terms().where("term = 'grp1a'").first().cnt == 4 and m.phrases().agg(F.sum("cnt")).first()[0] == 8
    assert [(r.block, r.lines, r.completed) for r in m.store.status().orderBy("block").collect()] == [(202425900, 4, True), (202425901, 4, False)]
    assert m.store.current("terms").where("term = 'grp1a'").isEmpty() and m.sizing() == (10_000, 1)
    plan = m.store.read("terms", [202425901])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "202425901" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_config_substitution(tmp_path, monkeypatch):
    monkeypatch.setenv("GLEANER_HOME", "/x")
    monkeypatch.delenv("GLEANER_NONE", raising=False)
    (tmp_path / "c.yaml").write_text("dataDir: '{{ GLEANER_HOME }}/d{{ GLEANER_NONE }}'\nretention: 5\nexcludeString:\n- a\n- b\n")
    assert config.load(str(tmp_path / "c.yaml")) == {"dataDir": "/x/d", "retention": 5, "excludeString": ["a", "b"]}


def test_files_in_order(spark, tmp_path):
    with gzip.open(tmp_path / "s.log.1.gz", "wt") as f:
        f.write("001\n002\r\n003\n")
    os.utime(tmp_path / "s.log.1.gz", (1000, 1000))
    write(tmp_path / "s.log", [f"{i:03d}" for i in range(4, 13)], 2000)
    lines = logs.numbered(logs.read_lines(spark, str(tmp_path / "s.log*")))
    got = lines.orderBy("mtime", "file", "line_no").collect()
    assert [r.value for r in got] == [f"{i:03d}" for i in range(1, 13)]
    assert [r.line_no for r in got] == [1, 2, 3, *range(1, 10)]
    assert logs.select_new(lines, 2000, got[-1].file, 4).count() == 5
    assert logs.select_new(lines, 1000, got[0].file, 2).count() == 10
    assert [r.n for r in logs.count_files(lines).orderBy("mtime").collect()] == [3, 9]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.log", OLD, 1_722_000_000)
    m = Miner(spark, str(tmp_path / "data"), settings(), now=NOW)
    q = feed.stream(m, str(tmp_path / "in"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert m.phrases().agg(F.sum("cnt")).first()[0] == 20


@pytest.mark.parametrize("word,pattern", [("Jan _2 15:04:05", "MMM d HH:mm:ss"), ("2006-01-02T15:04:05", "yyyy-MM-dd'T'HH:mm:ss")])
def test_layouts(word, pattern):
    from gleaner.functions.parse import java_layout

    assert java_layout(word) == (pattern, "")


def test_timestamps(spark):
    from gleaner.functions.parse import epoch

    rows = [("Jul  1 10:00:00", "2024-07-01 10:00:00"), ("Dec 31 10:00:00", "2023-12-31 10:00:00"), ("Feb 29 01:02:03", "2024-02-29 01:02:03"), ("nonsense", None)]
    now = F.to_timestamp(F.lit("2024-08-01 00:00:00"))
    got = spark.createDataFrame(rows, "t string, want string").select(F.timestamp_seconds(epoch(F.col("t"), "Jan 2 15:04:05", now)).cast("string").alias("g"), "want")
    assert [(r.g, r.want) for r in got.collect()] == [(w, w) for _, w in rows]


STOPS = ["a an the", "- ; the", "a"]


def test_feed_of_stop_words_and_of_old_lines(spark, tmp_path):
    """Batches that leave no terms, or that are wholly older than retention, count nothing and pass."""
    m = Miner(spark, str(tmp_path / "a"), settings(), now=NOW)
    assert m.feed(lines=logs.lines_of(spark, STOPS), batch_of=("s", 0))["lines"] == 3
    assert m.terms().isEmpty() and m.phrases().agg(F.sum("cnt")).first()[0] == 3
    assert m.feed(lines=logs.lines_of(spark, []), batch_of=("s", 1)) == {"lines": 0, "border": 0, "phrases": 0}
    assert m.feed(lines=logs.lines_of(spark, OLD), batch_of=("s", 2))["lines"] == 20
    s = Settings(log_format=r"^(?P<timestamp>\d+\-\d+\-\d+ \d+:\d+:\d+)\ (?P<message>.+)$", layout="2006-01-02 15:04:05", frequency="hour", retention=3)
    m = Miner(spark, str(tmp_path / "b"), s, now=NOW)
    m.feed(lines=logs.lines_of(spark, HOURLY), batch_of=("s", 0))
    old = [x.replace("2024-09-15 0", "2024-09-14 0") for x in HOURLY]
    for _ in range(2):
        m.feed(lines=logs.lines_of(spark, old), batch_of=("s", 1))
    assert m.store.head()["state"]["batches"] == {"s": 1} and m.terms().where("term = 'grp1a'").first().cnt == 4
    assert {r.block for r in m.store.status().collect()} == {202425900, 202425901}
    tables = m.store.tables()
    assert tables["terms"].names == ["term", "cnt", "block", "piece"] and set(tables) == {"vectors", "terms", "phrases", "term_totals", "phrase_totals"}


def test_stream_of_stop_words(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.log", STOPS, 1_722_000_000)
    m = Miner(spark, str(tmp_path / "data"), settings(), now=NOW)
    feed.stream(m, str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination(120)
    write(tmp_path / "in" / "b.log", OLD, 1_722_000_100)
    feed.stream(m, str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination(120)
    assert m.phrases().agg(F.sum("cnt")).first()[0] == 23


def scanned(df):
    return sorted(x.rsplit("/", 1)[1] for x in df.inputFiles())


def test_only_new_files_are_read(spark, tmp_path):
    for i in range(30):
        write(tmp_path / f"o{i:02d}.log", OLD[:2], 1_722_000_000 + i)
    m = Miner(spark, str(tmp_path / "data"), settings(), now=NOW)
    every = str(tmp_path / "*.log")
    assert m.feed(every)["lines"] == 60
    write(tmp_path / "new [1].log", MORE, 1_722_000_500)
    new = m.new_lines(every)
    assert scanned(new) == ["new%20%5B1%5D.log", "o29.log"] and new.count() == 5
    assert m.feed(every)["lines"] == 5 and m.feed(every)["lines"] == 0


def test_files_that_grow_and_are_renamed(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "data"), settings(), now=NOW)
    every = str(tmp_path / "app.log*")
    write(tmp_path / "app.log", OLD[:8], 1_722_000_000)
    assert m.feed(every)["lines"] == 8
    write(tmp_path / "app.log", OLD[:12], 1_722_000_100)
    assert m.feed(every)["lines"] == 4
    (tmp_path / "app.log").rename(tmp_path / "app.log.1")
    write(tmp_path / "app.log.1", OLD, 1_722_000_200)
    write(tmp_path / "app.log", MORE, 1_722_000_300)
    assert sorted(r.value for r in m.new_lines(every).collect()) == sorted(OLD[12:] + MORE)
    assert m.feed(every, limit=10)["lines"] == 10
    assert m.feed(every)["lines"] == 3
    assert m.phrases().agg(F.sum("cnt")).first()[0] == 25


def test_line_limit_takes_first_lines(spark, tmp_path):
    for i, n in enumerate((3, 0, 7, 4)):
        write(tmp_path / f"{i}.log", [f"{i}-{k}" for k in range(n)], 1_722_000_000 + i)
    lines = logs.read_lines(spark, str(tmp_path / "*.log"))
    everything = [f"{i}-{k}" for i, n in enumerate((3, 0, 7, 4)) for k in range(n)]
    for limit in (1, 3, 5, 10, 13, 14, 99):
        assert sorted(r.value for r in logs.first_lines(lines, limit).collect()) == everything[:limit]


def hourly(hours, per=6):
    return [f"2024-09-{15 + h // 24} {h % 24:02d}:{i:02d}:00 common words here grp{h % 3} item{(h * per + i) % 11}" for h in hours for i in range(per)]


STAMPED = {"log_format": r"^(?P<timestamp>\d+\-\d+\-\d+ \d+:\d+:\d+)\ (?P<message>.+)$", "layout": "2006-01-02 15:04:05"}


def test_totals_by_difference_equal_recomputation(spark, tmp_path, monkeypatch):
    from gleaner.plans import miner as module

    monkeypatch.setattr(module, "MOST_PARTS", 3)
    s = Settings(**STAMPED, frequency="hour", max_blocks=3)
    m = Miner(spark, str(tmp_path / "data"), s, now=NOW)
    ids = {}
    for hours in ([0, 1], [2, 3], [3, 4, 1], [5], [6, 7, 8, 9]):
        m.feed(lines=logs.lines_of(spark, hourly(hours)))
        for table, key in (("terms", "term"), ("phrases", "phrase")):
            again = {r[key]: r.n for r in m.store.read(table).groupBy(key).agg(F.sum("cnt").alias("n")).collect()}
            assert {r[key]: r.cnt for r in getattr(m, table)().collect()} == again
        now = {r.term: r.first for r in m.terms().collect()}
        assert all(ids.get(t, i) == i for t, i in now.items()) and len(set(now.values())) == len(now)
        ids |= now
        assert m.store.status().count() <= 3
    last = {r.phrase: r.updated for r in m.phrases().collect()}
    assert last == {r.phrase: r.u for r in m.store.read("phrases").groupBy("phrase").agg(F.max("updated").alias("u")).collect()}


def test_a_feed_reads_no_history(spark, tmp_path, monkeypatch):
    """No folder of an old block's terms, phrases or vectors is read, but for one that the ring drops."""
    m = Miner(spark, str(tmp_path / "data"), Settings(**STAMPED, frequency="hour"), now=NOW)
    m.feed(lines=logs.lines_of(spark, hourly([0])))
    read, whole = [], m.store.read
    monkeypatch.setattr(m.store, "read", lambda table, *a, **b: read.append(table) or whole(table, *a, **b))
    m.feed(lines=logs.lines_of(spark, hourly([1])))
    assert set(read) == {"term_totals", "phrase_totals"}


def test_rotation_by_size(spark, tmp_path):
    def expected(batches, size):
        seen, fresh, piece, out = set(), 0, 0, []
        for lines in batches:
            for x in lines:
                if fresh >= size:
                    fresh, piece = 0, piece + 1
                if x not in seen:
                    seen.add(x)
                    fresh += 1
                out.append((x, piece))
        return Counter(out)

    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    batches = [[f"{words[i % 3]} {words[i // 3 % 7]} {words[i % 5]}" for i in range(n, n + 17)] for n in (0, 17, 3, 60)]
    m = Miner(spark, str(tmp_path / "data"), Settings(block_size=4, border=1), now=NOW)
    for lines in batches:
        m.feed(lines=logs.lines_of(spark, lines))
    got = Counter({(r.phrase, r.piece): r.n for r in m.store.read("phrases").groupBy("phrase", "piece").agg(F.sum("cnt").alias("n")).collect()})
    assert got == expected(batches, 4) and max(p for _, p in got) > 2
    status = m.store.status().orderBy("piece").collect()
    assert sum(r.lines for r in status) == 68 and all(r.fresh == 4 for r in status[:-1])
    newest = {(r.block, r.piece) for r in m.store.current("phrases").select("block", "piece").distinct().collect()}
    assert newest == {(0, status[-1].piece)}


@pytest.mark.parametrize("most,size", [(2999, 10_000), (3000, 100_000), (30_000, 100_000), (300_000, 1_000_000)])
def test_sizes_are_chosen_by_the_first_feed(spark, tmp_path, most, size):
    m = Miner(spark, str(tmp_path / "data"), Settings(**STAMPED, frequency="day", retention=4), now=NOW)
    lines = spark.range(most).select(
        F.lit("").alias("file"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("part"), F.col("id").alias("at"), F.lit("2024-09-15 10:00:00 some words here").alias("value")
    )
    m.feed(lines=lines)
    assert Miner(spark, str(tmp_path / "data")).sizes() == (size, -(-most // size) * 4)


def test_remine_equals_one_feed(spark, tmp_path):
    lines = ["alpha beta gamma one", "alpha beta gamma two", "alpha beta gamma three", "alpha beta gamma four"]
    one = Miner(spark, str(tmp_path / "one"), Settings(border=2), now=NOW)
    one.feed(lines=logs.lines_of(spark, lines))
    many = Miner(spark, str(tmp_path / "many"), Settings(border=2), now=NOW)
    for k, x in enumerate(lines):
        many.feed(lines=logs.lines_of(spark, [x]).withColumn("part", F.lit(k).cast("long")))
    rows = lambda m: sorted(map(tuple, m.phrases().collect()))
    assert rows(one) != rows(many)
    assert many.remine()["phrases"] == 1
    assert rows(one) == rows(many) and many.terms().count() == one.terms().count()
    many.feed(lines=logs.lines_of(spark, lines[:1]))
    assert many.phrases().agg(F.sum("cnt")).first()[0] == 5


def test_detect_counts_custom_phrases(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "data"), Settings(custom_phrases=["alpha * gamma"], border=1), now=NOW)
    m.feed(lines=logs.lines_of(spark, ["alpha one gamma", "alpha two gamma", "alpha three gamma", "other words here"]))
    found = m.detect(lines=logs.lines_of(spark, ["alpha four gamma", "other words here", "alpha five delta"])).collect()
    assert [(r.phrase, r.cnt) for r in found] == [("alpha * gamma", 4), ("other words here", 2), ("alpha five delta", 1)]


def test_history_of_many_phrases(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "data"), Settings(**STAMPED, frequency="hour", border=1), now=NOW)
    m.feed(lines=logs.lines_of(spark, hourly([0, 1, 3])))
    cli.history(m, 0, str(tmp_path / "h"), ";")
    rows = [x.split(";") for x in (tmp_path / "h" / "history.csv").read_text().splitlines()]
    subjects = (tmp_path / "h" / "subjects.txt").read_text().splitlines()
    assert len({len(r) for r in rows}) == 1 and len(rows[0]) == 1 + len(subjects) and [r[0] for r in rows[1:]] == [f"2024-09-15 0{h}" for h in range(4)]
    _, grid = m.history(0)
    assert rows[1:] == [[r[0], *("" if x is None else str(x) for x in r[1:])] for r in grid.collect()]


def test_history_and_phrases_of_tasks(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "data"), Settings(**STAMPED, frequency="hour", border=1), now=NOW)
    m.feed(lines=logs.lines_of(spark, hourly([0, 1, 3])))
    cli.history(m, 0, str(tmp_path / "h"), ";")
    cli.history(m, 0, f"file://{tmp_path}/t", ";")
    read = lambda name: [r.value for r in logs.read_lines(spark, f"{tmp_path}/t/{name}").orderBy("file", "at").collect()]
    for name in ("history.csv", "subjects.txt"):
        assert read(name) == (tmp_path / "h" / name).read_text().splitlines()
    assert cli.main(["-d", f"{tmp_path}/data", "-m", "outputPhrases", "-o", f"file://{tmp_path}/p"]) == 0
    rows = [tuple(map(str, r)) for r in m.output_phrases(0).collect()]
    assert [tuple(r) for r in logs.read_table(spark, f"{tmp_path}/p").orderBy(F.desc("Count"), "Member").collect()] == sorted(rows, key=lambda r: (-int(r[2]), r[3]))


def test_csv_keeps_quotes_and_spaces(spark, tmp_path):
    rows = [(1, ' a "b", \\ c '), (2, "x;y"), (3, "")]
    logs.write_table(spark.createDataFrame(rows, "i int, t string"), str(tmp_path / "c"))
    assert [(int(r.i), r.t or "") for r in logs.read_table(spark, str(tmp_path / "c")).orderBy("i").collect()] == rows


@pytest.mark.parametrize("n", [0, 1, 7])
def test_standard_input_in_chunks(spark, tmp_path, n):
    texts = (f"line {i} of\r\n" for i in range(n))
    got = logs.spooled(spark, texts, str(tmp_path / "in"), chunk=3).orderBy("mtime", "file", "part", "at").collect()
    assert [r.value for r in got] == [f"line {i} of" for i in range(n)]
    assert [r.part for r in got] == [i // 3 for i in range(n)]


def test_a_new_store_has_totals_that_are_planned_as_empty(spark, tmp_path):
    m = Miner(spark, str(tmp_path / "new"))
    for t, columns in ((m.terms(), ["term", "cnt", "first"]), (m.phrases(), ["phrase", "cnt", "created", "updated", "last_value", "subject"])):
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert t.columns == columns and plan.startswith("LocalRelation <empty>") and t.count() == 0
