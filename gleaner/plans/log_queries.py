"""Queries over log-shaped views of the driver tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import cli, config
from gleaner.functions import parse, scalars
from gleaner.functions import tokens as tk
from gleaner.operators import mining, ring, table, terms
from gleaner.plans.miner import Miner, Settings
from gleaner.session import scratch, written
from gleaner.sources import logs
from gleaner.sources.logs import spread

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_lines(spark, sf):
    """L1: one line for each event, with its time as text."""
    ts = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(ts, F.lit(" "), F.col("event_type"), F.lit(" user"), F.col("user_id"), F.lit(" props "), F.col("props"))
    events = spread(_t(spark, sf, "events").select("event_id", "ts", "event_type", "user_id", "props"))
    return events.select(F.col("event_id").alias("seq"), line.alias("value"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))


def document_lines(spark, sf):
    """L2: lines of documents that are not blank; seq orders them, by document and line."""
    at = F.posexplode(F.split("text", "\n", -1)).alias("line", "value")
    lines = spread(_t(spark, sf, "documents").select("doc_id", "text")).select("doc_id", at)
    lines = lines.select("doc_id", F.col("line").cast("long").alias("line"), "value")
    return lines.select("doc_id", "line", F.struct("doc_id", "line").alias("seq"), "value").where("value != ''")


def tokenised(lines, keywords=(), ignorewords=()):
    return lines.withColumn("tokens", tk.tokens(F.col("value"), keywords, ignorewords))


_L1 = "SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' user' || user_id || ' props ' || props AS value, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events"
_L2 = "SELECT doc_id, at_ AS line, {'doc_id': doc_id, 'line': at_} AS seq, value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS at_ FROM documents) WHERE value <> ''"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tk.STOP_WORDS)
_PAT = tk.DELIMITERS.replace("'", "''")


def _tokens_sql(value="value", keywords=(), ignorewords=()):
    key = "list_contains([" + ", ".join(f"'{k}'" for k in keywords) + "], w)" if keywords else "false"
    ign = "list_contains([" + ", ".join(f"'{k}'" for k in ignorewords) + "], w)" if ignorewords else "false"
    words = f"list_filter(string_split(regexp_replace({value}, '{_PAT}', ' ', 'g'), ' '), lambda w: w <> '')"
    star = f"list_transform({words}, lambda w: CASE WHEN {ign} THEN '*' WHEN w IN ({_STOP}) AND NOT {key} THEN '*' ELSE w END)"
    low = f"list_transform({star}, lambda w: struct_pack(k := {key}, t := CASE WHEN strlen(lower(w)) > 1 THEN regexp_replace(lower(w), '\\.$', '') ELSE lower(w) END))"
    keep = r"x.t = '*' OR x.k OR (strlen(x.t) > 2 AND NOT (regexp_matches(x.t, '^\p{Nd}+$') AND NOT regexp_matches(x.t, '^0.') AND strlen(x.t) > 3))"
    return f"list_transform(list_filter({low}, lambda x: {keep}), lambda x: x.t)"


_TERMS = f"WITH l AS ({_L2}), k AS (SELECT seq, {_tokens_sql()} AS tokens FROM l), e AS (SELECT seq, unnest(tokens) AS term FROM k), terms AS (SELECT term, count(*) AS cnt FROM e WHERE term <> '*' GROUP BY term)"


@query(f"SELECT doc_id, line, len({_tokens_sql()}) AS n_tokens, array_to_string({_tokens_sql()}, ' ') AS tokens FROM ({_L2})")
def tokenize_docs(spark, sf):
    return tokenised(document_lines(spark, sf)).select("doc_id", "line", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def _terms(spark, sf):
    return terms.term_counts(tokenised(document_lines(spark, sf)))


@query(f"{_TERMS} SELECT term, cnt FROM terms")
def term_freq(spark, sf):
    return _terms(spark, sf).select("term", "cnt")


@query(f"{_TERMS} SELECT term, cnt FROM terms ORDER BY cnt DESC, term LIMIT 100")
def top_terms(spark, sf):
    return _terms(spark, sf).select("term", "cnt").orderBy(F.desc("cnt"), "term").limit(100)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filter_project(spark, sf):
    fits = (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")
    return table.scan(_t(spark, sf, "lineitem"), fits, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def first_match(spark, sf):
    df = _t(spark, sf, "customer")
    r = table.first_match(df, F.col("c_mktsegment") == "BUILDING", ["c_custkey", "c_name"], ["c_custkey"])
    return spark.createDataFrame([r], "c_custkey long, c_name string")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_where(spark, sf):
    return table.count(_t(spark, sf, "orders"), F.col("o_orderstatus") == "F")


@query("SELECT round(coalesce(sum(l_quantity), 0), 2) AS total FROM lineitem WHERE l_returnflag = 'A'")
def sum_where(spark, sf):
    return table.total(_t(spark, sf, "lineitem"), "l_quantity", F.col("l_returnflag") == "A").select(F.round("total", 2).alias("total"))


@query("SELECT coalesce(min(o_totalprice), 0) AS least, coalesce(max(o_totalprice), 0) AS most FROM orders WHERE o_orderstatus = 'O'")
def min_max_where(spark, sf):
    return table.extremes(_t(spark, sf, "orders"), "o_totalprice", F.col("o_orderstatus") == "O")


@query("SELECT CAST(0 AS DOUBLE) AS least, CAST(0 AS DOUBLE) AS most")
def min_max_empty(spark, sf):
    return table.extremes(_t(spark, sf, "orders"), "o_totalprice", F.col("o_orderkey") < 0)


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size, p_retailprice, p_partkey")
def order_multi_asc(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return table.order_by(df, ["p_size", "p_retailprice", "p_partkey"], ["int", "float", "int"])


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC")
def order_multi_desc(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return table.order_by(df, ["p_size", "p_retailprice", "p_partkey"], ["int", "float", "int"], descending=True)


@query("SELECT count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) WHERE k < 10")
def group_union_count(spark, sf):
    two = [_t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))]
    return table.union_count(two, F.col("k") < 10)


_N = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS grp FROM nation"


def _nations(spark, sf):
    return _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("grp"))


@query(f"{_N} UNION ALL SELECT CAST(99 AS BIGINT), '', CAST(7 AS BIGINT)")
def insert_rows(spark, sf):
    return table.insert(_nations(spark, sf), spark.createDataFrame([(99, 7)], "id long, grp long"))


@query(f"SELECT id, CASE WHEN grp = 1 THEN 'x' ELSE name END AS name, grp FROM ({_N})")
def update_rows(spark, sf):
    return table.update(_nations(spark, sf), {"name": "x"}, F.col("grp") == 1)


@query(f"SELECT id, CASE WHEN id = 3 THEN 'y' ELSE name END AS name, grp FROM ({_N}) UNION ALL SELECT CAST(77 AS BIGINT), 'z', CAST(5 AS BIGINT)")
def upsert_rows(spark, sf):
    once = table.upsert(_nations(spark, sf), {"id": 3, "name": "y"}, F.col("id") == 3)
    return table.upsert(once, {"id": 77, "name": "z", "grp": 5}, F.col("id") == 77)


@query(f"SELECT * FROM ({_N}) WHERE NOT (grp = 1 OR id = 7)")
def delete_rows(spark, sf):
    return table.delete(_nations(spark, sf), (F.col("grp") == 1) | (F.col("id") == 7))


@query(f"SELECT * FROM ({_N}) WHERE false")
def truncate_table(spark, sf):
    return table.delete(_nations(spark, sf))


@query(f"SELECT seq, value FROM ({_L1}) WHERE regexp_matches(value, 'click|view') AND regexp_matches(value, 'user1') AND NOT regexp_matches(value, 'user1[0-4]')")
def filter_include_exclude(spark, sf):
    lines = event_lines(spark, sf)
    return lines.where(parse.matches(F.col("value"), ["click|view", "user1"], ["user1[0-4]"])).select("seq", "value")


_FORMAT = r"^(?P<timestamp>\d+-\d+-\d+ \d+:\d+:\d+) (?P<message>.+)$"
_NOW = "2031-12-31 00:00:00"


@query(f"SELECT seq, CAST(epoch(CAST('2031-' || CASE WHEN substr(value, 6, 5) = '02-29' THEN '03-01' ELSE substr(value, 6, 5) END || substr(value, 11, 9) AS TIMESTAMP)) AS BIGINT) AS epoch, substr(value, 21) AS message FROM ({_L1})")
def parse_log_format(spark, sf):
    lines = event_lines(spark, sf)
    at = parse.parsed(F.col("value"), _FORMAT, "2006-01-02 15:04:05", F.lit(0), F.to_timestamp(F.lit(_NOW)))
    return lines.select("seq", at.alias("p")).select("seq", "p.epoch", "p.message")


@query(f"SELECT seq, value, CASE WHEN string_split(value, ' ')[3] IN ('click', 'view') THEN 'fits' ELSE 'other' END AS kind, CASE WHEN string_split(value, ' ')[3] IN ('click', 'view') THEN CAST(epoch(CAST('2031-' || CASE WHEN substr(value, 6, 5) = '02-29' THEN '03-01' ELSE substr(value, 6, 5) END || substr(value, 11, 9) AS TIMESTAMP)) AS BIGINT) ELSE 1000 + seq END AS epoch, CASE WHEN string_split(value, ' ')[3] = 'click' THEN substr(value, 27) WHEN string_split(value, ' ')[3] = 'view' THEN substr(value, 26) ELSE value END AS message FROM ({_L1})")
def unfit_lines(spark, sf):
    """Lines of which some don't fit the format: these are their own messages, at their file's time."""
    lines = event_lines(spark, sf)
    pattern = r"^(?P<timestamp>\d+-\d+-\d+ \d+:\d+:\d+) (?:click|view) (?P<message>.+)$"
    at = parse.parsed(F.col("value"), pattern, "2006-01-02 15:04:05", F.col("seq") + 1000, F.to_timestamp(F.lit(_NOW)))
    kind = F.when(F.col("value").rlike(" (?:click|view) "), "fits").otherwise("other")
    return lines.select("seq", "value", kind.alias("kind"), at.alias("p")).select("seq", "value", "kind", "p.epoch", "p.message")


def _pos(spark, sf, frequency):
    lines = event_lines(spark, sf)
    return lines.select("seq", parse.retention_pos(F.timestamp_seconds("epoch"), frequency).alias("retention_pos"))


@query("SELECT event_id AS seq, CAST(year(ts) * 100000 + dayofyear(ts) * 100 + hour(ts) AS BIGINT) AS retention_pos FROM events")
def time_bucket_hour(spark, sf):
    return _pos(spark, sf, "hour")


@query("SELECT event_id AS seq, CAST(year(ts) * 1000 + dayofyear(ts) AS BIGINT) AS retention_pos FROM events")
def time_bucket_day(spark, sf):
    return _pos(spark, sf, "day")


_KEY, _IGN = ("a", "props"), ("click",)


@query(f"SELECT seq, array_to_string({_tokens_sql(keywords=_KEY, ignorewords=_IGN)}, ' ') AS tokens FROM ({_L1})")
def keywords_and_ignorewords(spark, sf):
    return tokenised(event_lines(spark, sf), _KEY, _IGN).select("seq", F.array_join("tokens", " ").alias("tokens"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)), 1) AS DOUBLE) AS half,
    (sign(l_tax - l_discount) * floor(abs(l_tax - l_discount) * 10) + CASE WHEN l_tax < l_discount THEN -1 ELSE 1 END) / 10 AS away,
    sign(l_tax - l_discount) * floor(abs(l_tax - l_discount) * 10) / 10 AS down FROM lineitem""")
def round_modes(spark, sf):
    df = _t(spark, sf, "lineitem")
    x = F.col("l_tax") - F.col("l_discount")
    return df.select("l_orderkey", "l_linenumber", scalars.round_half(F.col("l_extendedprice"), 1).alias("half"), scalars.round_away(x, 1).alias("away"), scalars.round_down(x, 1).alias("down"))


_MIXED = "SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN event_type ELSE '0' || user_id END AS x, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_ FROM events"


@query(f"SELECT seq, regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '^0.') AS is_int, TRY_CAST(x AS DOUBLE) IS NOT NULL AS is_numeric, coalesce(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(x AS BIGINT) END, 0) AS as_long, CAST(CASE WHEN user_id % 7 = 0 THEN user_id ELSE (user_id // 7 + 1) * 7 END AS BIGINT) AS next7, at_ + 45 * 86400 AS later FROM ({_MIXED})")
def scalar_helpers(spark, sf):
    """Tests and casts of text, the next multiple of a number, and calendar days added to a time."""
    kind = F.col("event_id") % 4
    x = F.when(kind == 0, F.col("user_id").cast("string")).when(kind == 1, F.col("value").cast("string")).when(kind == 2, F.col("event_type")).otherwise(F.concat(F.lit("0"), F.col("user_id")))
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return _t(spark, sf, "events").select(
        F.col("event_id").alias("seq"), scalars.is_int(x).alias("is_int"), scalars.is_numeric(x).alias("is_numeric"), scalars.to_long(x).alias("as_long"),
        scalars.next_divisible(F.col("user_id"), 7).alias("next7"), scalars.add_days(at, 45).alias("later"),
    )


@query("SELECT event_id AS seq, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H') AS hour, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%Y-%m-%d %H:%M:%S') AS other FROM events")
def time_labels(spark, sf):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return _t(spark, sf, "events").select(F.col("event_id").alias("seq"), *[ring.label(at, f).alias(f) for f in ("day", "hour", "minute", "other")])


@query("SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place, p_partkey, p_retailprice FROM part")
def argsort(spark, sf):
    df = _t(spark, sf, "part").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("k"), "p_retailprice")
    return table.argsort(df, "p_retailprice", descending=True).select("place", F.col("k").cast("long").alias("p_partkey"), "p_retailprice")


def _border_sql(rate):
    return f"""{_TERMS}, r AS (SELECT cnt, sum(cnt) OVER (ORDER BY cnt DESC, term ROWS UNBOUNDED PRECEDING) / sum(cnt) OVER () AS share, max(cnt) OVER () AS top FROM terms),
    q AS (SELECT DISTINCT cnt FROM r WHERE share < CAST({rate} AS DOUBLE)), o AS (SELECT list_sort(list(cnt)) AS a FROM q)
    SELECT CAST(coalesce(a[2], a[1], (SELECT max(top) FROM r)) AS BIGINT) AS border FROM o"""


@query(_border_sql(0.999))
def count_border_999(spark, sf):
    return terms.count_border(_terms(spark, sf), 0.999).select(F.col("border").cast("long"))


@query(_border_sql(0.5))
def count_border_50(spark, sf):
    return terms.count_border(_terms(spark, sf), 0.5).select(F.col("border").cast("long"))


@query(f"{_TERMS} SELECT cnt AS term_count, count(*) AS n_terms, array_to_string(list_transform(list_slice(list_sort(list(term)), 1, 5), lambda t: CASE WHEN length(t) > 10 THEN substr(t, 1, 10) || '...' ELSE t END), ' ') AS sample FROM terms GROUP BY cnt")
def term_count_histogram(spark, sf):
    return terms.histogram(_terms(spark, sf))


@query(f"SELECT CAST(least AS BIGINT) AS given, CAST(coalesce(a[2], a[1], top) AS BIGINT) AS computed FROM (SELECT 77 AS least, * FROM ({_border_sql(0.999)[:_border_sql(0.999).rindex('SELECT CAST')]} SELECT a, (SELECT max(top) FROM r) AS top FROM o))")
def border_selection(spark, sf):
    """A border that is given wins; a rate of 0 stands for the default one."""
    t = _terms(spark, sf)
    return spark.createDataFrame([(terms.border_of(t, 0.0, 77), terms.border_of(t, 0.0))], "given long, computed long")


@query(f"WITH l AS ({_L2}), e AS (SELECT seq, unnest({_tokens_sql()}) AS term, unnest(range(len({_tokens_sql()}))) AS pos FROM l), f AS (SELECT term, count(*) AS cnt, min({{'s': seq, 'p': pos}}) AS first FROM e WHERE term <> '*' GROUP BY term) SELECT term, cnt, row_number() OVER (ORDER BY first) AS id FROM f")
def term_ids(spark, sf):
    return terms.with_ids(written(_terms(spark, sf)), "first").select("term", "cnt", F.col("id").cast("long").alias("id"))


@query("SELECT CAST(CASE WHEN most < 3000 THEN 10000 WHEN most < 300000 THEN 100000 ELSE 1000000 END AS BIGINT) AS block_size, CAST(ceil(most / CASE WHEN most < 3000 THEN 10000 WHEN most < 300000 THEN 100000 ELSE 1000000 END) * 7 AS BIGINT) AS n_blocks FROM (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('day', ts)))")
def block_sizing(spark, sf):
    most = ring.most_in_bucket(_pos(spark, sf, "day")).first()[0]
    return spark.createDataFrame([ring.sizing(most, 7)], "block_size long, n_blocks long")


@query("SELECT CAST(max(n) AS BIGINT) AS most FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('hour', ts))")
def max_lines_per_bucket(spark, sf):
    return ring.most_in_bucket(_pos(spark, sf, "hour"))


@query(f"{_TERMS} SELECT term, round(ln((SELECT sum(cnt) FROM terms) / cnt) + 1, 6) AS idf FROM terms")
def idf_scores(spark, sf):
    t = written(_terms(spark, sf).select("term", "cnt"))
    total = t.agg(F.sum("cnt")).first()[0] or 0
    return t.select("term", F.round(terms.idf(F.col("cnt"), F.lit(total)), 6).alias("idf"))


# --- templates of event lines -------------------------------------------------

_BORDER, _MIN = 500, 0.6
_MINE = f"""
WITH l AS ({_L1}), k AS (SELECT seq, value, epoch, {_tokens_sql()} AS tokens FROM l),
e AS (SELECT seq, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM k),
terms AS (SELECT term, count(*) AS cnt, min(seq * 100000 + pos) AS first FROM e WHERE term <> '*' GROUP BY term),
c AS (SELECT e.seq, e.pos, e.term, coalesce(cnt, 0) AS cnt, first FROM e LEFT JOIN terms USING (term)),
s AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY cnt DESC, first, pos) - 1 AS i FROM c WHERE term <> '*'),
p AS (SELECT *, string_agg(term, ' ') OVER (PARTITION BY seq ORDER BY i ROWS UNBOUNDED PRECEDING) AS key, coalesce(lag(cnt) OVER (PARTITION BY seq ORDER BY i), 0) AS prev FROM s),
nodes AS (SELECT key, count(*) AS node FROM p GROUP BY key),
z AS (SELECT seq, len(tokens) AS n, CASE WHEN len(tokens) > 3 THEN CAST(floor(len(tokens) * CAST({_MIN} AS DOUBLE)) AS INT) ELSE 3 END AS least FROM k),
h AS (SELECT p.seq, min(struct_pack(i := i, m := prev)) AS st FROM p JOIN nodes USING (key) JOIN z USING (seq) WHERE (node <= 1 OR cnt < {_BORDER}) AND i + 1 > CASE WHEN least = 0 THEN 3 ELSE least END GROUP BY p.seq),
r AS (SELECT seq, count(*) AS real, min(cnt) AS last FROM s GROUP BY seq),
stop AS (SELECT z.seq, n, least, coalesce(h.st.i, CASE WHEN n > coalesce(real, 0) THEN coalesce(real, 0) ELSE -1 END) AS stop, coalesce(h.st.m, last, 0) AS min_cnt FROM z LEFT JOIN h USING (seq) LEFT JOIN r USING (seq)),
kept AS (SELECT c.seq, string_agg(CASE WHEN term <> '*' AND cnt >= min_cnt AND cnt >= {_BORDER} THEN term ELSE '*' END, ' ' ORDER BY pos) AS kept, sum(CASE WHEN term <> '*' AND cnt >= min_cnt AND cnt >= {_BORDER} THEN 1 ELSE 0 END) AS n_kept FROM c JOIN stop USING (seq) GROUP BY c.seq),
lines AS (SELECT k.seq, k.value, k.epoch, CASE WHEN stop >= least AND n_kept >= least THEN kept ELSE array_to_string(tokens, ' ') END AS phrase, stop, min_cnt, least FROM k JOIN stop USING (seq) LEFT JOIN kept USING (seq)),
phrases AS (SELECT phrase, count(*) AS cnt, min(epoch) AS created, max(epoch) AS updated, arg_max(value, seq) AS last_value FROM lines GROUP BY phrase)
"""


def _vectors(spark, sf):
    """(lines, vectors, terms): lines are tokenised once; what follows works on their vectors, written as a table."""
    lines = tokenised(event_lines(spark, sf))
    one = [F.min("seq").alias("seq"), F.min("epoch").alias("created"), F.max("epoch").alias("updated"), F.max(F.struct("seq", "value")).alias("last"), F.min(F.struct("seq", "value")).alias("first_line")]
    vecs = written(mining.vectors(lines, None, *one))
    return lines, vecs, written(_vector_terms(vecs))


def _vector_terms(vecs):
    codes = terms.order_codes(vecs, "seq", room=F.max(F.size("tokens")))
    return terms.vector_terms(vecs, "seq", codes and codes[0])


def _ordered(vecs, t):
    return mining.ordered(vecs.select("vid", "tokens", "w").repartition("vid"), t)


def _stops(vecs, t):
    return mining.stops(_ordered(vecs, t), _BORDER, _MIN)


def _vector_phrases(spark, sf):
    """(lines, vectors with phrases, terms)."""
    lines, vecs, t = _vectors(spark, sf)
    return lines, mining.mined(vecs, t, _BORDER, _MIN), t


def _phrases(vecs):
    return vecs.groupBy("phrase").agg(
        F.sum("w").alias("cnt"), F.min("created").alias("created"), F.max("updated").alias("updated"), F.max("last")["value"].alias("last_value")
    )


@query(_MINE + "SELECT seq, CAST(stop AS BIGINT) AS stop, CAST(min_cnt AS BIGINT) AS min_cnt, CAST(least AS BIGINT) AS least FROM lines")
def stop_index(spark, sf):
    lines, vecs, t = _vectors(spark, sf)
    cols = [F.col(c).cast("long").alias(c) for c in ("stop", "min_cnt", "least")]
    return lines.select("seq", mining.vector_id().alias("vid")).join(_stops(vecs, t).select("vid", *cols), "vid").drop("vid")


@query(_MINE + "SELECT i + 1 AS depth, count(*) AS n_nodes, CAST(sum(node) AS BIGINT) AS weight FROM (SELECT DISTINCT key, i, node FROM p JOIN nodes USING (key)) GROUP BY i")
def prefix_counts(spark, sf):
    _, vecs, t = _vectors(spark, sf)
    pre = mining.prefixes(_ordered(vecs, t), "w")
    nodes = pre.groupBy("key").agg(F.min("i").alias("i"), F.sum("w").alias("node"))  # all of them: no border
    return nodes.groupBy("i").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("node").alias("weight")).select((F.col("i") + 1).cast("long").alias("depth"), "n_nodes", "weight")


@query(_MINE + "SELECT phrase, cnt, created, updated, last_value FROM phrases")
def phrase_counts(spark, sf):
    return _phrases(_vector_phrases(spark, sf)[1])


_SCORED = _MINE + """, sc AS (SELECT phrase, avg(ln((SELECT sum(cnt) FROM terms) / tc.cnt) + 1) AS score
FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS term FROM phrases) x LEFT JOIN terms tc USING (term) WHERE term NOT IN ('*', '') GROUP BY phrase)"""


def _scored(spark, sf):
    """Scores need no lines: vectors are token lists, with the first place of each."""
    lines = tokenised(event_lines(spark, sf)).withColumn("vid", mining.vector_id())
    vecs = written(lines.groupBy("vid", "tokens").agg(F.count(F.lit(1)).alias("w"), F.min("seq").alias("seq")))
    t = written(_vector_terms(vecs))
    total = t.agg(F.sum("cnt")).first()[0] or 0
    phrases = mining.mined(vecs, t, _BORDER, _MIN).groupBy("phrase").agg(F.sum("w").alias("cnt"))
    return mining.scores(written(phrases), t.select("term", "cnt"), total)


@query(_SCORED + "SELECT phrase, cnt, round(coalesce(score, 0), 6) AS score FROM phrases LEFT JOIN sc USING (phrase)")
def phrase_scores(spark, sf):
    return _scored(spark, sf).select("phrase", "cnt", F.round("score", 6).alias("score"))


@query(_SCORED + "SELECT phrase, cnt, round(coalesce(score, 0), 6) AS score FROM phrases LEFT JOIN sc USING (phrase) WHERE cnt <= 2000 ORDER BY coalesce(score, 0) DESC, phrase LIMIT 50")
def top_n_rare(spark, sf):
    return mining.top_rare(_scored(spark, sf), 50, 2000).select("phrase", "cnt", F.round("score", 6).alias("score"))


# What stands around a word in a line (fixed), as the subject's rule has it.
_AROUND = mining.AROUND.replace("'", "''")
_SUBJECT = _MINE + f""", f AS (SELECT phrase, arg_min(value, seq) AS value, arg_min(seq, seq) AS seq FROM lines GROUP BY phrase),
w AS (SELECT phrase, value, list_filter(string_split(regexp_replace(value, '{_PAT}', ' ', 'g'), ' '), lambda x: x <> '') AS words, k.tokens AS tokens, string_split(phrase, ' ') AS shown FROM f JOIN k USING (seq, value)),
g AS (SELECT phrase, value, list_filter(tokens, lambda x: NOT list_contains(shown, x)) || list_transform(list_filter(words, lambda x: x IN ({_STOP}) OR NOT list_contains(tokens, CASE WHEN strlen(lower(x)) > 1 THEN regexp_replace(lower(x), '\\.$', '') ELSE lower(x) END)), lambda x: lower(x)) AS gone,
  string_split_regex(value, '{_AROUND}') AS parts, regexp_extract_all(value, '{_AROUND}') || [''] AS seps FROM w)
"""


@query(_SUBJECT + "SELECT phrase, regexp_replace(array_to_string(list_transform(list_zip(parts, seps), lambda p: CASE WHEN list_contains(gone, lower(p[1])) THEN '*' ELSE p[1] END || p[2]), ''), '\\*(?:[\\s\\t]*\\*)+', '*', 'g') AS subject FROM g")
def subjects(spark, sf):
    vecs = _vector_phrases(spark, sf)[1]
    first = vecs.groupBy("phrase").agg(F.min_by(F.struct(F.col("first_line.value").alias("value"), "hidden"), "seq").alias("f"))
    hidden = F.array_union(F.col("f.hidden"), tk.excluded(F.col("f.value")))
    return first.select("phrase", mining.subject(F.col("f.value"), hidden).alias("subject"))


@query(f"SELECT seq, CASE WHEN len(t) = 3 AND t[1] = 'user' THEN 'user * *' ELSE array_to_string(t, ' ') END AS phrase FROM (SELECT event_id AS seq, {_tokens_sql('m')} AS t FROM (SELECT event_id, 'user ' || event_type || ' n' || event_id || 'x' AS m FROM events))")
def custom_phrase_match(spark, sf):
    line = F.concat(F.lit("user "), F.col("event_type"), F.lit(" n"), F.col("event_id"), F.lit("x"))
    lines = tokenised(_t(spark, sf, "events").select(F.col("event_id").alias("seq"), line.alias("value")))
    lines = lines.withColumn("phrase", F.array_join("tokens", " "))
    return mining.custom_match(lines, [["user", "*", "*"], ["user", "click", "*"]]).select("seq", "phrase")


def _again_sql(border):
    """_MINE once more, over the last line of each phrase, which weighs as much as the phrase, with the terms of all lines."""
    q = _MINE.replace(f"WITH l AS ({_L1}), k AS", f"{_MINE}, l2 AS (SELECT row_number() OVER (ORDER BY phrase) AS seq, last_value AS value, updated AS epoch, cnt AS w FROM phrases), k2 AS", 1)
    head, tail = q[: q.index(", k2 AS")], q[q.index(", k2 AS") :]
    tail = tail.replace("FROM l)", "FROM l2)").replace("k2 AS (SELECT seq, value, epoch,", "k2 AS (SELECT seq, value, epoch, w,", 1)
    tail = tail.replace("terms AS (SELECT term, count(*) AS cnt, min(seq * 100000 + pos) AS first FROM e WHERE term <> '*' GROUP BY term),\n", "")
    for name in ("e", "c", "s", "p", "nodes", "z", "h", "r", "stop", "kept", "lines", "phrases"):
        tail = re.sub(rf"(?<![\w.]){name}(?= AS \()|(?<=FROM ){name}\b|(?<=JOIN ){name}\b|(?<![\w.]){name}(?=\.\w)", f"{name}2", tail)
    tail = re.sub(r"(?<=FROM )k\b|(?<=JOIN )k\b|(?<![\w.])k(?=\.\w)", "k2", tail)
    tail = tail.replace("nodes2 AS (SELECT key, count(*) AS node FROM p2 GROUP BY key)", "nodes2 AS (SELECT key, sum(w) AS node FROM p2 JOIN k2 USING (seq) GROUP BY key)")
    tail = tail.replace("lines2 AS (SELECT k2.seq, k2.value, k2.epoch,", "lines2 AS (SELECT k2.seq, k2.w,")
    tail = re.sub(r"phrases2 AS \(.*?\)\n", "phrases2 AS (SELECT phrase, CAST(sum(w) AS BIGINT) AS cnt FROM lines2 GROUP BY phrase)\n", tail)
    return head + tail.replace(f"cnt < {_BORDER}", f"cnt < {border}").replace(f"cnt >= {_BORDER}", f"cnt >= {border}")


@query(_again_sql(2 * _BORDER) + "SELECT phrase, cnt FROM phrases2")
def rearranged_phrases(spark, sf):
    """The phrases again under a higher border, from one exemplar line each, weighted by its count."""
    m = new_miner(spark, settings())
    m.feed(lines=event_log(spark, sf))
    return m.rearranged(border=2 * _BORDER).select("phrase", "cnt")


# --- the miner itself ------------------------------------------------------------------


def event_log(spark, sf):
    """The event lines as a log: each at its own time, in the order of their ids."""
    e = event_lines(spark, sf)
    return e.select(F.lit("events").alias("file"), F.col("epoch").alias("mtime"), F.lit(0).cast("long").alias("part"), F.col("seq").alias("at"), "value")


def settings(**more) -> Settings:
    return Settings(border=_BORDER, min_rate=_MIN, **more)


def new_miner(spark, s: Settings) -> Miner:
    return Miner(spark, scratch(spark), s)


def miner(spark, sf) -> Miner:
    """A miner that was fed the events in two batches, the second of them twice."""
    m = new_miner(spark, settings(frequency="day"))
    lines = event_log(spark, sf)
    for n in (0, 1, 1):
        m.feed(lines=lines.where(F.col("at") % 2 == n), batch_of=("events", n))
    return Miner(spark, m.store.root)


def halves(spark, sf) -> list[DataFrame]:
    """The event log in two parts: the first half of the ids, and the rest."""
    lines = event_log(spark, sf)
    middle = _t(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2
    return [lines.where(F.col("at") <= middle), lines.where(F.col("at") > middle)]


@query(f"{_MINE} SELECT term, cnt FROM terms")
def miner_terms(spark, sf):
    return miner(spark, sf).terms().select("term", "cnt")


@query("SELECT CAST(year(ts) * 1000 + dayofyear(ts) AS BIGINT) AS block, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS block_seq, CAST(max(floor(epoch(ts))) AS BIGINT) AS last_epoch, count(*) AS lines, CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events) AS completed FROM events GROUP BY CAST(ts AS DATE), year(ts), dayofyear(ts)")
def ring_status(spark, sf):
    return miner(spark, sf).store.status().select("block", "block_seq", "last_epoch", "lines", "completed")


_DAY_TERMS = f"SELECT CAST(year(make_timestamp(epoch * 1000000)) * 1000 + dayofyear(make_timestamp(epoch * 1000000)) AS BIGINT) AS block, term, count(*) AS cnt FROM (SELECT epoch, unnest({_tokens_sql()}) AS term FROM ({_L1})) WHERE term <> '*' GROUP BY ALL"


@query(f"SELECT * FROM ({_DAY_TERMS}) WHERE block IN (SELECT DISTINCT block FROM ({_DAY_TERMS}) ORDER BY block LIMIT 3)")
def ring_scan(spark, sf):
    """The first three blocks of the ring, which are the only folders read."""
    store = miner(spark, sf).store
    first = [r.block for r in store.status().orderBy("block").limit(3).collect()]
    return store.read("terms", first).groupBy("block", "term").agg(F.sum("cnt").alias("cnt"))


@query(f"SELECT term, cnt FROM ({_DAY_TERMS}) WHERE block = (SELECT max(block) FROM ({_DAY_TERMS}))")
def ring_current_block(spark, sf):
    return miner(spark, sf).store.current("terms").groupBy("term").agg(F.sum("cnt").alias("cnt"))


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT block FROM ({_DAY_TERMS}) WHERE term LIKE 'user1%')")
def ring_count(spark, sf):
    """How many blocks hold a term that begins so: the rows of a ring that was fed in one go for each day."""
    store = miner(spark, sf).store
    hits = store.read("terms").where(F.col("term").startswith("user1"))
    return hits.agg(F.countDistinct("block").alias("n"))


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT seq % 2, block, term FROM (SELECT seq, CAST(floor(epoch / 86400) AS BIGINT) AS block, unnest({_tokens_sql()}) AS term FROM ({_L1})) WHERE term <> '*' AND term LIKE 'user%')")
def ring_count_rows(spark, sf):
    return miner(spark, sf).store.count("terms", F.col("term").startswith("user"))


@query(_MINE + "SELECT value, phrase, phrases.cnt AS cnt FROM lines JOIN phrases USING (phrase) WHERE phrases.cnt >= 2")
def detect_counts(spark, sf):
    m = new_miner(spark, settings())
    return m.detect(lines=event_log(spark, sf), least=2).select("value", "phrase", "cnt")


@query(f"{_MINE} SELECT term, coalesce(max(terms.cnt), 0) AS cnt, max(x.phrase) AS phrase FROM (SELECT unnest(tokens) AS term, array_to_string(tokens, ' ') AS phrase FROM k ORDER BY seq LIMIT (SELECT len(tokens) FROM k ORDER BY seq LIMIT 1)) x LEFT JOIN terms USING (term) WHERE term <> '*' GROUP BY term")
def analyze_line(spark, sf):
    """The first event's line: its template, and the counts of its terms."""
    first = event_lines(spark, sf).orderBy("seq").limit(1).first()["value"]
    phrase, counts = miner(spark, sf).analyze_line(first)
    return counts.select("term", "cnt", F.lit(phrase).alias("phrase"))


@query(f"{_MINE} SELECT cnt AS term_count, count(*) AS n_terms, array_to_string(list_transform(list_slice(list_sort(list(term)), 1, 5), lambda t: CASE WHEN length(t) > 10 THEN substr(t, 1, 10) || '...' ELSE t END), ' ') AS sample FROM terms GROUP BY cnt ORDER BY cnt DESC LIMIT 20")
def miner_term_counts(spark, sf):
    return miner(spark, sf).term_counts(20)


@query(_SCORED + "SELECT phrase AS text, cnt, round(coalesce(score, 0), 6) AS score FROM phrases LEFT JOIN sc USING (phrase) WHERE cnt <= 100000 AND updated >= (SELECT max(updated) FROM phrases) - 5 * 86400 AND regexp_matches(last_value, 'click|view') AND NOT regexp_matches(last_value, 'nothing') ORDER BY coalesce(score, 0) DESC, phrase LIMIT 7")
def miner_top_n(spark, sf):
    """The rarest-worded phrases of the last five days whose last line passes the filters."""
    m = new_miner(spark, settings())
    m.feed(lines=event_log(spark, sf))
    m.settings.include, m.settings.exclude = ["click|view"], ["nothing"]
    return m.top_n(7, 100_000, days=5).select("text", "cnt", F.round("score", 6).alias("score"))


_MEMBER = "regexp_replace(array_to_string(list_transform(list_zip(parts, seps), lambda p: CASE WHEN list_contains(gone, lower(p[1])) THEN '*' ELSE p[1] END || p[2]), ''), '\\*(?:[\\s\\t]*\\*)+', '*', 'g')"


@query(_SUBJECT + f"SELECT strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M:%S') AS Created, strftime(make_timestamp(updated * 1000000), '%Y-%m-%d %H:%M:%S') AS Updated, cnt AS Count, {_MEMBER} AS Member FROM g JOIN phrases USING (phrase) ORDER BY cnt DESC, phrase LIMIT 3")
def output_phrases(spark, sf):
    m = new_miner(spark, settings())
    m.feed(lines=event_log(spark, sf))
    return m.output_phrases(3)


# --- the miner over several feeds -------------------------------------------------------

_MIDDLE = "(SELECT max(event_id) // 2 FROM events)"


@query(f"{_MINE} SELECT term, cnt, row_number() OVER (ORDER BY first) AS id FROM terms")
def miner_term_ids(spark, sf):
    """Terms of two feeds; their ids are given in the order of first sight, and stay."""
    m = new_miner(spark, settings())
    for half in halves(spark, sf):
        m.feed(lines=half)
    return m.terms().select("term", "cnt", F.col("first").alias("id"))


@query(_MINE + "SELECT phrase, cnt, created, updated, last_value FROM phrases")
def miner_remine(spark, sf):
    """Two feeds, and all their lines mined again: what one feed gives."""
    m = new_miner(spark, settings(frequency="day"))
    for half in halves(spark, sf):
        m.feed(lines=half)
    m.remine()
    return m.phrases().select("phrase", "cnt", "created", "updated", "last_value")


_LAST_DAYS = f"SELECT block, term, cnt FROM ({_DAY_TERMS}) WHERE block IN (SELECT DISTINCT block FROM ({_DAY_TERMS}) ORDER BY block DESC LIMIT 5)"


@query(f"SELECT term, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({_LAST_DAYS}) GROUP BY term")
def miner_ring_totals(spark, sf):
    """Totals after the ring has dropped all days but five: kept by difference, as if counted again."""
    m = new_miner(spark, settings(frequency="day", max_blocks=5))
    for half in halves(spark, sf):
        m.feed(lines=half)
    return m.terms().select("term", "cnt")


_SIZE = 2


@query(_MINE + f""", f AS (SELECT phrase, min(seq) AS seq FROM lines GROUP BY phrase), seen AS (SELECT seq, row_number() OVER (ORDER BY seq) AS n FROM f),
p2 AS (SELECT lines.phrase, lines.seq, coalesce((SELECT max(n) FROM seen WHERE seen.seq < lines.seq), 0) // {_SIZE} AS piece FROM lines)
SELECT phrase, CAST(piece AS BIGINT) AS piece, count(*) AS cnt FROM p2 GROUP BY ALL""")
def miner_size_blocks(spark, sf):
    """A feed in pieces that end with every second new phrase."""
    m = new_miner(spark, settings(block_size=_SIZE))
    m.feed(lines=event_log(spark, sf))
    return m.store.read("phrases").select("phrase", F.col("piece").cast("long").alias("piece"), "cnt")


@query("SELECT CAST(CASE WHEN most < 3000 THEN 10000 WHEN most < 300000 THEN 100000 ELSE 1000000 END AS BIGINT) AS block_size, CAST(ceil(most / CASE WHEN most < 3000 THEN 10000 WHEN most < 300000 THEN 100000 ELSE 1000000 END) * 7 AS BIGINT) AS max_blocks FROM (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('day', ts)))")
def miner_sizing(spark, sf):
    """The block size and ring length that a feed without either chooses and stores."""
    m = new_miner(spark, settings(frequency="day", retention=7))
    m.feed(lines=event_log(spark, sf))
    return spark.createDataFrame([Miner(spark, m.store.root).sizes()], "block_size long, max_blocks long")


_COMPLETED = f"SELECT block, term, cnt, block < (SELECT max(block) FROM ({_DAY_TERMS})) AS completed FROM ({_DAY_TERMS})"


@query(_COMPLETED)
def ring_rows_completed(spark, sf):
    """The ring's rows, each with whether its block is completed."""
    m = new_miner(spark, settings(frequency="day"))
    m.feed(lines=event_log(spark, sf))
    return m.store.read("terms", with_status=True).select("block", "term", "cnt", "completed")


def _mined_sql(lines: str, among: str) -> str:
    """The CTEs of _MINE over some lines, with the terms of more."""
    own = _MINE.replace(f"l AS ({_L1})", f"l AS ({lines})", 1)
    count = "terms AS (SELECT term, count(*) AS cnt, min(seq * 100000 + pos) AS first FROM e WHERE term <> '*' GROUP BY term)"
    assert count in own
    everything = f"terms AS (SELECT term, count(*) AS cnt, min(seq * 100000 + pos) AS first FROM (SELECT seq, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM (SELECT seq, {_tokens_sql()} AS tokens FROM ({among}))) WHERE term <> '*' GROUP BY term)"
    return own.replace(count, everything, 1)


_FIRST, _SECOND = f"SELECT * FROM ({_L1}) WHERE seq <= {_MIDDLE}", f"SELECT * FROM ({_L1}) WHERE seq > {_MIDDLE}"
#: A phrase that the user names, and its test in SQL: tokens of the same number, one of which is given.
_CUSTOM = "* click * props *"
_FITS = "len(t) = 5 AND t[2] = 'click' AND t[4] = 'props'"


@query(f"""WITH old AS ({_mined_sql(_FIRST, _FIRST)} SELECT last_value AS value, phrase, cnt FROM phrases),
new AS ({_mined_sql(_SECOND, _L1)} SELECT value, phrase, 1 AS cnt FROM lines),
both_ AS (SELECT 'old' AS w, * FROM old UNION ALL SELECT 'new', * FROM new),
named AS (SELECT w, value, CASE WHEN {_FITS} THEN '{_CUSTOM}' ELSE phrase END AS phrase, cnt FROM (SELECT *, {_tokens_sql()} AS t FROM both_)),
total AS (SELECT phrase, CAST(sum(cnt) AS BIGINT) AS cnt FROM named GROUP BY phrase)
SELECT value, phrase, total.cnt AS cnt FROM named JOIN total USING (phrase) WHERE w = 'new' AND total.cnt >= 3""")
def detect_history(spark, sf):
    """The second half of the events against a store of the first, with a custom phrase that folds stored ones as well."""
    first, second = halves(spark, sf)
    m = new_miner(spark, settings())
    m.feed(lines=first)
    m.settings.custom_phrases = [_CUSTOM]
    return m.detect(lines=second, least=3).select("value", "phrase", "cnt")


@query(f"SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) > (SELECT CAST(min(ts) AS DATE) + 3 FROM events) GROUP BY 1")
def miner_new_files(spark, sf):
    """A log folder with a file for each day, of which a feed has read four days: the lines that the next one reads."""
    path = scratch(spark)
    events = event_lines(spark, sf).select(F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd").alias("day"), "seq", "value")
    first = events.agg(F.min("day")).first()[0]
    early = F.col("day") <= F.date_format(F.date_add(F.lit(first), 3), "yyyy-MM-dd")
    write = lambda df: df.repartitionByRange("day", "seq").sortWithinPartitions("day", "seq").select("day", "value").write.mode("append").partitionBy("day").text(path)
    write(events.where(early))
    m = new_miner(spark, settings())
    m.feed(f"{path}/*")
    write(events.where(~early))
    new = logs.drop_blank(m.new_lines(f"{path}/*"))
    return new.groupBy(F.regexp_extract("file", "day=([^/]*)", 1).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(_DAY_TERMS)
def miner_late_lines(spark, sf):
    """The later half of the log first, then the earlier one: late lines join the blocks of their own days."""
    lines = event_log(spark, sf)
    middle = lines.agg(((F.min("mtime") + F.max("mtime")) / 2).cast("long")).first()[0]
    m = new_miner(spark, settings(frequency="day"))
    for part in (F.col("mtime") > middle, F.col("mtime") <= middle):
        m.feed(lines=lines.where(part))
    return m.store.read("terms").groupBy("block", "term").agg(F.sum("cnt").alias("cnt"))


@query(f"{_mined_sql(_SECOND, _SECOND)} SELECT term, cnt, first_id AS id FROM (SELECT term, cnt, row_number() OVER (ORDER BY first) AS first_id FROM terms)")
def miner_clean(spark, sf):
    """A store that was fed, deleted and fed something else: nothing of the first feed is left, ids included."""
    first, second = halves(spark, sf)
    m = new_miner(spark, settings())
    m.feed(lines=first)
    m.clean()
    again = Miner(spark, m.store.root, settings())
    again.feed(lines=second)
    return again.terms().select("term", "cnt", F.col("first").alias("id"))


_CHOSEN = f"SELECT * FROM ({_L1}) WHERE (contains(value, ' click ') OR contains(value, ' view ')) AND NOT contains(value, 'user1')"


@query(f"{_mined_sql(_CHOSEN, _CHOSEN)} SELECT CAST(year(make_timestamp(epoch * 1000000)) * 1000 + dayofyear(make_timestamp(epoch * 1000000)) AS BIGINT) AS block, phrase, count(*) AS cnt FROM lines GROUP BY ALL")
def configured_feed(spark, sf):
    """A feed whose settings come from a file with variables, of which the command line overrides one."""
    text = f"frequency: '{{{{ UNIT }}}}'\nsearchString: '(click|{{{{ OTHER }}}}) '\nexcludeString:\n- user1\n- '{{{{ NONE }}}}'\ntermCountBorder: 7\nminMatchRate: {_MIN}\n"
    file = config.parsed(text, {"UNIT": "day", "OTHER": "view"})
    m = new_miner(spark, cli.settings(cli.arguments().parse_args(["-m", "feed", "-b", str(_BORDER)]), file))
    m.feed(lines=event_log(spark, sf))
    return m.store.read("phrases").groupBy("block", "phrase").agg(F.sum("cnt").alias("cnt"))


@query(_SUBJECT + f"SELECT strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M:%S') AS Created, strftime(make_timestamp(updated * 1000000), '%Y-%m-%d %H:%M:%S') AS Updated, CAST(cnt AS VARCHAR) AS Count, {_MEMBER} AS Member FROM g JOIN phrases USING (phrase)")
def phrases_file(spark, sf):
    """All phrases written as CSV, and read back."""
    m = new_miner(spark, settings())
    m.feed(lines=event_log(spark, sf))
    path = scratch(spark)
    m.write_phrases(path)
    return logs.read_table(spark, path)


@query(_MINE + f""", days AS (SELECT phrase, epoch // 86400 * 86400 AS at_, count(*) AS cnt FROM lines GROUP BY ALL), ranks AS (SELECT phrase, cnt, row_number() OVER (ORDER BY cnt DESC, phrase) AS n FROM phrases),
t AS (SELECT unnest(range(min(at_), max(at_) + 1, 86400)) AS a FROM days), g AS (SELECT a, n, days.cnt FROM t CROSS JOIN ranks LEFT JOIN days ON days.phrase = ranks.phrase AND at_ = a)
SELECT 'time,' || string_agg(n || '(' || cnt || ')', ',' ORDER BY n) AS line FROM ranks
UNION ALL SELECT strftime(make_timestamp(a * 1000000), '%Y-%m-%d') || ',' || string_agg(coalesce(CAST(cnt AS VARCHAR), ''), ',' ORDER BY n) FROM g GROUP BY a""")
def history_file(spark, sf):
    """The history of all phrases written as a file with a header, and read back."""
    m = new_miner(spark, settings(frequency="day"))
    m.feed(lines=event_log(spark, sf))
    path = scratch(spark)
    m.write_history(path)
    return logs.read_lines(spark, f"{path}/history.csv").select(F.col("value").alias("line"))


# --- sources and stores -----------------------------------------------------------------


@query("SELECT event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no, CAST(event_id AS VARCHAR) || ' ' || props AS value FROM events WHERE event_id % 5 <> 0")
def log_files(spark, sf):
    """Events as gzip files by type, with blank lines and carriage returns, read back as numbered lines."""
    path = scratch(spark)
    blank = F.col("event_id") % 5 == 0
    line = F.when(blank, "").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("props"), F.lit("\r")))
    out = _t(spark, sf, "events").select("event_type", "event_id", line.alias("value"))
    out = out.repartitionByRange("event_type", "event_id").sortWithinPartitions("event_type", "event_id").select("event_type", "value")
    out.write.partitionBy("event_type").option("compression", "gzip").text(path)
    lines = logs.drop_blank(logs.read_lines(spark, f"{path}/*/*.gz"))
    # A type's files are numbered on as one: their names follow the ranges of ids.
    lines = lines.withColumn("kind", F.regexp_extract("file", "event_type=([^/]*)", 1))
    lines = logs.numbered(lines.select(F.col("kind").alias("file"), F.struct("file", "part").alias("part"), "at", "value"))
    return lines.select(F.col("file").alias("kind"), F.col("line_no").cast("long").alias("line_no"), "value")


def document_files(spark, sf):
    """Every document as a file of numbered lines, blank ones too; its id is its time."""
    at = F.posexplode(F.split("text", "\n", -1)).alias("at", "value")
    lines = _t(spark, sf, "documents").select("doc_id", "text").select("doc_id", at)
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    return logs.numbered(lines.select("doc_id", name.alias("file"), F.col("doc_id").alias("mtime"), F.lit(0).cast("long").alias("part"), "at", "value"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY doc_id ORDER BY doc_id LIMIT 50")
def line_counts(spark, sf):
    """The number of lines of each of the first 50 files."""
    return logs.count_files(document_files(spark, sf), first=50).select(F.col("mtime").alias("doc_id"), "n")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, h FROM nation, (SELECT unnest(['with', 'without']) AS h)")
def csv_tables(spark, sf):
    """The nations as CSV with a header and as gzip CSV without one, read back."""
    df = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    a, b = scratch(spark), scratch(spark)
    df.write.csv(a, header=True)
    df.write.csv(b, compression="gzip")
    one, two = logs.read_table(spark, a), logs.read_table(spark, b, ["id", "name"])
    return one.withColumn("h", F.lit("with")).unionByName(two.withColumn("h", F.lit("without")))


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS at_, r_name AS word FROM region")
def word_list(spark, sf):
    path = scratch(spark)
    logs.write_words(spark, [r.r_name for r in _t(spark, sf, "region").orderBy("r_regionkey").collect()], path)
    return spark.createDataFrame(list(enumerate(logs.read_words(spark, path))), "at_ long, word string")


@query(f"SELECT id, CASE WHEN id < 5 THEN 'x' ELSE name END AS name, grp FROM ({_N} UNION ALL {_N}) WHERE grp <> 2")
def table_store(spark, sf):
    """A table made, filled in two appends, changed and reread from its store."""
    store, rows = table.Store(spark, scratch(spark)), _nations(spark, sf)
    store.create("nations", "id long, name string, grp long")
    store.append("nations", rows)
    store.append("nations", rows)
    store.write("nations", table.delete(store.read("nations"), F.col("grp") == 2))
    store.write("nations", table.update(store.read("nations"), {"name": "x"}, F.col("id") < 5))
    return store.read("nations")


@query(f"SELECT * FROM ({_N})")
def row_decode(spark, sf):
    """Rows as texts, and back with their types, each checked for its number of fields."""
    return table.decode(table.encode(_nations(spark, sf)), "fields", "id long, name string, grp long")


@query("SELECT * FROM (VALUES ('geo', 'nations', 0, 'id', 'bigint'), ('geo', 'nations', 1, 'name', 'string'), ('geo', 'nations', 2, 'grp', 'bigint'), ('geo', 'regions', 0, 'r_regionkey', 'bigint'), ('geo', 'regions', 1, 'r_name', 'string'), ('lone', 'lone', 0, 'x', 'double')) v(\"group\", \"table\", place, \"column\", type)")
def table_catalog(spark, sf):
    """The definitions of a store's tables: two of a group, of which one was emptied, and one that never had rows."""
    store = table.Store(spark, scratch(spark))
    store.write("nations", _nations(spark, sf), "geo")
    store.write("regions", _t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"), "geo")
    store.truncate("regions", "geo")
    store.create("lone", "x double")
    return store.catalog()


@query(f"SELECT doc_id, line FROM ({_L2}) WHERE doc_id > 100 OR (doc_id = 100 AND line >= 2)")
def resume_offset(spark, sf):
    """What is new after the second line of file 100."""
    new = logs.drop_blank(logs.select_new(document_files(spark, sf), 100, f"{100:012d}", 2))
    return new.select("doc_id", (F.col("line_no") - 1).cast("long").alias("line"))


@query(f"SELECT seq, value FROM ({_L1}) ORDER BY seq LIMIT 500")
def line_limit(spark, sf):
    """The first 500 lines of a log: what a feed with that limit reads."""
    path = scratch(spark)
    line = F.concat(F.col("seq").cast("string"), F.lit("|"), F.col("value"))
    event_lines(spark, sf).repartitionByRange("seq").sortWithinPartitions("seq").select(line).write.text(path)
    lines = new_miner(spark, settings()).new_lines(path, limit=500)
    return lines.select(F.substring_index("value", "|", 1).cast("long").alias("seq"), F.expr("substr(value, instr(value, '|') + 1)").alias("value"))


# --- blocks -----------------------------------------------------------------------------


def _daily(spark, sf):
    lines = event_lines(spark, sf).withColumn("retention_pos", parse.retention_pos(F.timestamp_seconds("epoch"), "day"))
    return lines.withColumn("phrase", F.element_at(F.split("value", " "), 3))


_DAILY = f"SELECT seq, epoch, string_split(value, ' ')[3] AS phrase, CAST(year(make_timestamp(epoch * 1000000)) * 1000 + dayofyear(make_timestamp(epoch * 1000000)) AS BIGINT) AS retention_pos FROM ({_L1})"


@query(f"SELECT seq, retention_pos, CAST(dense_rank() OVER (ORDER BY retention_pos) - 1 AS BIGINT) AS block_seq FROM ({_DAILY})")
def block_assign_time(spark, sf):
    return ring.block_by_time(_daily(spark, sf)).select("seq", "retention_pos", F.col("block_seq").cast("long").alias("block_seq"))


@query(f"WITH l AS ({_L2}), e AS (SELECT seq, unnest({_tokens_sql()}) AS term FROM l), f AS (SELECT term, min(seq) AS first FROM e WHERE term <> '*' GROUP BY term) SELECT term, (row_number() OVER (ORDER BY first, term) - 1) // 1000 AS block_seq FROM f")
def block_assign_size(spark, sf):
    t = _terms(spark, sf).select("term", F.col("first.seq").alias("first"))
    return ring.block_by_size(t, 1000).select("term", "block_seq")


_BLOCKS = f"WITH d AS ({_DAILY}), b AS (SELECT *, dense_rank() OVER (ORDER BY retention_pos) - 1 AS block_seq FROM d)"


@query(f"{_BLOCKS} SELECT phrase, block_seq % 5 AS block_no, count(*) AS cnt FROM b WHERE block_seq > (SELECT max(block_seq) FROM b) - 5 GROUP BY phrase, block_seq % 5")
def ring_keep_last(spark, sf):
    kept = ring.keep_last(ring.block_by_time(_daily(spark, sf)), 5)
    return kept.groupBy("phrase", F.col("block_no").cast("long").alias("block_no")).agg(F.count(F.lit(1)).alias("cnt"))


@query(f"{_BLOCKS}, s AS (SELECT block_seq, max(epoch) AS last_epoch FROM b GROUP BY block_seq) SELECT block_seq, last_epoch FROM s WHERE last_epoch >= (SELECT max(last_epoch) FROM s) - 3 * 86400 + 1")
def retention_filter(spark, sf):
    status = ring.block_by_time(_daily(spark, sf)).groupBy(F.col("block_seq").cast("long").alias("block_seq")).agg(F.max("epoch").alias("last_epoch"))
    return ring.retained(status, 3, "day")


_HIST = f"{_BLOCKS}, p AS (SELECT phrase, block_seq, count(*) AS cnt, min(epoch) AS created FROM b GROUP BY phrase, block_seq), h AS (SELECT phrase, created // 86400 * 86400 AS at_, CAST(sum(cnt) AS BIGINT) AS cnt FROM p GROUP BY 1, 2)"


def _history(spark, sf):
    p = ring.block_by_time(_daily(spark, sf)).groupBy("phrase", "block_seq").agg(F.count(F.lit(1)).alias("cnt"), F.min("epoch").alias("created"))
    return ring.history(p, 86400)


@query(f'{_HIST} SELECT phrase, at_ AS "at", cnt FROM h')
def history_long(spark, sf):
    return _history(spark, sf)


@query(f'{_HIST}, t AS (SELECT unnest(range(min(at_), max(at_) + 1, 86400)) AS a FROM h) SELECT a AS "at", CAST(sum(cnt) FILTER (phrase = \'click\') AS BIGINT) AS p1, CAST(sum(cnt) FILTER (phrase = \'view\') AS BIGINT) AS p2 FROM t LEFT JOIN h ON a = at_ GROUP BY a')
def history_pivot(spark, sf):
    return ring.history_grid(_history(spark, sf), ["click", "view"], 86400)


@query(f"""{_HIST}, r AS (SELECT phrase, row_number() OVER (ORDER BY sum(cnt) DESC, phrase) AS n FROM h GROUP BY phrase), t AS (SELECT unnest(range(min(at_), max(at_) + 1, 86400)) AS a FROM h),
g AS (SELECT a, n, cnt FROM t CROSS JOIN r LEFT JOIN h ON h.phrase = r.phrase AND at_ = a)
SELECT strftime(make_timestamp(a * 1000000), '%Y-%m-%d') || ',' || string_agg(coalesce(CAST(cnt AS VARCHAR), ''), ',' ORDER BY n) AS line FROM g GROUP BY a""")
def history_lines(spark, sf):
    """The history of all phrases as lines of a delimited file."""
    h = _history(spark, sf)
    total = h.groupBy("phrase").agg((-F.sum("cnt")).alias("o"))
    ranks = ring.ranked(total, "o", "phrase")
    return ring.history_lines(h, ranks, ranks.count(), 86400, "day").select("line")
