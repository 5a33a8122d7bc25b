"""The operators as queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    decontamination,
    language_id,
    licenses,
    line_dedup,
    lm_scoring,
    mixing,
    paragraph_dedup,
    pii,
    quality,
    simhash,
    url_filter,
    vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    ids = F.array_join("hit_items", ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        "contaminated",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", lm_scoring.held_out("doc_id").alias("held_out"))
    out = lm_scoring.score(docs, docs.where(~F.col("held_out")))
    return out.drop("text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, line_words=line_dedup.LONG_LINE)
    return out.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The query's key is fixed so that its result is; a real run takes a secret one.
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), "key of the query")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = quality.trusted_sample(docs, _table(spark, sf_dir, "labels"), "doc_id", quality.TRUSTED)
    return quality.judge(docs, trusted).drop("text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_lm_scoring,
        op3_mixing,
        op4_language_id,
        op5_line_dedup,
        op6_pii,
        op7_url_filter,
        op8_substring_dedup,
        op9_quality_rules,
        op10_simhash,
        op11_vector_codes,
        op12_collocations,
        op13_licenses,
    )
}

_OP1 = r"""
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bi AS (
  SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
  FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM bi
), lens AS (SELECT DISTINCT m FROM windows),
di AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m
), dk AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM di
), hits AS (
  SELECT dk.doc_id, dk.i, dk.m, windows.item_id FROM dk JOIN windows ON dk.m = windows.m AND dk.k = windows.k
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

_OP5 = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l
), n AS (SELECT * FROM s WHERE line <> ''),
r AS (
  SELECT doc_id, pos AS a, line, lead(pos) OVER w AS z, lead(line) OVER w AS nxt
  FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), f AS (
  SELECT doc_id, a, z, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, a) AS k FROM r WHERE z IS NOT NULL
), alone AS (
  SELECT doc_id, pos AS a, pos AS z, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k
  FROM n WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS pos
  FROM (SELECT doc_id, a, z, k FROM f UNION ALL SELECT * FROM alone) WHERE k > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS t
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_OP7 = r"""
WITH r(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages
), s AS (
  SELECT page_id, regexp_extract(t, '^[^/?#]*') AS h, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), p AS (
  SELECT page_id, path,
         translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM s
), m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""



def _op11(rounds: int = vector_codes.ROUNDS) -> str:
    best = """a{r} AS MATERIALIZED (
  SELECT vec_id, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT vec_id, x.p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{r} USING (p)
  ) GROUP BY vec_id, p
)"""
    step = """s{r} AS (
  SELECT p, best.e AS e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS y FROM a{r} JOIN x USING (vec_id, p)
), m{r} AS (
  SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, e, i, CAST(sum(y) AS BIGINT) AS t, count(*) AS n FROM s{r} GROUP BY ALL) GROUP BY p, e
), b{n} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))"""
    ctes = []
    for r in range(rounds):
        ctes += [best.format(r=r), step.format(r=r, n=r + 1)]
    ctes.append(best.format(r=rounds))
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * 1024) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, p, w[p * (len(w) // 4) + 1:(p + 1) * (len(w) // 4)] AS v FROM k, (SELECT unnest(range(4)) AS p)
), f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT p, e, v AS c FROM x JOIN f USING (vec_id)),
{', '.join(ctes)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
o AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN k USING (vec_id), h
"""


_OP12 = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
), f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS s FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
scores AS (
  SELECT k.lang, k.phrase, k.k, x.a AS l, y.a AS r, n.n, (CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM k JOIN n ON k.lang = n.lang
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(s[1:k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(s[k.k + 1:], ' ')
), best AS (SELECT lang, phrase, min({'score': score, 'k': k, 'l': l, 'r': r, 'n': n}) AS b FROM scores GROUP BY lang, phrase),
inside AS (
  SELECT lang, array_to_string(s[i:i + q - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c)) GROUP BY ALL
), kept AS (
  SELECT c.lang, c.phrase, c.a, b.l AS l, b.r AS r, b.n AS n, CAST(b.score AS BIGINT) AS score
  FROM c JOIN best USING (lang, phrase) LEFT JOIN inside ON inside.lang = c.lang AND inside.phrase = c.phrase
  WHERE NOT coalesce(100 * longer >= 100 * c.a, false)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def _op13() -> str:
    known = licenses.prepared(licenses.TEMPLATES)
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{t.label}', {quoted(t.words)}, {t.half}, {t.least})" for t in known)
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in licenses.PHRASES)
    return rf"""
WITH t(label, words, half, least) AS (VALUES {templates}), ph(p, label) AS (VALUES {phrases}),
d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
hit AS (SELECT doc_id, i, label FROM i JOIN ph ON w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM hit GROUP BY doc_id),
b AS (
  SELECT doc_id, half, list_distinct(w[b * half + 1:b * half + 2 * half]) AS block
  FROM (SELECT doc_id, w, half, unnest(range(CAST(greatest(ceil(len(w) / half) - 2, 0) AS BIGINT) + 1)) AS b FROM d, (SELECT DISTINCT half FROM t) WHERE len(w) > 0)
), m AS (
  SELECT doc_id, label, len(list_intersect(block, words)) AS o, len(words) AS n, least FROM b JOIN t USING (half)
), found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(o / n) AS containment FROM m WHERE o >= least GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(found.labels, []))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ORACLE_SQL = {
    "op7_url_filter": _OP7,
    "op1_decontamination": _OP1,
    "op5_line_dedup": _OP5,
    "op11_vector_codes": _op11(),
    "op12_collocations": _OP12,
    "op13_licenses": _op13(),
}
