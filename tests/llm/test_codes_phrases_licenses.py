"""Vector codes, collocations and licence scans against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import collocations, licenses, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INF = float("inf")


# --- vector codes ---


def brute_codes(rows, entries, rounds, parts=4):
    """With Python's integers only."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    vec = [[math.floor(1024 * v) for v in r[1]] + [0] * (width - len(r[1])) for r in kept]
    m = width // parts
    cut = [[v[p * m : (p + 1) * m] for p in range(parts)] for v in vec]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in order] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            at = [assign(p, x[p])[1] for x in cut]
            new = []
            for e, c in enumerate(books[p]):
                mine = [x[p] for x, k in zip(cut, at) if k == e]
                new.append([sum(col) // len(mine) for col in zip(*mine)] if mine else c)
            books[p] = new
    final = [[assign(p, x[p]) for p in range(parts)] for x in cut]
    text = ",".join(str(v) for b in books for c in b for v in c)
    by_label = Counter()
    for r, f in zip(kept, final):
        by_label[r[2]] += sum(d for d, _ in f)
    return Counter(
        (r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[r[2]], hashlib.sha256(text.encode()).hexdigest())
        for r, f in zip(kept, final)
    )


def vectors(spark, rows):
    """With columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, _by int, _n string")


def codes(df, **named):
    got = vector_codes.compress(df, **named).collect()
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got)


def rows_of_vectors():
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(200 + i, [0.25] * 8, 3) for i in range(80)]  # copies and ties
    rows += [(3, [0.5] * 8, 1), (None, [0.1] * 8, 1), (300, None, 1), (301, [0.1, None] * 4, 2)]
    rows += [(302, [float("nan")] + [0.0] * 7, 2), (303, [INF] * 8, 2), (304, [-INF] * 8, 2), (305, [], None), (306, [1.5, -2.25, 3.0], 1)]
    return rows


@pytest.mark.parametrize("entries,rounds", [(16, 4), (256, 2)])
def test_vector_codes(spark, entries, rounds):
    rows = rows_of_vectors()
    assert codes(vectors(spark, rows), entries=entries, rounds=rounds) == brute_codes(rows, entries, rounds)


def test_vector_codes_large_components(spark):
    rows = [(i, [float((-1) ** i * 10**k)] * 4, 1) for i, k in enumerate([0, 3, 5, 6, 6, 5, 0, 2])]
    assert codes(vectors(spark, rows), entries=3, rounds=3) == brute_codes(rows, 3, 3)
    beyond = codes(vectors(spark, [*rows, (99, [1e300, -1e300, 0.0, 1.0], 2)]), entries=3, rounds=1)
    assert sum(beyond.values()) == 9 and all(0 <= e <= vector_codes.LONG for _, _, e, _, _ in beyond)


def test_vector_codes_empty_and_many_labels(spark, monkeypatch):
    assert vector_codes.compress(vectors(spark, [])).isEmpty()
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).isEmpty()
    out = vector_codes.compress(vectors(spark, rows_of_vectors()), entries=4, rounds=1)
    assert out.columns == ["vec_id", "label", "_by", "_n", "code", "error", "label_error", "codebooks_sha256"]
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 3)
    rows = [(i, v, i if i % 3 else None) for i, v, _ in rows_of_vectors() if i is not None]
    assert codes(vectors(spark, rows), entries=4, rounds=1) == brute_codes(rows, 4, 1)
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, rows), entries=257)


# --- collocations ---


def brute_phrases(rows, least, longest, top, covered=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, all_ in f.items():
        often = {p: a for p, a in all_.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= covered * all_[p[i : i + m]]}
        best = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (all_[p[:k]] * all_[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), all_[p[:k]], all_[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def rows_of_texts():
    rng = random.Random(9)
    words = ["New", "york", "CITY", "the", "of", "über", "a\x01", "a", "x" * 40, "naïve", " ", "東京", "it's", "b-c"]
    ends = ["", "", "", ".", ",", "\n", " \t ", "!?", "\x0b", ";:"]
    text = lambda k: "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(ends) + " " for _ in range(k))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [("new york city hall . ", "en")] * 30 + [("a b a b a b a b", "en"), ("the the the the the the the", "de"), (None, "en"), ("", None), (" \n\t. ", "fr"), (text(20_000), "en")]
    return rows


@pytest.mark.parametrize("least,dictionary", [(3, 1 << 20), (3, 400), (10, 0)])
def test_collocations(spark, monkeypatch, least, dictionary):
    monkeypatch.setattr(collocations, "BUFFER_KEYS", 1000)  # several runs in a task
    rows = rows_of_texts()
    df = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id int, text string, lang string, rank int, key string")
    got = collocations.collocations(df.repartition(5), least=least, top=40, dictionary_bytes=dictionary)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, 5, 40)


def test_collocations_covered_and_shorter(spark):
    rows = rows_of_texts()
    df = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(df, least=5, longest=3, top=1000, covered=60)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 5, 3, 1000, 60)
    assert collocations.collocations(df, least=10**6).isEmpty()
    assert collocations.collocations(df.limit(0)).isEmpty()


def test_radix_order_and_scores_past_64_bits(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 40, (500, 3), np.uint64) >> rng.integers(0, 40, (500, 3), np.uint64)
    assert keys[collocations.radix_order(keys)].tolist() == sorted(keys.tolist())
    from pyspark.sql import functions as F

    big = [3_000_000_000_001, 7_000_000_000_003, 4_000_000_000_007, 5_000_000_000_011]
    df = spark.createDataFrame([tuple(big)], "a long, n long, l long, r long")
    cols = [F.col(c).cast("decimal(20,0)") for c in "anlr"]
    assert df.select(collocations.score_of(*cols)).first()[0] == 1000 * big[0] * big[1] // (big[2] * big[3])


# --- licences ---

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_scan(text, phrases, templates):
    w = re.findall(WORD, (text or "").translate(LOWER))
    at, base, labels, best = [], set(), set(), 0.0
    for phrase, label in phrases:
        p = re.findall(WORD, phrase.translate(LOWER))
        here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += here
        base |= {label} if here else set()
    for label, template, share in templates:
        t = re.findall(WORD, template.translate(LOWER))
        half = 8
        while half < len(t):
            half *= 2
        s = set(t)
        need = math.ceil(round(share * len(s), 9))
        for b in range(max(math.ceil(len(w) / half) - 2, 0) + 1):
            o = len(s & set(w[b * half : b * half + 2 * half]))
            if o >= max(1, need) and t:
                labels.add(label)
                best = max(best, o / len(s))
    score = 1.0 if base else best
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 9)


def rows_of_licences():
    rng = random.Random(4)
    filler = "the of to this software is license under use by free any copy nc cc mit apache general public hereby granted ünder".split()
    some = lambda k: " ".join(rng.choice(filler) for _ in range(k))
    rows = []
    for label, t, _ in licenses.TEMPLATES:
        words = t.split()
        for lost in (0, 2, 5, 9):
            part = [w for i, w in enumerate(words) if i not in set(rng.sample(range(len(words)), min(lost, len(words))))]
            rows.append(some(rng.randint(0, 90)) + "\n" + " ".join(part).upper() + " -- " + some(rng.randint(0, 90)))
    rows += ["MIT  \t license, mit-License; MIT\nLICENSE mit licenses commit license", "...Apache License", "General public, license general public license", "mit mit license license"]
    rows += [None, "", " .,;", some(30_000) + " mit license", "Permission " * 50, "Mit Lıcense mit lİcense Kelvin under", rows[3], rows[3]]
    return rows


def test_license_scan(spark):
    rows = rows_of_licences()
    df = spark.createDataFrame([(i if i % 7 else None, t, "a", 1.5, 2) for i, t in enumerate(rows)], "doc_id long, text string, labels string, _row double, m int")
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "_row", "m", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got.collect())
    assert got == Counter((i if i % 7 else None, *brute_scan(t, licenses.PHRASES, licenses.TEMPLATES)) for i, t in enumerate(rows))
    assert licenses.scan(df.limit(0)).isEmpty()


def test_license_scan_own_lists(spark):
    """Phrases that overlap themselves, templates of any share, and none at all."""
    rng = random.Random(8)
    rows = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    phrases = [("a a", "x"), ("b a b", "y"), ("c", "x"), ("d.d", "z")]
    templates = [("t1", "a b c d e f g a b", 0.5), ("t2", "a c e", 1.0), ("t3", "x y z a", 0.25), ("t4", "...", 0.5)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for p, t in ((phrases, templates), (phrases, []), ([], templates), ([], [])):
        got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(df, phrases=p, templates=t).collect()}
        assert got == {i: brute_scan(x, p, t) for i, x in enumerate(rows)}


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_collocations", "op13_licenses"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from gleaner.llm import queries

    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = db.sql(queries.ORACLE_SQL[name]).project(", ".join(columns)).fetchall()
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(want)
