"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import time
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import regex
import xxhash

from gleaner.llm import (
    decontamination,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    paragraph_dedup,
    pii,
    quality,
    simhash,
    url_filter,
)
from gleaner.llm.components import components

WORDS = "alpha beta gamma delta omega sigma kappa lambda river stone tree cloud wind ember moss fern".split()
EXTRA = "doc_id long, text string, n_words long, fingerprint string, component_id string, score string, kept string"


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n"]) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    out = [(i, text(rng, rng.randint(1, 120))) for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, text(rng, 30_000)), (None, "alpha beta gamma")]
    out += [(n + 4, out[3][1]), (5, out[5][1]), (6, "another text of a repeated id")]
    return out


def frame(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "x", "y", "z", "w") for r in rows], EXTRA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def multiset(rows):
    return Counter(map(tuple, rows))


def brute_hits(doc, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = re.findall(word, lower(doc)), set(), set()
    for item, t in items:
        p = re.findall(word, lower(t))
        m = min(13, len(p))
        if item is None or not m:
            continue
        for i in range(len(p) - m + 1):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    rng = random.Random(3)
    items = [(1, text(rng, 20)), (2, text(rng, 13)), (10, "moss fern"), (11, "ember"), (3, None), (4, ""), (None, "river"), (2, text(rng, 40))]
    rows = [(i, t) for i, t in corpus() if len(t or "") < 5000]
    rows += [(100, "x " + items[0][1].upper().replace(" ", "--") + " y"), (101, items[7][1] * 2)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(frame(spark, rows), bench, block_bytes=block_bytes)
    got = [(r.doc_id, r.n_words, r.n_hit, ",".join(r.hit_items), r.contaminated) for r in got.collect()]
    assert multiset(got) == multiset((i, *brute_hits(t, items)) for i, t in rows)
    assert decontamination.decontaminate(frame(spark, rows), bench.limit(0)).where("n_hit > 0 or contaminated").isEmpty()
    # Columns whose names clash with new ones or with helpers', and many copies of a text with hits.
    more = frame(spark, rows + [(200 + i, items[7][1]) for i in range(300)]).selectExpr("doc_id", "text", "'x' as n_hit", "doc_id as _digest", "1 as _found")
    again = decontamination.decontaminate(more, bench, block_bytes=block_bytes)
    assert again.columns == ["doc_id", "text", "_digest", "_found", "n_words", "n_hit", "hit_items", "hit_spans", "contaminated"]
    assert again.where("doc_id >= 200 and n_hit = 40 and contaminated and _digest = doc_id").count() == 300
    merged_spans = lambda r: [*r.hit_spans] == sorted(r.hit_spans) and sum(r.hit_spans[1::2]) - sum(r.hit_spans[::2]) == r.n_hit
    assert all(merged_spans(r) for r in again.collect())
    assert decontamination.decontaminate(frame(spark, []), bench).isEmpty()
    assert decontamination.items_digest([]) == hashlib.sha256(b"").hexdigest()


def test_lm_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", lm_scoring.held_out("doc_id"))
    got = lm_scoring.score(docs, docs.where("not held_out")).collect()
    parted = lm_scoring.score(docs, docs.where("not held_out"), piece_tokens=8, piece_bytes=500, shard_pieces=2).collect()
    toks = [spaced(lower(t)) + [None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) for t in toks]
    want = sorted((len(t), sum(c[w] > 0 for w in t), round(b, 6)) for t, b in zip(toks, base))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n for r in got)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)
    assert np.allclose([r.score for r in sorted(got, key=key)], [r.score for r in sorted(parted, key=key)])
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    empty = lm_scoring.score(docs, docs.limit(0)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in empty)
    assert lm_scoring.score(docs.limit(0), docs).isEmpty()


def test_lm_scores_match_brute_force(spark, monkeypatch):
    """The interpolated bigram model from exact counts, quantised by level; the filter has room, so no chance hits."""
    monkeypatch.setattr(lm_scoring, "BITS_PER_ENTRY", 400)
    rows = [(i, t) for i, t in corpus(7) if len(t or "") < 5000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id % 2 = 0")
    toks = [spaced(lower(t)) + [None] for _, t in rows]
    learnt = [t for (i, _), t in zip(rows, toks) if i is not None and i % 2 == 0]
    c = Counter(w for t in learnt for w in t)
    two = Counter(x for t in learnt for x in zip([None, *t], t))
    n, v = sum(c.values()), len(c)
    kind = lambda h: math.floor(math.log2(c[h]))
    all_of, once = Counter(), Counter()
    for (h, _), k in two.items():
        all_of[kind(h)] += k
        once[kind(h)] += k == 1

    def mean_of_level(k):
        q = next(q for q in range(1, 200) if 1.5 ** (q - 1) - 1e-9 <= k < 1.5**q - 1e-9)
        inside = [x for x in range(1, 20_000) if 1.5 ** (q - 1) - 1e-9 <= x < 1.5**q - 1e-9]
        return sum(inside) / len(inside)

    def p(h, w):
        p1 = (c[w] + 1) / (n + v + 1)
        if not c[h]:
            return p1
        lam = min(0.999, max(0.001, 1 - once[kind(h)] / all_of[kind(h)]))
        return lam * min(mean_of_level(two[h, w]) if two[h, w] else 0, c[h]) / c[h] + (1 - lam) * p1

    want = sorted(round(sum(math.log10(p(h, w)) for h, w in zip([None, *t], t)), 5) for t in toks)
    assert np.allclose(sorted(r.score for r in lm_scoring.score(docs, train).collect()), want, atol=1e-4)
    many = lm_scoring.score(docs, train, piece_tokens=5, piece_bytes=300, shard_pieces=2)
    assert many.columns == lm_scoring.score(docs, train).columns
    assert np.allclose(sorted(r.score for r in many.collect()), want, atol=1e-4)


def test_lm_filter_holds_all_counts():
    g = lm_scoring.mix(np.arange(1, 2001, dtype=np.uint64))
    count = np.arange(2000) % 50 + 1
    q = lm_scoring.level(count)
    bits = int(q.sum()) * lm_scoring.BITS_PER_ENTRY
    filled = np.zeros(-(-bits // 8) * 8, bool)
    for at in range(1, q.max() + 1):
        for probe in range(lm_scoring.PROBES):
            filled[lm_scoring.places(g[q >= at], at, probe, np.uint64(bits)).astype(np.int64)] = True
    f = lm_scoring.Filter([(0, bits, np.packbits(filled, bitorder="little").tobytes())], 1)
    assert (f.levels(g) >= q).all() and (f.levels(g) == q).mean() > 0.97
    other = lm_scoring.mix(np.arange(5001, 9001, dtype=np.uint64))
    assert (f.levels(other) > 0).mean() < 0.03


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", None])) for i in range(3000)] + [(None, "a"), (7, "a"), (7, "a")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, source string, slot int, phase string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    got = mixing.mix(docs, weights, block_rows=10).collect()
    assert multiset((r.doc_id, r.source) for r in got) == multiset(rows)
    slots = {r.slot: (r.phase, r.source) for r in got}
    assert sorted(slots) == list(range(len(slots)))
    assert len({(r.source, r.block_no, r.place_in_block) for r in got}) == len(rows)
    assert len({(r.slot, r.source, r.block_no) for r in got}) == len(slots)
    first = [s for t, (p, s) in sorted(slots.items()) if p == 0]
    shares = mixing.parts(weights, mixing.RESOLUTION)
    for t in range(1, len(first) + 1):
        for s in weights:
            assert abs(first[:t].count(s) - t * shares[s] / sum(shares.values())) < 1
    assert mixing.mix(docs.limit(0)).isEmpty()


@pytest.mark.parametrize(
    "weights",
    [{"a": 0.9, "b": 0.1}, {k: (10 if k else 141) ** 0.5 for k in range(21)}, {k: 1 if k else 450 for k in range(901)}],
)
def test_mixing_keeps_to_the_given_weights(weights):
    total, got = sum(weights.values()), dict.fromkeys(weights, 0)
    plan = mixing.schedule({s: int(12_000 * w / total) + 50 for s, w in weights.items()}, weights, mixing.RESOLUTION)
    first = [(t, s) for t, k, s in plan if k == 0]
    assert len(first) > 12_000 and [t for t, _ in first] == list(range(len(first)))
    for t, s in first:
        got[s] += 1
        assert abs(got[s] - (t + 1) * weights[s] / total) < 1
        if t % 97 == 0:
            assert all(abs(got[x] - (t + 1) * w / total) < 1 for x, w in weights.items())


def test_mixing_over_chunks_of_the_schedule(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 10 = 0, 'b', 'a') as source")
    got = {r.slot: r.source for r in mixing.mix(docs, {"a": 0.9, "b": 0.1}, block_rows=1).collect()}
    assert sorted(got) == list(range(9000))
    n = 0
    for t in range(9000):
        n += got[t] == "b"
        assert abs(n - (t + 1) / 10) < 1


def test_mixing_period_meets_windows():
    shares = {"a": 7, "b": 5, "c": 3, "d": 1, "e": 1}
    n = sum(shares.values())
    ran = list(mixing.earliest_first(shares))
    assert len(ran) == n
    for s in shares:
        for i, t in enumerate(t for t in range(n) if ran[t] == s):
            assert i * n // shares[s] <= t < -(-(i + 1) * n // shares[s])


def brute_schedule(blocks, weights):
    """Every slot looks at every source, in exact fractions."""
    left, out = dict(blocks), []
    while any(left.values()):
        live = sorted(s for s in left if left[s])
        total = sum(Fraction(str(weights[s])) for s in live)
        w = {s: Fraction(str(weights[s])) / total for s in live}
        ran = dict.fromkeys(live, 0)
        for t in itertools.count():
            free = [s for s in live if math.floor(ran[s] / w[s]) <= t]
            s = min(free, key=lambda s: (math.ceil((ran[s] + 1) / w[s]), s))
            ran[s] += 1
            out.append(s)
            if ran[s] == left[s]:
                break
        left = {s: left[s] - ran.get(s, 0) for s in left}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_mixing_schedule_matches_brute_force(seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(rng.randint(1, 7))]
    blocks = {s: rng.randint(0, 40) for s in names}
    weights = {s: rng.choice([0.5, 1.0, 0.125, 3.75, 0.1, 12.0]) for s in names}
    got = list(mixing.schedule(blocks, weights, mixing.RESOLUTION))
    assert [t for t, _, _ in got] == list(range(sum(blocks.values())))
    assert [s for _, _, s in got] == brute_schedule(blocks, weights)
    assert [k for _, k, _ in got] == sorted(k for _, k, _ in got)


@pytest.mark.parametrize("seed", range(12))
def test_mixing_frames_need_no_earlier_ones(seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(rng.choice([2, 3, 5, 9, 14]))]
    weights = {s: rng.choice([1.0, 1.0, 0.3, 7.1, 0.125, rng.random() + 0.02]) for s in names}
    total = sum(weights.values())
    blocks = {s: int(rng.choice([0.5, 1, 1, 1.3]) * 4000 * w / total) + rng.randint(0, 3) for s, w in weights.items()}
    every = list(mixing.frames(blocks, weights, mixing.RESOLUTION, 1))
    assert max(f[3] for f in every) > 0  # a phase has several
    got = list(mixing.schedule(blocks, weights, mixing.RESOLUTION, 1))
    assert got == list(mixing.schedule(blocks, weights, mixing.RESOLUTION)) and [t for t, _, _ in got] == list(range(sum(blocks.values())))
    assert [s for _, _, s in got] == brute_schedule(blocks, weights)
    rng.shuffle(every)
    slots = sorted((t, f[0], s) for f in every for t, s, _ in mixing.in_frame(f, weights, mixing.RESOLUTION))
    assert slots == got


def test_mixing_hands_out_frames_without_running_blocks():
    blocks = {f"s{i}": 10**8 + i for i in range(20)}
    weights = {s: (i + 1) ** 0.5 for i, s in enumerate(blocks)}
    began = time.time()
    every = list(mixing.frames(blocks, weights, mixing.RESOLUTION))
    assert time.time() - began < 60 and sum(f[4] - f[3] for f in every) == sum(blocks.values())


def test_mixing_plan_is_made_by_tasks(spark):
    blocks, weights = {"a": 9000, None: 2500, "c": 700, "d": 1}, {"a": 0.7, None: 0.2, "c": 0.09, "d": 0.01}
    names = {None: 0, "a": 1, "c": 2, "d": 3}
    rows = mixing.plan(spark, blocks, weights, mixing.RESOLUTION, names, 500).collect()
    assert all(len(r["_slots"]) <= mixing.CHUNK for r in rows) and len({(r["_k"], r["_c"]) for r in rows}) == len(rows)
    got = {(t, p): (r["_k"], r["_c"] * mixing.CHUNK + i) for r in rows for i, (t, p) in enumerate(zip(r["_slots"], r["_phases"], strict=True))}
    ran, expected = dict.fromkeys(names, 0), {}
    for t, p, s in mixing.schedule(blocks, weights, mixing.RESOLUTION):
        expected[t, p] = names[s], ran[s]
        ran[s] += 1
    assert got == expected


def test_mixing_deals_out_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_ROWS", 50)
    rows = [(None if i % 3 else i, "a", i) for i in range(900)] + [(i, "b", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int")
    got = mixing.mix(docs, {"a": 3, "b": 1}, block_rows=10).collect()
    assert multiset((r.doc_id, r.source, r.n) for r in got) == multiset(rows)
    assert len({(r.slot, r.place_in_block) for r in got}) == 1200 and {r.place_in_block for r in got} == set(range(10))


def test_language_id(spark):
    rng = random.Random(2)
    of = {"en": "the of and that with river stone".split(), "de": "der die und nicht sich straße über".split(), "fr": "le la que avec pour étoile être".split()}
    rows = [(i, " ".join(rng.choices(of[x], k=rng.randint(5, 60))), x) for i, x in enumerate(rng.choices(list(of), k=200))]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 ... 456", "de"), (903, "the river " * 3000, "en"), (904, "la étoile", None), (None, "der die und", "de")]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, lang_pred string, held_out boolean")
    got = {r.doc_id: r for r in language_id.identify(docs, sample=30).collect()}
    right = [got[i].lang_pred == x for i, _, x in rows[:200] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(right) and len(right) > 40
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "en", "fr", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.lang_pred == "und" for r in language_id.identify(docs.where("lang is null")).collect())
    assert language_id.identify(docs.limit(0)).isEmpty()


def test_forward_sums_all_segmentations():
    names = sorted({bytes([b]) for b in range(256)} | {b" ab", b"ab", b"bc", b"abc", b"c ", "é".encode(), b"abcabcabcabcabcabcabcabcabc"})
    table = language_id.Pieces(names)
    p = np.random.default_rng(0).random((len(names), 2)) / 9

    def brute(w, k):
        """Log-sum over segmentations, from the word's begin on."""
        total = [1.0]
        for j in range(1, len(w) + 1):
            total.append(sum(total[j - len(n)] * p[i, k] for i, n in enumerate(names) if w[:j].endswith(n)))
        return math.log(total[-1])

    words = [b"abc", b"cabc", b"xabb", b"abc" * 30, "éabñ".encode(), b"q"]
    got = table.inside(words).log_words(np.log(p))
    assert np.allclose(got, [[brute(b" " + w, k) for k in (0, 1)] for w in words])
    whole = table.inside([b"abcx" * 60]).log_words(np.log(p))
    assert np.isfinite(whole).all() and np.allclose(whole, [[brute(b" " + b"abcx" * 60, k) for k in (0, 1)]])


def test_words_are_never_cut():
    """A word of 200 bytes, a sentence without spaces, and one so long that plain products would underflow."""
    words = language_id.words_of("Ab" * 100 + " これは空白のない日本語の文章であり、途中で切られてはなりません。\u00a0ÉTÉ")
    assert words == [b"ab" * 100, "これは空白のない日本語の文章であり、途中で切られてはなりません。".encode(), "été".encode()]
    table = language_id.Pieces(sorted({bytes([b]) for b in range(256)} | {b"ab"}))
    log_p = np.full((table.size, 1), -5.0)
    x = [0.0, -5.0]  # by a plain recursion: p(j) = p(j - 1) e^-5 + p(j - 2) e^-5 after every "ab"
    for j in range(2, 6002):
        x.append(np.logaddexp(x[-1] - 5, x[-2] - 5) if j % 2 else x[-1] - 5)
    assert np.allclose(table.inside([b"ab" * 3000]).log_words(log_p)[0, 0], x[6001])


def test_language_scores_match_brute_force(spark):
    """Posteriors from the learnt probabilities by a plain recursion over each word."""
    rows = [(i, t, x) for i, (t, x) in enumerate([("the river and the stone", "en"), ("der die und straße", "de"), ("le étoile avec", "fr")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table, log_p, prior = language_id.fit(docs, "doc_id", "text", "lang", language_id.VOCABULARY, 200, 3)
    names = language_id.pieces(language_id.VOCABULARY)
    assert np.allclose(np.exp(log_p).sum(axis=0), 1) and not any(n != n.decode(errors="ignore").lower().encode() for n in names if len(n) > 1)
    at = {n: i for i, n in enumerate(names)}

    def brute(word, k):
        total = [1.0]
        for j in range(1, len(word) + 1):
            total.append(sum(total[i] * math.exp(log_p[at[word[i:j]], k]) for i in range(j) if word[i:j] in at))
        return math.log(total[-1])

    for r in language_id.identify(docs).collect():
        logs = [prior[k] + sum(brute(b" " + w.encode(), k) for w in r.text.lower().split()) for k in range(len(langs))]
        best = max(range(len(langs)), key=lambda k: logs[k])
        assert r.lang_pred == langs[best] and abs(r.score - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-4


def brute_lines(rows, t, long_line=None):
    seen, gone = {}, {}
    docs = sorted({(i is not None, i if i is not None else 0, x) for i, x in rows if x is not None})
    for has, i, x in docs:
        lines = [(k, s.strip(" \t\n\v\f\r")) for k, s in enumerate(x.split("\n"))]
        lines = [(k, s) for k, s in lines if s]
        for a in range(len(lines) - t + 1):
            run = tuple(s for _, s in lines[a : a + t])
            if seen.setdefault(run, (has, i, x, a)) != (has, i, x, a):
                gone.setdefault((i if has else None, x), set()).update(range(lines[a][0], lines[a + t - 1][0] + 1))
        for k, line in lines:
            if long_line and len(spaced(line)) > long_line and seen.setdefault(line, (has, i, x, k)) != (has, i, x, k):
                gone.setdefault((i if has else None, x), set()).add(k)
    return [(i, x if x is None else "\n".join(s for k, s in enumerate(x.split("\n")) if k not in gone.get((i, x), ())), len(gone.get((i, x), ()))) for i, x in rows]


@pytest.mark.parametrize("t", [2, 3])
def test_line_dedup(spark, t):
    rng = random.Random(8)
    pool = [text(rng, 6).replace("\n", " ") for _ in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 15)))) for i in range(80)]
    rows += [(90, None), (91, ""), (3, rows[3][1]), (92, "\n".join(pool) * 60), (None, "\n".join(pool[:5]))]
    got = line_dedup.dedup_lines(frame(spark, rows), min_lines=t).collect()
    assert multiset((r.doc_id, r.text, r.n_removed) for r in got) == multiset(brute_lines(rows, t))
    assert line_dedup.dedup_lines(frame(spark, [])).isEmpty()


def test_fingerprints_of_lines_that_stand_once_are_not_exchanged(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {k} of {i}" for k in range(20))) for i in range(200)]
    rows += [(900, "new\n" + rows[7][1])]
    seen, real = [], line_dedup.sifted

    def sifted(df, filter_, h, name):
        out = real(df, filter_, h, name)
        seen.append((df.count(), out.where(name).count()))
        return out

    monkeypatch.setattr(line_dedup, "sifted", sifted, raising=False)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: (x, 0) for i, x in rows[:-1]} | {900: ("new", 20)}
    ((fingerprints, exchanged),) = seen
    assert fingerprints > 2000 and exchanged < fingerprints / 50


def test_long_single_lines(spark):
    new = lambda n, k: " ".join(f"l{k}w{i}" for i in range(n))
    rows = [(1, f"head\n{new(51, 1)}\ntail"), (2, f"other\n  {new(51, 1)} \n{new(50, 2)}\nend"), (3, new(51, 1)), (4, f"x\n{new(50, 2)}\ny"), (5, f"{new(60, 3)}\nmid\n\n{new(60, 3)}\nq"), (6, None), (None, new(60, 3)), (7, f"head\n{new(51, 1)}\nz")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows), line_words=50).collect()}
    of = dict(rows)
    assert got[1] == (of[1], 0) and got[2] == (f"other\n{new(50, 2)}\nend", 1) and got[3] == ("", 1)
    assert got[4] == (of[4], 0) and got[5] == ("mid\n\nq", 2) and got[6] == (None, 0) and got[None] == (of[None], 0)
    assert got[7] == ("z", 2)


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 300).astype(np.uint64)
    for w in (1, 2, 5):
        picked = set(line_dedup.winnow(h, w).tolist())
        assert all(picked & set(range(i, i + w)) for i in range(len(h) - w + 1))


KEY = "gleaner"
PEOPLE = [
    (1, "Mail jane.doe@mail5.example.com or call +1 (743) 555-3824, card 4785380592391139."),
    (2, "Again jane.doe@mail5.example.com and 152.143.123.131, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""),
    (3, "Mr. John Smith met Mrs. Mary Jones; later Mr. Smith left. Господин Иван Петров пришёл."),
    (4, "Frau Erika Muster, SSN 123-45-6789."), (5, None), (6, ""), (7, "nothing here"), (1, "4785380592391139 " * 2000), (None, "8.8.8.8"),
]


def test_pii(spark):
    docs = spark.createDataFrame([(*r, "x") for r in PEOPLE], "doc_id long, text string, n_entities string")
    got = {(r.doc_id, i): r for i, r in enumerate(pii.pseudonymise(docs, KEY).orderBy("doc_id", "text").collect())}
    out = {k[0]: v for k, v in got.items() if k[0] != 1}
    whole = "\n".join(r.text or "" for r in got.values())
    for secret in ("jane.doe", "555-3824", "4785380592391139", "152.143.123.131", "24be6443", "Smith", "Jones", "Muster", "Петров", "123-45-6789", "8.8.8.8"):
        assert secret not in whole
    one = next(r for k, r in got.items() if k[0] == 1 and r.n_entities == 3)
    mail = re.search(r"\S+@\S+\.com", one.text)[0]
    assert mail in out[2].text and re.fullmatch(r"[a-z]{4}\.[a-z]{3}@[a-z]{4}\d\.[a-z]{7}\.com", mail)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one.text) and re.search(r"4\d{15}\.", one.text)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); later Mr\. (\w+) left\. Господин ([А-Яа-яё]+) ([А-Яа-яё]+) пришёл\.", out[3].text)
    assert m and m[2] == m[5] and m[2] != m[4]
    assert m[1] in pii._GIVEN["m", "Latin"].split() and m[3] in pii._GIVEN["f", "Latin"].split()
    assert (out[5].text, out[5].n_entities, out[6].text, out[7].text) == (None, 0, "", "nothing here")
    assert max(r.n_entities for r in got.values()) == 2000
    assert pii.pseudonymise(docs.limit(0), KEY).isEmpty()


def test_pii_surrogates_stay_distinct(spark):
    names = [chr(65 + i // 26) + chr(97 + i % 26) + "on" for i in range(500)]
    rows = [(i, f"Mr. {n} came.") for i, n in enumerate(names)] + [(900, f"Mr. {pii._SURNAMES['Latin'].split()[0]} came.")]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    new = [r.text.split()[1] for r in got]
    assert len(set(new)) == len(rows) and not set(new) & {t.split()[1] for _, t in rows}


def test_pii_small_formats_stay_distinct(spark, monkeypatch):
    """400 of the 676 addresses of one form: surrogates grow until all differ from each other and from all entities."""
    monkeypatch.setattr(pii, "SAME_LENGTH", 1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.io" for a in letters for b in letters][:400]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(mails)), "doc_id long, text string"), KEY).collect()
    new = {r.text for r in got}
    assert len(new) == 400 and not new & set(mails) and all(re.fullmatch(r"[a-z]+@[a-z]\.io", x) for x in new)


def test_pii_exhausted_formats_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 3)
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, attempt, key: pii.F.lit("1.1.1.1"))
    with pytest.raises(ValueError, match="ip"):
        pii.pseudonymise(spark.createDataFrame([(1, "8.8.8.8 9.9.9.9")], "doc_id long, text string"), KEY).collect()
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")


def test_pii_every_script_is_replaced(spark):
    rows = [(i, f"{x}@example.com") for i, x in enumerate(["محمد", "山田", "יוסי", "ανδρεασ", "каролина", "सविता", "かすみ", "ヤマダ", "김철수", "Ծովինար", "สมชาย", "ⴰⵎⵓⵔ", "٠١٢٣٤٥٦٧"])]
    for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect():
        old, new = dict(rows)[r.doc_id].split("@")[0], r.text.split("@")[0]
        assert new != old and len(new) == len(old)
        assert all(regex.match(r"[\p{L}\p{N}\p{M}]", c) for c in new)
        if r.doc_id < 11:
            script = next(s for s in ("Arabic", "Han", "Hebrew", "Greek", "Cyrillic", "Devanagari", "Hiragana", "Katakana", "Hangul", "Armenian", "Thai") if regex.match(rf"\p{{{s}}}", old))
            assert all(regex.match(rf"\p{{{script}}}", b) for a, b in zip(old, new) if regex.match(r"\p{L}", a))


def test_pii_names_without_titles_and_more_formats(spark):
    rows = [
        (1, "Mr. John Smith came. John Smith left; Smith's hat, and John. Smithson stayed, blacksmith too."),
        (2, "Dr. Anna Weiss and Prof. Peter Klein; Herr Dr. Hans O'Brien-Müller. Weiss smiled."),
        (3, "Ring 743-555-3824 or 743.555.3824; at 2001:db8::1 and fe80:0:0:0:0:0:0:1, not 12:30:45."),
        (4, "M. Street is long. M. Jean Dupont lives there. Dupont!"),
        (5, "Pay 4012 8888 8888 1881 or 4012888888881882."),
        (6, "John Smith has no title here."),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) (\w+) left; (\w+)'s hat, and (\w+)\. Smithson stayed, blacksmith too\.", got[1].text)
    assert m and m[1] == m[3] == m[6] != "John" and m[2] == m[4] == m[5] != "Smith" and got[1].n_entities == 5
    m = re.fullmatch(r"Dr\. (\w+) (\w+) and Prof\. (\w+) (\w+); Herr Dr\. (\w+) (\w+)\. (\w+) smiled\.", got[2].text)
    assert m and m[1].startswith(tuple(pii._GIVEN["n", "Latin"].split())) and m[5].startswith(tuple(pii._GIVEN["m", "Latin"].split())) and m[7] == m[2]
    m = re.fullmatch(r"Ring (\d{3}-\d{3}-\d{4}) or (\d{3}\.\d{3}\.\d{4}); at (\w{4}:\w{3}::\w) and (\w{4}(?::\w){7}), not 12:30:45\.", got[3].text)
    assert m and got[3].n_entities == 4 and m[1] != "743-555-3824" and m[3] != "2001:db8::1"
    m = re.fullmatch(r"M\. Street is long\. M\. (\w+) (\w+) lives there\. (\w+)!", got[4].text)
    assert m and m[2] == m[3] != "Dupont" and m[1].startswith(tuple(pii._GIVEN["m", "Latin"].split()))

    def luhn(x):
        d = [int(c) for c in x if c.isdigit()][::-1]
        return sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0

    cards = re.findall(r"\d[\d ]{11,}\d", got[5].text)
    assert luhn(cards[0]) and re.fullmatch(r"4\d{3}( \d{4}){3}", cards[0]) and cards[0] != "4012 8888 8888 1881"
    assert got[6].text == rows[5][1]


def brute_entities(text):
    """The places of entities that begin at each character, found one at a time."""
    out, i = [], 0
    patterns = [(k, regex.compile(p.replace("Is", "").replace("&&", ""))) for k, p in pii.PATTERNS]
    while i < len(text):
        hit = next(((k, m) for k, p in patterns if (m := p.match(text, i)) and m.end() > i), None)
        if hit:
            out.append((hit[0], i, hit[1].end()))
            i = hit[1].end()
        else:
            i += 1
    return out


def test_pii_matches_brute_force(spark):
    """Places by a plain search; surrogates are a one-to-one map that keeps length classes and misses no place."""
    rng = random.Random(21)
    make = {
        "email": lambda: f"u{rng.randint(0, 60)}@m{rng.randint(0, 3)}.example.com",
        "ip": lambda: ".".join(str(rng.randint(1, 30)) for _ in range(4)),
        "ssn": lambda: f"{rng.randint(100, 120)}-{rng.randint(10, 12)}-{rng.randint(1000, 1009)}",
        "phone": lambda: f"+1 ({rng.randint(200, 210)}) 555-{rng.randint(1000, 1020)}",
        "card": lambda: str(rng.randint(4 * 10**15, 4 * 10**15 + 40)),
    }
    rows = [(i, " ".join(f"{w} {make[rng.choice(list(make))]()}" if rng.random() < 0.3 else w for w in rng.choices(WORDS, k=30))) for i in range(120)]
    to, back = {}, {}
    for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect():
        old = dict(rows)[r.doc_id]
        found, new = brute_entities(old), brute_entities(r.text)
        assert [k for k, _, _ in found] == [k for k, _, _ in new] and r.n_entities == len(found)
        gaps = lambda t, f: [t[a:b] for a, b in zip([0, *[z for *_, z in f]], [*[a for _, a, _ in f], len(t)])]
        assert gaps(old, found) == gaps(r.text, new)
        for (k, a, z), (_, b, y) in zip(found, new):
            assert to.setdefault((k, old[a:z]), r.text[b:y]) == r.text[b:y]
            assert back.setdefault((k, r.text[b:y]), old[a:z]) == old[a:z]
    assert len(to) > 200 and not {(k, v) for (k, _), v in to.items()} & set(to)


def test_pii_planted_entities_are_found(spark):
    """Places are known from how the texts were made, not from the operator's patterns."""
    rng = random.Random(33)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    make = [
        lambda: f"{rng.choice(['Mr', 'Mrs', 'Dr.', 'Frau', 'Prof.'])} {rng.choice(['Anna', 'Jörg', 'Zoë'])} {rng.choice(['O’Neill', 'Brown-Ikeda', 'Müller'])}",
        lambda: "7" + hexes(31),
        lambda: "2001:db8:" + ":".join(hexes(4) for _ in range(5)) + ":1",
        lambda: f"fe80::{hexes(4)}:{rng.randint(1, 9)}",
        lambda: f"a.b_{rng.randint(0, 99)}+x@sub.host-{rng.randint(0, 9)}.example.org",
        lambda: f"10.{rng.randint(0, 255)}.0.{rng.randint(1, 255)}",
    ]
    texts = []
    for i in range(60):
        planted = [rng.choice(make)() for _ in range(rng.randint(0, 6))]
        gaps = [" " + " ".join(rng.choices(WORDS, k=3)) + rng.choice([" ", ", ", "; (", " "]) for _ in range(len(planted) + 1)]
        texts.append((i, planted, gaps, "".join(g + p for g, p in zip(gaps, [*planted, ""]))))
    got = pii.pseudonymise(spark.createDataFrame([(i, t) for i, _, _, t in texts], "doc_id long, text string"), KEY).collect()
    for r in got:
        _, planted, gaps, _ = texts[r.doc_id]
        found = re.fullmatch("(.+?)".join(re.escape(g) for g in gaps), r.text, re.S)
        assert found and r.n_entities == len(planted)
        assert not set(planted) & set(found.groups())


def test_pii_very_long_words(spark):
    """Neither the matcher's stack nor the square of a word's length."""
    m = 10**6
    rows = ["Mr. A" + "a" * m, "x@" + "a." * (m // 2) + "com", "a" * m, "Mr. " * (m // 8) + "Smith", "1 " * (m // 4), "f" * m]
    rows += ["Mr. A" + "-a" * (m // 4), "Mr. A" + "a" * m + " Smith", ":1" * (m // 4), "x@" * (m // 4)]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert "aaaaaaaaaa" not in got[0].text and got[0].n_entities == 1 and got[7].n_entities == 1 and "Smith" not in got[7].text
    assert got[3].text.startswith("Mr. Mr. ") and "Smith" not in got[3].text
    assert [got[i].text == rows[i] for i in (1, 2, 5, 8, 9)] == [True] * 5


def brute_url(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = lower(host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("block", [100, 2])
def test_url_filter(spark, block):
    urls = ["http://a.example.com/en/1", "https://EXAMPLE.com/en/71?x=/de/", "http://x.example.net/de/8", "http://net/de/", "http://org/es/#a", "http://b.org/es", "http://notexample.com/en/7", "ftp://com", "com/en/", "", None, "://com/en/", "http://com?/en/", "http://a.example.com/en/7/é", "x" * 50000 + "://com/en/" + "y" * 50000, "http://a.example.com/en/1"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict int")
    got = url_filter.filter_urls(pages, block_rules=block).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute_url(u) for u in urls]
    assert url_filter.filter_urls(pages, []).where("verdict != 'allow' or rule is not null").isEmpty()
    assert url_filter.filter_urls(pages.limit(0)).isEmpty()


def brute_paragraphs(t, least=6):
    out = []
    for line in (t or "").split("\n"):
        now = []
        for w in spaced(line):
            now.append(w)
            if w[-1] in ".!?":
                out.append(now)
                now = []
        out += [now] if now else []
    return {k: tuple(lower(w) for w in p) for k, p in enumerate(out) if len(p) >= least}


def test_paragraph_dedup(spark):
    rng = random.Random(4)
    long = [f"w{rng.randint(0, 9999)}" for _ in range(40)]
    near = [long[0], "changed", *long[2:]]
    other = [f"v{rng.randint(0, 9999)}" for _ in range(40)]
    rows = [(1, " ".join(long) + "."), (2, "Intro. " + " ".join(other) + ". " + " ".join(near) + "."), (3, "Intro words. " + " ".join(other) + ".\nshort one."), (4, " ".join(long).upper() + "."), (5, None), (6, ""), (7, "one two three four five six. one two three four five six."), (1, " ".join(long) + ".")]
    docs = frame(spark, rows)
    found = paragraph_dedup.repeated_paragraphs(docs, min_words=6)
    got = found.collect()

    def sh(p):
        return {p[i : i + 5] for i in range(len(p) - 4)}

    occ = {(i, k): p for i, t in rows for k, p in brute_paragraphs(t).items()}
    root = {o: o for o in occ}
    for a in occ:
        for b in occ:
            x, y = sh(occ[a]), sh(occ[b])
            if len(x & y) >= 0.8 * len(x | y):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {o: new if r == old else r for o, r in root.items()}
    many = Counter(root.values())
    want = {(o[0], o[1], r[0], r[1], o != r) for o, r in root.items() if many[r] > 1}
    assert {(r.doc_id, r.paragraph, r.kept_key, r.kept_paragraph, r.removed) for r in got} == want
    assert any(0 < len(sh(occ[a]) & sh(occ[b])) < len(sh(occ[a])) and root[a] == root[b] for a in occ for b in occ)
    cut = {r.doc_id: r.text for r in paragraph_dedup.remove_paragraphs(docs, found).collect()}
    assert cut[2] == f"Intro. {' '.join(other)}. " and cut[7] == "one two three four five six. " and cut[5] is None
    assert paragraph_dedup.repeated_paragraphs(docs.limit(0)).isEmpty()


def brute_passages(rows, n):
    """Spans of words (key, word) that a run of n words covers which stands earlier."""
    seen, gone = {}, set()
    for i, t in sorted(rows):
        w = spaced(lower(t))
        for a in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[a : a + n]), (i, a)) != (i, a):
                gone |= {(i, k) for k in range(a, a + n)}
    return gone


def test_passages_without_long_sentences(spark):
    rng = random.Random(12)
    new = lambda n, mark: " ".join(f"q{rng.randint(0, 10**9)}" + mark * (k % 3 == 2) for k in range(n))
    short, plain = new(120, "."), new(120, "")
    part = " ".join(plain.split()[40:91])
    rows = [(1, new(30, ".") + " " + short + " " + new(9, "")), (2, plain), (3, short), (4, new(70, "") + " " + part.upper() + " " + new(80, "")), (5, new(20, "") + "\n" + part + "\n" + new(60, ".") + " " + short), (6, " ".join(plain.split()[:49])), (7, new(4, ".") + "."), (8, None), (9, "")]
    rows += [(20 + k, " ".join(rng.choice([short, plain, new(40, ".")]) for _ in range(4))) for k in range(6)]
    docs = frame(spark, rows)
    found = paragraph_dedup.repeated_paragraphs(docs)
    of, got = dict(rows), set()
    for r in found.where("removed and paragraph is null").collect():
        data = of[r.doc_id].encode()
        before = len(spaced(data[: r.first].decode()))
        got |= {(r.doc_id, before + k) for k in range(len(spaced(data[r.first : r.end].decode())))}
    assert got == brute_passages([r for r in rows if r[1]], paragraph_dedup.RUN)
    assert {k for i, k in got if i == 4} == set(range(70, 121)) and not any(i == 6 for i, _ in got)
    cut = {r.doc_id: r.text for r in paragraph_dedup.remove_paragraphs(docs, found).collect()}
    assert cut[3] == "" and cut[1] == of[1] and len(cut[4].split()) == 150
    p = paragraph_dedup.Paragraphs(np.array([0, len(short)]), np.frombuffer(short.encode(), np.uint8), 6)
    assert p.words.sum() == 120 and p.words.min() >= 6


def test_paragraphs_of_repeated_and_null_ids(spark):
    rng = random.Random(13)
    new = lambda n: " ".join(f"x{rng.randint(0, 10**9)}" for _ in range(n)) + "."
    a, b, c, passage = new(30), new(30), new(31), new(60)
    rows = [(5, f"{a} {b}"), (5, f"{a} {c}"), (5, None), (None, f"{b} {passage}"), (None, f"é {passage} {c}"), (None, None), (5, f"{a} {b}"), (6, "")]
    docs = frame(spark, rows)
    found = paragraph_dedup.repeated_paragraphs(docs)
    assert {r.cluster for r in found.where("paragraph is not null").collect()} and found.where("text_hash is null").isEmpty()
    listed = multiset((r.doc_id, r.removed) for r in found.where("paragraph is not null").collect())
    assert sum(listed.values()) == 3 + 3 + 2 + 2 and sum(n for (_, gone), n in listed.items() if not gone) in (4, 5)
    cut = paragraph_dedup.remove_paragraphs(docs, found).collect()
    assert len(cut) == len(rows) and [r.text for r in cut].count(None) == 2
    left = " ".join({(r.doc_id, r.text) for r in cut if r.text} and sorted({r.text for r in cut if r.text}))
    for p in (a, b, c, passage):
        assert left.count(p) == 1
    assert all(r.n_removed == 0 for r in cut if not r.text and (r.doc_id == 6 or r.text is None))


def test_near_paragraphs_are_recalled(spark):
    """Of all pairs of paragraphs with a Jaccard similarity of 0.8 or more, by brute force, at least 0.9 are linked."""
    rng = random.Random(14)
    rows, paragraphs = [], []
    for k in range(120):
        base = [f"b{rng.randint(0, 10**9)}" for _ in range(rng.randint(60, 120))]
        for _ in range(3):
            p = list(base)
            for _ in range(rng.randint(0, 3)):
                p[rng.randrange(len(p))] = f"e{rng.randint(0, 10**9)}"
            paragraphs.append((k, {tuple(p[i : i + 5]) for i in range(len(p) - 4)}))
            rows.append((len(rows), f"n{len(rows)}. " + " ".join(p) + "."))
    want = {(i, j) for i, (_, x) in enumerate(paragraphs) for j, (_, y) in enumerate(paragraphs[:i]) if len(x & y) >= 0.8 * len(x | y)}
    got = {r.doc_id: r.cluster for r in paragraph_dedup.repeated_paragraphs(frame(spark, rows)).where("paragraph is not null").collect()}
    hit = sum(got.get(i, -1) == got.get(j, -2) for i, j in want)
    assert len(want) > 100 and hit >= 0.9 * len(want)
    of = {}
    for i, c in got.items():
        of.setdefault(c, set()).add(paragraphs[i][0])
    assert all(len(k) == 1 for k in of.values())


def test_passage_that_repeats_itself_keeps_one(spark):
    docs = spark.createDataFrame([(1, "a b c " * 100), (2, "a b c " * 100)], "doc_id long, text string")
    found = paragraph_dedup.repeated_passages(docs, "doc_id", "text").collect()
    assert min(r.first for r in found if r.key == 1) == 99 and min(r.first for r in found if r.key == 2) == 0


def brute_quality(t):
    w = spaced(t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    covered = {j for i, x in enumerate(g) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(x in "#*$%&|<>" for x in t or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    good = [(i, " ".join(rng.choices(words, k=80))) for i in range(40)]
    bad = [(100 + i, " ".join(w + rng.choice(["###", "$$$"]) for w in rng.choices(words, k=80))) for i in range(40)]
    rows = good + bad + corpus() + [(300, "é" * 60 + " \n\n x\n x"), (301, " ".join(f"t{i}" for i in range(60)) + " a b c a b c")]
    docs = frame(spark, rows)
    trusted = spark.createDataFrame(good[:30], "doc_id long, text string")
    got = quality.judge(docs, trusted).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert multiset((r.doc_id, *(r[c] for c in names)) for r in got) == multiset((i, *brute_quality(t)) for i, t in rows)
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= {i for i, _ in good} and not kept & {i for i, _ in bad}
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(docs.limit(0), trusted).isEmpty()
    assert all(r.llr == 0 for r in quality.judge(docs, trusted.limit(0)).collect())


def test_quality_ratio_matches_brute_force(spark):
    """Mean log-likelihood ratios of hashed uni- and bigrams, by a plain count."""
    rows = [(i, t) for i, t in corpus(9) if i is not None and len(t or "") < 5000][:40] + [(400, "Über x2 -- a#b, ÜBER"), (401, None), (402, "")]
    trusted = rows[:10]
    n = 64

    def signed_hash(x, seed):
        h = xxhash.xxh64_intdigest(x.encode(), seed)
        return h - (1 << 64) if h >> 63 else h

    def grams(t):
        w = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", (t or "").lower())
        one = [signed_hash(x, 42) for x in w]
        return [h % n for h in one] + [signed_hash(y, h % (1 << 64)) % n for h, y in zip(one, w[1:])]

    def shares(of):
        c = Counter(g for _, t in of for g in grams(t))
        return [math.log((c[b] + 1) / (sum(c.values()) + n)) for b in range(n)]

    ratio = [round(a - b, 4) for a, b in zip(shares(trusted), shares(rows))]
    frame_of = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    for r in quality.judge(frame_of(rows), frame_of(trusted), buckets=n, threshold=0.01).collect():
        g = grams(r.text)
        want = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert abs(r.llr - want) < 1e-3 and r.kept == (not r.base_failed and r.llr >= 0.01)


def test_trusted_sample_of_clashing_columns(spark):
    docs = helpers_frame(spark, spark.createDataFrame([(i, "t") for i in range(4)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 1)], "doc_id long, quality int")
    got = quality.trusted_sample(docs, labels, "doc_id", 10)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {1, 3}


def test_trusted_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (1, 1)], "doc_id long, quality int")
    ids = {r.doc_id for r in quality.trusted_sample(docs, labels, "doc_id", 10).collect()}
    assert len(ids) == 10 and all(i % 2 for i in ids)


def test_trusted_sample_leaves_toxic_out(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(8)], "doc_id long, text string")
    rows = [(0, 1, 0), (1, 1, 1), (2, 0, 0), (3, 1, None), (4, 1, 0), (4, 1, 1), (5, 1, 0), (5, 0, None), (None, 1, 0), (6, None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.trusted_sample(docs, labels, "doc_id", 10).collect()} == {0, 3, 5}


def brute_fingerprint(t):
    w = spaced(lower(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("segments,bucket_rows", [(3, 4096), (2, 20), (5, 4096)])
def test_simhash(spark, segments, bucket_rows):
    rows = corpus() + [(200 + k, " ".join(f"z{i if i != k else -k}" for i in range(300))) for k in range(40)]
    got = simhash.near_duplicates(frame(spark, rows), segments=segments, bucket_rows=bucket_rows).collect()
    f = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(f[i] ^ f[j]).count("1") <= 4 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = multiset((i, x - (1 << 64) if x >> 63 else x, least[r]) for (i, _), x, r in zip(rows, f, root))
    assert multiset(got) == want and len(set(root)) < len(rows) - 20
    assert simhash.near_duplicates(frame(spark, [])).isEmpty()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    groups = lambda r: sorted(sorted(x for x in nodes if r[x] == k) for k in {r[x] for x in nodes})
    assert groups(got) == groups(root)
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def helpers_frame(spark, docs):
    """docs with columns that have the names of the operators' helpers."""
    from pyspark.sql import functions as F

    names = ["_id", "_k", "_s", "_t", "_h", "_w", "_b", "_g", "_lang", "_gone", "_runs", "_counts", "_key", "_th", "_row", "_fp", "_N_Words"]
    return docs.select("*", *(F.lit(n).alias(n) for n in names))


def test_columns_named_like_helpers(spark):
    docs = spark.createDataFrame([(i, "en", f"a red fox {i}\nran over the hill\nand away {i}") for i in range(4)] + [(9, None, None)], "doc_id long, lang string, text string")
    docs = helpers_frame(spark, docs).withColumnRenamed("lang", "source")
    operators = (
        lambda d: mixing.mix(d),
        lambda d: quality.judge(d, d),
        lambda d: line_dedup.dedup_lines(d),
        lambda d: pii.pseudonymise(d, KEY),
        lambda d: lm_scoring.score(d, d),
        lambda d: decontamination.decontaminate(d, spark.createDataFrame([(1, "red fox")], "item_id long, text string")),
        lambda d: simhash.keep_one(d),
        lambda d: simhash.near_duplicates(d),
    )
    for k, operator in enumerate(operators):
        out = operator(docs)
        if k < len(operators) - 1:
            assert set(docs.columns) <= set(out.columns)
        rows = out.collect()
        assert rows and (k >= len(operators) - 1 or {r["_k"] for r in rows} == {"_k"})


def test_keep_one_judges_texts_not_ids(spark):
    """Repeated ids with different texts: every group keeps one row, with its own columns."""
    rng = random.Random(4)
    a, b, c, d = (text(rng, 80) for _ in range(4))
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (7, c, "u"), (7, d, "v"), (None, d, "w"), (None, "lone words that nobody else has at all", "n"), (8, None, "e"), (9, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    kept = multiset(simhash.keep_one(docs).collect())
    assert kept == multiset([rows[0], rows[2], rows[3], rows[4], rows[6], rows[7]])
