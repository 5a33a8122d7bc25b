"""The pipeline's stages, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from test_operators import brute_fingerprint, brute_hits, brute_lines, brute_quality

DATA = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert len(stages) == 5
    for k, (name, stage) in enumerate(stages.items()):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert k == 4 or docs.columns == columns
        if name == "quality rules":
            assert not [i for i in ids if brute_quality(before[i])[-1]] and len(ids) > 0.7 * len(before)
        elif name == "line dedup":
            after = {i: t for i, t, _ in brute_lines(list(before.items()), 2, 50)}
            assert {r.doc_id: r.text for r in docs.collect()} == {i: t for i, t in after.items() if t.strip() or t == before[i]}
        elif name == "simhash near-dedup":
            f = {i: brute_fingerprint(t) for i, t in before.items()}
            root = {i: i for i in f}
            for a in sorted(f):
                for b in sorted(f):
                    if bin(f[a] ^ f[b]).count("1") <= 4 and root[a] != root[b]:
                        x, y = max(root[a], root[b]), min(root[a], root[b])
                        root = {i: y if r == x else r for i, r in root.items()}
            assert ids == set(root.values())
        elif name == "decontamination":
            assert ids == {i for i, t in before.items() if not brute_hits(t, items)[-1]}
        else:
            assert ids == set(before)


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    assert len({r.doc_id for r in out}) == len(out) and "slot" in out[0].asDict()


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.isEmpty()
        docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)


def edge_rows(spark):
    """Whole documents beside null, empty, long and repeated ones, ids that are null or shared, and columns named like helpers."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = [r.asDict() for r in docs.orderBy("doc_id").limit(12).collect()]
    like = dict(base[0])
    prose = " ".join(f"{w} stands here" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten") for _ in range(3))
    other = " ".join(f"word{i}" for i in range(120))
    texts = [(900, None), (901, None), (902, ""), (903, "  \n "), (None, other + " end"), (None, prose), (904, prose + "\n" + other), (904, prose), (905, other), (905, other)]
    texts += [(906, "a" * 200_000 + " " + other)] + [(i, r["text"]) for r in base if r["doc_id"] == 1 for i in (None, 907, 907)]
    rows = base + [like] + [like | {"doc_id": i, "text": t} for i, t in texts]
    extra = "_w string, kept string, fingerprint long, slot string, _id long, n_hit string"
    rows = [(*r.values(), "x", None, 7, "s", k, None) for k, r in enumerate(rows)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return spark.createDataFrame(rows, f"{kinds}, {extra}")


def held(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def stage_rows(name, before, items):
    """(id, text) of what a stage leaves, by brute force; None where it is only bounded."""
    if name == "line dedup":
        after = brute_lines([(r.doc_id, r.text) for r in before], 2, 50)
        return Counter((i, t) for i, t, n in after if not n or t.strip())
    if name == "decontamination":
        return held(r for r in before if not brute_hits(r.text, items)[-1])
    return None


def components_of(before):
    """The smallest id, null last, of each group of fingerprints that differ in 4 bits or fewer."""
    first = {}
    for r in before:
        f = brute_fingerprint(r.text)
        first[f] = min(first.get(f, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    groups = []
    for f in first:
        near = [g for g in groups if any(bin(f ^ x).count("1") <= 4 for x in g)]
        groups = [g for g in groups if g not in near] + [{f}.union(*near)]
    return Counter(min(first[f] for f in g) for g in groups)


def test_stages_on_null_repeated_and_clashing(spark, tmp_path):
    edge_rows(spark).write.parquet(f"{tmp_path}/edge")
    docs = spark.read.parquet(f"{tmp_path}/edge")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, docs, DATA)
        out = table.collect()
        if name == "mixing":  # its last stage leaves places for all rows, without texts
            assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in before)
            continue
        assert table.columns == docs.columns and all(r.slot == "s" for r in out)
        expected = stage_rows(name, before, items)
        if expected is not None:
            assert held(out) == expected, name
        elif name == "quality rules":
            kept = {r.text for r in out}  # texts are judged, so all rows of one share its verdict
            assert len(kept) > 3 and not any(brute_quality(t)[-1] for t in kept)
            assert held(out) == held(r for r in before if r.text in kept)
        else:
            assert Counter((r.doc_id is None, r.doc_id or 0) for r in out) == components_of(before)
