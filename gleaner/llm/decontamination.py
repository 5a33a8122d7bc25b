"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The pattern set is every window of 13 consecutive words of a test item (an item with
fewer words is one window of its own). The alphabet is words, not letters. For each
window length there is a table of shifts by the last block of two words: a block that
no window holds lets the search jump over all positions that it rules out. Where the
shift is zero, the block selects a bucket of windows, their first block narrows it,
and a direct comparison of all words confirms an occurrence.

Test items are read to the driver in blocks of bounded size, which are broadcast. A single
block is searched for in one pass. With several, each block's search passes on only the
texts with hits, by their digest: equal texts have equal hits. These are brought together
and given to the documents, whose other rows are not exchanged and which are written
nowhere, so any number of items works. A worker makes a block's tables once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend, materialise, prepare, shielded, sieve, sifted

WINDOW = 13
#: Bytes of item text that are searched for together; bounds what is broadcast and each worker's tables.
BLOCK_BYTES = 2 << 20

#: A-Z become a-z; other ASCII characters but digits and letters part words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WordSearch:
    """Wu-Manber tables over (item id, text) rows."""

    def __init__(self, items, window: int = WINDOW):
        found: dict[int, dict[tuple, frozenset]] = {}
        for item, text in items:
            w = words((text or "").encode())
            m = min(window, len(w))
            if item is None or not m:
                continue
            own, patterns = frozenset([str(item)]), found.setdefault(m, {})
            for i in range(len(w) - m + 1):
                p = tuple(w[i : i + m])
                patterns[p] = patterns[p] | own if p in patterns else own
        self.groups = [(m, *self._tables(m, found[m])) for m in sorted(found)]

    @staticmethod
    def _tables(m: int, patterns: dict[tuple, frozenset]):
        b = min(2, m)
        shift: dict[tuple, int] = {}
        bucket: dict[tuple, dict[tuple, list]] = {}
        for p, items in patterns.items():
            for end in range(b, m + 1):
                block = p[end - b : end]
                shift[block] = min(shift.get(block, m), m - end)
            bucket.setdefault(p[m - b :], {}).setdefault(p[:b], []).append((p, items))
        return shift, bucket

    def search(self, w: list[bytes]) -> tuple[list[int], set]:
        """Merged spans [from, to, ...) of the words inside occurrences, and the items that occur."""
        spans, items, n = [], set(), len(w)
        for m, shift, bucket in self.groups:
            b = min(2, m)
            skip, at = m - b + 1, m
            get = shift.get
            while at <= n:
                block = (w[at - 2], w[at - 1]) if b == 2 else (w[at - 1],)
                jump = get(block, skip)
                if jump:
                    at += jump
                    continue
                here = bucket[block].get(tuple(w[at - m : at - m + b]), ())
                for p, of in here:
                    if tuple(w[at - m : at]) == p:
                        items |= of
                        spans.append((at - m, at))
                at += 1
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int):
    block, size = [], 0
    for r in items.select(item_col, text_col).toLocalIterator():
        if size >= block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len((r[1] or "").encode())
    yield block


def _tables(shared, window: int) -> WordSearch:
    """The tables of a broadcast block, kept beside its items: a worker has them until another block's tasks come."""
    block = shared.value
    if "tables" not in block:
        block["tables"] = WordSearch(block["items"], window)
    return block["tables"]


_FOUND = "array<struct<items: array<string>, spans: array<int>>>"


def _hits(docs: DataFrame, text_col: str, blocks: list, window: int) -> DataFrame:
    """(_digest, _found): for each different text with hits, those of each block that has any."""

    def of(shared, number):
        def run(batches):
            tables = _tables(shared, window)
            for batch in batches:
                out = []
                for digest, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                    spans, found = tables.search(words(t)) if t else ((), ())
                    if spans:
                        out.append((digest, number, sorted(found), spans))
                kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
                columns = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["_digest", "_block", "items", "spans"])

        return run

    slim = docs.select(_digest(text_col).alias("_digest"), F.col(text_col))
    kind = "_digest string, _block int, items array<string>, spans array<int>"
    out = None
    for number, shared in enumerate(blocks):
        one = slim.mapInArrow(of(shared, number), kind)
        out = one if out is None else out.union(one)
    # Copies of a text bring the same hits, of which one is kept before the blocks' are gathered.
    each = out.groupBy("_digest", "_block").agg(F.first(F.struct("items", "spans")).alias("hit"))
    return each.groupBy("_digest").agg(F.collect_list("hit").alias("_found"))


def _digest(text_col: str):
    return F.md5(F.col(text_col).cast("binary"))


@shielded
def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, hit_items (their ids as strings, sorted), hit_spans and contaminated.

    hit_spans holds word positions [from, to, from, to, ...), merged. A document is
    contaminated if n_hit > 0 and 20 * n_hit >= n_words. A null or empty text has no
    words and is clean; an item whose id or text is null, or that has no word, is not
    searched for; items with equal ids are one. Without items every document is clean.
    Repeated rows get equal results. Columns of docs with one of the new names are
    replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    new = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
        T.StructField("contaminated", T.BooleanType()),
    ]
    blocks = [spark.sparkContext.broadcast({"items": b}) for b in _blocks(items, item_col, item_text_col, block_bytes)]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in new}]
    if len(blocks) == 1:
        at = docs.columns.index(text_col)

        def search():
            tables = _tables(blocks[0], window)
            return lambda batch: _judged(batch.column(at), lambda i, w: tables.search(w))

        return extend(docs, search, new)
    found = materialise(_hits(docs, text_col, blocks, window))
    marked = sifted(docs.select(*kept, _digest(text_col).alias("_digest")), sieve(found.select(F.xxhash64("_digest"))), F.xxhash64("_digest"), "_hit")
    theirs = marked.where("_hit").join(found, "_digest", "left").select(*kept, "_found")
    both = theirs.union(marked.where("not _hit").select(*kept, F.lit(None).cast(_FOUND)))
    at = both.columns.index(text_col)

    def gather():
        def step(batch):
            found = batch.column(len(kept)).to_pylist()

            def of(i, w):
                hits = found[i] or []
                spans = [pair for h in hits for pair in zip(h["spans"][::2], h["spans"][1::2])]
                return merged(spans), {item for h in hits for item in h["items"]}

            return _judged(batch.column(at), of)

        return step

    return extend(both, gather, new, drop=("_found",))


def _judged(column: pa.Array, hits) -> list[pa.Array]:
    """The new columns: hits(i, words) gives the spans and items of text i."""
    n, n_hit, found, at, bad = [], [], [], [], []
    for i, t in enumerate(column.cast(pa.large_binary()).to_pylist()):
        w = words(t) if t else []
        spans, items = hits(i, w)
        hit = sum(spans[1::2]) - sum(spans[::2])
        n.append(len(w))
        n_hit.append(hit)
        found.append(sorted(items))
        at.append(spans)
        bad.append(hit > 0 and 20 * hit >= len(w))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.bool_())
    return [pa.array(v, k) for v, k in zip((n, n_hit, found, at, bad), kinds)]


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
