"""Language-model scoring with a log-frequency Bloom filter.

The model is an interpolated bigram model. A bigram's count is quantised on a
logarithmic scale to a level q, and the filter holds the pairs (bigram, 1) to
(bigram, q); a count is read back by probing levels until one is absent. Counts of
single tokens are exact, by 64-bit hash.

With c the count of the history h and b its size class (floor of log2 c),
    p(w | h) = lambda_b * min(count(h, w), c) / c + (1 - lambda_b) * (c(w) + 1) / (N + V + 1)
where 1 - lambda_b is the Good-Turing mass of unseen continuations: the share of
bigrams that occur once among all bigram tokens with such a history.

Counts read back are the mean of their level, so the probabilities of a history's
continuations sum to one only about; scores compare texts under one model.

The filter is cut by hash into sub-filters of at most about a million bigrams each,
which tasks build side by side; vocabulary and filter are written by piece, so that each
is read once, and broadcast in shards of bounded size, one pass over the texts for each
shard. A corpus whose model fits one shard is scored in a single pass; otherwise each
pass leaves the counts it found, which are brought together by row.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, extend, materialise, mix, prepare, remainder, revive, shared_dir, shielded, slices, token_hashes

#: Counts from BASE**(q - 1) on and below BASE**q are of level q.
BASE = 1.5
BITS_PER_ENTRY = 10
PROBES = 5
FOLDS, HELD_OUT = 7, 2
#: Entries of the vocabulary and bytes of the filter that the driver loads and broadcasts in one piece.
PIECE_TOKENS = 1_000_000
PIECE_BYTES = 12 << 20
#: Pieces of either that a task holds in one pass.
SHARD_PIECES = 12
SUB_FILTERS, SUB_BIGRAMS = 64, 1_000_000
#: Sub-filters in one folder.
FOLDER_SUBS = 8
_NEW = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
#: Tokens that a task counts before it passes counts on.
COUNT_TOKENS = 600_000
CLASSES = 48

END = np.uint64(0x2545F4914F6CDD1D)

def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def level_counts() -> np.ndarray:
    """The mean of the whole numbers of each level; level 0 is 0, a level without any takes its lower end."""
    out = [0.0]
    for q in range(1, 110):
        a, b = BASE ** (q - 1), BASE**q
        first, last = math.ceil(a - 1e-9), math.ceil(b - 1e-9) - 1
        out.append((first + last) / 2 if last >= first else a)
    return np.array(out)


def sequences(column: pa.Array):
    """(rows from, rows to, tokens each row, tokens, their histories) in slices; an end follows each text."""
    for i, j, offsets, data in slices(column):
        h, n = token_hashes(offsets, data)
        size = n + 1
        last = np.cumsum(size) - 1
        seq = np.empty(len(h) + len(n), np.uint64)
        inner = np.ones(len(seq), bool)
        inner[last] = False
        seq[inner] = h
        seq[last] = END
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[0] = END
        yield i, j, size, seq, before


def bigram(before: np.ndarray, seq: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xFF51AFD7ED558CCD) ^ (seq + np.uint64(0x9E3779B97F4A7C15)))


def _counted(parts: list[np.ndarray]):
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    return values, counts


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, c): exact counts of token hashes."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for *_, seq, _ in sequences(batch.column(0)):
                held.append(seq)
                n += len(seq)
                if n >= COUNT_TOKENS:
                    yield of(held)
                    held, n = [], 0
        if held:
            yield of(held)

    def of(held):
        v, c = _counted(held)
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c)], names=["h", "c"])

    return docs.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def look_up(values: np.ndarray, tables: list, pieces: int) -> np.ndarray:
    """Counts of hashes in (piece, sorted hashes, counts) tables, 0 for others."""
    out = np.zeros(len(values), np.int64)
    piece = piece_of(values, pieces)
    for k, names, counts in tables:
        mine = np.flatnonzero(piece == k)
        if len(names) and len(mine):
            v = values[mine]
            at = np.minimum(np.searchsorted(names, v), len(names) - 1)
            out[mine] = np.where(names[at] == v, counts[at], 0)
    return out


def piece_of(h: np.ndarray, pieces: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(pieces)


def by_piece(table: DataFrame, piece: Column, tasks: int = 0) -> DataFrame:
    """table written in folders by `piece`, which becomes its column _piece; dealt by it over so many tasks, or as it is."""
    path = f"{shared_dir(table.sparkSession)}/gleaner/{uuid.uuid4().hex}"
    out = table.withColumn("_piece", piece.cast("int"))
    (out.repartition(tasks, "_piece") if tasks else out).write.partitionBy("_piece").parquet(path)
    schema = T.StructType([*table.schema.fields, T.StructField("_piece", T.IntegerType())])
    return table.sparkSession.read.schema(schema).parquet(path)


def load_vocabulary(table: DataFrame, piece: int):
    """One folder's rows, sorted by hash."""
    t = table.where(F.col("_piece") == piece).select("h", "c").toArrow()
    h, c = t.column("h").to_numpy().view(np.uint64), t.column("c").to_numpy()
    order = np.argsort(h)
    c = c.astype(np.int32) if not len(c) or c.max() < 1 << 31 else c
    return piece, h[order], c[order]


def bigram_rows(docs: DataFrame, text_col: str, vocabulary: list, group: list[int], pieces: int) -> DataFrame:
    """(g, k, c): partial counts of bigrams whose history is in the group of pieces, and the history's size class."""

    def run(batches):
        table, held, n = [b.value for b in vocabulary], [], 0
        for batch in batches:
            for *_, seq, before in sequences(batch.column(0)):
                if len(group) < pieces:
                    mine = np.isin(piece_of(before, pieces), group)
                    seq, before = seq[mine], before[mine]
                held.append((bigram(before, seq), before))
                n += len(seq)
                if n >= COUNT_TOKENS:
                    yield of(held, table)
                    held, n = [], 0
        if held:
            yield of(held, table)

    def of(held, table):
        g = np.concatenate([x for x, _ in held])
        before = np.concatenate([x for _, x in held])
        g, first, c = np.unique(g, return_index=True, return_counts=True)
        k = size_class(look_up(before[first], table, pieces))
        return pa.RecordBatch.from_arrays(
            [pa.array(g.view(np.int64)), pa.array(k.astype(np.int8)), pa.array(c.astype(np.int32))], names=["g", "k", "c"]
        )

    return docs.select(text_col).mapInArrow(run, "g long, k byte, c int")


def size_class(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), CLASSES - 1)


def places(g: np.ndarray, q: int, probe: int, bits) -> np.ndarray:
    """The filter's bit for one probe of (bigram, level)."""
    a = mix(g + np.uint64(q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    b = (a >> np.uint64(33)) | np.uint64(1)
    return (a + np.uint64(probe) * b) % bits


def build(rows: DataFrame, subs: int) -> DataFrame:
    """(p, bits, filter, tokens, once): the sub-filters, with bigram tokens and singletons by history class."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        g, k, c = (t.column(i).to_numpy() for i in range(3))
        sub = np.mod(g, subs)
        for p in np.unique(sub).tolist():
            mine = sub == p
            name, first, inverse = np.unique(g[mine].view(np.uint64), return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=c[mine]).astype(np.int64)
            kind = k[mine][first].astype(np.int64)
            q = level(count)
            bits = max(64, int(q.sum()) * BITS_PER_ENTRY)
            filled = np.zeros(-(-bits // 8) * 8, bool)
            for at in range(1, int(q.max()) + 1):
                name, q = name[q >= at], q[q >= at]
                for probe in range(PROBES):
                    filled[places(name, at, probe, np.uint64(bits)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p], pa.int32()),
                    pa.array([bits], pa.int64()),
                    pa.array([np.packbits(filled, bitorder="little").tobytes()], pa.binary()),
                    pa.array([np.bincount(kind, weights=count, minlength=CLASSES).astype(np.int64)], pa.list_(pa.int64())),
                    pa.array([np.bincount(kind[count == 1], minlength=CLASSES)], pa.list_(pa.int64())),
                ],
                names=["p", "bits", "filter", "tokens", "once"],
            )

    return rows.repartition(subs, F.pmod("g", F.lit(subs))).mapInArrow(
        run, "p int, bits long, filter binary, tokens array<long>, once array<long>"
    )


class Filter:
    """Some of the sub-filters, laid end to end."""

    def __init__(self, parts: list[tuple[int, int, bytes]], subs: int):
        self.subs = subs
        self.bits = np.zeros(subs, np.uint64)
        self.start = np.zeros(subs, np.int64)
        at = 0
        for p, bits, raw in parts:
            self.bits[p], self.start[p] = bits, at
            at += len(raw)
        self.bytes = np.frombuffer(b"".join(raw for *_, raw in parts), np.uint8)

    def levels(self, g: np.ndarray) -> np.ndarray:
        """The quantised count of each bigram hash, 0 for those that the filter doesn't hold."""
        out = np.zeros(len(g), np.uint8)
        sub = np.mod(g.view(np.int64), self.subs)
        alive = np.flatnonzero(self.bits[sub] > 0)
        q = 1
        while len(alive):
            for probe in range(PROBES):
                s = sub[alive]
                bit = places(g[alive], q, probe, self.bits[s]).astype(np.int64)
                there = (self.bytes[self.start[s] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1
                alive = alive[there == 1]
            out[alive] = q
            q += 1
            if q > 108:
                break
        return out


def _groups(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Runs of neighbours whose sizes add up to `most` at most (one alone may be larger)."""
    out, size = [], most + 1
    for p in sorted(sizes):
        if size + sizes[p] > most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += sizes[p]
    return out


@shielded
def score(
    docs: DataFrame,
    train: DataFrame,
    text_col: str = "text",
    piece_tokens: int = PIECE_TOKENS,
    piece_bytes: int = PIECE_BYTES,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score.

    train: the training documents, with the same text column. Tokens are words that
    white space parts, A-Z lower-cased, and an end after each text; a null text is
    empty, so it is the end alone. base_score: the add-one score of single tokens;
    score: the model's log10 probability of the text. Without training documents N and
    V are 0 and both scores are 0 for every text. Repeated rows get equal results.
    Columns of docs with one of the new names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = materialise(count_tokens(train, text_col))
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v_train = total["n"], total["v"]
    pieces = max(1, -(-v_train // piece_tokens))
    subs = max(SUB_FILTERS, -(-n_train // SUB_BIGRAMS))
    share = spark.sparkContext.broadcast
    ends = vocabulary.where(F.col("h") == int(END)).first()
    counted = vocabulary
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = by_piece(counted, F.pmod(F.shiftrightunsigned("h", 32), F.lit(pieces)), min(pieces, tasks))
    discard(counted)
    # The driver holds one piece at a time; the broadcasts themselves live in files.
    words = [share(load_vocabulary(vocabulary, k)) for k in range(pieces)]
    v_shards = [list(range(k, min(k + shard_pieces, pieces))) for k in range(0, pieces, shard_pieces)]
    rows = None
    for group in v_shards:
        more = bigram_rows(train, text_col, [words[k] for k in group], group, pieces)
        rows = more if rows is None else rows.union(more)
    table = by_piece(build(rows, subs), F.floor(F.col("p") / FOLDER_SUBS))
    at = [F.sum(F.get("tokens", F.lit(i))).alias(f"t{i}") for i in range(CLASSES)]
    once = [F.sum(F.get("once", F.lit(i))).alias(f"o{i}") for i in range(CLASSES)]
    sums = table.agg(*at, *once).first()
    seen = np.array(
        [min(0.999, max(0.001, 1 - sums[f"o{i}"] / sums[f"t{i}"])) if sums[f"t{i}"] else 0.0 for i in range(CLASSES)]
    )
    constants = (n_train, v_train, seen, ends["c"] if ends else 0, level_counts())

    sizes = {r["p"]: r["n"] for r in table.select("p", F.octet_length("filter").alias("n")).collect()}
    filters = []
    for group in _groups(sizes, piece_bytes):
        folders = F.col("_piece").between(group[0] // FOLDER_SUBS, group[-1] // FOLDER_SUBS)
        some = table.where(folders & F.col("p").between(group[0], group[-1])).select("p", "bits", "filter").collect()
        filters.append(share(vars(Filter([tuple(r) for r in some], subs))))
        del some
    f_shards = [filters[k : k + shard_pieces] for k in range(0, len(filters), shard_pieces)]
    passes = max(len(v_shards), len(f_shards))
    final = [T.StructField(n, T.LongType() if k < 3 else T.DoubleType()) for k, n in enumerate(_NEW)]
    if passes == 1:
        return extend(docs, _scorer(docs.columns.index(text_col), words, filters, constants, pieces), final)
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for k in range(passes):
        voc = [words[i] for i in v_shards[k]] if k < len(v_shards) else []
        filt = f_shards[k] if k < len(f_shards) else []
        some = rows.select("_row", text_col).mapInArrow(_finder(voc, filt, pieces), _FOUND)
        found = some if found is None else found.union(some)
    one = F.struct("n", "at", "c", "bigram_at", "q")
    gathered = found.groupBy("_row").agg(F.collect_list(one).alias("found"))
    scored = gathered.mapInArrow(_gatherer(constants), T.StructType([T.StructField("_row", T.LongType()), *final]))
    names = {f.name for f in final}
    kept = [c for c in docs.columns if c.lower() not in names]
    return rows.select(*kept, "_row").join(scored, "_row").select(*kept, *[f.name for f in final])


def _counts(column: pa.Array, words, filters, pieces):
    """(rows from, tokens each row, counts, levels) of slices of a text column."""
    for i, _, size, seq, before in sequences(column):
        u, inverse = np.unique(seq, return_inverse=True)
        c = look_up(u, words, pieces)[inverse]
        u, inverse = np.unique(bigram(before, seq), return_inverse=True)
        q = np.zeros(len(u), np.uint8)
        for f in filters:
            q = np.maximum(q, f.levels(u))
        yield i, size, c, q[inverse]


def _scorer(at, voc, filt, constants, pieces):
    """For a single pass: the scores of each batch."""

    def make():
        words, filters = [b.value for b in voc], [revive(Filter, b.value) for b in filt]

        def step(batch):
            return _scores([_evaluate(*x, constants) for _, *x in _counts(batch.column(at), words, filters, pieces)], constants[0])

        return step

    return make


#: What a pass finds of a text: its number of tokens, places (int32) and counts (int64) of
#: tokens whose piece it had, places and levels (bytes) of bigrams that its filters hold.
_FOUND = "_row long, n int, at binary, c binary, bigram_at binary, q binary"


def _finder(voc, filt, pieces):
    def run(batches):
        words, filters = [b.value for b in voc], [revive(Filter, b.value) for b in filt]
        for batch in batches:
            for i, size, c, q in _counts(batch.column(1), words, filters, pieces):
                cut = np.cumsum(size)
                parts = [(c[z - n : z], q[z - n : z]) for n, z in zip(size, cut)]
                places = [(np.flatnonzero(x).astype(np.int32), np.flatnonzero(y).astype(np.int32)) for x, y in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(size)),
                        pa.array(size, pa.int32()),
                        pa.array([a.tobytes() for a, _ in places], pa.binary()),
                        pa.array([x[a].astype(np.int64).tobytes() for (x, _), (a, _) in zip(parts, places)], pa.binary()),
                        pa.array([b.tobytes() for _, b in places], pa.binary()),
                        pa.array([y[b].tobytes() for (_, y), (_, b) in zip(parts, places)], pa.binary()),
                    ],
                    names=["_row", "n", "at", "c", "bigram_at", "q"],
                )

    return run


def _gatherer(constants):
    def run(batches):
        for batch in batches:
            done = []
            for found in batch.column(1).to_pylist():
                n = found[0]["n"]
                c, q = np.zeros(n, np.int64), np.zeros(n, np.uint8)
                for f in found:
                    c[np.frombuffer(f["at"], np.int32)] = np.frombuffer(f["c"], np.int64)
                    at = np.frombuffer(f["bigram_at"], np.int32)
                    q[at] = np.maximum(q[at], np.frombuffer(f["q"], np.uint8))
                done.append(_evaluate(np.array([n]), c, q, constants))
            if done:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_scores(done, constants[0])], names=["_row", *_NEW])

    return run


def _evaluate(size, c, q, constants):
    n, v, share, ends, counts = constants
    first = np.cumsum(size) - size
    history = np.empty_like(c)
    history[1:] = c[:-1]
    history[first] = ends
    p1 = (c + 1) / (n + v + 1)
    lam = np.where(history > 0, share[size_class(history)], 0.0)
    p = lam * np.minimum(counts[q], history) / np.maximum(history, 1) + (1 - lam) * p1
    total = lambda x: np.add.reduceat(x, first)
    return size, total((c > 0).astype(np.int64)), total(np.log10(p1)), total(np.log10(p))


def _scores(parts, n_train):
    size, known, base, score_ = (np.concatenate(x) for x in zip(*parts))
    return [
        pa.array(size.astype(np.int64)),
        pa.array(known),
        pa.array(np.full(len(size), n_train, np.int64)),
        pa.array(base),
        pa.array(score_),
    ]


def held_out(key_col: str):
    return remainder(key_col, FOLDS) == HELD_OUT
