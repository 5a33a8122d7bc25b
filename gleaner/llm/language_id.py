"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (those of a
tokenizer's pieces that lower-cased text can hold; every single byte is a piece too). A
word's probability in a language is the sum over all its segmentations into pieces, which
a forward pass over the word's bytes gives; a text's is the product over its words. Words
are never cut, however long. Piece probabilities are learnt by expectation maximisation
with forward and backward sums.

The languages are fitted on the driver from a sample of at most SAMPLE labelled texts
for each language, chosen by a hash of the id. Prediction looks at whole texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, extend, mix, powers, prepare, remainder, revive, shielded

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 200
ROUNDS = 3
FOLDS, HELD_OUT = 3, 1
#: Bytes of words that one forward pass takes together (one word may be longer), and numbers that it holds.
PASS_BYTES, PASS_NUMBERS = 1 << 18, 1 << 23
#: Log probabilities that a task remembers, over all languages.
REMEMBERED = 1_200_000
UNKNOWN = "und"
MOST_LANGUAGES = 300


def pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces in UTF-8 that a lower-cased word can hold, a space for its begin, and every byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i).replace("▁", " ")
            if piece and piece == piece.lower() and not any(map(str.isspace, piece[1:])):
                found.add(piece.encode())
    return sorted(found)


def words_of(text: str) -> list[bytes]:
    return " ".join(text.lower().split()).encode().split()


class Pieces:
    """Finds pieces among all substrings of many words at once."""

    def __init__(self, names: list[bytes]):
        self.size = len(names)
        self.longest = max(map(len, names))
        up, _ = powers(self.longest)
        h = np.array([self._hash(n, up) for n in names], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.may = np.zeros(1 << 20, bool)
        self.may[(h & np.uint64(0xFFFFF)).astype(np.int64)] = True

    @staticmethod
    def _hash(name: bytes, up) -> np.uint64:
        b = np.frombuffer(name, np.uint8)
        return mix(np.add.reduce(_BYTE[b] * up[: len(b)], keepdims=True))[0]

    def inside(self, words: list[bytes]) -> Segments:
        """All places of pieces in words, each of which has a space before it."""
        data = np.frombuffer(b" " + b" ".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(size) - size
        up, down = powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up, out=sums[1:])
        # The ends of all substrings by their distance from the word's begin.
        word = np.repeat(np.arange(len(words)), size)
        far = np.arange(len(data)) - start[word] + 1
        order = np.argsort(far.astype(np.uint16) if size.max() < 1 << 16 else far, kind="stable")
        far, end, word = far[order], order + 1, word[order]
        found = []
        for n in range(1, min(self.longest, int(size.max())) + 1):
            from_ = int(np.searchsorted(far, n))
            e = end[from_:]
            h = mix((sums[e] - sums[e - n]) * down[e - n])
            at = np.flatnonzero(self.may[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            h = h[at]
            k = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
            same = self.hashes[k] == h
            at, k = at[same] + from_, k[same]
            found.append((far[at], end[at] + word[at], self.order[k]))
        return Segments(size, start + np.arange(len(words)), found)


class Segments:
    """Places of pieces in words. A word of n bytes has n + 1 slots, from its begin to its end."""

    def __init__(self, size: np.ndarray, begin: np.ndarray, found: list):
        self.size, self.begin, self.slots = size, begin, int(size.sum()) + len(size)
        self.found = [(slot, piece) for _, slot, piece in found]
        # Places with equal distance from the begin and equal length: (distance, length, from, to, first slot and piece).
        rows = [np.zeros((0, 6), np.int32)]
        for n, (far, slot, piece) in enumerate(found, 1):
            if len(far):
                cut = np.r_[0, np.flatnonzero(np.diff(far)) + 1, len(far)]
                at = cut[:-1]
                rows.append(np.stack([far[at], np.full(len(at), n), at, cut[1:], slot[at], piece[at]], 1).astype(np.int32))
        groups = np.concatenate(rows)
        self.groups = groups[np.lexsort((groups[:, 1], groups[:, 0]))]

    def steps(self, backwards: bool = False):
        """(length, slots of ends, pieces), so that all that a place builds on has come before.

        A place without others beside it, as most are in a long word, comes as plain numbers.
        """
        groups = self.groups[::-1] if backwards else self.groups
        for k in range(0, len(groups), 100_000):
            for _, n, a, z, slot, piece in groups[k : k + 100_000].tolist():
                if z - a == 1:
                    yield n, slot, piece
                else:
                    slots, names = self.found[n - 1]
                    yield n, slots[a:z], names[a:z]

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over segmentations up to each slot: slots x languages."""
        a = np.full((self.slots, log_p.shape[1]), -np.inf)
        a[self.begin] = 0
        for n, slot, piece in self.steps():
            here = a[slot]  # of a single place a view, which spares the copies
            a[slot] = np.logaddexp(here, a[slot - n] + log_p[piece], out=here)
        return a

    def backward(self, log_p: np.ndarray) -> np.ndarray:
        b = np.full((self.slots, log_p.shape[1]), -np.inf)
        b[self.begin + self.size] = 0
        for n, slot, piece in self.steps(backwards=True):
            here = b[slot - n]
            b[slot - n] = np.logaddexp(here, b[slot] + log_p[piece], out=here)
        return b

    def log_words(self, log_p: np.ndarray) -> np.ndarray:
        """The log probability of each word: words x languages."""
        some = max(1, PASS_NUMBERS // self.slots)
        parts = [self.forward(log_p[:, k : k + some])[self.begin + self.size] for k in range(0, log_p.shape[1], some)]
        return np.hstack(parts)


def slices_of(words: list[bytes], most: int):
    """Runs of words of about `most` bytes."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    i = 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield words[i:j]
        i = j


def learn(counts: Counter, table: Pieces, rounds: int) -> np.ndarray:
    """Log piece probabilities of one language from its words' counts."""
    groups = [(table.inside(w), np.array([counts[x] for x in w], float)) for w in slices_of(sorted(counts), PASS_BYTES)]
    log_p = np.full((table.size, 1), -np.log(table.size))
    for _ in range(rounds):
        expected = np.zeros(table.size)
        for seg, c in groups:
            a, b = seg.forward(log_p), seg.backward(log_p)
            whole = np.repeat(a[seg.begin + seg.size, 0] - np.log(c), seg.size + 1)
            for n, slot, piece in seg.steps():
                part = np.exp(a[slot - n, 0] + log_p[piece, 0] + b[slot, 0] - whole[slot])
                np.add.at(expected, piece, part)
        log_p = np.log((expected + 0.01) / (expected.sum() + 0.01 * table.size)).reshape(-1, 1)
    return log_p


def fit(docs: DataFrame, key_col: str, text_col: str, lang_col: str, path: str, sample: int, rounds: int):
    """(languages, piece table, log piece probabilities by language, log priors)."""
    train = docs.where(F.col(lang_col).isNotNull() & F.col(key_col).isNotNull() & (remainder(key_col, FOLDS) != HELD_OUT))
    found = train.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: a label is a name, not data")
    langs = sorted(r[0] for r in found)
    ids = []
    for lang in langs:
        few = train.where(F.col(lang_col) == lang).select(key_col).orderBy(F.xxhash64(key_col), key_col).limit(sample)
        ids += [(r[0], lang) for r in few.collect()]
    table = Pieces(pieces(path))
    counts = {lang: Counter() for lang in langs}
    if ids:
        kind = docs.schema[key_col].dataType.simpleString()
        chosen = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(ids)), f"_id {kind}, _lang string"))
        on = (F.col(key_col) == F.col("_id")) & (F.col(lang_col) == F.col("_lang"))
        for r in train.join(chosen, on, "left_semi").select(lang_col, text_col).toLocalIterator():
            counts[r[0]].update(words_of(r[1] or ""))
    p = np.hstack([learn(counts[lang], table, rounds) for lang in langs]) if langs else np.zeros((table.size, 0))
    total = sum(r["n"] for r in found)
    share = {r[0]: r["n"] / total for r in found}
    return langs, table, p, np.log([share[lang] for lang in langs])


class Scorer:
    """Log probabilities of words in each language, of which it remembers many."""

    def __init__(self, table: Pieces, log_p: np.ndarray):
        self.table, self.p = table, log_p
        self.most = max(1, REMEMBERED // max(1, log_p.shape[1]))
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.log = np.zeros((0, self.p.shape[1]), np.float32)

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.most:
            self.clear()
            new = list(words)
        some = max(1, min(PASS_BYTES, PASS_NUMBERS // max(1, self.p.shape[1])))
        log = [self.table.inside(w).log_words(self.p).astype(np.float32) for w in slices_of(new, some)]
        base = len(self.at)
        self.at.update((w, base + i) for i, w in enumerate(new))
        self.log = np.concatenate([self.log, *log])

    def texts(self, lists: list[list[bytes]]) -> np.ndarray:
        """The log probability of each list of words: lists x languages."""
        self.learn(dict.fromkeys(w for x in lists for w in x))
        at = self.at
        out = np.zeros((len(lists), self.p.shape[1]))
        for k, x in enumerate(lists):
            if x:
                out[k] = self.log[[at[w] for w in x]].sum(axis=0, dtype=np.float64)
        return out


@shielded
def identify(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str = VOCABULARY,
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """docs with held_out, lang_pred and score, the posterior probability of lang_pred.

    Languages are learnt from rows whose label and key are not null and whose
    crc32(key as text) mod 3 is not 1; held_out tells the other rows. The label and the
    key are no inputs of a prediction. More than MOST_LANGUAGES labels are an error. A null text, or one without a letter, is `und`
    with score 0, as is every text if nothing could be learnt; ties go to the
    alphabetically first language. Repeated rows get equal results. Columns of docs with
    one of the new names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    langs, table, p, prior = fit(docs, key_col, text_col, lang_col, vocabulary, sample, rounds)
    shared = spark.sparkContext.broadcast((langs, vars(table), p, prior))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    out = docs.withColumn("held_out", remainder(key_col, FOLDS) == HELD_OUT)
    at = out.columns.index(text_col)

    def make():
        langs, table, p, prior = shared.value
        table = revive(Pieces, table)
        scorer = Scorer(table, p)

        def step(batch):
            pred, score = [], []
            texts = batch.column(at).to_pylist()
            ends = np.cumsum([len(t or "") for t in texts])
            i = 0
            while i < len(texts):
                # Texts of about PASS_BYTES characters together.
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PASS_BYTES, "right")))
                some = [t if t and langs and any(map(str.isalpha, t)) else None for t in texts[i:j]]
                i = j
                logs = scorer.texts([words_of(t) if t else [] for t in some]) + prior
                for t, x in zip(some, logs):
                    if t is None:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                    else:
                        best = int(np.argmax(x))
                        pred.append(langs[best])
                        score.append(float(1 / np.exp(x - x[best]).sum()))
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

        return step

    return extend(out, make, new)
