"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Tokens are runs of letters and digits, lower-cased, and runs of other characters; tokens
and pairs of neighbours are hashed into BUCKETS buckets. The share of each bucket among the
n-grams of trusted documents and among those of all documents gives its log-likelihood
ratio; a document's score is the mean ratio of its n-grams, and a fixed threshold
decides on each document. Everything is DataFrame functions.

Trusted documents are a sample of at most TRUSTED ids labelled good and not toxic, taken in the order of a
hash; counts of the raw corpus cover all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shielded

BUCKETS = 10_000
TRUSTED = 20_000
THRESHOLD = -0.25
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0)
    )


def ngrams(words: Column, buckets: int) -> Column:
    """Bucket of each token and of each pair of neighbours."""
    one = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda x, i: F.pmod(F.xxhash64(x, F.get(words, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def fit(docs: DataFrame, trusted: DataFrame, text_col: str, buckets: int) -> list[float]:
    """The log-likelihood ratio of each bucket. trusted: documents of the target."""

    def counts(of: DataFrame) -> DataFrame:
        w = of.select(tokens_of(F.col(text_col)).alias("w"))
        return w.select(F.explode(ngrams(F.col("w"), buckets)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))

    raw = {r["b"]: r["n"] for r in counts(docs).collect()}  # at most `buckets` rows
    good = {r["b"]: r["n"] for r in counts(trusted).collect()}
    if not good:
        return [0.0] * buckets
    all_raw, all_good = sum(raw.values()) + buckets, sum(good.values()) + buckets
    return [
        round(math.log((good.get(b, 0) + 1) / all_good) - math.log((raw.get(b, 0) + 1) / all_raw), 4)
        for b in range(buckets)
    ]


def statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_w", words_of(F.col(text_col))).withColumn("_l", lines)
    w = F.col("_w")
    df = df.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        ).alias("_h"),
    ).drop("_l")
    # A text's windows with their positions, sorted by hash: neighbours with equal hashes are repeats.
    h = F.col("_h")
    twice = F.size(F.array_distinct(h)) < F.size(h)
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("at"))))
    df = df.withColumn("_v", F.when(twice, pairs))

    def same(x, i):
        return F.coalesce(F.get("_v", i)["h"] == x["h"], F.lit(False))

    again = F.filter("_v", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["at"])))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_w", "_h", "_v", "_p"
    )


@shielded
def trusted_sample(docs: DataFrame, labels: DataFrame, key_col: str, limit: int) -> DataFrame:
    """The documents of up to `limit` ids that labels call good, chosen by a hash of the id.

    An id that any row calls toxic is left out, if labels have a column toxic. Null ids and
    null labels count for nothing; all rows of docs with a chosen id are returned, with
    all their columns.
    """
    toxic = F.col("toxic") == 1 if "toxic" in labels.columns else F.lit(False)
    ids = (
        labels.select(F.col(key_col).alias("_id"), F.col("quality"), *(["toxic"] if "toxic" in labels.columns else []))
        .where(F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.coalesce(toxic, F.lit(False))).alias("_toxic"))
        .where("_good and not _toxic")
        .select("_id")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    ids = materialise(ids)
    return docs.join(F.broadcast(ids), F.col(key_col) == F.col("_id"), "left_semi")


@shielded
def judge(
    docs: DataFrame,
    trusted: DataFrame,
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    trusted: the target's documents, with the same text column. llr is the mean
    log-likelihood ratio of a document's n-grams, 0 for one without words. base_failed:
    n_words < 50 or 100 * n_repeat_words > 50 * n_words. kept: not base_failed and
    llr >= threshold. A null text counts as empty, so it is not kept; without trusted
    n-grams every ratio is 0. Repeated rows get equal results. Columns of docs with one
    of these names are replaced.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    docs = docs.drop(*new)
    ratios = fit(docs, trusted, text_col, buckets)
    table = F.expr(f"cast(split('{','.join(map(str, ratios))}', ',') as array<double>)")
    df = statistics(docs, text_col).withColumn("_t", tokens_of(F.col(text_col)))
    df = df.withColumn("_g", ngrams(F.col("_t"), buckets))
    total = F.aggregate("_g", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    llr = F.when(F.size("_g") > 0, total / F.size("_g")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # The row number, never below zero, keeps a filter on `kept` from being pushed down, which
    # would copy the nested expressions below into one another.
    kept = ~failed & (F.col("llr") >= threshold) & (F.monotonically_increasing_id() >= 0)
    return (
        df.withColumn("llr", llr)
        .withColumn("base_failed", failed)
        .withColumn("kept", kept)
        .select(*docs.columns, *new)
    )
