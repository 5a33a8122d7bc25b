"""Mixing sources to target weights as a Pfair schedule.

A source is cut into blocks of equal numbers of rows. With weight w, block i (from 1)
of a source is released at slot floor((i - 1) / w) and due at slot ceil(i / w); in each
slot the released block with the earliest deadline runs. As the weights sum to one, a
single sequence meets every deadline, so after any slot each source is less than one
block away from its target share.

Weights are taken exactly, as whole parts of whatever total their decimal digits need,
so nothing drifts however many slots there are. When a source runs out, the others'
weights are renormalised and a new phase begins; no row is dropped or repeated.

Tasks compute the slots, each those of one frame of a phase. A frame needs no earlier
one: by any slot a source has run its share rounded down or up, and two runs that
differ in which sources are rounded up run the same blocks from the last deadline of
these sources' open blocks on (until then they differ in as many blocks as before, which
only move to later deadlines). So a task begins that many slots before its frame, with
those rounded up whose deadlines come first, which leaves the most room, and drops what
it ran before the frame. The driver finds where a phase ends in the same way, from the
slots around the earliest last block, so its time grows with sources and phases.

Ranks inside a source come from two levels: a row's place among the rows of its hash
bucket, and the sizes of the buckets before it. Both have about the square root of the
source's rows, so no task gets a whole source. Keys that many rows share, null among them,
are dealt over all buckets.
"""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from array import array
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, shielded, sieve, sifted

BLOCK_ROWS = 100
RESOLUTION = 1000
ALPHA = 0.5
#: Blocks of a source whose slots stand in one row of the schedule.
CHUNK = 1024
#: Slots of a frame, or four times those that a task runs before it, if these are more.
FRAME = 1 << 18
#: Frames that the driver hands out together.
PIECE = 1000
#: A key with more rows than this in a source is dealt over all buckets of the source.
HOT_ROWS = 1000
#: Sources that a schedule can have; each is a configured name, not data.
MOST_SOURCES = 5000


def parts(weights: dict, resolution: int) -> dict:
    """Whole parts in exactly the ratio of the weights, as their decimal digits give it; at least `resolution` in all."""
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    times = -(-resolution * common // sum(whole.values()))
    return {s: w // common * times for s, w in whole.items()}


def standing(shares: dict, t: int) -> dict:
    """Blocks run before slot t: shares rounded down, and up for as many as it takes, those with the earliest deadlines."""
    n = sum(shares.values())
    ran = {s: t * w // n for s, w in shares.items()}
    begun = [s for s in sorted(shares, key=str) if t * shares[s] % n]
    begun.sort(key=lambda s: -(-(ran[s] + 1) * n // shares[s]))
    for s in begun[: t - sum(ran.values())]:
        ran[s] += 1
    return ran


def settled(shares: dict) -> int:
    """Slots after which a run from `standing` is the run from the start: the longest window of a block."""
    return sum(shares.values()) // min(shares.values()) + 2


def earliest_first(shares: dict, first: int = 0, last: int | None = None):
    """The source of each slot from first to before last: that whose released block has the earliest deadline, of equal ones the first by name.

    Without last, to the end of the first period. From a later slot on it begins with the
    blocks that `standing` counts as run.
    """
    n = sum(shares.values())
    names, ran = sorted(shares, key=str), standing(shares, first)
    waiting = [(ran[s] * n // shares[s], k, ran[s]) for k, s in enumerate(names)]  # release, source, block
    heapq.heapify(waiting)
    ready: list = []
    for t in range(first, n if last is None else last):
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * n // shares[names[k]]), k, i))
        _, k, i = heapq.heappop(ready)
        yield names[k]
        heapq.heappush(waiting, ((i + 1) * n // shares[names[k]], k, i + 1))


def phase_end(shares: dict, left: dict) -> tuple[int, dict]:
    """How many slots pass until the first source has run the blocks that it has left, and what each has run by then."""
    n = sum(shares.values())
    begins = min((left[s] - 1) * n // shares[s] for s in shares)
    first = max(0, begins - settled(shares))
    ran = standing(shares, first)
    last = min(-(-left[s] * n // shares[s]) for s in shares)
    for t, s in enumerate(earliest_first(shares, first, last), first):
        ran[s] += 1
        if ran[s] == left[s]:
            return t + 1, ran
    raise AssertionError("a block missed its deadline")


def frames(blocks: dict, weights: dict, resolution: int, size: int = FRAME):
    """(phase, slot that it begins with, blocks left then, first and last slot in the phase) of every frame, until all sources have run out."""
    left = {s: n for s, n in blocks.items() if n}
    began = 0
    for phase in itertools.count():
        if not left:
            return
        shares = parts({s: weights[s] for s in left}, resolution)
        slots, ran = phase_end(shares, left)
        step = max(size, 4 * settled(shares))
        for first in range(0, slots, step):
            yield phase, began, left, first, min(first + step, slots)
        began += slots
        left = {s: n - ran[s] for s, n in left.items() if n > ran[s]}


def in_frame(frame, weights: dict, resolution: int):
    """(slot, source, block of those left) of a frame's slots, in order."""
    _, began, left, first, last = frame
    shares = parts({s: weights[s] for s in left}, resolution)
    before = max(0, first - settled(shares))
    ran = standing(shares, before)
    for t, s in enumerate(earliest_first(shares, before, last), before):
        if t >= first:
            yield began + t, s, ran[s]
        ran[s] += 1


def schedule(blocks: dict, weights: dict, resolution: int, size: int = FRAME):
    """(slot, phase, source) of every block, frame after frame."""
    for frame in frames(blocks, weights, resolution, size):
        for slot, s, _ in in_frame(frame, weights, resolution):
            yield slot, frame[0], s


def pieces(frame, blocks: dict, weights: dict, resolution: int, names: dict):
    """A frame's rows (_k, _c, _at, _phase, _slots): slots of blocks of a source, from _at on, all of one chunk of CHUNK blocks."""
    held: dict = {}
    phase, _, left, _, _ = frame
    row = lambda s, at, slots: (names[s], at // CHUNK, at, phase, slots)
    for slot, s, i in in_frame(frame, weights, resolution):
        block = blocks[s] - left[s] + i
        at, slots = held.setdefault(s, (block, array("q")))
        slots.append(slot)
        if (block + 1) % CHUNK == 0:
            yield row(s, *held.pop(s))
    for s, (at, slots) in held.items():
        yield row(s, at, slots)


def plan(spark: SparkSession, blocks: dict, weights: dict, resolution: int, names: dict, size: int = FRAME) -> DataFrame:
    """(_k, _c, _slots, _phases): slot and phase of CHUNK blocks of a source, scheduled by tasks; the driver holds PIECE frames at a time."""
    path = f"{shared_dir(spark)}/gleaner/{uuid.uuid4().hex}"
    schema = "_k int, _c long, _at long, _phase int, _slots array<long>"
    spark.createDataFrame([], schema).write.parquet(path)
    order = sorted(names, key=names.get)

    def placed(batches):
        for batch in batches:
            for phase, began, rest, first, last in zip(*(batch[c] for c in batch.columns), strict=True):
                left = {order[k]: int(n) for k, n in enumerate(rest) if n}
                rows = pieces((phase, int(began), left, int(first), int(last)), blocks, weights, resolution, names)
                for some in itertools.batched(rows, 64):
                    yield pd.DataFrame(some, columns=["_k", "_c", "_at", "_phase", "_slots"])

    every = ((phase, began, [left.get(s, 0) for s in order], first, last) for phase, began, left, first, last in frames(blocks, weights, resolution, size))
    for some in itertools.batched(every, PIECE):
        df = spark.createDataFrame(some, "phase int, began long, rest array<long>, first long, last long")
        df.repartition(len(some)).mapInPandas(placed, schema).write.mode("append").parquet(path)
    parts_of = F.sort_array(F.collect_list(F.struct("_at", "_phase", "_slots")))  # of CHUNK blocks in all
    chunk = spark.read.schema(schema).parquet(path).groupBy("_k", "_c").agg(parts_of.alias("_p"))
    phases = F.flatten(F.transform("_p", lambda x: F.array_repeat(x["_phase"], F.size(x["_slots"]))))
    return chunk.select("_k", "_c", F.flatten("_p._slots").alias("_slots"), phases.alias("_phases"))


@shielded
def mix(
    docs: DataFrame,
    weights: dict | None = None,
    source_col: str = "source",
    key_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    resolution: int = RESOLUTION,
    alpha: float = ALPHA,
) -> DataFrame:
    """docs with phase, block_no, slot and place_in_block: ordered by slot and place they are the mix.

    weights: target weight by source; a source that is not named, or all of them if
    weights is None, weighs its number of rows to the power alpha. Every row of docs
    comes out once. A null source is a source of its own. Rows with equal keys (null
    keys among them) are ordered among each other arbitrarily, so their places may be
    exchanged. Only the last block of a source can have fewer than block_rows rows.
    Columns of docs with one of the new names are replaced.
    """
    spark = docs.sparkSession
    new = ("phase", "block_no", "slot", "place_in_block")
    docs = docs.drop(*new)
    counts = docs.groupBy(F.col(source_col).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = {r["_s"]: r["_n"] for r in counts.limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: name a coarser source column")
    given = weights or {}
    target = {s: float(given.get(s, n**alpha)) for s, n in sizes.items()}
    if any(w <= 0 for w in target.values()):
        raise ValueError("weights must be above zero")

    names = {s: k for k, s in enumerate(sorted(sizes, key=lambda s: (s is not None, s)))}
    bounded = [(s, names[s], max(1, int(n**0.5))) for s, n in sizes.items()]
    kind = docs.schema[source_col].dataType.simpleString()
    by_name = F.broadcast(spark.createDataFrame(bounded, f"_s {kind}, _k int, _b int"))
    key = F.xxhash64(F.col(source_col), F.col(key_col))
    hot = docs.groupBy(key.alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select("h")
    hot = materialise(hot)
    salt = F.lit(0).cast("long")
    if not hot.isEmpty():
        # Numbers tell rows of a key apart; the table holds them fixed.
        docs = materialise(docs.withColumn("_id", F.monotonically_increasing_id()))
        docs = sifted(docs, sieve(hot), key, "_hot")
        salt = F.when(F.col("_hot"), F.col("_id")).otherwise(salt)
    columns = [c for c in docs.columns if c not in ("_id", "_hot")]
    dealt = (
        docs.join(by_name, F.col(source_col).eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_h", F.xxhash64(F.col(key_col), salt))
        .withColumn("_u", F.pmod("_h", "_b").cast("int"))
    )
    per = materialise(dealt.groupBy("_k", "_u").agg(F.count(F.lit(1)).alias("_m")))
    before = Window.partitionBy("_k").orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_k", "_u", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_k", "_u").orderBy("_h", F.col(key_col)))
    ranked = (
        dealt.withColumn("_r", rank - 1)
        .join(starts, ["_k", "_u"])
        .withColumn("_r", F.col("_r") + F.col("_start"))
        .withColumn("block_no", F.floor(F.col("_r") / block_rows))
        .withColumn("place_in_block", F.pmod(F.col("_r"), F.lit(block_rows)))
    )
    table = plan(spark, {s: -(-n // block_rows) for s, n in sizes.items()}, target, resolution, names)
    at = F.pmod("block_no", F.lit(CHUNK)).cast("int")
    return (
        ranked.withColumn("_c", F.floor(F.col("block_no") / CHUNK))
        .join(table, ["_k", "_c"])
        .withColumn("slot", F.get("_slots", at))
        .withColumn("phase", F.get("_phases", at))
        .select(*columns, *new)
    )
