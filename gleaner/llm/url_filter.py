"""URL filtering against a sorted array of digests.

Rules' strings (host and path) are hashed to 64 bits, sorted and laid out as one file:
the digests, and the strings with their verdicts in the same order. A task maps the
digests into memory and probes, in one binary search for a whole batch of URLs, every
host suffix with every path prefix that some rule's shape allows. A digest that is
found counts only if the stored string equals the probe.

Rule lists are broadcast in blocks of bounded size; the longest match so far is carried
from block to block.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extend, materialise, prepare, revive

BLOCK_RULES = 2_000_000
#: The rules of the production query, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both are empty without a ://."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode().lower().decode(), path


class DigestArray:
    """Sorted digests of rules, mapped into memory, with their strings beside them."""

    def __init__(self, rules):
        rows = sorted({(xxhash.xxh64_intdigest((h + p).encode()), h + p, h, v) for v, h, p in rules})
        self.digests = np.array([r[0] for r in rows], np.uint64).tobytes()
        self.strings = [r[1] for r in rows]
        self.verdicts = [r[3] for r in rows]
        self.labels = sorted({r[2].count(".") + 1 for r in rows})
        self.lengths = sorted({len(r[1]) - len(r[2]) for r in rows})

    def open(self):
        """Puts the digests into an unlinked file of this process and maps it."""
        with tempfile.TemporaryFile() as f:
            f.write(self.digests or b"\0" * 8)
            f.flush()
            self.mapped = np.memmap(f, np.uint64, "r")
        return self

    def probes(self, host: str, path: str):
        names = host.split(".")
        for k in self.labels:
            if k <= len(names):
                suffix = ".".join(names[-k:])
                for n in self.lengths:
                    if n <= len(path):
                        yield suffix + path[:n]

    def match(self, urls: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """(rule, verdict) of the longest rule that fits each (host, path)."""
        probe, of = [], []
        for i, (host, path) in enumerate(urls):
            for s in self.probes(host, path) if host else ():
                probe.append(s)
                of.append(i)
        out: list = [None] * len(urls)
        if not probe or not self.strings:
            return out
        h = np.array([xxhash.xxh64_intdigest(s.encode()) for s in probe], np.uint64)
        low = np.searchsorted(self.mapped, h, "left")
        high = np.searchsorted(self.mapped, h, "right")
        for k in np.flatnonzero(low < high).tolist():
            for at in range(low[k], high[k]):
                if self.strings[at] == probe[k] and (out[of[k]] is None or len(probe[k]) > len(out[of[k]][0])):
                    out[of[k]] = (probe[k], self.verdicts[at])
        return out


def filter_urls(pages: DataFrame, rules=RULES, url_col: str = "url", block_rules: int = BLOCK_RULES) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: an iterable of (verdict, host, path), read in blocks. A rule fits its host
    and all subdomains if the path starts with the rule's; the longest string of host and
    path wins, and of equal ones (a rule given twice with both verdicts) allow. The host
    is what stands after the first :// up to /, ?, # or the end, A-Z lower-cased; the path
    what follows up to ? or #. Both are empty for a null URL or one without ://, which no
    rule fits. rule is null where none fits; the verdict is then allow, as the URL is in
    no list. Repeated rows get equal results. Columns of pages with one of the new names
    are replaced.
    """
    spark = pages.sparkSession
    prepare(spark)
    new = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    out, block, passes = pages, [], 0
    rules = iter(rules)
    while True:
        block = [r for _, r in zip(range(block_rules), rules)]
        if passes and not block:
            return out
        if passes:
            out = materialise(out)
        out = extend(out, _pass(list(out.columns), url_col, spark.sparkContext.broadcast(vars(DigestArray(block))), passes), new)
        passes += 1


def _pass(columns, url_col, shared, passes):
    at = columns.index(url_col)

    def make():
        table = revive(DigestArray, shared.value).open()

        def step(batch):
            split = [parts(u) for u in batch.column(at).to_pylist()]
            found = table.match(split)
            if passes:
                old = zip(*(batch.column(columns.index(c)).to_pylist() for c in ("rule", "verdict")))
                found = [max((f, o), key=lambda x: (len(x[0]), x[1] == "allow")) if f and o[0] else f or (o if o[0] else None) for f, o in zip(found, old)]
            rows = [(h, p, *(f or (None, "allow"))) for (h, p), f in zip(split, found)]
            return [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]

        return step

    return make
