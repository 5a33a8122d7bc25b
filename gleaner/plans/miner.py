"""The log miner: feeds log files into a store and answers from it.

State is a ledger: by block, the vectors (distinct token lists) of the lines with their
counts, the terms and the phrases; totals of terms and phrases over all live blocks; and
commits that say which of it counts, with the settings, the reading position and the last
batch of each stream. A feed reads new files only. It adds its own counts as new parts and
to the totals, takes those of blocks that the ring drops from the totals, and makes one
commit; so it counts wholly or not at all, and a stream's batch that comes again is passed
over. It reads its lines, the totals and the dropped blocks, and no other history.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import parse
from gleaner.functions import tokens as tk
from gleaner.operators import mining, ring, terms
from gleaner.operators.ledger import MOST_PARTS, Ledger, among, key_of, place_of
from gleaner.session import empty, erase, small, written
from gleaner.sources import logs


@dataclass
class Settings:
    log_format: str = ""
    layout: str = ""
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    ignorewords: list[str] = field(default_factory=list)
    custom_phrases: list[str] = field(default_factory=list)
    frequency: str = ""
    retention: int = 0
    max_blocks: int = 0
    block_size: int = 0
    min_rate: float = 0.6
    max_rate: float = 0.0
    border_rate: float = terms.BORDER_RATE
    border: int = 0


_TOTAL_TERMS = "term string, cnt long, id long"
_TOTAL_PHRASES = "phrase string, cnt long, created long, updated long, last_value string, subject string, feed long"
#: Tables whose rows go with their block.
BY_BLOCK = ("vectors", "terms", "phrases")
#: Where reading goes on: time, name, line and the line's hash of the last file read.
_START = {"mtime": -1, "file": "", "row": 0, "last": None, "feeds": 0, "now": 0}


class Miner:
    """now: the time that fills in timestamps' years, as Unix seconds; of the newest file by default."""

    def __init__(self, spark: SparkSession, data_dir: str, settings: Settings | None = None, now: int | None = None, read_only: bool = False):
        self.spark, self.store, self.now, self.read_only = spark, Ledger(spark, data_dir), now, read_only
        known = self.store.head()["state"].get("settings")
        self.settings = settings or (Settings(**known) if known else Settings())

    # --- state ---

    def terms(self, head: dict | None = None) -> DataFrame:
        """(term, cnt, first) of the live blocks; first: the term's id, given in the order of first sight, for good."""
        t = self.store.read("term_totals", head=head)
        t = empty(self.spark, _TOTAL_TERMS) if t is None else t
        return t.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.min("id").alias("first")).where("cnt > 0")

    def phrases(self, head: dict | None = None) -> DataFrame:
        """(phrase, cnt, created, updated, last_value, subject) of the live blocks; created: when it was first seen at all."""
        p = self.store.read("phrase_totals", head=head)
        p = empty(self.spark, _TOTAL_PHRASES) if p is None else p
        return _summed_phrases(p).drop("feed").where("cnt > 0")

    def status(self) -> dict:
        return _START | self.store.head()["state"].get("position", {})

    def sizes(self) -> tuple[int, int]:
        """(block size, number of blocks): settings, else what the first feed chose; 0 for any."""
        chosen = self.store.head()["state"].get("sizes", {})
        return self.settings.block_size or chosen.get("block_size", 0), self.settings.max_blocks or chosen.get("max_blocks", 0)

    # --- reading ---

    def parsed(self, lines: DataFrame) -> DataFrame:
        """(seq, value, epoch, block, tokens) of lines that pass the filters."""
        s = self.settings
        now = F.timestamp_seconds(F.lit(self.now)) if self.now is not None else F.timestamp_seconds("mtime")
        seq = F.struct(F.col("mtime").alias("file_no"), "part", "at")
        kept = logs.drop_blank(lines).where(parse.matches(F.col("value"), s.include, s.exclude))
        p = parse.parsed(F.col("value"), s.log_format, s.layout, F.col("mtime"), now)
        kept = kept.select(seq.alias("seq"), "value", p.alias("p"))
        bucket = parse.retention_pos(F.timestamp_seconds("p.epoch"), s.frequency)
        return kept.select(
            "seq", "value", F.col("p.epoch").alias("epoch"), bucket.alias("block"), F.col("p.message").alias("message"),
            tk.tokens(F.col("p.message"), s.keywords, s.ignorewords).alias("tokens"),
        )

    def new_lines(self, paths, limit: int = 0) -> DataFrame:
        """Lines after the position; of files that are not new only the listing is read."""
        return self._reading(paths, limit)[0]

    def _reading(self, paths, limit: int = 0) -> tuple[DataFrame, str, int]:
        """(new lines, the file that is resumed, its line).

        The file that was read last goes on after its last line, if that stands where it
        stood. It is looked for under its name, then (logs are renamed) in the oldest file
        that has changed. Any other file is new as a whole.
        """
        at = self.status()
        files = logs.new_files(logs.files_of(self.spark, paths), at["mtime"], at["file"])
        out, resumed = None, ""
        if at["row"]:
            same = [f for f in files if f.file == at["file"]]
            for f in dict.fromkeys([*same, *files[:1]]):
                rest = logs.after_row(logs.read_files(self.spark, [f]), at["row"], at["last"])
                if rest is not None:
                    files, out, resumed = [x for x in files if x != f], rest, f.file
                    break
        if files:
            new = logs.read_files(self.spark, files)
            out = new if out is None else out.unionByName(new)
        if out is None:
            out = logs.lines_of(self.spark, [])
        out = logs.first_lines(out, limit) if limit else out
        return out, resumed, at["row"] if resumed else 0

    def _templates(self, lines: DataFrame, known: DataFrame, border: int, weight: str | None = None) -> DataFrame:
        s = self.settings
        found = mining.mine(lines, known, border, s.min_rate, s.max_rate, s.keywords, weight)
        return lines.withColumn("vid", mining.vector_id()).join(found.select("vid", "phrase", "hidden"), "vid").drop("vid")

    def _custom(self, lines: DataFrame) -> DataFrame:
        if not self.settings.custom_phrases:
            return lines
        one = self.spark.createDataFrame([(i, p) for i, p in enumerate(self.settings.custom_phrases)], "i int, p string")
        words = one.orderBy("i").select(tk.tokens(F.col("p"), self.settings.keywords).alias("t")).collect()
        return mining.custom_match(lines, [r.t for r in words])

    # --- modes ---

    def feed(self, paths=None, limit: int = 0, lines: DataFrame | None = None, batch_of: tuple[str, int] | None = None) -> dict:
        """Counts new lines' terms, mines their templates and adds both to the blocks. Returns counts.

        batch_of: a stream's name and the number of its batch, which is fed once however
        often it is given. Lines that the filters drop, that have no term or that are older
        than retention move the position on as any others. With a block size, a new piece of
        a block begins once it has seen that many phrases that no feed had seen before.
        """
        s = self.settings
        before = self.store.head()
        batches = before["state"].get("batches", {})
        if batch_of and batches.get(batch_of[0], -1) >= batch_of[1]:
            return {"lines": 0, "border": 0, "phrases": 0}
        raw, resumed, row = self._reading(paths, limit) if lines is None else (lines, "", 0)
        raw = raw.persist() if lines is None else raw  # files are read once; lines that are given are cheaper to read again than to keep
        newest = _newest(before)
        batch = self.parsed(raw).withColumn("vid", mining.vector_id())
        vecs, part = self._kept(_vectors(self._placed(batch, newest)), newest)
        codes = _codes(vecs)
        counts = written(_terms_of(vecs, codes))
        known, next_id = self._known(before, counts)
        border = terms.border_of(known, s.border_rate, s.border)
        seen = self._mined(vecs, known, border, codes)
        grouped, work = _phrases_seen(seen, codes)
        used = [counts, known, grouped, *seen._work, *work]
        here = _places_of(grouped)
        n = sum(x["n"] for x in here)  # each line has one phrase
        if not self.read_only:
            size, chosen = self._sizes_after(before, vecs)
            fresh, pieces, cut = self._pieces(before, grouped, size, sorted({x["block"] for x in here}), newest)
            if cut:
                erase(vecs)
                cut_up = _vectors(batch.join(F.broadcast(pieces), "block").withColumn("piece", _piece_of("seq")))
                vecs, part = self._kept(cut_up, None)
                seen, counts = self._mined(vecs, known, border, codes), written(_terms_of(vecs, codes))  # the same lines, so the same phrases and codes
                grouped, work = _phrases_seen(seen, codes)
                used += [counts, grouped, pieces, *seen._work, *work]
                here = _places_of(grouped)
            position = before["state"].get("position", _START)
            if lines is None:
                end = logs.end_of(raw, resumed, row)
                if end:
                    position = end | {"feeds": position["feeds"] + 1, "now": self.now or end["mtime"]}
            if batch_of:
                batches = batches | {batch_of[0]: batch_of[1]}
            feeds = before["state"].get("fed", 0) + 1
            state = {"settings": asdict(s), "position": position, "batches": batches, "next_id": next_id, "sizes": chosen, "fed": feeds}
            self._commit(before, part, counts, grouped, known, fresh, state, here)
        out = {"lines": n, "border": border, "phrases": grouped.select("phrase").distinct().count()}
        raw.unpersist()
        erase(*used, *([vecs] if self.read_only else []))
        return out

    def _placed(self, lines: DataFrame, newest: dict[int, int]) -> DataFrame:
        """Lines with the piece that their block goes on in."""
        if not any(newest.values()):
            return lines.withColumn("piece", F.lit(0))
        at = F.broadcast(small(self.spark, [(b, p) for b, p in newest.items() if p], "block long, _p int"))
        return lines.join(at, "block", "left").withColumn("piece", F.coalesce("_p", F.lit(0))).drop("_p")

    def _kept(self, vecs: DataFrame, newest: dict[int, int] | None) -> tuple[DataFrame, dict]:
        """(vectors, written; their part of the store): they are written once, where they stay if a commit names them.

        newest: each block's piece, if it is known that its lines go there.
        """
        if self.read_only:
            return written(vecs), {}
        if newest is not None and self.settings.frequency not in parse.UNIT_SECONDS:
            vecs._place = (0, newest.get(0, 0))
        part = self.store.write_part("vectors", vecs)
        return self.store.rows_of("vectors", part), part

    def _known(self, before: dict, new: DataFrame) -> tuple[DataFrame, int]:
        """((term, cnt, first) of the totals and of new counts, written; the next free id).

        Terms that the totals lack get ids after all that were ever given, in the order of first sight.
        """
        old = self.terms(before)
        new = new.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
        start = before["state"].get("next_id", 1)
        ranks = ring.ranked(new.join(old, "term", "left_anti"), "first", "term")
        unseen = ranks.withColumn("first", F.col("rank") + start)
        both = new.select("term", "cnt").join(old.select("term", F.col("cnt").alias("had"), "first"), "term", "full")
        both = both.select("term", (F.coalesce("cnt", F.lit(0)) + F.coalesce("had", F.lit(0))).alias("cnt"), "first")
        known = written(both.where("first is not null").unionByName(unseen.select("term", "cnt", "first")))
        erase(ranks)
        return known, max(start, (known.agg(F.max("first")).first()[0] or 0) + 1)

    def _mined(self, vecs: DataFrame, known: DataFrame, border: int, codes: list[Column] | None = None) -> DataFrame:
        """The vectors with phrase and hidden; with codes their patterns have what _phrases_seen sums."""
        s = self.settings
        by = ("block", "piece") if codes else ()
        return mining.mined(vecs, known, border, s.min_rate, s.max_rate, s.keywords, by, _ends_of(codes))

    def _sizes_after(self, before: dict, vecs: DataFrame) -> tuple[int, dict]:
        """(block size, what is stored): settings, else chosen once, for the most lines that a block of this feed has."""
        s, chosen = self.settings, before["state"].get("sizes", {})
        if s.frequency and not chosen and not (s.block_size and s.max_blocks):
            most = vecs.groupBy("block").agg(F.sum("w").alias("n")).agg(F.max("n")).first()[0] or 0
            if most:
                size, blocks = ring.sizing(most, s.retention)
                chosen = {"block_size": size, "max_blocks": blocks}
        return s.block_size or chosen.get("block_size", 0), chosen

    def _pieces(self, before: dict, grouped: DataFrame, size: int, blocks: list[int], newest: dict[int, int]) -> tuple[dict, DataFrame | None, bool]:
        """(new phrases by block and piece; (block, base, ends): the piece that a block's lines go on in, and the lines that end one; whether any does).

        blocks: those of the feed; newest: the piece that each block of the store is in.
        """
        if not size:
            return {}, None, False
        base = {b: newest.get(b, 0) for b in blocks}
        # Phrases that the totals lack, where they are first seen.
        new = grouped.groupBy("phrase").agg(F.min(F.struct("f.first.seq", "block")).alias("at"))
        new = written(new.join(self.phrases(before).select("phrase"), "phrase", "left_anti").select("phrase", "at.block", "at.seq"))
        counts = {r["block"]: r["n"] for r in new.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
        carried = {b: before["status"].get(key_of(b, base[b]), {}).get("fresh", 0) for b in blocks}
        if all(carried[b] + counts.get(b, 0) < size for b in blocks):
            erase(new)
            return {(b, base[b]): counts.get(b, 0) for b in blocks}, None, False
        starts = small(self.spark, [(b, base[b], carried[b]) for b in blocks], "block long, base int, carried long")
        ranks = ring.ranked(new.withColumn("o", F.struct("block", "seq")), "o", "phrase")
        first = ranks.groupBy("block").agg(F.min("rank").alias("r0"))  # a row for each time bucket
        nth = ranks.join(F.broadcast(first), "block").join(F.broadcast(starts), "block")
        nth = nth.withColumn("nth", F.col("carried") + F.col("rank") - F.col("r0"))
        # One row for each `size` new phrases: a piece ends with the line that brings its last one.
        ends = nth.where((F.col("nth") + 1) % size == 0).groupBy("block").agg(F.sort_array(F.collect_list("seq")).alias("ends"))
        at = lambda n: (F.col("base") + F.floor(n / size)).cast("int")
        pieces = written(starts.join(ends, "block", "left").select("block", at(F.col("carried")).alias("base"), "ends"))
        fresh = nth.groupBy("block", at(F.col("nth")).alias("piece")).agg(F.count(F.lit(1)).alias("n"))
        counted = {(r["block"], r["piece"]): r["n"] for r in fresh.collect()}  # a row for each piece
        erase(new, ranks)
        return counted, pieces, True

    def _commit(self, before: dict, part: dict, counts: DataFrame, grouped: DataFrame, known: DataFrame, fresh: dict, state: dict, seen: list) -> None:
        """Adds parts to the blocks, of which the ring keeps the newest and retention the recent ones, and to the totals.

        part: the vectors' part, which is written; counts: their terms; grouped: their phrases; seen: _places_of these.
        """
        s = self.settings
        status = {k: dict(x) for k, x in before["status"].items()}
        for r in seen:
            old = status.get(key_of(r["block"], r["piece"]), {"last_epoch": 0, "lines": 0, "fresh": 0})
            status[key_of(r["block"], r["piece"])] = {
                "last_epoch": max(old["last_epoch"], r["e"]), "lines": old["lines"] + r["n"], "fresh": old["fresh"] + fresh.get((r["block"], r["piece"]), 0),
            }
        most = s.max_blocks or (state["sizes"].get("max_blocks", 0) if s.retention else 0) or s.retention
        if s.frequency and (s.retention or s.max_blocks) and status:
            unit = parse.UNIT_SECONDS.get(s.frequency, 86400)
            newest = max(x["last_epoch"] for x in status.values())
            recent = sorted((place_of(k) for k, x in status.items() if not s.retention or x["last_epoch"] >= newest - s.retention * unit + 1))
            status = {key_of(*p): status[key_of(*p)] for p in recent[-most:]}
        live = among([place_of(k) for k in status])
        dropped = [place_of(k) for k in before["status"] if k not in status]
        counts, grouped = counts.drop("first"), grouped.where(live)
        if len(seen) == 1 and key_of(seen[0]["block"], seen[0]["piece"]) in status:
            counts._place = (seen[0]["block"], seen[0]["piece"])
        else:
            counts = counts.where(live)
        # Vectors in blocks that the ring drops are not read; their files stay as long as the part does.
        part = part | {"blocks": [k for k in part["blocks"] if k in status]}
        part["rows"] = part["rows"] if part["blocks"] else 0
        by_block = {"terms": counts, "phrases": self._phrases_of(grouped)}
        totals = {
            "term_totals": self._total_terms(before, counts, known, dropped),
            "phrase_totals": self._total_phrases(before, self._phrases_of(_phrases_in_all(grouped)), dropped, state["fed"]),
        }
        with ThreadPoolExecutor(len(by_block | totals)) as pool:  # one small job each
            written_parts = pool.map(lambda x: self.store.write_part(*x), (by_block | totals).items())
            new = {"vectors": part} | dict(zip(by_block | totals, written_parts))
        parts, schemas = self.store.added(before, new, {name: set(status) for name in BY_BLOCK})
        for name in parts:
            head = {"parts": parts, "schemas": schemas}
            parts[name] = self.store.folded(head, name, lambda rows, name=name: _folded(name, rows), MOST_PARTS)
        self.store.commit(before, parts, status, state, schemas)

    def _phrases_of(self, grouped: DataFrame) -> DataFrame:
        """(phrase, cnt, created, updated, last_value, subject, block, piece) of phrases with their first and last lines."""
        s = self.settings
        message = F.coalesce("f.first.message", "f.first.value")
        hidden = F.array_union(F.col("f.hidden"), tk.excluded(message, s.keywords, s.ignorewords))
        return grouped.select("phrase", "block", "piece", "cnt", "created", "updated", F.col("last.value").alias("last_value"), mining.subject(F.col("f.first.value"), hidden).alias("subject"))

    def _total_terms(self, before: dict, counts: DataFrame, known: DataFrame, dropped: list) -> DataFrame:
        """What a feed adds to the totals, and what dropped blocks take from them."""
        place = {"block": F.lit(0).cast("long"), "piece": F.lit(0)}
        new = counts.groupBy("term").agg(F.sum("cnt").alias("cnt"))
        out = new.join(known.select("term", F.col("first").alias("id")), "term")
        gone = self.store.read("terms", dropped, before) if dropped else None
        if gone is not None:
            out = out.unionByName(gone.groupBy("term").agg((-F.sum("cnt")).alias("cnt")).withColumn("id", F.lit(None).cast("long")))
        return out.withColumns(place)

    def _total_phrases(self, before: dict, new: DataFrame, dropped: list, feed: int) -> DataFrame:
        out = new.withColumn("feed", F.lit(feed).cast("long"))
        gone = self.store.read("phrases", dropped, before) if dropped else None
        if gone is not None:
            gone = gone.groupBy("phrase", F.lit(0).cast("long").alias("block"), F.lit(0).alias("piece")).agg((-F.sum("cnt")).alias("cnt"))
            out = out.unionByName(gone, allowMissingColumns=True)
        return out

    def remine(self) -> dict:
        """Mines all live lines again, with the terms of all feeds: the phrases that one feed of all these lines would give.

        Feeds see the terms of all feeds before them, but look for shared beginnings among
        their own lines; this looks among all. It reads the stored vectors, not the logs,
        and replaces the phrases of all blocks in one commit.
        """
        s, before = self.settings, self.store.head()
        vecs = self.store.read("vectors")
        if vecs is None:
            return {"lines": 0, "border": 0, "phrases": 0}
        known = written(self.terms(before))
        border = terms.border_of(known, s.border_rate, s.border)
        codes = _codes(vecs)
        found = self._mined(vecs, known, border, codes)
        grouped, work = _phrases_seen(found, codes)
        erase(*found._work, *work)
        phrases, all_ = self._phrases_of(grouped), self._phrases_of(_phrases_in_all(grouped))
        n = vecs.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        if not self.read_only:
            feeds = before["state"]["fed"] + 1
            new = {"phrases": self.store.write_part("phrases", phrases), "phrase_totals": self.store.write_part("phrase_totals", self._total_phrases(before, all_, [], feeds))}
            parts, schemas = self.store.added(before, new, {"phrases": set(), "phrase_totals": set()})
            self.store.commit(before, parts, before["status"], before["state"] | {"fed": feeds}, schemas)
        out = {"lines": n, "border": border, "phrases": grouped.select("phrase").distinct().count()}
        erase(known, grouped)
        return out

    def rearranged(self, rate: float = 0.0, border: int = 0) -> DataFrame:
        """The phrases; under a higher border, mined again from one line each with its count as weight."""
        p, known = self.phrases(), self.terms()
        if rate <= 0 and border <= 0:
            return p
        current = terms.border_of(known, self.settings.border_rate, self.settings.border)
        new = terms.border_of(known, rate, border)
        if new <= current:
            return p
        s = self.settings
        fake = p.select(
            F.lit("").alias("file"), F.col("updated").alias("mtime"), F.lit(0).alias("part"), F.xxhash64("phrase").alias("at"),
            F.col("last_value").alias("value"), "cnt", "created", "updated",
        )
        again = self.parsed(fake).withColumn("at", F.col("seq.at"))
        again = again.join(fake.select("at", F.col("cnt").alias("w"), "created", "updated"), "at")
        mined = self._custom(self._templates(again, known, new, "w"))
        hidden = F.array_union(F.col("f.hidden"), tk.excluded(F.col("f.message"), s.keywords, s.ignorewords))
        return mined.groupBy("phrase").agg(
            F.sum("w").alias("cnt"), F.min("created").alias("created"), F.max("updated").alias("updated"),
            F.max_by("value", "seq").alias("last_value"), F.min_by(F.struct("value", "hidden", "message"), "seq").alias("f"),
        ).withColumn("subject", mining.subject(F.col("f.value"), hidden)).drop("f")

    def top_n(self, n: int = 10, most: int = 1, days: int = 0, last_text: bool = False, rate: float = 0.0, border: int = 0) -> DataFrame:
        """(text, cnt, score): the rarest-worded phrases that occurred at most `most` times in the last days (n by default)."""
        p, known = self.rearranged(rate, border), self.terms()
        total = known.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
        latest = p.agg(F.max("updated")).first()[0] or 0
        p = p.where(parse.matches(F.col("last_value"), self.settings.include, self.settings.exclude))
        top = mining.top_rare(mining.scores(p, known, total), n, most, max(0, latest - (days or n) * 86400))
        return top.select((F.col("last_value") if last_text else F.col("phrase")).alias("text"), "cnt", F.col("score"))

    def _folded_into_custom(self, p: DataFrame) -> DataFrame:
        """(phrase, cnt) of stored phrases, those whose last line fits a custom phrase under its name."""
        if not self.settings.custom_phrases:
            return p.select("phrase", "cnt")
        tokens = self._message_tokens(F.col("last_value"), F.col("updated"))
        return self._custom(p.select("phrase", "cnt", tokens.alias("tokens"))).groupBy("phrase").agg(F.sum("cnt").alias("cnt"))

    def _message_tokens(self, line: Column, at: Column) -> Column:
        s = self.settings
        return tk.tokens(parse.parsed(line, s.log_format, s.layout, at, F.timestamp_seconds(at))["message"], s.keywords, s.ignorewords)

    def detect(self, paths=None, least: int = 0, rate: float = 0.0, border: int = 0, lines: DataFrame | None = None) -> DataFrame:
        """(value, phrase, cnt) of new lines: how often each one's template occurred, this batch included.

        With custom phrases, lines and stored phrases that fit one count as it, whichever
        of them was there first: a stored phrase fits if its last line does.
        """
        raw = self.new_lines(paths) if lines is None else lines
        # Written, as the lines are read four times: for ranges, terms, patterns, and to get their patterns' phrases.
        batch = written(self.parsed(raw).select("seq", "value", "tokens"))
        codes = terms.order_codes(batch, "seq", room=F.max(F.size("tokens")))
        batch = batch.withColumns({"vid": mining.vector_id(), "w": F.lit(1).cast("long")})
        before = self.store.head()
        known, _ = self._known(before, terms.vector_terms(batch, "seq", codes and codes[0]))
        base = terms.border_of(known, self.settings.border_rate, self.settings.border)
        chosen = max(base, terms.border_of(known, rate, border)) if rate > 0 or border > 0 else base
        old = self._folded_into_custom(self.rearranged(rate, border))
        mined = self._mined(batch, known, chosen)
        found = self._custom(mined)
        here = _counted(mined) if not self.settings.custom_phrases else found.groupBy("phrase").agg(F.sum("w").alias("cnt"))
        total = old.unionByName(here).groupBy("phrase").agg(F.sum("cnt").alias("cnt"))
        total = written(total.where(F.col("cnt") >= least))  # so that Spark knows whether it can be broadcast
        erase(known)
        return found.select("seq", "value", "phrase").join(total, "phrase").orderBy("seq").select("value", "phrase", "cnt")

    def term_counts(self, n: int = 0, paths=None) -> DataFrame:
        known = terms.term_counts(self.parsed(self.new_lines(paths))) if paths else self.terms()
        return terms.histogram(known).orderBy(F.desc("term_count")).limit(max(n, 1))

    def analyze_line(self, line: str) -> tuple[str, DataFrame]:
        """The template of a line (its terms, or a custom phrase) and the counts of its terms."""
        one = self.parsed(logs.lines_of(self.spark, [line])).withColumn("phrase", F.array_join("tokens", " "))
        row = self._custom(one).select("phrase", "tokens").first()
        words = self.spark.createDataFrame([(t,) for t in dict.fromkeys(row.tokens) if t != tk.STAR], "term string")
        known = self.terms().select("term", "cnt")
        return row.phrase, words.join(known, "term", "left").select("term", F.coalesce("cnt", F.lit(0)).alias("cnt"))

    def output_phrases(self, n: int = 100, rate: float = 0.0, border: int = 0) -> DataFrame:
        """(Created, Updated, Count, Member) of the n largest phrases; all for n of 0."""
        p = self.rearranged(rate, border).orderBy(F.desc("cnt"), "phrase")
        p = p.limit(n) if n > 0 else p
        at = lambda c: F.date_format(F.timestamp_seconds(c), parse.DEFAULT_LABEL)
        return p.select(at("created").alias("Created"), at("updated").alias("Updated"), F.col("cnt").alias("Count"), F.col("subject").alias("Member"))

    def history(self, n: int = 100) -> tuple[list[str], DataFrame]:
        """The n largest phrases, and their counts by time bucket: one row a bucket, one column a phrase."""
        unit = parse.UNIT_SECONDS.get(self.settings.frequency, 86400)
        p = self.store.read("phrases")
        if p is None:
            raise LookupError("the history needs a data folder that was fed")
        top = self.phrases().orderBy(F.desc("cnt"), "phrase")
        ranked = [r.phrase for r in (top.limit(n) if n > 0 else top).select("phrase").collect()]
        grid = ring.history_grid(ring.history(p, unit), ranked, unit)
        return ranked, grid.withColumn("time", ring.label(F.col("at"), self.settings.frequency)).select("time", *grid.columns[1:])

    def ranked_phrases(self, n: int = 0) -> DataFrame:
        """(rank from 0, phrase, cnt, subject) of the n largest phrases (all for n of 0), in the order of the history's columns."""
        ranks = ring.ranked(self.phrases().withColumn("o", -F.col("cnt")), "o", "phrase").select("rank", "phrase", "cnt", "subject")
        return ranks.where(F.col("rank") < n) if n > 0 else ranks

    def history_lines(self, ranks: DataFrame, delim: str = ",") -> DataFrame:
        """(at, line): the counts of ranked phrases by time bucket, as lines of a delimited file; for any number of phrases."""
        p = self.store.read("phrases")
        if p is None:
            raise LookupError("the history needs a data folder that was fed")
        unit = parse.UNIT_SECONDS.get(self.settings.frequency, 86400)
        return ring.history_lines(ring.history(p, unit), ranks, ranks.count(), unit, self.settings.frequency, delim)

    def write_phrases(self, path: str, n: int = 0, delim: str = ",", rate: float = 0.0, border: int = 0) -> None:
        """output_phrases as a folder of CSV files with a header, whose names are in the order of the rows."""
        logs.write_table(self.output_phrases(n, rate, border), path, delim)

    def write_history(self, path: str, n: int = 0, delim: str = ",") -> None:
        """Two folders in path: history.csv, a header and a line for each time bucket, and subjects.txt, a row for each column.

        Tasks write both, so the driver holds neither phrases nor lines; a header is as long as a line.
        """
        ranks = self.ranked_phrases(n)
        name = F.concat((F.col("rank") + 1).cast("string"), F.lit("("), F.col("cnt").cast("string"), F.lit(")"))
        names = F.sort_array(F.collect_list(F.struct("rank", name.alias("name"))))
        head = ranks.agg(F.array_join(F.concat(F.array(F.lit("time")), F.transform(names, lambda x: x["name"])), delim).alias("line"))
        lines = self.history_lines(ranks, delim).unionByName(head.withColumn("at", F.lit(None).cast("long")))
        lines.orderBy(F.asc_nulls_first("at")).select("line").write.text(f"{path}/history.csv")
        logs.write_table(ranks.orderBy("rank").select(name.alias("name"), "subject"), f"{path}/subjects.txt", delim, header=False)

    def sizing(self, retention: int | None = None) -> tuple[int, int]:
        """(block size, number of blocks) for the most lines that a live block had, all its pieces together."""
        lines: dict[int, int] = {}
        for k, x in self.store.head()["status"].items():
            lines[place_of(k)[0]] = lines.get(place_of(k)[0], 0) + x["lines"]
        return ring.sizing(max(lines.values(), default=0), retention or self.settings.retention or 1)

    def clean(self) -> None:
        self.store.drop_all()


def _newest(head: dict) -> dict[int, int]:
    """The newest piece of each live block."""
    return dict(sorted(map(place_of, head["status"])))


def _places_of(grouped: DataFrame) -> list:
    """(block, piece, e, n) of phrases: their latest time and their lines; a row for each block."""
    return grouped.groupBy("block", "piece").agg(F.max("updated").alias("e"), F.sum("cnt").alias("n")).collect()


def _vectors(lines: DataFrame) -> DataFrame:
    """Lines with equal tokens as one row in each block, with their first and last line; a message that is the whole line is null."""
    return lines.groupBy("vid", "block", "piece").agg(
        F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("w"), F.min("epoch").alias("created"), F.max("epoch").alias("updated"),
        F.min(F.struct("seq", "value", F.nullif("message", "value").alias("message"))).alias("first"), F.max(F.struct("seq", "value")).alias("last"),
    )


def _codes(vecs: DataFrame) -> list[Column] | None:
    """Longs that order vectors by their first and last lines, if there are such: the first with room for a token's place."""
    return terms.order_codes(vecs, "first.seq", "last.seq", room=F.max(F.size("tokens")))


def _counted(vecs: DataFrame) -> DataFrame:
    """(phrase, cnt) of mined vectors: of their patterns, and of those vectors whose tokens are their phrase."""
    own, all_ = vecs._own(), vecs._groups.select("phrase", "w")
    all_ = all_ if own is None else all_.unionByName(own.groupBy("phrase").agg(F.sum("w").alias("w")))
    return all_.groupBy("phrase").agg(F.sum("w").alias("cnt"))


def _ends_of(codes: list[Column] | None) -> list[Column]:
    """What a pattern's or a phrase's vectors come to, but for texts: times, first and last line by code, and their number."""
    if codes is None:
        return []
    return [F.min("created").alias("created"), F.max("updated").alias("updated"), F.min(codes[0]).alias("_a"), F.max(codes[1]).alias("_z"), F.count(F.lit(1)).alias("_n")]


def _phrases_seen(vecs: DataFrame, codes: list[Column] | None) -> tuple[DataFrame, list[DataFrame]]:
    """((phrase, block, piece, cnt, created, updated, last, f) of vectors with their phrases, written; other tables to erase). f: the first line and what the phrase hides.

    With codes phrases are summed from their patterns, by hash, and only vectors that hold a
    phrase's first or last line are read once more, named and sorted; where phrases are nearly
    as many as vectors, all are.
    """
    key = ["phrase", "block", "piece"]
    sums = [F.sum("w").alias("cnt"), F.min("created").alias("created"), F.max("updated").alias("updated")]
    ends = [F.max("last").alias("last"), F.min_by(F.struct("first", "hidden"), "first.seq").alias("f")]
    if codes is None:
        return written(vecs.groupBy(*key).agg(*sums, *ends)), []
    parts = vecs._groups
    own = vecs._own()
    if own is not None:
        parts = parts.unionByName(own.groupBy(*key).agg(F.sum("w").alias("w"), *_ends_of(codes)))
    all_ = written(parts.groupBy(*key).agg(*sums, F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.sum("_n").alias("_n")))
    if all_.agg(F.coalesce(F.sum("_n") < 4 * F.count(F.lit(1)), F.lit(False))).first()[0]:
        return written(vecs.groupBy(*key).agg(*sums, *ends)), [all_]
    # Vectors whose line ends any phrase come first, and get their phrases then.
    end = lambda c, name: all_.select(F.col(c).alias(name)).distinct().withColumn(f"{name}?", F.lit(True))
    at = lambda rows: rows.withColumns({"_c0": codes[0], "_c1": codes[1]})
    found = at(vecs._some(lambda rows: at(rows).join(end("_a", "_c0"), "_c0", "left").join(end("_z", "_c1"), "_c1", "left").where("`_c0?` or `_c1?`")))
    found = found.join(all_.select(*key, "_a", "_z"), key).withColumns({"_first": F.col("_c0") == F.col("_a"), "_last": F.col("_c1") == F.col("_z")})
    ends = found.where("_first or _last").groupBy(*key).agg(
        F.max(F.when(F.col("_last"), F.col("last"))).alias("last"),
        F.min_by(F.struct("first", "hidden"), F.when(F.col("_first"), F.col("first.seq"))).alias("f"),
    )
    return written(all_.drop("_a", "_z", "_n").join(ends, key)), [all_]


def _phrases_in_all(grouped: DataFrame) -> DataFrame:
    """One row for each phrase, in block 0, of _phrases_seen."""
    return grouped.groupBy("phrase", F.lit(0).cast("long").alias("block"), F.lit(0).alias("piece")).agg(
        F.sum("cnt").alias("cnt"), F.min("created").alias("created"), F.max("updated").alias("updated"),
        F.max("last").alias("last"), F.min_by("f", "f.first.seq").alias("f"),
    )


def _terms_of(vecs: DataFrame, codes: list[Column] | None) -> DataFrame:
    """(term, cnt, first) of vectors by block: first orders terms by where they were first seen."""
    return terms.vector_terms(vecs, "first.seq", codes and codes[0], "block", "piece")


def _piece_of(seq: str) -> Column:
    """A line's piece: as many after the base as ended before the line."""
    return F.col("base") + F.coalesce(F.size(F.filter("ends", lambda e: e < F.col(seq))), F.lit(0))


def _summed_phrases(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each phrase of rows of several feeds; what blocks that were dropped take away has no time."""
    fed = F.when(F.col("cnt") > 0, F.col("feed"))
    return rows.groupBy("phrase", *by).agg(
        F.sum("cnt").alias("cnt"), F.min("created").alias("created"), F.max("updated").alias("updated"),
        F.max_by("last_value", F.struct("updated", "feed")).alias("last_value"), F.min_by("subject", fed).alias("subject"), F.max("feed").alias("feed"),
    )


def _folded(name: str, rows: DataFrame) -> DataFrame:
    """The rows of several parts as one for each vector, term or phrase and block."""
    if name == "terms":
        return rows.groupBy("term", "block", "piece").agg(F.sum("cnt").alias("cnt"))
    if name == "term_totals":
        return rows.groupBy("term", "block", "piece").agg(F.sum("cnt").alias("cnt"), F.min("id").alias("id"))
    if name == "phrase_totals":
        return _summed_phrases(rows, "block", "piece")
    if name == "vectors":
        return rows.groupBy("vid", "block", "piece").agg(
            F.first("tokens").alias("tokens"), F.sum("w").alias("w"), F.min("created").alias("created"), F.max("updated").alias("updated"),
            F.min("first").alias("first"), F.max("last").alias("last"),
        )
    return rows.groupBy("phrase", "block", "piece").agg(
        F.sum("cnt").alias("cnt"), F.min("created").alias("created"), F.max("updated").alias("updated"),
        F.max_by("last_value", "updated").alias("last_value"), F.min_by("subject", "created").alias("subject"),
    )
