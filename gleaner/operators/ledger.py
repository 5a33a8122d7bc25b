"""Tables of blocks that change together: data folders first, then one commit file that makes them count.

A table is a set of parts, each a folder partitioned by block and piece. A commit is a small
JSON file that names the parts and blocks in use, the tables' schemas, and whatever state
belongs to them; it comes into being by one rename, so readers see all of a change or
nothing. What a failed change has written is in no commit. Reading filters by part and
block, which prunes folders; a table without rows keeps its schema.

A block is a stretch of time, and its pieces are what rotation by size makes of it; a table
that isn't cut by time has block 0 only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import small

#: Parts of one level beyond which a change folds them into one part of the next level.
MOST_PARTS = 16
_PLACE = [T.StructField("block", T.LongType()), T.StructField("piece", T.IntegerType())]


def key_of(block: int, piece: int = 0) -> str:
    return f"{block}.{piece}"


def place_of(key: str) -> tuple[int, int]:
    block, _, piece = key.partition(".")
    return int(block), int(piece or 0)


def among(places):
    """Whether a row's block and piece are among some: one flat list, however many pieces there are."""
    key = F.concat_ws(".", F.col("block").cast("string"), F.col("piece").cast("string"))
    return key.isin([key_of(*p) for p in places])


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def head(self) -> dict:
        """The newest commit: number, parts (by table), schemas (by table), status (by block and piece) and state."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "parts": {}, "schemas": {}, "status": {}, "state": {}}
        fs, p = self._fs(f"{self.root}/commits/{numbers[-1]:010d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    # --- reading ---

    def tables(self) -> dict[str, T.StructType]:
        """The schema of each table, block and piece among its columns, whether it has rows or not."""
        return {name: T.StructType.fromJson(s).add(_PLACE[0]).add(_PLACE[1]) for name, s in self.head()["schemas"].items()}

    def read(self, table: str, blocks: list | None = None, head: dict | None = None, with_status: bool = False) -> DataFrame | None:
        """The rows of a table in its live blocks, or in some of them; None if there is no such table.

        blocks: numbers, which stand for all pieces, or (number, piece). with_status: with
        block_seq and completed, as status() has them.
        """
        head = head or self.head()
        if table not in head["schemas"]:
            return None
        plain = T.StructType.fromJson(head["schemas"][table])
        schema = T.StructType([*plain.fields, T.StructField("part", T.StringType()), *_PLACE])
        base = f"{self.root}/{table}"
        wanted = []
        for p in head["parts"].get(table, []):
            here = [place_of(k) for k in p["blocks"]]
            here = [x for x in here if blocks is None or x in blocks or x[0] in blocks]
            if here:
                wanted.append((p["id"], here))
        columns = [*plain.names, "block", "piece"]
        whole = {p["id"] for p in head["parts"].get(table, []) if not p["pieces"]}
        if wanted:
            df = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/part={name}" for name, _ in wanted])
            live = F.lit(False)
            for name, here in wanted:
                here_too = F.col("block").isin([b for b, _ in here]) if name in whole else among(here)
                live = live | (here_too & (F.col("part") == name))
            df = df.where(live).select(columns)
        else:
            df = self.spark.createDataFrame([], schema).select(columns)
        if with_status:
            known = F.broadcast(self.status(head).select("block", "piece", "block_seq", "completed"))  # a row for each live block
            df = df.join(known, ["block", "piece"], "left").select(*columns, "block_seq", "completed")
        return df

    def count(self, table: str, where=None, blocks: list | None = None) -> DataFrame:
        """One row (n): the rows of a table's live blocks that fit."""
        df = self.read(table, blocks)
        if df is None:
            return self.spark.createDataFrame([(0,)], "n long")
        return (df if where is None else df.where(where)).agg(F.count(F.lit(1)).alias("n"))

    def status(self, head: dict | None = None) -> DataFrame:
        """(block, piece, block_seq, last_epoch, lines, fresh, completed) of live blocks; all but the newest are completed."""
        known = sorted((*place_of(k), s["last_epoch"], s["lines"], s.get("fresh", 0)) for k, s in (head or self.head())["status"].items())
        rows = [(b, q, k, e, n, f, k < len(known) - 1) for k, (b, q, e, n, f) in enumerate(known)]
        return small(self.spark, rows, "block long, piece int, block_seq long, last_epoch long, lines long, fresh long, completed boolean")

    def current(self, table: str) -> DataFrame | None:
        """The rows of the newest block."""
        head = self.head()
        newest = max(map(place_of, head["status"]), default=None)
        return self.read(table, [newest] if newest else [], head)

    # --- changing ---

    def write_part(self, table: str, df: DataFrame, level: int = 0) -> dict:
        """Writes rows (with block and piece) as a new part, which counts from the commit that names it on.

        The part tells its blocks and its number of rows, which the write itself observes,
        and its schema. A block's rows are put together, but those of a large block are
        split over several tasks. Rows marked with the one place (`_place`) that they all have
        are neither exchanged nor sorted.
        """
        name, seen, place = uuid.uuid4().hex, Observation(), getattr(df, "_place", None)
        places = F.collect_set(F.struct("block", "piece"))  # live blocks, not rows
        df = df.withColumn("block", F.col("block").cast("long")).withColumn("piece", F.col("piece").cast("int"))
        path, rows = f"{self.root}/{table}/part={name}", F.count(F.lit(1)).alias("rows")
        if place is not None:
            plain = df.drop("block", "piece").observe(seen, rows)
            plain.write.parquet(f"{path}/block={place[0]}/piece={place[1]}")
            got = {"rows": seen.get["rows"], "places": [{"block": place[0], "piece": place[1]}]}
        else:
            df = df.hint("rebalance", "block", "piece").observe(seen, rows, places.alias("places"))
            df.write.partitionBy("block", "piece").parquet(path)
            got = seen.get
        schema = T.StructType([f for f in df.schema if f.name not in ("block", "piece")])
        return {"id": name, "rows": got["rows"], "blocks": sorted(key_of(x["block"], x["piece"]) for x in got["places"]), "pieces": max((x["piece"] for x in got["places"]), default=0), "level": level, "schema": json.loads(schema.json())}

    def rows_of(self, table: str, part: dict) -> DataFrame:
        """The rows of a part that was written, whether a commit names it or not."""
        plain = T.StructType.fromJson(part["schema"])
        base = f"{self.root}/{table}/part={part['id']}"
        out = self.spark.read.schema(T.StructType([*plain.fields, *_PLACE])).option("basePath", base).parquet(base)
        out._written = base  # so that it can be erased
        return out

    def added(self, before: dict, new: dict[str, dict], live: dict[str, set[str]]) -> tuple[dict, dict]:
        """(parts, schemas) of a head with new parts; live: the blocks that stay, by table (all, if it isn't named)."""
        parts, schemas = {}, dict(before["schemas"])
        for table in {**before["parts"], **new}:
            old = before["parts"].get(table, [])
            if table in live:
                old = [{**p, "blocks": [b for b in p["blocks"] if b in live[table]]} for p in old]
            kept = [p for p in old if p["blocks"]]
            if table in new:
                part = dict(new[table])
                schemas[table] = part.pop("schema")
                kept += [part] if part["rows"] else []
            parts[table] = kept
        return parts, schemas

    def folded(self, head: dict, table: str, fold, most: int = MOST_PARTS) -> list[dict]:
        """The parts of a table, of which those of one level become one of the next once they are many.

        fold: what makes one DataFrame of another with the same columns. Each row is rewritten
        about once for each power of `most` that the number of changes reaches.
        """
        parts = head["parts"].get(table, [])
        level = 0
        while any(p["level"] >= level for p in parts):
            same = [p for p in parts if p["level"] == level]
            if len(same) >= most:
                rows = self.read(table, head={**head, "parts": {table: same}})
                part = self.write_part(table, fold(rows), level + 1)
                part.pop("schema")
                parts = [p for p in parts if p["level"] != level] + ([part] if part["rows"] else [])
            level += 1
        return parts

    def commit(self, before: dict, parts: dict, status: dict, state: dict, schemas: dict | None = None) -> dict:
        """Makes a new head after the head `before`; an error if another came in between."""
        head = {"number": before["number"] + 1, "parts": parts, "schemas": schemas or before.get("schemas", {}), "status": status, "state": state}
        fs, target = self._fs(f"{self.root}/commits/{head['number']:010d}.json")
        _, draft = self._fs(f"{self.root}/commits/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"commit {head['number']} of {self.root} was made by someone else")
        return head

    def vacuum(self) -> int:
        """Deletes data and commits that the newest commit doesn't need; returns how many folders and files went."""
        head, gone = self.head(), 0
        used = {p["id"] for parts in head["parts"].values() for p in parts}
        for table in head["schemas"]:
            fs, p = self._fs(f"{self.root}/{table}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName().removeprefix("part=") not in used:
                    gone += fs.delete(s.getPath(), True)
        for n in self._numbers()[:-1]:
            fs, p = self._fs(f"{self.root}/commits/{n:010d}.json")
            gone += fs.delete(p, False)
        return gone

    def drop_all(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)
