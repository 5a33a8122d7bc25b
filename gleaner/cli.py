"""Command line: python -m gleaner.cli -m MODE -d DATA -f LOGS."""

from __future__ import annotations

import argparse
import contextlib
import csv
import os
import sys

from gleaner import config
from gleaner.plans.miner import Miner, Settings
from gleaner.session import scratch, session
from gleaner.sources import logs

MODES = ("topN", "detect", "feed", "remine", "clean", "termCounts", "analyzeLine", "outputPhrases", "outputPhrasesHistory")
#: Keys of the configuration file, and the settings that they are.
KEYS = {
    "logFormat": "log_format", "timestampLayout": "layout", "searchString": "include", "excludeString": "exclude",
    "keywords": "keywords", "ignorewords": "ignorewords", "customPhrases": "custom_phrases", "frequency": "frequency",
    "retention": "retention", "maxBlocks": "max_blocks", "blockSize": "block_size", "minMatchRate": "min_rate", "maxMatchRate": "max_rate",
    "termCountBorderRate": "border_rate", "termCountBorder": "border",
}
#: Modes that look at the stored phrases again under a border of their own, and the settings that give it.
REARRANGING, RENEWED = ("topN", "detect", "outputPhrases"), ("border_rate", "border")
LISTS = ("include", "exclude", "keywords", "ignorewords", "custom_phrases")


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("-c", dest="config")
    a.add_argument("-m", dest="mode", choices=MODES, default="topN")
    a.add_argument("-d", dest="data")
    a.add_argument("-f", dest="logs", help="glob of log files; standard input if there is none")
    for flag, name in (("-s", "include"), ("-x", "exclude"), ("-k", "keywords"), ("-i", "ignorewords"), ("-frequency", "frequency")):
        a.add_argument(flag, dest=name)
    for flag, name in (("-minR", "min_rate"), ("-maxR", "max_rate"), ("-R", "border_rate")):
        a.add_argument(flag, dest=name, type=float)
    for flag, name in (("-b", "border"), ("-retention", "retention"), ("-blockSize", "block_size"), ("-maxBlocks", "max_blocks")):
        a.add_argument(flag, dest=name, type=int)
    a.add_argument("-N", type=int, default=10)
    a.add_argument("-M", type=int, default=None)
    a.add_argument("-biggestN", type=int, default=100)
    a.add_argument("-line", default="")
    a.add_argument("-o", dest="out", default="")
    a.add_argument("-delim", default=",")
    a.add_argument("-showLastText", action="store_true")
    a.add_argument("-readonly", action="store_true")
    a.add_argument("-silent", action="store_true", help="no progress and no warnings")
    a.add_argument("-debug", action="store_true", help="Spark's log as well")
    return a


def settings(args, file: dict) -> Settings:
    """The command line wins over the file, which wins over defaults."""
    out = Settings()
    for key, name in KEYS.items():
        if file.get(key) not in (None, ""):
            v = file[key]
            setattr(out, name, v.split(",") if name in LISTS and isinstance(v, str) else v)
    for name in KEYS.values():
        v = getattr(args, name, None)
        if v is not None and not (name in RENEWED and args.mode in REARRANGING):
            setattr(out, name, ([v] if name in ("include", "exclude") else v.split(",")) if name in LISTS else v)
    return out


def table(rows, header, out: str, delim: str) -> None:
    """Rows one at a time into a file, or to the standard output, which stays open."""
    with open(out, "w", newline="") if out else contextlib.nullcontext(sys.stdout) as f:
        w = csv.writer(f, delimiter=delim[0])
        if header:
            w.writerow(header)
        w.writerows(rows)


def shared(out: str) -> bool:
    """Whether an output is a folder of a file system that Spark's tasks write to, such as hdfs://host/path."""
    return "://" in out


def history(miner: Miner, n: int, out: str, delim: str) -> None:
    """history.csv and subjects.txt in a folder, or both to the standard output; rows pass one at a time."""
    if shared(out):
        return miner.write_history(out, n, delim[0])
    ranks = miner.ranked_phrases(n)
    lines = miner.history_lines(ranks, delim[0])
    if out:
        os.makedirs(out, exist_ok=True)
    with open(f"{out}/history.csv", "w") if out else contextlib.nullcontext(sys.stdout) as f:
        f.write("time")
        for r in ranks.orderBy("rank").select("rank", "cnt").toLocalIterator():
            f.write(f"{delim[0]}{r['rank'] + 1}({r.cnt})")
        f.write("\n")
        for r in lines.orderBy("at").toLocalIterator():
            f.write(r.line + "\n")
    heads = ((f"{r['rank'] + 1}({r.cnt})", r.subject) for r in ranks.orderBy("rank").toLocalIterator())
    table(heads, None, out and f"{out}/subjects.txt", delim)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    file = config.load(args.config) if args.config else {}
    data, path = args.data or file.get("dataDir") or "", args.logs or file.get("logPath") or ""
    spark = session(**{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": str(not args.silent).lower()})
    spark.sparkContext.setLogLevel("INFO" if args.debug else "ERROR" if args.silent else "WARN")
    renewed = RENEWED if args.mode in REARRANGING else ()
    explicit = any(getattr(args, n, None) is not None for n in KEYS.values() if n not in renewed) or bool(file)
    miner = Miner(spark, data or scratch(spark), settings(args, file) if explicit else None, read_only=args.readonly)
    again = {"rate": args.border_rate or 0.0, "border": args.border or 0} if renewed else {}
    stdin = logs.spooled(spark, sys.stdin, scratch(spark)) if not path and args.mode in ("topN", "feed", "detect") else None
    if args.mode == "clean":
        if input(f"Delete {data}? (y/N) ").strip().lower() == "y":
            miner.clean()
    elif args.mode == "feed":
        fed = miner.feed(path, lines=stdin)
        if not args.silent:
            print(fed)
    elif args.mode == "remine":
        mined = miner.remine()
        if not args.silent:
            print(mined)
    elif args.mode == "topN":
        miner.feed(path, lines=stdin)
        for r in miner.top_n(args.N, 1 if args.M is None else args.M, args.retention or 0, args.showLastText, **again).collect():
            print(f"{r.cnt},{r.score:f},{r.text}")
    elif args.mode == "detect":
        for r in miner.detect(path, args.M or 0, lines=stdin, **again).toLocalIterator():
            print(f"{r.cnt} {r.value}\n  {r.phrase}")
    elif args.mode == "termCounts":
        table(([*r] for r in miner.term_counts(args.N, path or None).collect()), ["count", "terms", "sample"], args.out, args.delim)
    elif args.mode == "analyzeLine":
        phrase, counts = miner.analyze_line(args.line)
        print(phrase)
        for r in counts.collect():
            print(f"{r.term}: {r.cnt}")
    elif args.mode == "outputPhrases" and shared(args.out):
        miner.write_phrases(args.out, args.biggestN, args.delim[0], **again)
    elif args.mode == "outputPhrases":
        df = miner.output_phrases(args.biggestN, **again)
        table(([*r] for r in df.toLocalIterator()), df.columns, args.out, args.delim)
    else:
        history(miner, args.biggestN, args.out, args.delim)
    return 0


if __name__ == "__main__":
    sys.exit(main())
