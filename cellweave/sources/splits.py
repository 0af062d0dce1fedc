"""Delimited files read by many tasks each, whatever their quoted newlines.

Spark's text reader gives the lines of a file in splits. Whether a line begins inside a quoted value depends on all lines before it, but each
split can say what it does to either state: where it ends and how many rows it completes. These transitions are composed file by file, one
step a split; each split then knows its state and its first row's number, and gives its cells. A row that goes on from one split to the next is
put together from its pieces, which only happens where a split begins inside quotes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.model import ROWS, batches_of, by_text, cells, streamed
from cellweave.sources.streams import csv_values

#: Splits that are broadcast at most: some 100 bytes each. At Spark's 128 MB a split that is over 60 TB of text.
SPLITS = 1 << 19


class Quotes:
    """Whether a line ends inside a quoted value, given whether it begins there. Only a value's first character opens quotes."""

    def __init__(self, delimiter: str):
        self.delimiter = delimiter if len(delimiter) == 1 else ""
        self.closing = re.compile(r'[^"]*+(?:""[^"]*+)*+"')

    def after(self, line: str, inside: bool) -> bool:
        at = 0
        if inside:
            m = self.closing.match(line)
            if m is None:
                return True
            at = self.next_cell(line, m.end())
        elif '"' not in line:
            return False
        while at >= 0:
            # the next value that begins with a quote
            if not line.startswith('"', at):
                at = line.find(f'{self.delimiter}"', at) + 1 if self.delimiter else 0
                if at == 0:
                    return False
            m = self.closing.match(line, at + 1)
            if m is None:
                return True
            at = self.next_cell(line, m.end())
        return False

    def next_cell(self, line: str, at: int) -> int:
        return line.find(self.delimiter, at) + 1 or -1 if self.delimiter else -1


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, size, octets, line): lines of files in the order in which a task reads them; start is their split's first byte."""
    m = "_metadata.file_"
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    octets = (F.octet_length("value") + 1).alias("octets")
    return read.select(F.col(f"{m}path").alias("path"), F.col(f"{m}block_start").alias("start"), F.col(f"{m}size").alias("size"), octets, F.make_valid_utf8("value").alias("line"))


def by_split(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """(key, runs of rows) of each split; names: the columns that are the same for all lines of a split."""
    ahead: list = []

    def pieces() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for b in batches:
            keys = list(zip(*(b.column(n).to_pylist() for n in names), strict=True))
            i = 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                yield keys[i], b.slice(i, j - i)
                i = j

    every = pieces()

    def run(key: tuple, first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield first
        for one in every:
            if one[0] != key:
                ahead.append(one)
                return
            yield one[1]

    while (begin := ahead.pop() if ahead else next(every, None)) is not None:
        yield begin[0], run(*begin)


_TRANSITIONS = "path string, start long, size long, out_ends boolean, out_rows long, in_ends boolean, in_rows long, bytes long"


def _transitions(delimiter: str) -> Callable:
    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        quotes = Quotes(delimiter)
        for key, runs in by_split(batches, ["path", "start", "size"]):
            state, rows, size = [False, True], [0, 0], 0
            for b in runs:
                size += pc.sum(b.column("octets")).as_py()
                for line in b.column("line").to_pylist():
                    bare = line.replace("\r", "")
                    for k in (0, 1):
                        state[k] = quotes.after(bare, state[k])
                        rows[k] += not state[k]
            yield *key, state[0], rows[0], state[1], rows[1], size

    return lambda batches: batches_of(splits(batches), _TRANSITIONS)


def split_states(transitions: DataFrame) -> DataFrame:
    """(path, start, inside, row, last, closed): each split's state and number of rows before it; closed: the file ends with a line's end."""
    steps = F.array_sort(F.collect_list(F.struct("start", "out_ends", "out_rows", "in_ends", "in_rows")))
    files = transitions.groupBy("path").agg(steps.alias("steps"), F.first("size").alias("size"), F.sum("bytes").alias("bytes"))
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("row"), F.array().cast("array<struct<start:bigint,inside:boolean,row:bigint>>").alias("out"))

    def step(acc, s):
        here = F.struct(s["start"].alias("start"), acc["inside"].alias("inside"), acc["row"].alias("row"))
        ends = F.when(acc["inside"], s["in_ends"]).otherwise(s["out_ends"])
        rows = acc["row"] + F.when(acc["inside"], s["in_rows"]).otherwise(s["out_rows"])
        return F.struct(ends.alias("inside"), rows.alias("row"), F.concat(acc["out"], F.array(here)).alias("out"))

    # a mark at the file's start, which the reader takes off, is of three bytes
    closed = (F.col("bytes") == F.col("size")) | (F.col("bytes") == F.col("size") - 3)
    files = files.select("path", closed.alias("closed"), F.aggregate("steps", zero, step, lambda acc: acc["out"]).alias("out"))
    files = files.select("path", "closed", F.explode("out").alias("s"), F.element_at("out", -1)["start"].alias("end"))
    return files.select("path", "s.start", "s.inside", "s.row", (F.col("s.start") == F.col("end")).alias("last"), "closed")


def rows_of(runs: Iterator[pa.RecordBatch], quotes: Quotes, inside: bool) -> Iterator[tuple[bool, bool, list[str]]]:
    """(begins here, ends here, lines) of each row of a split."""
    begins, kept = not inside, []
    for b in runs:
        for line in b.column("line").to_pylist():
            kept.append(line.replace("\r", ""))
            inside = quotes.after(kept[-1], inside)
            if not inside:
                yield begins, True, kept
                begins, kept = True, []
    if kept:
        yield begins, False, kept


_OUT = "path string, row long, col int, piece long, ends boolean, v string"


def _cells(delimiter: str, pieces: bool) -> Callable:
    """Cells of rows that lie in one split, or the pieces of those that do not (col is null, piece the split's start)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        quotes = Quotes(delimiter)
        for (path, start, inside, row, last, closed), runs in by_split(batches, ["path", "start", "inside", "row", "last", "closed"]):
            events = rows_of(runs, quotes, inside)
            ready, first, event = [], row, next(events, None)
            while event is not None:
                (begins, ends, lines), event = event, next(events, None)
                at_end = last and event is None
                if begins and (ends or at_end):
                    if at_end and not closed and not pieces:
                        yield from laid(path, first, ready)
                        yield from laid(path, row, lines, open_end=True)
                        ready = []
                    elif not pieces:
                        ready += lines
                        if len(ready) >= ROWS:
                            yield from laid(path, first, ready)
                            ready, first = [], row + 1
                elif pieces:
                    yield path, row, None, start, at_end and not closed, "\n".join(lines)
                else:
                    yield from laid(path, first, ready)
                    ready, first = [], row + 1
                row += ends
            yield from laid(path, first, ready)

    def laid(path: str, first: int, lines: list[str], open_end: bool = False) -> Iterator[tuple]:
        if lines:
            for r, c, v in csv_values("\n".join(lines) + ("" if open_end else "\n"), delimiter, open_end):
                yield path, first + r, c, None, None, v

    return lambda batches: batches_of(records(batches), _OUT)


def scan_csv_files(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Cells of delimited UTF-8 files at or under a path, as sources.delimited.scan_csv gives them, workbook_id the file's path.

    Each split of a file is a task's work. What is broadcast is a row a split (at most SPLITS); an empty file has no cells."""
    lines = text_lines(spark, path)
    states = split_states(lines.mapInArrow(_transitions(delimiter), _TRANSITIONS)).persist()
    n, over = states.agg(F.count("*"), F.max("inside")).first()
    if n > SPLITS:
        raise ValueError(f"{n} splits; raise spark.sql.files.maxPartitionBytes")
    known = lines.drop("size", "octets").join(F.broadcast(states), ["path", "start"]).select("path", "start", "inside", "row", "last", "closed", "line")
    out = known.mapInArrow(_cells(delimiter, False), _OUT).select("path", "row", "col", "v")
    if over:
        part = known.mapInArrow(_cells(delimiter, True), _OUT).groupBy("path", "row")
        texts = part.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "v"))), lambda x: x["v"]), "\n").alias("v"), F.max("ends").alias("ends"))
        texts = texts.select(F.struct("path", "row").alias("at"), F.concat("v", F.when(F.col("ends"), "").otherwise("\n")).alias("v"))
        split = streamed(texts, "at", "v", "r int, col int, v string", lambda text: csv_values(text, delimiter))
        out = out.unionByName(split.select("workbook_id.path", "workbook_id.row", "col", "v"))
    found = out.select(F.col("path").alias("workbook_id"), F.lit(0).alias("sheet_idx"), F.col("row").alias("row_idx"), F.col("col").alias("col_idx"), "v")
    return cells(found, kind=by_text(F.col("v")), text=F.col("v"))
