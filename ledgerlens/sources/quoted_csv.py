"""CSV files with quoted fields, read in parallel.

A quoted field may hold commas, doubled quotes and line ends, so whether a line
starts a record depends on all quotes before it.  Files are still split as any
text: a first pass follows every split under both possible start states (outside
and inside a quoted field) until they meet, the splits' state functions are
joined in order, and a second pass parses each split from its true state.  Just
the lines of records that go over the end of a split are brought together; the
first pass writes them, for each state that a split could start in.
"""

from __future__ import annotations

import csv
import io
import re
import sys

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.shared import materialise

# A line from outside a quoted field: whole fields, then a quoted one that stays open.  A quote opens a field just at its
# start; after the closing quote the rest of the field is plain text.
_REST = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_REST}"(?:[^",][^,]*+)?|[^",][^,]*+)?'
_STAYS_OPEN = re.compile(rf'(?:{_FIELD},)*+"{_REST}\Z')
#: The rest of a quoted field from its inside, to the end of the field.
_CLOSES = re.compile(rf'{_REST}"(?:[^",][^,]*+)?(?:,|\Z)')

_SPLITS = ("kind long, file string, block long, line long, text string, ends_open boolean, ends_open_after_quote boolean, "
           "head long, head_after_quote long, header_line long, header string")
#: Kinds of rows of the first pass: a split, a line before the first record's start in a split that starts inside, a line
#: of the record that stays open at its end if it starts outside, and if it starts inside.
SPLIT, BEFORE, OPEN, OPEN_AFTER_QUOTE = range(4)
#: Records of a batch.
_ROWS = 10_000


def state_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, if one was (``inside``)
    or was not before it."""
    if inside:
        closed = _CLOSES.match(line)
        if closed is None:
            return True
        if not line[:closed.end()].endswith(","):
            return False
        line = line[closed.end():]
    return '"' in line and _STAYS_OPEN.match(line) is not None


def _by_split(batches):
    """(file, block, lines, columns) of each split; lines must be read to their end
    before the next split.  columns: the first row's further values."""
    pieces = _pieces(batches)
    held = next(pieces, None)

    def lines(key):
        nonlocal held
        while held is not None and held[0] == key:
            yield from held[1].to_pylist()
            held = next(pieces, None)

    while held is not None:
        key, _, more = held
        yield *key, _no_mark(lines(key), key[1]), more


def _pieces(batches):
    """Batches of (file, block, value, ...) cut where the split changes."""
    for b in batches:
        if not b.num_rows:
            continue
        block, file = b.column(1).to_numpy(), b.column(0).dictionary_encode()
        place = file.indices.to_numpy()
        cut = [0, *(((block[1:] != block[:-1]) | (place[1:] != place[:-1])).nonzero()[0] + 1).tolist(), b.num_rows]
        for s, e in zip(cut, cut[1:]):
            yield (file.dictionary[int(place[s])].as_py(), int(block[s])), b.column(2).slice(s, e - s), [c[s].as_py() for c in b.columns[3:]]


def _no_mark(lines, block: int):
    """The lines, at the start of a file without its byte order mark."""
    if block == 0:
        for line in lines:
            yield line.removeprefix("\ufeff")
            break
    yield from lines


def _records(lines):
    """(lines, fields) of each record from a place outside of quotes; fields are
    None where the record stays open at the end.  Of an odd record (a carriage
    return within a line) the fields are those of the whole record's text."""
    csv.field_size_limit(sys.maxsize)
    held, odd, ended = [], False, False

    def feed():
        nonlocal odd, ended
        for line in lines:
            held.append(line)
            if "\r" in line and line.find("\r") < len(line) - 1:
                odd = True
                line = line.replace("\r", " ")
            yield line + "\n"
        ended = True
        yield "end"  # a row of its own, or the rest of an open field

    for row in csv.reader(feed()):
        if ended:
            if held:
                yield held, None
            return
        if odd:
            record, odd = "\n".join(held).removesuffix("\r"), False
            row = fields_of(record) if '"' in record else record.split(",")
        yield held, row
        held.clear()


def _blank(lines: list[str]) -> bool:
    return len(lines) == 1 and not lines[0].removesuffix("\r").strip(" ")


def _first_pass(batches):
    """Per split the states after it under both start states, the last line that
    starts a record (-1: none in this split) and the header, and the lines of
    records that may be torn."""
    for file, block, lines, _ in _by_split(batches):
        row = lambda kind, line, text: (kind, file, block, line, text, *[None] * 6)
        rows: list[tuple] = []
        states, heads, held, n, header = [False, block != 0], [-1, -1], [[], []], 0, None
        # in the first split both states are the true one
        for line in lines:
            if states[0] == states[1] and (block == 0 or not states[0]):
                break
            for k in (0, 1):
                if not states[k]:
                    heads[k], held[k] = n, []
                if heads[k] >= 0:
                    held[k].append(line)
            if heads[1] < 0:
                rows.append(row(BEFORE, n, line))
                if len(rows) >= _ROWS:
                    yield _batch(rows, _SPLITS)
                    rows = []
            if '"' in line:
                states = [state_after(line, s) for s in states]
            n += 1
        else:
            line = None
        if line is not None:
            def rest(first=line):
                yield first
                yield from lines

            for own, fields in _records(rest()):
                heads, held, states = [n, n], [own, own], [fields is None] * 2
                if block == 0 and header is None and not _blank(own):
                    header = (n, "\n".join(own).removesuffix("\r") if fields is not None else None)
                n += len(own)
            held = [list(own) if states[0] else [] for own in held]
        for k, kind in enumerate((OPEN, OPEN_AFTER_QUOTE)):
            if states[k] and heads[k] >= 0:
                for s in range(0, len(held[k]), _ROWS):
                    yield _batch([row(kind, heads[k] + s + i, t) for i, t in enumerate(held[k][s:s + _ROWS])], _SPLITS)
        yield _batch([*rows, (SPLIT, file, block, n, None, *states, *heads, *(header or (-1, None)))], _SPLITS)


def _second_pass(width: int):
    """The fields of the records that begin and end in a split, by its true state."""

    def run(batches):
        for file, block, lines, (inside, header_line) in _by_split(batches):
            if inside is None:
                raise ValueError(f"the splits of {file} changed while it was read")
            n, rows, places = 0, [], []
            while inside:
                line = next(lines, None)
                if line is None:
                    break
                inside = state_after(line, True) if '"' in line else True
                n += 1
            for own, fields in _records(lines):
                if fields is not None and not _blank(own) and (block != 0 or n != header_line):
                    rows.append(fields if len(fields) == width else (fields + [None] * width)[:width])
                    places.append(n)
                    if len(rows) >= _ROWS:
                        yield _columns(file, block, places, rows, width)
                        rows, places = [], []
                n += len(own)
            if rows:
                yield _columns(file, block, places, rows, width)

    return run


def _columns(file: str, block: int, places: list[int], rows: list[list], width: int) -> pa.RecordBatch:
    fields = [pa.array(c, pa.string()) for c in zip(*rows)] if width else []
    return pa.RecordBatch.from_arrays([pa.array([file], pa.string()).take(pa.array([0] * len(rows))), pa.array([block] * len(rows), pa.int64()),
                                       pa.array(places, pa.int64()), *fields], ["file", "block", "line", *[f"f{k}" for k in range(width)]])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _split_states(s: DataFrame) -> DataFrame:
    """(file, block, opens_inside, head_block, head_line, header_line, header,
    never_closed): the true state at each split's start and the line before it
    that starts the open record.

    A split maps the state before it to that after it: it keeps the state,
    turns it, or ends in one state whatever came before.  The state at a split
    is what the last split of the third kind left, turned as often as splits
    since then say.  One row per split (of some 128 MB of text): a file's
    splits are few enough for one window."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("ends_open") == F.col("ends_open_after_quote")
    turns = F.col("ends_open") & ~F.col("ends_open_after_quote")
    s = s.withColumn("turned", F.sum(turns.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = (s.withColumn("known", F.last(F.when(fixed, F.struct("ends_open", "turned")), ignorenulls=True).over(before))
         .withColumn("upto", F.last("turned").over(before)))
    left = F.coalesce(F.col("known.ends_open").cast("long"), F.lit(0)) + F.coalesce(F.col("upto"), F.lit(0)) - F.coalesce(F.col("known.turned"), F.lit(0))
    s = s.withColumn("opens_inside", left % 2 == 1)
    own = F.when(F.col("opens_inside"), F.col("head_after_quote")).otherwise(F.col("head"))
    s = s.withColumn("own", F.when(own >= 0, F.struct(F.col("block").alias("block"), own.alias("line"))))
    last_open = F.when(F.col("opens_inside"), F.col("ends_open_after_quote")).otherwise(F.col("ends_open"))
    return (s.withColumn("open_head", F.last("own", ignorenulls=True).over(before))
            .select("file", "block", "opens_inside", F.col("open_head.block").alias("head_block"), F.col("open_head.line").alias("head_line"),
                    "header_line", "header", (last_open & (F.lead("block").over(order).isNull())).alias("never_closed")))


def fields_of(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline="")), [])


def _torn_records(passed: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, block, line, record): the records over the ends of splits as text,
    by where they start, line ends kept, blank ones left out."""
    inside = F.col("opens_inside")
    own = F.col("kind") == F.when(inside, OPEN_AFTER_QUOTE).otherwise(OPEN)
    lines = (passed.where(F.col("kind") != SPLIT).select("kind", "file", "block", "line", "text").join(F.broadcast(splits), ["file", "block"])
             .where(own | (inside & (F.col("kind") == BEFORE))))
    # the head of an open record is its split's last one: its first line here
    first = lines.where(own).groupBy("file", "block").agg(F.min("line").alias("own_line"))
    lines = lines.join(first, ["file", "block"], "left").select(
        "file", F.when(own, F.col("block")).otherwise(F.col("head_block")).alias("first_block"),
        F.when(own, F.col("own_line")).otherwise(F.col("head_line")).alias("first_line"), "block", "line", "text")
    return (lines.groupBy("file", "first_block", "first_line").agg(F.sort_array(F.collect_list(F.struct("block", "line", "text"))).alias("parts"))
            .select("file", F.col("first_block").alias("block"), F.col("first_line").alias("line"),
                    F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), "\r\\z", "").alias("record"))
            .where(F.length(F.btrim("record")) > 0))


def read_quoted_csv(spark: SparkSession, path) -> DataFrame:
    """Files with the header of the first one: its columns as text (unnamed
    ones as ``_c<place>``) and the struct ``_at`` (file, start, place) to sort
    by.  Absent fields are null, empty ones "", surplus ones left out; line ends
    within quotes are kept, blank lines left out.  A quote that is never closed
    is an error, as it makes one record of all that follows."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    passed = materialise(raw.mapInArrow(_first_pass, _SPLITS), "csv-lines")
    splits = materialise(_split_states(passed.where(F.col("kind") == SPLIT)), "csv-splits")
    lost = splits.where("never_closed").first()
    if lost is not None:
        raise ValueError(f"a quoted field is not closed in {lost.file}")
    torn = _torn_records(passed, splits.select("file", "block", "opens_inside", "head_block", "head_line"))
    # a header that goes over the end of its split is among the torn records
    first = (splits.where("block = 0 and header_line >= 0").select("file", "block", F.col("header_line").alias("line"), "header")
             .join(torn, ["file", "block", "line"], "left").select("file", "line", F.coalesce("header", "record").alias("record")))
    head = first.orderBy("file").first()
    if head is None:
        return spark.createDataFrame([], "_at struct<file:string,start:long,place:long>")
    names: list[str] = []
    for k, n in enumerate(fields_of(head.record)):
        n = n.strip() or f"_c{k}"
        names.append(n if n not in names else f"{n}.{sum(x.split('.')[0] == n for x in names)}")

    @F.pandas_udf("array<string>")
    def parsed(record: pd.Series) -> pd.Series:
        return record.map(fields_of, na_action="ignore")

    # line by line in the order of the split: the joined states must not move the lines
    lines = raw.join(F.broadcast(splits.select("file", "block", "opens_inside", "header_line")), ["file", "block"], "left")
    whole = lines.select("file", "block", "value", "opens_inside", "header_line").mapInArrow(
        _second_pass(len(names)), "file string, block long, line long" + "".join(f", f{k} string" for k in range(len(names))))
    over = (torn.join(F.broadcast(splits.where("block = 0").select("file", "header_line")), "file", "left")
            .where("header_line is null or block <> 0 or line <> header_line").select("file", "block", "line", parsed("record").alias("f"))
            .select("file", "block", "line", *[F.get("f", F.lit(k)).alias(f"f{k}") for k in range(len(names))]))
    at = F.struct("file", F.col("block").alias("start"), F.col("line").alias("place")).alias("_at")
    return whole.unionByName(over).select(*[F.col(f"f{k}").alias(n) for k, n in enumerate(names)], at)


def has_quotes(spark: SparkSession, path) -> bool:
    """Whether any line holds a quote (the search ends at the first)."""
    return not spark.read.text(path).where(F.col("value").contains('"')).isEmpty()
