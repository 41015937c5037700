"""Records of JSON documents and CSV files, which no single line holds, cut out by many tasks.

Where a record of such a file ends depends on everything before it (an open quote, the nesting depth). It is found as a
prefix computation over the scan's splits:

1. every split is summed up for both states it may start in (outside or inside quotes): the state it ends in, and for
   JSON how much deeper;
2. those sums, one row a split, are chained file by file, which gives the state each split starts in;
3. every split is read once more, from its true state, and cut into records. What lies before its first cut and behind
   its last one are fragments; the few that meet at split borders are joined.

Splits are read by Spark's text reader with a record separator that both formats are full of (a comma, a line feed), so a
file of one line splits like any other, and from any store Spark reads. The records are written to the checkpoint folder
once, each with its place (``__path``, ``__block``, ``__local``): later jobs read them in any number of tasks, and do not
depend on how Spark splits the source the next time.

The broadcast of step 3 has one row a split, i.e. at most one for ``spark.sql.files.maxPartitionBytes`` of input or for a file.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, work_dir
from .files import metadata_path

PLACE = "__path string, __block long"
SUMS = PLACE + ", end0 int, end1 int, deep0 long, deep1 long, first string, last string"
STATES = PLACE + ", state int, depth long, is_last boolean, target int, from_block long, from_offset long, part boolean"
# kind 0: a whole record; 1: what lies before a split's first cut; 2: what lies behind its last one
CUT = PLACE + ", __local long, kind int, has_cut boolean, opens boolean, closes boolean, text string, fields array<string>"
SPACE = b" \t\r\n"
WHOLE = -1  # no depth at which to cut: the file is one record


def pieces(spark: SparkSession, source: str, separator: str, glob: str | None = None) -> DataFrame:
    """(__path, __block, piece): what lies between separators, in the order of the split they are read in."""
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(source).select(metadata_path().alias("__path"), F.col("_metadata.file_block_start").alias("__block"),
                                      F.col("value").cast("binary").alias("piece"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of one split at a time; a split may come in several parts, one after the other."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        path, block = batch.column(0), np.asarray(batch.column(1))
        ids = np.asarray(path.dictionary_encode().indices)
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(block) != 0)) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield (path[int(start)].as_py(), int(block[start])), batch.slice(int(start), int(end - start))


# ------------------------------------------------------------------ JSON text

def json_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: whether an odd number of quotes opens before it, its step of depth (brackets, also those inside
    strings), whether it is a quote that counts."""
    back = data == 92
    quote = data == 34
    if back.any():
        index = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(back, -1, index))
        run = np.zeros(len(data), np.int64)  # backslashes right before each byte
        run[1:] = index[1:] - 1 - plain[:-1]
        quote &= run % 2 == 0
    within = (np.cumsum(quote) - quote) % 2 == 1
    step = np.zeros(len(data), np.int8)
    step[(data == 91) | (data == 123)] = 1
    step[(data == 93) | (data == 125)] = -1
    return within, step, quote


def _json_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, object] = {}
    for place, part in _runs(batches):
        if held.get("place") != place:
            if held:
                yield _sum_row(held)
            held = {"place": place, "ends": [0, 1], "deep": [0, 0], "first": None, "last": None}
        text = b",".join(part.column(2).to_pylist()) + b","
        data = np.frombuffer(text, np.uint8)
        within, step, quote = json_marks(data)
        odd = int(quote.sum()) % 2
        inside, outside = int(step[within].sum()), int(step[~within].sum())
        for s in (0, 1):
            held["deep"][s] += inside if held["ends"][s] else outside
            held["ends"][s] ^= odd
        shown = text.removeprefix(b"\xef\xbb\xbf").strip(SPACE + b"," if held["first"] is None else SPACE)
        if held["first"] is None and shown:
            held["first"] = chr(shown[0])
        if shown := text[:-1].rstrip(SPACE):  # the last byte is the separator
            held["last"] = chr(shown[-1])
        elif held["last"] or place[1] > 0:
            held["last"] = ","  # only blanks since the separator before
    if held:
        yield _sum_row(held)


def _sum_row(held: dict) -> pa.RecordBatch:
    (path, block), ends, deep = held["place"], held["ends"], held["deep"]
    values = [path, block, ends[0], ends[1], deep[0], deep[1], held["first"], held["last"]]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["__path", "__block", "end0", "end1", "deep0", "deep1", "first", "last"]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)


def _chain(table: pd.DataFrame) -> pd.DataFrame:
    """The splits of one file: the state and depth each starts with."""
    table = table.sort_values("__block").reset_index(drop=True)
    first = next((c for c in table["first"] if isinstance(c, str)), "")
    last = next((c for c in table["last"][::-1] if isinstance(c, str)), "")
    part = last == "," or (first == "{" and last == "]")  # of an exported array: not closed, or closes a list it does not open
    state, depth, rows = 0, 1 if part and first != "[" else 0, []
    for r in table.itertuples(index=False):
        path, block, end0, end1, deep0, deep1 = r[:6]
        rows.append((path, block, state, depth, block == table["__block"].iloc[-1], 1 if part or first == "[" else WHOLE,
                     0, 0, part, first))
        depth += deep1 if state else deep0
        state = end1 if state else end0
    return pd.DataFrame(rows, columns=["__path", "__block", "state", "depth", "is_last", "target", "from_block", "from_offset", "part", "first"])


def chained(sums: DataFrame) -> DataFrame:
    """One task a file; its splits are as many rows."""
    return sums.groupBy("__path").applyInPandas(lambda t: _chain(t), STATES + ", first string")


MEMBER = re.compile(rb'("(?:[^"\\]|\\.)*")\s*$', re.S)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members ``data`` and ``rows`` of a document that is an object: where their value starts, and whether it is a list."""
    found, place, at = [], None, 0
    for here, part in _runs(batches):
        if here != place:
            place, at = here, 0
            state, depth = part.column(3)[0].as_py(), part.column(4)[0].as_py()
        text = b",".join(part.column(2).to_pylist()) + b","
        data = np.frombuffer(text, np.uint8)
        within, step, quote = json_marks(data)
        within = within ^ bool(state)
        deep = depth + np.cumsum(np.where(within, 0, step))
        for i in np.flatnonzero((data == 58) & ~within & (deep == 1)):
            name = MEMBER.search(text[max(0, i - 100):i])
            if name and (key := json.loads(name[1])) in ("data", "rows"):
                value = text[i + 1:i + 1 + len(text)].lstrip(SPACE)
                opens = len(text) - len(value)
                found.append((place[0], key, place[1], at + opens + 1, value[:1] == b"["))
        state ^= int(quote.sum()) % 2
        depth = int(deep[-1])
        at += len(text)
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in
                                      enumerate([pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()])],
                                     ["__path", "key", "from_block", "from_offset", "is_list"])


def _json_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, held = None, None
    for here, part in _runs(batches):
        if here != place:
            if held:
                yield from held.end()
            place, held = here, _JsonSplit(here, *(part.column(i)[0].as_py() for i in range(3, 10)))
        yield from held.more(part.column(2).to_pylist())
    if held:
        yield from held.end()


class _Split:
    """Gathers the records and fragments of one split. ``starts``: its first record starts here, not in a split before."""

    def __init__(self, place: tuple, starts: bool):
        self.place, self.starts, self.local, self.rows, self.opening = place, starts, 0, [], True

    def record(self, text: str, closes: bool = False, opens: bool = False, fields: list[str] | None = None) -> None:
        """A record ends here."""
        whole = self.starts or not self.opening
        self.rows.append((*self.place, self.local, 0 if whole else 1, True, opens, closes, text if fields is None or not whole else None, fields if whole else None))
        self.local, self.opening = self.local + 1, False

    def rest(self, text: str, opens: bool = False) -> None:
        """What the split ends with; without any cut it is all there is."""
        self.rows.append((*self.place, self.local, 1 if self.opening else 2, not self.opening, opens, False, text, None))

    def out(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        if rows:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string())]
            names = ["__path", "__block", "__local", "kind", "has_cut", "opens", "closes", "text", "fields"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


class _JsonSplit(_Split):
    def __init__(self, place, state, depth, is_last, target, from_block, from_offset, part):
        if state is None:
            raise ValueError(f"{place[0]}: its splits changed while it was read")
        super().__init__(place, place[1] == from_block)
        self.state, self.depth, self.last, self.target, self.part = state, depth, is_last, target, part
        self.before = place[1] < from_block
        self.skip = from_offset if self.starts else 0
        self.bracket = self.starts and target == 1 and depth == 0  # the opening bracket is still to come
        self.closed = not self.starts and target != WHOLE and depth < target
        self.open, self.at, self.held = [], 0, []

    def more(self, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        if self.last:  # no separator follows the file's last piece: one waits until another comes
            found = [*self.held, *found]
            found, self.held = found[:-1], found[-1:]
        if found:
            yield from self._more(b",".join(found) + b",")

    def _more(self, text: bytes) -> Iterator[pa.RecordBatch]:
        if self.before:
            return
        if self.closed:
            self._nothing_but_blanks(text)
            return
        data = np.frombuffer(text, np.uint8)
        within, step, quote = json_marks(data)
        within = within ^ bool(self.state)
        deep = self.depth + np.cumsum(np.where(within, 0, step))
        self.state ^= int(quote.sum()) % 2
        self.depth = int(deep[-1])
        begin = min(len(text), max(0, self.skip - self.at))
        if self.bracket:
            bare = text.removeprefix(b"\xef\xbb\xbf").lstrip(SPACE)
            self.bracket = not bare
            begin = len(text) - len(bare) + 1 if bare else len(text)
        self.at += len(text)
        if self.target == WHOLE:
            self.open.append(text)
            return
        shut = np.flatnonzero(deep[begin:] < self.target) + begin
        end = int(shut[0]) if len(shut) else len(text)
        for cut in np.flatnonzero((data[begin:end] == 44) & ~within[begin:end] & (deep[begin:end] == self.target)) + begin:
            self._record(text[begin:cut], False)
            begin = int(cut) + 1
        if len(shut):
            if text[end:end + 1] != b"]":
                raise ValueError(f"{self.place[0]}: a list closed by {text[end:end + 1]!r}")
            self._record(text[begin:end], True)
            self.closed = True
            self._nothing_but_blanks(text[end + 1:])
        elif begin < len(text):
            self.open.append(text[begin:])
        yield from self.out()

    def _nothing_but_blanks(self, text: bytes) -> None:
        if self.target == 1 and text.strip(SPACE + b","):
            raise ValueError(f"{self.place[0]}: content after the end of the list")

    def _record(self, text: bytes, closes: bool) -> None:
        whole = b"".join([*self.open, text])
        self.open = []
        self.record(whole.decode(), closes, self._opens())

    def _opens(self) -> bool:
        """Whether the next record may be empty: the only one of a list, or what stands behind a part's last comma."""
        return self.part or (self.opening and self.starts)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held and self.held[0]:
            yield from self._more(self.held[0])
        if self.before or self.closed:
            return
        left = b"".join(self.open).decode()
        if self.last:  # the end of the file
            if self.target != WHOLE and not self.part:
                raise ValueError(f"{self.place[0]}: the list is not closed")
            self.record(left.removeprefix("\ufeff"), True, self._opens())
        elif self.open:
            self.rest(left[:-1], self._opens())  # the last character is the separator of the last piece
        yield from self.out()


# ------------------------------------------------------------------ CSV text

# A line that, read from the start of a row, leaves no quote open: fields that start with a quote end it, in others quotes are plain.
_FIELD = rb'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
_CLOSED = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+", re.S).fullmatch
_LINES = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)").findall


def csv_lines(found: list[bytes]) -> Iterator[bytes]:
    """Lines with their ends; a lone carriage return ends one, too."""
    for piece in found:
        line = piece + b"\n"
        if b"\r" in piece[:-1]:
            yield from _LINES(line)
        else:
            yield line


def csv_after(line: bytes, quoted: int) -> int:
    """Whether a quote is open after a line, by whether one was before."""
    if b'"' not in line:
        return quoted
    bare = line.rstrip(b"\r\n")
    return 0 if _CLOSED(b'"' + bare if quoted else bare) else 1


def _csv_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, object] = {}
    for place, part in _runs(batches):
        if held.get("place") != place:
            if held:
                yield _sum_row(held)
            held = {"place": place, "ends": [0, 1], "deep": [0, 0], "first": None, "last": None}
        a, b = held["ends"]
        for line in csv_lines(part.column(2).to_pylist()):
            if b'"' in line:
                a, b = (csv_after(line, a),) * 2 if a == b else (csv_after(line, a), csv_after(line, b))
        held["ends"] = [a, b]
    if held:
        yield _sum_row(held)


def csv_fields(text: str) -> list[str]:
    """The fields of one row; a blank line has none."""
    return next(csv.reader([text]), [])


class _CsvSplit(_Split):
    def __init__(self, place, state, depth, is_last, target, from_block, from_offset, part):
        if state is None:
            raise ValueError(f"{place[0]}: its splits changed while it was read")
        super().__init__(place, not state)
        self.state, self.last, self.open, self.header = state, is_last, [], place[1] == 0

    def more(self, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        for line in csv_lines(found):
            self.open.append(line)
            self.state = csv_after(line, self.state)
            if not self.state:
                self._record()
        yield from self.out()

    def _text(self) -> str:
        text, self.open = b"".join(self.open).decode(), []
        return text.removeprefix("\ufeff") if self.header else text

    def _record(self, closes: bool = False) -> None:
        text = self._text()
        fields = csv_fields(text) if self.starts or not self.opening else None
        if fields != []:  # a blank line is no row
            self.record(text, closes, self.header, fields)
            self.header = False

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open and self.last:
            self._record(True)
        elif self.open:
            self.rest(self._text(), self.header)
        yield from self.out()


def _csv_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, held = None, None
    for here, part in _runs(batches):
        if here != place:
            if held:
                yield from held.end()
            place, held = here, _CsvSplit(here, *(part.column(i)[0].as_py() for i in range(3, 10)))
        yield from held.more(part.column(2).to_pylist())
    if held:
        yield from held.end()


# ------------------------------------------------------------------ the records

def _cut(found: DataFrame, states: DataFrame, cut: Callable, joiner: str, parse: Callable | None = None) -> DataFrame:
    """(__path, __block, __local, opens, closes, text, fields): all records, fragments joined (and parsed)."""
    columns = ["state", "depth", "is_last", "target", "from_block", "from_offset", "part"]
    placed = found.join(F.broadcast(states.select("__path", "__block", *columns)), ["__path", "__block"], "left")
    rows = _written(placed.select("__path", "__block", "piece", *columns).mapInArrow(cut, CUT), "records")
    later = W.partitionBy("__path").orderBy("__block", "kind").rowsBetween(1, W.unboundedFollowing)
    own = F.when((F.col("kind") == 1) & F.col("has_cut"), F.col("__block"))
    fragments = rows.filter("kind > 0").withColumn("end", F.coalesce(own, F.min(own).over(later)))
    joined = (fragments.groupBy("__path", F.col("end").alias("__block")).agg(
        F.sort_array(F.collect_list(F.struct("__block", "kind", "text"))).alias("parts"),
        F.max("opens").alias("opens"), F.max("closes").alias("closes")))
    joined = _written(joined.select("__path", "__block", F.lit(0).cast("long").alias("__local"), "opens", "closes",
                                    F.array_join(F.col("parts.text"), joiner).alias("text"), F.lit(None).cast("array<string>").alias("fields")), "joined-records")
    if parse is not None:
        joined = _written(joined.mapInArrow(parse, joined.schema), "parsed-records")
    return rows.filter("kind = 0").select(*joined.columns).unionByName(joined)


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def json_records(spark: SparkSession, source: str, glob: str | None = None) -> DataFrame:
    """(__line, __path, __block, __local): the texts of the rows of JSON documents: the items of a list, or of the list that
    an object has under ``data`` or else ``rows``, or the whole document. Other members of such an object are not looked at."""
    work_dir(spark)
    ship_package(spark)
    found = pieces(spark, source, ",", glob)
    states = chained(found.mapInArrow(_json_sums, SUMS)).checkpoint(eager=True)
    objects = states.filter((F.col("first") == "{") & ~F.col("part")).select("__path").distinct()
    if not objects.isEmpty():
        inside = found.join(F.broadcast(states.join(objects, "__path", "left_semi").select("__path", "__block", "state", "depth")), ["__path", "__block"])
        members = inside.select("__path", "__block", "piece", "state", "depth").mapInArrow(
            _members, "__path string, key string, from_block long, from_offset long, is_list boolean")
        last = members.groupBy("__path", "key").agg(F.max(F.struct("from_block", "from_offset", "is_list")).alias("at"))
        lists = last.filter("at.is_list").groupBy("__path").agg(F.min_by("at", "key").alias("at"))  # data before rows
        states = states.join(lists, "__path", "left")
        chosen = F.col("at").isNotNull()
        states = states.select("__path", "__block", "state", "depth", "is_last", F.when(chosen, 2).otherwise(F.col("target")).alias("target"),
                               F.when(chosen, F.col("at.from_block")).otherwise(F.col("from_block")).alias("from_block"),
                               F.when(chosen, F.col("at.from_offset")).otherwise(F.col("from_offset")).alias("from_offset"), "part", "first")
        states = states.checkpoint(eager=True)
    rows = _cut(found, states, _json_cut, ",")
    shut = rows.filter("closes").groupBy("__path").agg(F.min("__block").alias("shut")).join(states.filter("target = 2").select("__path").distinct(), "__path")
    # In such a document, what lies behind the split that closes the list are other members.
    rows = rows.join(shut, "__path", "left").filter(F.col("shut").isNull() | (F.col("__block") <= F.col("shut")))
    blank = F.btrim("text", F.lit(" \t\r\n")) == ""
    return (rows.filter(~(blank & F.col("opens") & F.col("closes")))  # of an empty list, or behind a part's last comma
            .select(F.col("text").alias("__line"), "__path", "__block", "__local"))


def _parse_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = [csv_fields(t) for t in batch.column("text").to_pylist()]
        columns = [pa.nulls(batch.num_rows, pa.string()) if n == "text" else pa.array(fields, pa.list_(pa.string())) if n == "fields" else batch.column(n)
                   for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def csv_records(spark: SparkSession, source: str, glob: str | None = None) -> DataFrame:
    """(fields, is_header, __path, __block, __local): the rows of CSV files; blank lines are none. The first row of each
    file is its header."""
    work_dir(spark)
    ship_package(spark)
    found = pieces(spark, source, "\n", glob)
    states = chained(found.mapInArrow(_csv_sums, SUMS)).checkpoint(eager=True)
    rows = _cut(found, states, _csv_cut, "", _parse_joined)
    return rows.select("fields", F.col("opens").alias("is_header"), "__path", "__block", "__local")
