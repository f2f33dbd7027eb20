"""Saved run documents of any size, read in parallel.

A run saved elsewhere is one JSON document with all its files inside.  Reading
it as one row needs as much memory as the document.  Here Spark's text source
cuts a document at commas, so its byte ranges are read by many tasks, and each
task walks its range once with a buffer of constant size.  What a range needs
to know of the text in front of it is whether it starts inside a string and
which brackets are open, a few values a range:

1. count the quotes of every range: the sums say which start in a string;
2. note the brackets every range closes and leaves open, with the last name
   in each;
3. emit the members of the document and the elements of its lists as rows.  The
   first and last piece of a range may be parts of one; these alone are joined
   across ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linescope.operators.languages import from_json_name
from linescope.schemas import FILE_ROW, RUN_DOCUMENT

BUFFER = 1 << 20  # characters walked at once
_FILE_LISTS = ["per_file_records", "skipped_file_records"]

_ESCAPED = re.compile(r"\\.", re.DOTALL)
#: A whole string and the colon that makes it a name, a mark, or a string whose
#: end is not there yet.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?|[{}\[\],]|"', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)

#: An open bracket and the last name inside of it.
Frame = list


class Walker:
    """Walks the text of a range, given what was open in front of it.

    `frames` are the open brackets with the last name in each; brackets that are
    closed without being known are counted by `closed`, and `base` is then the
    last name outside of them.
    """

    def __init__(self, in_string: bool, frames: list[Frame] | None = None):
        self.in_string = in_string
        self.frames = [list(f) for f in frames or []]
        self.closed, self.base = 0, None
        self.rest, self.wanted = "", BUFFER

    def feed(self, text: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """Marks and names outside of strings with the text in front of them."""
        self.rest += text
        if len(self.rest) < self.wanted and not last:
            return
        data, at = self.rest, 0
        if self.in_string:
            end = _REST_OF_STRING.match(data)
            if end is None:
                self.wanted = 2 * len(data)
                return
            self.in_string, at = False, end.end()
        done = 0
        for token in _TOKEN.finditer(data, at):
            mark = token[0]
            if mark == '"':
                self.rest, self.wanted = data[done:], 2 * (len(data) - done) + BUFFER
                break
            if mark[0] != '"' or token[1]:
                yield mark[: len(mark) - len(token[1] or "")], data[done : token.start()]
                done = token.end()
        else:
            self.rest, self.wanted = data[done:], BUFFER

    def move(self, token: str) -> None:
        """Follow a mark or a name."""
        if token in "{[":
            self.frames.append([token, None])
        elif token in "}]":
            if self.frames:
                self.frames.pop()
            else:
                self.closed, self.base = self.closed + 1, None
        elif token != ",":
            name = token[1:-1]
            if self.frames:
                self.frames[-1][1] = name
            else:
                self.base = name


def after(frames: list[Frame], closed: int, base: str | None, opened: list[Frame]) -> list[Frame]:
    """What is open behind a range."""
    frames = [list(f) for f in frames[: len(frames) - closed]]
    if base is not None and frames:
        frames[-1][1] = base
    return frames + [list(f) for f in opened]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, str]]:
    """Pieces of text by range: (path, start), whether a range ends, text.  The
    commas that parted the pieces come back in front of them."""
    now, held, size = None, [], 0
    for batch in batches:
        for path, start, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (path, start) != now:
                if now is not None:
                    yield now, True, "".join(held)
                now, held, size = (path, start), [], 0
                if start:
                    held.append(",")
            else:
                held.append(",")
            held.append(text)
            size += len(text) + 1
            if size >= BUFFER:
                yield now, False, "".join(held)
                held, size = [], 0
    if now is not None:
        yield now, True, "".join(held)


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = 0
    for (path, start), ends, text in _ranges(batches):
        count += _ESCAPED.sub("", text).count('"')
        if ends:
            yield pa.RecordBatch.from_pydict({"path": [path], "start": pa.array([start], pa.int64()), "quotes": pa.array([count], pa.int64())})
            count = 0


_FRAMES = pa.list_(pa.list_(pa.string()))


def _brackets(batches: Iterator[pa.RecordBatch], inside: dict) -> Iterator[pa.RecordBatch]:
    walker = None
    for at, ends, text in _ranges(batches):
        walker = walker or Walker(inside[at])
        for token, _ in walker.feed(text, ends):
            walker.move(token)
        if ends:
            columns = {"path": [at[0]], "start": pa.array([at[1]], pa.int64()), "closed": pa.array([walker.closed], pa.int64())}
            columns |= {"base": pa.array([walker.base], pa.string()), "opened": pa.array([walker.frames], _FRAMES)}
            yield pa.RecordBatch.from_pydict(columns)
            walker = None


_PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("ord", pa.int64()), ("section", pa.string()), ("element", pa.bool_()), ("part", pa.string()), ("text", pa.string())])
_PIECES_DDL = "path string, start bigint, ord bigint, section string, element boolean, part string, text string"


def _pieces(batches: Iterator[pa.RecordBatch], inside: dict, open_at: dict) -> Iterator[pa.RecordBatch]:
    """Members and elements; `part` tells a whole one from the head and tail of
    a range, and from a middle that spans one."""
    walker, rows, held, first, order = None, [], [], True, 0

    def row(at: tuple[str, int], last: bool) -> None:
        nonlocal held, first, order
        part = ("middle" if last else "head") if first else ("tail" if last else "whole")
        frames = walker.frames
        element = len(frames) > 1 and frames[1][0] == "["
        rows.append({"path": at[0], "start": at[1], "ord": order, "section": frames[0][1] if frames else None, "element": element, "part": part, "text": "".join(held)})
        held, first, order = [], False, order + 1

    for at, ends, text in _ranges(batches):
        walker = walker or Walker(inside[at], open_at[at])
        for token, before in walker.feed(text, ends):
            held.append(before)
            depth = len(walker.frames)
            in_list = depth > 1 and walker.frames[1][0] == "["
            border = (token == "," and (depth == 1 or (depth == 2 and in_list))) or (
                token in "}]" and (depth == 1 or (depth == 2 and in_list))
            )
            if border:
                row(at, False)
            elif token in "{[" and (depth == 0 or (depth == 1 and token == "[")):
                held, first = [], False  # a document or a list begins
            elif token[0] == '"':
                held = [] if depth == 1 else [*held, token, ":"]
                first = first and depth != 1
            else:
                held.append(token)
            walker.move(token)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, _PIECES)
                rows = []
            if len(held) > 4096:
                held = ["".join(held)]
        if ends:
            held.append(walker.rest)
            row(at, True)
            walker, held, first, order = None, [], True, 0
    yield pa.RecordBatch.from_pylist(rows, _PIECES)


def document_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Members of the documents at a path and the elements of their lists, one
    row each: path, start and ord (their order), section (the member's name),
    element, text (JSON).  An empty list has one element without text.  Names
    hold no commas.

    Lists keep their elements' order by (start, ord).  The text is read three
    times, now for the states of its ranges and later for the rows.
    """
    text = spark.read.text(path, lineSep=",").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text")
    )
    counted = sorted(map(tuple, text.mapInArrow(_quotes, "path string, start bigint, quotes bigint").collect()))  # one row a range
    inside, odd, file = {}, False, None
    for name, start, quotes in counted:
        odd = odd if name == file else False
        inside[name, start], odd, file = odd, odd ^ (quotes % 2 == 1), name
    shape = "path string, start bigint, closed bigint, base string, opened array<array<string>>"
    found = text.mapInArrow(lambda batches: _brackets(batches, inside), shape).collect()  # one row a range
    open_at, frames, file = {}, [], None
    for row in sorted(found, key=lambda r: (r.path, r.start)):
        frames = frames if row.path == file else []
        open_at[row.path, row.start], file = frames, row.path
        frames = after(frames, row.closed, row.base, row.opened)
    return _joined(text.mapInArrow(lambda batches: _pieces(batches, inside, open_at), _PIECES_DDL))


def _joined(rows: DataFrame) -> DataFrame:
    """Whole pieces, and those whose parts lie in several ranges: a tail, and what
    follows up to the next tail.  There are two parts a range."""
    whole = rows.where(F.col("part") == "whole").drop("part")
    order = Window.partitionBy("path").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.where(F.col("part") != "whole").withColumn("group", F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("start", "ord", "section", "element", "text")))
    over = parts.where("group > 0").groupBy("path", "group").agg(pieces.alias("parts"))
    first = F.element_at("parts", F.lit(1))
    over = over.select(
        "path",
        *[first[name].alias(name) for name in ("start", "ord", "section", "element")],
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )
    every = whole.unionByName(over).withColumn("text", F.regexp_replace("text", r"\A\s+|\s+\z", ""))
    # Text that is empty is what stands in an empty list, or behind any list.
    return every.where(((F.col("text") != "") | F.col("element")) & F.col("section").isNotNull())


def read_run_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved runs of any size, one document a file: the runs in the shape of
    RUN_DOCUMENT, their file records, and their warnings (run_id, warning)."""
    every = document_pieces(spark, path)
    pieces = every.where(F.col("text") != "")
    large = F.col("section").isin(*_FILE_LISTS, "warnings")
    small = every.where(~large)
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("start", "ord", "text"))))
    member = F.array_join(F.transform(ordered, lambda p: p["text"]), ",")
    members = small.groupBy("path", "section").agg(F.bool_or("element").alias("listed"), member.alias("text"))
    value = F.when(F.col("listed"), F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    members = members.select("path", F.concat(F.lit('"'), "section", F.lit('": '), value).alias("member"))
    documents = members.groupBy("path").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("member"), ", "), F.lit("}")).alias("text"))
    parsed = documents.select("path", F.from_json("text", RUN_DOCUMENT).alias("run"))
    ids = parsed.select("path", F.col("run.tool.run_id").alias("run_id"))
    files = pieces.where(F.col("section").isin(_FILE_LISTS) & F.col("element")).select("path", F.from_json("text", FILE_ROW).alias("f"))
    warnings = pieces.where((F.col("section") == "warnings") & F.col("element"))
    records = files.withColumnRenamed("path", "document").join(ids, F.col("document") == F.col("path"))
    return (
        parsed.select("run.*"),
        records.select(
            "run_id",
            "f.path",
            "f.relative_path",
            from_json_name(F.col("f.language")).alias("language"),
            "f.size_bytes",
            "f.detected_encoding",
            F.col("f.raw_line_categories").alias("raw"),
            F.col("f.effective_counts").alias("effective"),
            "f.status",
            "f.warnings",
            "f.generated",
            "f.minified",
            "f.vendor",
            "f.parse_mode",
            "f.submodule",
        ),
        warnings.join(ids, "path").select("run_id", F.get_json_object(F.concat(F.lit("["), "text", F.lit("]")), "$[0]").alias("warning")),
    )
