"""Delimited text in parts, as a Spark data source.

Reading is a chain of stages: a source lists files and cuts them into ranges of bytes, a filter
undoes their compression, a parser turns lines into typed columns, and lines that it can't take
become rejects.  Writing gives one file a task; only a commit makes these part of the table.

    register(spark)
    edges.write.format("delimited_parts").option("codec", "gz").mode("append").save(path)
    spark.read.format("delimited_parts").schema("from_node bigint, to_node bigint").load(path)

Options: ``sep`` (tab), ``null`` (text of a null, \\N), ``on_error`` (fail, drop or keep), ``rejects``
(the column that keeps rejected lines, "rejected"), ``split_bytes`` (64 MiB a range at most),
``codec`` when writing (none, gz, bz2 or zst).  Paths are those that Arrow's file systems know.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains,
    StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "delimited_parts"
MANIFEST = "_manifest.json"
CODECS = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}
CHUNK = 4 << 20


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/[^/]", path):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


# ---- source: files and ranges of bytes ----


@dataclass
class Range(InputPartition):
    """Lines that start in [start, end) of a file; all of it where ``end`` is None."""

    path: str
    start: int = 0
    end: int | None = None


def codec_of(path: str) -> str | None:
    return CODECS.get(path.rsplit(".", 1)[-1])


def read_manifest(files: pafs.FileSystem, root: str) -> list[dict] | None:
    """The files that commits have made part of the table; None where nothing was committed."""
    at = f"{root}/{MANIFEST}"
    if files.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(at) as f:
        return json.loads(f.read())["files"]


def ranges_of(files: pafs.FileSystem, root: str, split_bytes: int, may_hold=lambda stats: True) -> list[Range]:
    """The ranges of a table or a single file.  A folder with a manifest has the files it lists,
    less those whose statistics rule them out; another folder has all but hidden ones."""
    info = files.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == pafs.FileType.File:
        found = [(root, info.size)]
    elif (listed := read_manifest(files, root)) is not None:
        found = [(f"{root}/{f['name']}", f["bytes"]) for f in listed if may_hold(f)]
    else:
        every = files.get_file_info(pafs.FileSelector(root, recursive=True))
        found = [(f.path, f.size) for f in every if f.type == pafs.FileType.File and not any(p[0] in "._" for p in f.path[len(root) :].strip("/").split("/"))]
    out = []
    for path, size in sorted(found):
        if codec_of(path):
            out.append(Range(path))
        else:
            out += [Range(path, a, min(size, a + split_bytes)) for a in range(0, size, split_bytes)]
    return out


# ---- filter: bytes to lines ----


def lines_of(files: pafs.FileSystem, part: Range) -> Iterator[list[bytes]]:
    """Lists of lines, whatever their file's compression.  A line belongs to the range that it
    starts in; a range reads on until its last line ends."""
    end, at, rest = part.end, part.start, b""
    if end is None:
        stream = files.open_input_stream(part.path, compression=codec_of(part.path))
    else:
        stream = files.open_input_file(part.path)
    # whether the first line is still to be passed over: it starts in the range before, unless the
    # byte before this range ends one
    skip = at > 0
    if skip:
        at -= 1
        stream.seek(at)
    with stream:
        while chunk := stream.read(CHUNK):
            rest += chunk
            if skip:
                cut = rest.find(b"\n")
                if cut < 0:
                    at, rest = at + len(rest), b""
                    continue
                at, rest, skip = at + cut + 1, rest[cut + 1 :], False
            # ``rest`` begins where a line does, at ``at``
            if end is not None and at >= end:
                return
            if end is not None and at + len(rest) > end:
                cut = rest.find(b"\n", end - at - 1)
                if cut >= 0:
                    yield rest[:cut].split(b"\n")
                    return
                continue
            cut = rest.rfind(b"\n")
            if cut >= 0:
                yield rest[:cut].split(b"\n")
                at, rest = at + cut + 1, rest[cut + 1 :]
        if rest and not skip and (end is None or at < end):
            yield rest.split(b"\n")


# ---- parser: lines to columns, and rejects ----

#: Texts that a cast is sure to take; others are tried one by one.
SURE = {
    pa.int64(): r"^-?[0-9]{1,18}$", pa.int32(): r"^-?[0-9]{1,9}$", pa.int16(): r"^-?[0-9]{1,4}$", pa.int8(): r"^-?[0-9]{1,2}$",
    pa.float64(): r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", pa.float32(): r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
}


def _one(text: str, kind: pa.DataType):
    try:
        return pa.scalar(text).cast(kind).as_py()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None


def converted(texts: pa.Array, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """(values, wrong): ``texts`` as ``kind``, null where a text is null or no value of that kind."""
    if pa.types.is_string(kind):
        return texts, pa.nulls(len(texts), pa.bool_()).fill_null(False)
    sure = pc.fill_null(pc.match_substring_regex(texts, SURE[kind]), False) if kind in SURE else pa.nulls(len(texts), pa.bool_()).fill_null(False)
    values = pc.if_else(sure, texts, pa.scalar(None, pa.string())).cast(kind)
    doubt = pc.and_(pc.invert(sure), pc.is_valid(texts))
    if pc.any(doubt).as_py():
        tried = [_one(t, kind) if d else None for t, d in zip(texts.to_pylist(), doubt.to_pylist(), strict=True)]
        values = pc.if_else(doubt, pa.array(tried, kind), values)
    return values, pc.and_(doubt, pc.is_null(values))


@dataclass
class Parser:
    """Lines to record batches of ``schema``; ``rejects`` is a column of it where lines are kept."""

    schema: pa.Schema
    sep: str
    null: str
    on_error: str
    rejects: str

    def __call__(self, lines: list[bytes], where: str = "") -> pa.RecordBatch:
        if len(self.schema) - (self.on_error == "keep") > 1:
            lines = [x for x in lines if x.strip()]  # an empty line is a row of a single column only
        texts = [x.decode("utf-8", "replace").removesuffix("\r") for x in lines]
        broken = [i for i, (x, t) in enumerate(zip(lines, texts, strict=True)) if "�" in t and "�".encode() not in x]
        column = pa.array(texts, pa.string())
        names = [n for n in self.schema.names if not (self.on_error == "keep" and n == self.rejects)]
        fields = pc.split_pattern(column, self.sep)
        good = pc.equal(pc.list_value_length(fields), len(names))
        if broken:
            bad = set(broken)
            good = pc.and_(good, pa.array([i not in bad for i in range(len(lines))]))
        kept = fields.filter(good)
        columns, wrong = {}, pa.array([False] * len(kept))
        for j, name in enumerate(names):
            value = pc.list_element(kept, j) if len(kept) else pa.array([], pa.string())
            value = pc.if_else(pc.equal(value, self.null), pa.scalar(None, pa.string()), value)
            columns[name], odd = converted(value, self.schema.field(name).type)
            wrong = pc.or_(wrong, odd)
        ok = pc.invert(wrong)
        lost = pa.concat_arrays([column.filter(pc.invert(good)), column.filter(good).filter(wrong)])
        if self.on_error == "fail" and len(lost):
            raise ValueError(f"{where}: no row of {', '.join(f'{f.name} {f.type}' for f in self.schema)}: {lost[0].as_py()!r:.200}")
        columns = {n: c.filter(ok) for n, c in columns.items()}
        if self.on_error == "keep":
            n = len(lost)
            whole = len(columns[names[0]]) if names else 0
            columns = {k: pa.concat_arrays([c, pa.nulls(n, c.type)]) for k, c in columns.items()}
            columns[self.rejects] = pa.concat_arrays([pa.nulls(whole, pa.string()), lost])
        return pa.RecordBatch.from_arrays([columns[n] for n in self.schema.names], schema=self.schema)


# ---- pushed filters ----

COMPARED = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}
ON_TEXT = {StringStartsWith: "starts_with", StringEndsWith: "ends_with", StringContains: "match_substring"}


def takes(f: Filter, names: Iterable[str]) -> bool:
    """Whether :func:`mask` can decide a filter."""
    if isinstance(f, Not):
        return takes(f.child, names)
    return isinstance(f, (*COMPARED, *ON_TEXT, EqualNullSafe, In, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in names


def mask(f: Filter, batch: pa.RecordBatch) -> pa.Array:
    """Where a filter holds; null where it is unknown."""
    if isinstance(f, Not):
        return pc.invert(mask(f.child, batch))
    column = batch.column(batch.schema.get_field_index(f.attribute[0]))
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        found = pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
        return pc.if_else(pc.is_valid(column), found, pa.scalar(None, pa.bool_()))
    if isinstance(f, EqualNullSafe):
        return pc.is_null(column) if f.value is None else pc.fill_null(pc.equal(column, pa.scalar(f.value, column.type)), False)
    if type(f) in ON_TEXT:
        return getattr(pc, ON_TEXT[type(f)])(column, f.value)
    return getattr(pc, COMPARED[type(f)])(column, pa.scalar(f.value, column.type))


def rules_out(f: Filter, stats: dict) -> bool:
    """Whether a file's least and greatest values leave a filter no row."""
    if not isinstance(f, (*COMPARED, In)) or len(f.attribute) != 1:
        return False
    name = f.attribute[0]
    if name not in stats["low"]:
        return False
    low, high = stats["low"][name], stats["high"][name]
    if low is None:
        return True  # nothing but nulls
    values = [v for v in f.value if v is not None] if isinstance(f, In) else [f.value]
    if not all(isinstance(v, type(low)) for v in values):
        return False
    if isinstance(f, GreaterThan):
        return high <= values[0]
    if isinstance(f, GreaterThanOrEqual):
        return high < values[0]
    if isinstance(f, LessThan):
        return low >= values[0]
    if isinstance(f, LessThanOrEqual):
        return low > values[0]
    return all(v < low or v > high for v in values)


class PartsReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], to_arrow_schema(schema)
        self.split = int(options.get("split_bytes", 64 << 20))
        self.parser = Parser(self.schema, options.get("sep", "\t"), options.get("null", "\\N"), options.get("on_error", "fail"), options.get("rejects", "rejected"))
        if self.parser.on_error not in ("fail", "drop", "keep"):
            raise ValueError(f"on_error {self.parser.on_error!r} is none of 'fail', 'drop', 'keep'")
        if self.parser.on_error == "keep" and self.parser.rejects not in self.schema.names:
            raise ValueError(f"on_error 'keep' needs a column {self.parser.rejects!r} in the schema")
        if self.split < 1:
            raise ValueError("split_bytes must be at least 1")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if takes(f, self.schema.names):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        files, root = store(self.path)
        # statistics leave out rejects, which are null in every column
        ranges = ranges_of(files, root, self.split, lambda stats: not any(rules_out(f, stats) for f in self.filters))
        return ranges or [Range("")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        files, _ = store(self.path)
        for lines in lines_of(files, part):
            batch = self.parser(lines, part.path)
            for f in self.filters:
                batch = batch.filter(pc.fill_null(mask(f, batch), False))
            if batch.num_rows:
                yield batch


# ---- writing ----


@dataclass
class Written(WriterCommitMessage):
    """A task's file, not part of the table before the commit."""

    name: str | None = None
    rows: int = 0
    bytes: int = 0
    low: dict = field(default_factory=dict)
    high: dict = field(default_factory=dict)


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.sep, self.null, self.codec = options.get("sep", "\t"), options.get("null", "\\N"), options.get("codec", "none")
        if self.codec not in ("none", *CODECS):
            raise ValueError(f"codec {self.codec!r} is none of none, {', '.join(CODECS)}")

    def _text(self, column: pa.Array, name: str) -> pa.Array:
        if pa.types.is_nested(column.type):
            raise TypeError(f"column {name} is {column.type}, which has no place in delimited text")
        text = column.cast(pa.string())
        odd = pc.match_substring_regex(text, f"[\n\r]|{re.escape(self.sep)}")
        if pc.any(pc.or_(odd, pc.equal(text, self.null))).as_py():
            raise ValueError(f"column {name} has a text with a separator or a line end in it, or that reads as null")
        return text

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.path)
        done, out = Written(), None
        name = f"part-{uuid.uuid4().hex}.txt" + (f".{self.codec}" if self.codec != "none" else "")
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    files.create_dir(root, recursive=True)
                    done.name, out = name, files.open_output_stream(f"{root}/{name}", compression=CODECS.get(self.codec))
                texts = [self._text(c, n) for n, c in zip(batch.schema.names, batch.columns, strict=True)]
                lines = pc.binary_join_element_wise(*texts, self.sep, null_handling="replace", null_replacement=self.null)
                out.write(("\n".join(lines.to_pylist()) + "\n").encode())
                done.rows += batch.num_rows
                for n, c in zip(batch.schema.names, batch.columns, strict=True):
                    if pa.types.is_integer(c.type) or pa.types.is_string(c.type):
                        ends = pc.min_max(c)
                        for kept, end, better in ((done.low, ends["min"].as_py(), min), (done.high, ends["max"].as_py(), max)):
                            kept[n] = end if kept.get(n) is None else kept[n] if end is None else better(kept[n], end)
            if out is not None:
                out.close()
                done.bytes = files.get_file_info(f"{root}/{name}").size
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(f"{root}/{name}")
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Make the tasks' files the table's: one new manifest, moved into place at once."""
        files, root = store(self.path)
        files.create_dir(root, recursive=True)
        before = read_manifest(files, root) or []
        now = [{"name": m.name, "rows": m.rows, "bytes": m.bytes, "low": m.low, "high": m.high} for m in messages if m is not None and m.name]
        draft = f"{root}/_{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(json.dumps({"files": now if self.overwrite else before + now}).encode())
        files.move(draft, f"{root}/{MANIFEST}")
        for f in before if self.overwrite else ():
            files.delete_file(f"{root}/{f['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of the tasks' files stays."""
        files, root = store(self.path)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{root}/{m.name}")


class DelimitedParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError(f"{NAME} needs a schema: spark.read.format({NAME!r}).schema(...)")

    def reader(self, schema: T.StructType) -> PartsReader:
        return PartsReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PartsWriter:
        return PartsWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach its readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DelimitedParts)
