"""PLY files as a Spark data source: spark.read.format("ply"), df.write.format("ply").

Reading: ASCII or binary of either byte order; option element = vertex (default) or face. The schema comes from the first file's header;
scan_id (the file's name) and point_id (the row's place) come before the properties. A binary file is cut into ranges of
rows, so that one large scan is many tasks'. Writing: a file a task, or with option by = column, a file for each
of its values within the task; option ascii = true.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from stemline.sources.store import listing, store

#: Property types of the format (fixed values): name, numpy code.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
#: Unsigned types widen by one step.
_SPARK = {"i1": ByteType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "f4": FloatType(), "f8": DoubleType()}
_NAMES = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "int", "float": "float", "double": "double"}
#: Rows of a binary file that one task reads.
ROWS = 4_000_000


class PlyError(ValueError):
    """A file that isn't PLY, or a property type that the format doesn't have."""


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str, str | None]]  # name, type, type of a list's length


@dataclass
class Header:
    order: str  # "<", ">" or "a" for ASCII
    elements: list[Element]
    size: int

    def element(self, name: str) -> Element:
        for e in self.elements:
            if e.name == name:
                return e
        raise PlyError(f"no element {name}")


def read_header(f) -> Header:
    if f.readline().strip() != b"ply":
        raise PlyError("the file does not start with ply")
    order, elements = "", []
    while True:
        line = f.readline()
        if not line:
            raise PlyError("the header does not end")
        words = line.decode("ascii", "replace").split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            order = {"ascii": "a", "binary_little_endian": "<", "binary_big_endian": ">"}.get(words[1], "")
        elif words[0] == "element":
            elements.append(Element(words[1], int(words[2]), []))
        elif words[0] == "property":
            kinds = words[2:4] if words[1] == "list" else words[1:2]
            if any(k not in TYPES for k in kinds):
                raise PlyError(f"unknown property type in: {' '.join(words)}")
            elements[-1].properties.append((words[-1], TYPES[kinds[-1]], TYPES[kinds[0]] if words[1] == "list" else None))
        elif words[0] == "end_header":
            break
    if not order:
        raise PlyError("unknown format")
    return Header(order, elements, f.tell())


def _files(path: str) -> list[str]:
    found = listing(path, "*.ply")
    if not found:
        raise FileNotFoundError(f"no PLY files at {path}")
    return found


def _opened(uri: str, path: str) -> io.BufferedReader:
    """A file of the file system that uri is on."""
    return io.BufferedReader(store(uri)[0].open_input_file(path))


def row_type(e: Element, order: str) -> np.dtype:
    return np.dtype([(n, ("" if order == "a" else order) + t) for n, t, _ in e.properties])


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    count: int


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def _element(self) -> str:
        return self.options.get("element", "vertex")

    def schema(self) -> StructType:
        with _opened(self.options["path"], _files(self.options["path"])[0]) as f:
            e = read_header(f).element(self._element())
        fields = [StructField("scan_id", StringType()), StructField("point_id", LongType())]
        return StructType([*fields, *(StructField(n, ArrayType(_SPARK[t]) if length else _SPARK[t]) for n, t, length in e.properties)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(self.options["path"], self._element(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PlyWriter(self.options["path"], schema, self.options.get("by"), self.options.get("ascii", "false") == "true", overwrite)


class PlyReader(DataSourceReader):
    def __init__(self, path: str, element: str, schema: StructType):
        self.path, self.element, self.schema = path, element, schema

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            with _opened(self.path, path) as f:
                h = read_header(f)
            e = h.element(self.element)
            whole = h.order == "a" or any(x for p in h.elements[: h.elements.index(e) + 1] for _, _, x in p.properties)
            out += [Rows(path, 0, e.count)] if whole else [Rows(path, k, min(ROWS, e.count - k)) for k in range(0, max(e.count, 1), ROWS)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        import pyspark.sql.pandas.types as types

        with _opened(self.path, part.path) as f:
            h = read_header(f)
            e = h.element(self.element)
            columns = self._ascii(f, h, e) if h.order == "a" else self._binary(f, h, e, part)
        name = posixpath.basename(part.path).removesuffix(".ply")
        n = part.count
        columns = {"scan_id": [name] * n, "point_id": np.arange(part.first, part.first + n)} | columns
        schema = types.to_arrow_schema(self.schema)
        yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) if x.name in columns else pa.nulls(n, x.type) for x in schema], schema=schema)

    def _binary(self, f, h: Header, e: Element, part: Rows) -> dict:
        for x in h.elements:
            if x is e:
                break
            if any(length for _, _, length in x.properties):
                self._lists(f, h.order, x)
            else:
                f.seek(x.count * row_type(x, h.order).itemsize, 1)
        if any(length for _, _, length in e.properties):
            return self._lists(f, h.order, e)
        kind = row_type(e, h.order)
        f.seek(part.first * kind.itemsize, 1)
        rows = np.frombuffer(f.read(part.count * kind.itemsize), kind)
        if len(rows) < part.count:
            raise PlyError(f"{part.path} ends early")
        return {n: rows[n].astype(rows[n].dtype.newbyteorder("=")) for n in kind.names}

    @staticmethod
    def _lists(f, order: str, e: Element) -> dict:
        out: dict = {n: [] for n, _, _ in e.properties}
        for _ in range(e.count):
            for n, t, length in e.properties:
                size = int(np.frombuffer(f.read(np.dtype(length).itemsize), order + length)[0]) if length else 1
                values = np.frombuffer(f.read(size * np.dtype(t).itemsize), order + t)
                out[n].append(values.tolist() if length else values[0].item())
        return out

    @staticmethod
    def _ascii(f, h: Header, e: Element) -> dict:
        for x in h.elements:
            if x is e:
                break
            for _ in range(x.count):
                f.readline()
        out: dict = {n: [] for n, _, _ in e.properties}
        for _ in range(e.count):
            words = f.readline().split()
            for n, t, length in e.properties:
                cast = float if t[0] == "f" else int
                if length:
                    size, words = int(words[0]), words[1:]
                    out[n].append([cast(w) for w in words[:size]])
                    words = words[size:]
                else:
                    out[n].append(cast(words[0]))
                    words = words[1:]
        return out


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]


class PlyWriter(DataSourceWriter):
    """One file for each value of `by`, whatever tasks hold its rows, or one a task.

    A task keeps its rows as packed records and writes a part for each value; on commit a value's only part gets its name, and
    several are laid end to end behind one header, a block at a time.
    """

    def __init__(self, path: str, schema: StructType, by: str | None, ascii_: bool, overwrite: bool):
        self.path, self.by, self.ascii, self.overwrite = path, by, ascii_, overwrite
        self.names = [x.name for x in schema.fields if x.name != by]
        kinds = {x.name: x.dataType.simpleString() for x in schema.fields}
        wrong = [n for n in self.names if kinds[n] not in _NAMES]
        if wrong:
            raise PlyError(f"PLY has no type for {', '.join(wrong)}")
        self.kinds = [_NAMES[kinds[n]] for n in self.names]

    def write(self, rows) -> WriterCommitMessage:
        packed = np.dtype([(n, "<" + TYPES[k]) for n, k in zip(self.names, self.kinds)])
        groups: dict = {}
        for r in rows:
            some, chunks = groups.setdefault(r[self.by] if self.by else None, ([], []))
            some.append(tuple(r[n] for n in self.names))
            if len(some) == 10_000:
                chunks.append(np.array(some, packed))
                some.clear()
        system, to = store(self.path)
        system.create_dir(to, recursive=True)
        files = []
        for key, (some, chunks) in groups.items():
            stem = str(key) if self.by else f"part-{uuid.uuid4().hex[:12]}"
            data = np.concatenate([*chunks, np.array(some, packed)])
            temp = f"{to}/.{stem}-{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(temp) as f:
                f.write(_body(data, self.ascii))
            files.append((stem, temp, len(data)))
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, to = store(self.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(to, allow_not_found=True)):
                if old.type == fs.FileType.File and old.path.endswith(".ply"):
                    system.delete_file(old.path)
        parts: dict[str, list] = {}
        for m in messages:
            for stem, temp, n in m.files if m else ():
                parts.setdefault(stem, []).append((temp, n))
        for stem, some in parts.items():
            whole = f"{to}/.{stem}-{uuid.uuid4().hex}.whole"
            with system.open_output_stream(whole) as out:
                out.write(_head(self.names, self.kinds, sum(n for _, n in some), self.ascii))
                for temp, _ in some:
                    with system.open_input_stream(temp) as part:
                        while block := part.read(8 << 20):
                            out.write(block)
            system.move(whole, f"{to}/{stem}.ply")
            for temp, _ in some:
                system.delete_file(temp)

    def abort(self, messages) -> None:
        system, _ = store(self.path)
        for m in messages:
            for _, temp, _ in m.files if m else ():
                system.delete_file(temp)


def _head(names: list[str], kinds: list[str], rows: int, ascii_: bool, faces: int | None = None) -> bytes:
    head = ["ply", f"format {'ascii' if ascii_ else 'binary_little_endian'} 1.0", f"element vertex {rows}", *(f"property {k} {n}" for n, k in zip(names, kinds))]
    if faces is not None:
        head += [f"element face {faces}", "property list uchar int vertex_indices"]
    return ("\n".join([*head, "end_header"]) + "\n").encode()


def _body(data: np.ndarray, ascii_: bool) -> bytes:
    return "".join(" ".join(map(repr, r)) + "\n" for r in data.tolist()).encode() if ascii_ else data.tobytes()


def write_file(path: str, names: list[str], kinds: list[str], rows: list[tuple], ascii_: bool = False, faces=None) -> None:
    """One PLY file; faces: rows of vertex numbers."""
    data = np.array(rows, dtype=[(n, "<" + TYPES[k]) for n, k in zip(names, kinds)])
    system, to = store(path)
    with system.open_output_stream(to) as f:
        f.write(_head(names, kinds, len(data), ascii_, None if faces is None else len(faces)))
        f.write(_body(data, ascii_))
        for face in faces if faces is not None else ():
            f.write((f"{len(face)} {' '.join(map(str, face))}\n").encode() if ascii_ else np.uint8(len(face)).tobytes() + np.array(face, "<i4").tobytes())


def register(spark) -> None:
    spark.dataSource.register(PlySource)


def read_predictions(spark, path: str):
    """A folder of prediction files, or of leftovers without predictions, in one layout."""
    from pyspark.sql import functions as F

    df = spark.read.format("ply").load(path)
    base = ["scan_id", "point_id", "x", "y", "z"]
    if {"semantic_pred", "instance_pred", "score"} <= set(df.columns):
        gt = [F.col(c) if c in df.columns else F.lit(-1).alias(c) for c in ("semantic_gt", "instance_gt")]
        return df.select(*base, "semantic_pred", "instance_pred", "score", *gt)
    if {"semantic_seg", "treeID"} <= set(df.columns):
        s = F.col("semantic_seg").cast("int") - 1
        return df.select(*base, s.alias("semantic_pred"), F.lit(-1).alias("instance_pred"), F.lit(0.0).cast("float").alias("score"), s.alias("semantic_gt"), F.col("treeID").alias("instance_gt"))
    raise ValueError(f"neither predictions nor leftovers: {', '.join(df.columns)}")


def with_labels(df):
    """Constant labels where a scan has none."""
    from pyspark.sql import functions as F

    for name, value in (("semantic_seg", 1), ("treeID", 0)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df
