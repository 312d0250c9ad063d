"""LAS 1.2, point format 3, with extra dimensions: what the merged predictions are handed on as."""

from __future__ import annotations

import struct

import numpy as np

#: Record of point format 3 (fixed by the format).
POINT = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("time", "<f8"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
#: Extra dimensions and their types' numbers in the format: 6 signed 32 bits, 9 float.
EXTRA = [("semantic_pred", "<i4", 6), ("instance_pred", "<i4", 6), ("score", "<f4", 9), ("semantic_gt", "<i4", 6), ("instance_gt", "<i4", 6)]
SCALE = 0.001


def write_las(path: str, columns: dict, offset: tuple[float, float, float]) -> None:
    with open(path, "wb") as f:
        f.write(las_bytes(columns, offset))


def las_bytes(columns: dict, offset: tuple[float, float, float]) -> bytes:
    """A whole file. columns: x, y, z and the extra dimensions, as arrays; the file's offset is the scan's, rounded down."""
    n = len(columns["x"])
    base = np.floor(offset)
    data = np.zeros(n, POINT + [(name, kind) for name, kind, _ in EXTRA])
    for axis, name, o in zip("XYZ", "xyz", base):
        data[axis] = np.round((np.asarray(columns[name], float) - o) / SCALE)
    for name, _, _ in EXTRA:
        data[name] = columns[name]
    body = b"".join(struct.pack("<2sBB32s4s24s24s24s24s24s32s", b"", number, 0, name.encode(), b"", b"", b"", b"", b"", b"", b"") for name, _, number in EXTRA)
    record = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"extra bytes") + body
    low, high = ([float(f(columns[a])) if n else 0.0 for a in "xyz"] for f in (np.min, np.max))
    head = struct.pack(
        "<4sHHIHH8sBB32s32sHHHIIBHI5I3d3d6d", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"stemline", b"stemline", 1, 1, 227, 227 + len(record), 1, 3, data.itemsize, n, n, 0, 0, 0, 0, *[SCALE] * 3, *base,
        high[0], low[0], high[1], low[1], high[2], low[2],
    )
    return head + record + data.tobytes()


def read_las(path: str) -> dict:
    """x, y, z and all extra dimensions that write_las() knows."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    at, = struct.unpack_from("<I", raw, 96)
    form, size, n = struct.unpack_from("<BHI", raw, 104)
    scale, offset = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    kind = np.dtype(POINT + [(name, k) for name, k, _ in EXTRA])
    if form & 0x3F != 3 or size != kind.itemsize:
        raise ValueError("not point format 3 with these extra dimensions")
    data = np.frombuffer(raw, kind, n, at)
    return {a: data[a.upper()] * s + o for a, s, o in zip("xyz", scale, offset)} | {name: data[name] for name, _, _ in EXTRA}


#: Fields behind the common ones of each point format (fixed by the format), and sizes of extra dimensions' types by number.
_MORE = {0: [], 1: POINT[9:10], 2: POINT[10:], 3: POINT[9:]}
_SIXTH = [*POINT[:4], ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]
_MORE_SIXTH = {6: [], 7: POINT[10:], 8: [*POINT[10:], ("nir", "<u2")]}
_EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}


def layout(head: bytes) -> tuple[int, int, np.dtype, tuple, tuple]:
    """(offset of the points, their number, record, scales, offsets) from a file's bytes up to its points: formats 0 to 3 and 6 to 8, with any extra dimensions."""
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    size_of_head, at, records = struct.unpack_from("<HII", head, 94)
    form, size, n = struct.unpack_from("<BHI", head, 104)
    form &= 0x3F
    if head[25] >= 4 and size_of_head >= 255 and not n:
        n = struct.unpack_from("<Q", head, 247)[0]
    if form not in _MORE and form not in _MORE_SIXTH:
        raise ValueError(f"point format {form} is not known")
    fields = [*POINT[:9], *_MORE[form]] if form in _MORE else [*_SIXTH, *_MORE_SIXTH[form]]
    place = size_of_head
    for _ in range(records):
        _, user, number, length, _ = struct.unpack_from("<H16sHH32s", head, place)
        if user.rstrip(b"\0") == b"LASF_Spec" and number == 4:
            for k in range(place + 54, place + 54 + length, 192):
                _, kind, _, name = struct.unpack_from("<2sBB32s", head, k)
                fields.append((name.rstrip(b"\0").decode(), _EXTRA_TYPES.get(kind, "u1")))
        place += 54 + length
    kind = np.dtype(fields)
    if kind.itemsize < size:
        kind = np.dtype([*fields, ("_rest", f"V{size - kind.itemsize}")])
    return at, n, kind, struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)


def read_scans(spark, path: str, rows: int = 1_000_000):
    """(scan_id, point_id, x, y, z, and the files' extra dimensions) of LAS files, ranges of `rows` points a task; the first file names the extra dimensions."""
    import posixpath

    import pyarrow as pa

    from stemline.sources.store import listing, store

    files = listing(path, "*.las")
    if not files:
        raise FileNotFoundError(f"no LAS files at {path}")

    def headed(name: str):
        with store(path)[0].open_input_file(name) as f:
            first = f.read(375)
            return layout(first + f.read(max(0, struct.unpack_from("<I", first, 96)[0] - len(first))))

    known = {x for x, *_ in (*POINT, *_SIXTH, ("nir",), ("_rest",))}
    parts, extra = [], []
    for name in files:
        _, n, kind, _, _ = headed(name)
        extra = extra or [(f, kind[f]) for f in kind.names if f not in known]
        parts += [(name, k, min(rows, n - k)) for k in range(0, max(n, 1), rows)]
    spark_types = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "u8": "bigint", "f4": "float", "f8": "double"}
    schema = ", ".join(["scan_id string, point_id bigint, x double, y double, z double", *(f"`{f}` {spark_types[k.str[1:]]}" for f, k in extra)])
    arrow_types = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            for name, first, count in zip(*(batch[c].to_pylist() for c in ("name", "first", "count"))):
                at, _, kind, scale, offset = headed(name)
                with store(path)[0].open_input_file(name) as f:
                    data = np.frombuffer(f.read_at(count * kind.itemsize, at + first * kind.itemsize), kind)
                if len(data) < count:
                    raise ValueError(f"{name} ends early")
                for k in range(0, count, 50_000):
                    some = data[k : k + 50_000]
                    columns = [pa.array([posixpath.basename(name).removesuffix(".las")] * len(some)), pa.array(np.arange(first + k, first + k + len(some)))]
                    columns += [pa.array(some[a] * s + o) for a, s, o in zip("XYZ", scale, offset)]
                    for e, t in extra:
                        kind_of = arrow_types[spark_types[t.str[1:]]]
                        columns.append(pa.array(some[e].astype(kind_of.to_pandas_dtype()), kind_of) if e in kind.names else pa.nulls(len(some), kind_of))
                    yield pa.RecordBatch.from_arrays(columns, names=["scan_id", "point_id", "x", "y", "z", *(e for e, _ in extra)])

    listed = spark.createDataFrame(parts, "name string, first bigint, count bigint")
    return listed.repartition(min(len(parts), 10_000)).mapInArrow(run, schema)


def write_scans(df, folder: str) -> None:
    """A LAS file for each scan of df(scan_id, x, y, z, ox, oy, oz, extra dimensions), to a folder that driver and executors share; written under a temporary name first."""
    import uuid

    from stemline.sources.store import store

    system, to = store(folder)
    system.create_dir(to, recursive=True)

    def run(pdf):
        import pandas as pd

        files, at = store(folder)
        name = f"{at}/{pdf['scan_id'].iloc[0]}.las"
        temp = f"{at}/.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(temp) as f:
            f.write(las_bytes({c: pdf[c].to_numpy() for c in ("x", "y", "z", *(e[0] for e in EXTRA))}, tuple(pdf[["ox", "oy", "oz"]].iloc[0])))
        files.move(temp, name)
        return pd.DataFrame({"path": [name]})

    df.groupBy("scan_id").applyInPandas(run, "path string").write.format("noop").mode("overwrite").save()
