"""LAS files, versions 1.0 to 1.4, point formats 0 to 10, after the public ASPRS specification.

Compressed LAZ needs a LASzip codec: give one as the option "codec", the name of
a module with decode(file, header, first, count) -> bytes of plain records.
"""

from __future__ import annotations

import importlib
import itertools
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.schema import metadata
from .files import open_input, open_output

#: Points of one partition and Arrow batch.
CHUNK = 1 << 20

_XYZ = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
_OLD = [*_XYZ, ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("user_data", "u1"), ("source", "<u2")]
_NEW = [*_XYZ, ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps_time", "<f8")]
_TIME, _RGB, _NIR = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
_WAVE = [("wave", "V29")]
#: Fields of each point format, from the specification. Fixed values.
FORMATS = {
    0: _OLD,
    1: _OLD + _TIME,
    2: _OLD + _RGB,
    3: _OLD + _TIME + _RGB,
    4: _OLD + _TIME + _WAVE,
    5: _OLD + _TIME + _RGB + _WAVE,
    6: _NEW,
    7: _NEW + _RGB,
    8: _NEW + _RGB + _NIR,
    9: _NEW + _WAVE,
    10: _NEW + _RGB + _NIR + _WAVE,
}
_SIZES = {k: np.dtype(v).itemsize for k, v in FORMATS.items()}


@dataclass(frozen=True)
class Header:
    version: tuple[int, int]
    offset: int
    point_format: int
    record_length: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    compressed: bool

    @classmethod
    def read(cls, file) -> Header:
        head = file.read(375)
        if head[:4] != b"LASF":
            raise ValueError("no LAS file")
        version = head[24], head[25]
        (offset,) = struct.unpack_from("<I", head, 96)
        kind, length, count = struct.unpack_from("<BHI", head, 104)
        scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
        if version >= (1, 4):
            count = struct.unpack_from("<Q", head, 247)[0] or count
        made = cls(version, offset, kind & 0x3F, length, count, scale, shift, bool(kind & 0xC0))
        if made.point_format not in FORMATS or length < _SIZES[made.point_format]:
            raise ValueError(f"unknown point format {made.point_format} of {length} bytes")
        return made

    @property
    def extended(self) -> bool:
        return self.point_format >= 6

    def has(self, name: str) -> bool:
        return any(n == name for n, _ in FORMATS[self.point_format])

    def dtype(self) -> np.dtype:
        fields = list(FORMATS[self.point_format])
        if extra := self.record_length - _SIZES[self.point_format]:
            fields.append(("extra", f"V{extra}"))
        return np.dtype(fields)


def las_schema(header: Header) -> T.StructType:
    """Sixteen columns, then time, colour and near infrared where the format has them."""
    short, whole, flag = T.ShortType(), T.IntegerType(), T.BooleanType()
    fields = [T.StructField(a, T.DoubleType(), False, metadata(k, a)) for k, a in enumerate("xyz", 1)]
    plain = [("return_number", short), ("number_of_returns", short), ("is_synthetic", flag), ("is_key_point", flag), ("is_withheld", flag), ("is_overlap", flag)]
    plain += [("scanner_channel", short), ("is_edge_of_flight_line", flag), ("classification", short), ("user_data", short), ("scan_angle", T.FloatType()), ("point_source_id", whole)]
    fields.append(T.StructField("intensity", whole, True))
    fields += [T.StructField(n, t, False) for n, t in plain]
    if header.has("gps_time"):
        fields.append(T.StructField("gps_time", T.DoubleType(), False))
    fields += [T.StructField(n, whole, False) for n in ("red", "green", "blue", "nir") if header.has(n)]
    return T.StructType(fields)


def columns(raw: np.ndarray, h: Header) -> dict[str, np.ndarray]:
    """The columns of las_schema from records."""
    out = {a: raw[b] * s + o for a, b, s, o in zip("xyz", "XYZ", h.scale, h.shift)}
    out["intensity"] = raw["intensity"].astype(np.int32)
    flags = raw["flags"]
    if h.extended:
        out["return_number"], out["number_of_returns"] = raw["returns"] & 15, raw["returns"] >> 4
        bits = {"is_synthetic": flags & 1, "is_key_point": flags & 2, "is_withheld": flags & 4, "is_overlap": flags & 8, "is_edge_of_flight_line": flags & 128}
        out["scanner_channel"] = flags >> 4 & 3
        out["classification"], out["scan_angle"] = raw["class"], raw["angle"] * np.float32(0.006)
    else:
        kind = raw["class"]
        out["return_number"], out["number_of_returns"] = flags & 7, flags >> 3 & 7
        bits = {"is_synthetic": kind & 32, "is_key_point": kind & 64, "is_withheld": kind & 128, "is_overlap": (kind & 31) == 12, "is_edge_of_flight_line": flags & 128}
        out["scanner_channel"] = np.zeros(len(raw), np.uint8)
        out["classification"], out["scan_angle"] = kind & 31, raw["angle"].astype(np.float32)
    out |= {k: v.astype(bool) for k, v in bits.items()}
    out["user_data"], out["point_source_id"] = raw["user_data"], raw["source"]
    out |= {n: raw[n] for n in ("gps_time", "red", "green", "blue", "nir") if h.has(n)}
    return out


def read_records(path: str, h: Header, first: int, count: int, codec: str | None = None) -> np.ndarray:
    with open_input(path) as f:
        if h.compressed:
            if not codec:
                raise ValueError(f"{path} is compressed; give the option 'codec', the name of a module that decodes LAZ")
            raw = importlib.import_module(codec).decode(f, h, first, count)
        else:
            f.seek(h.offset + first * h.record_length)
            raw = f.read(count * h.record_length)
    return np.frombuffer(raw, h.dtype(), count)


@dataclass
class Split(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path, first, count):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


def paths_of(options: dict) -> list[str]:
    """Several paths in one option are parted by line feeds."""
    found = [p for p in (options.get("path") or "").split("\n") if p]
    if not found:
        raise ValueError("no path")
    return found


class LasReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.paths, self.codec = schema, paths_of(options), options.get("codec")

    def partitions(self):
        out = []
        for path in self.paths:
            with open_input(path) as f:
                h = Header.read(f)
            out += [Split(path, at, min(CHUNK, h.count - at)) for at in range(0, h.count, CHUNK)]
        return out or [Split(self.paths[0], 0, 0)]

    def read(self, split):
        from pyspark.sql.pandas.types import to_arrow_schema

        with open_input(split.path) as f:
            h = Header.read(f)
        if split.count:
            found, arrow = columns(read_records(split.path, h, split.first, split.count, self.codec), h), to_arrow_schema(self.schema)
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name]).cast(f.type) for f in arrow], schema=arrow)


class LasDataSource(DataSource):
    """spark.read.format("las").load(path): a partition for each CHUNK points; several paths must agree in schema."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> T.StructType:
        found = []
        for path in paths_of(self.options):
            with open_input(path) as f:
                found.append(las_schema(Header.read(f)))
        if any(s != found[0] for s in found):
            raise ValueError("files of different schemas")
        return found[0]

    def reader(self, schema: T.StructType) -> LasReader:
        return LasReader(schema, self.options)


def write_las(batches, path: str, point_format: int = 3, scale: float = 0.001, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> int:
    """Write Arrow batches with x, y, z and any other columns of las_schema as one LAS 1.2 or 1.4 file; returns the points."""
    new, fields = point_format >= 6, [f for f in FORMATS[point_format]]
    dtype, count = np.dtype(fields), 0
    low, high = np.full(3, np.inf), np.full(3, -np.inf)
    size = 375 if new else 227

    def header() -> bytes:
        h = bytearray(size)
        h[:4] = b"LASF"
        h[24:26] = bytes((1, 4 if new else 2))
        h[58:67] = b"cloudgrid"
        struct.pack_into("<HIIBHI", h, 94, size, size, 0, point_format, dtype.itemsize, 0 if new else count)
        box = [v for a, b in zip(high, low) for v in (a, b)] if count else [0.0] * 6
        struct.pack_into("<12d", h, 131, *[scale] * 3, *shift, *box)
        if new:
            struct.pack_into("<Q", h, 247, count)
        return bytes(h)

    with open_output(path) as out:
        out.write(header())
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.zeros(b.num_rows, dtype)
            get = lambda n, b=b: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) if n in b.schema.names else np.zeros(b.num_rows)
            for k, (a, c) in enumerate(zip("xyz", "XYZ")):
                v = get(a).astype(np.float64)
                low[k], high[k] = min(low[k], v.min()), max(high[k], v.max())
                raw[c] = np.rint((v - shift[k]) / scale)
            u1 = lambda n: get(n).astype(np.uint8)  # noqa: B023, E731
            bit = lambda n, v: np.where(get(n).astype(bool), v, 0).astype(np.uint8)  # noqa: B023, E731
            raw["intensity"], raw["user_data"], raw["source"] = np.nan_to_num(get("intensity").astype(np.float64)).astype(np.uint16), u1("user_data"), get("point_source_id").astype(np.uint16)
            if new:
                raw["returns"] = u1("return_number") | u1("number_of_returns") << 4
                raw["flags"] = bit("is_synthetic", 1) | bit("is_key_point", 2) | bit("is_withheld", 4) | bit("is_overlap", 8) | (u1("scanner_channel") & 3) << 4 | bit("is_edge_of_flight_line", 128)
                raw["class"], raw["angle"] = u1("classification"), np.rint(get("scan_angle") / 0.006).astype(np.int16)
            else:
                raw["flags"] = u1("return_number") & 7 | (u1("number_of_returns") & 7) << 3 | bit("is_edge_of_flight_line", 128)
                raw["class"] = u1("classification") & 31 | bit("is_synthetic", 32) | bit("is_key_point", 64) | bit("is_withheld", 128)
                raw["angle"] = get("scan_angle").astype(np.int8)
            for n in ("gps_time", "red", "green", "blue", "nir"):
                if n in dtype.names:
                    raw[n] = get(n).astype(dtype[n])
            out.write(raw.tobytes())
            count += b.num_rows
        out.seek(0)
        out.write(header())
    return count


def write_parts(df: DataFrame, folder: str, point_format: int = 3, scale: float = 0.001) -> list[str]:
    """Write the rows as LAS files in a folder that all executors see, one for each partition that has rows; returns their paths.

    A file belongs to one task attempt; those that no path names come from lost attempts.
    """

    def run(batches):
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.las"
        batches = (b for b in batches if b.num_rows)
        if first := next(batches, None):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([write_las(itertools.chain([first], batches), path, point_format, scale)])], ["path", "points"])

    return sorted(r["path"] for r in df.mapInArrow(run, "path string, points bigint").collect())
