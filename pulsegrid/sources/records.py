"""Binary files of fixed-size records as a Spark data source, and a writer of them.

One source serves the flat formats of the field: interleaved samples (a record is one sample of all
channels), spike times, cluster ids, features, waveforms, locations and parent lists differ in type,
width and header only (see FORMATS). A file is split into byte ranges, so a long recording is read by
many tasks; periods of records become ranges that are read, the rest is skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

#: Type, values in a record (None: told by an option), and bytes of the header of each file format.
FORMATS = {
    "samples": ("<i2", None, 0),
    "samples32": ("<i4", None, 0),
    "times": ("<i8", 1, 0),
    "clusters": ("<i4", 1, 4),
    "atoms": ("<i4", 1, 4),
    "parents": ("<i4", 1, 4),
    "features": ("<i8", None, 4),
    "waveforms": ("<i2", None, 0),
    "locations": ("<f4", 5, 0),
}
BATCH = 65_536


def _open(path: str):
    store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return store, at


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        kind, width, header = FORMATS[options.get("layout", "samples")]
        self.dtype, self.header = np.dtype(kind), int(options.get("header", header))
        self.width = int(options.get("width", width or 0))
        self.step = int(options.get("split_records", 4_000_000))
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        self.scale = float(options["scale"]) if options.get("scale") else None
        self.ranges = [tuple(map(int, r.split(":"))) for r in options["ranges"].split(",")] if options.get("ranges") else None
        self.wants_float = self.scale is not None or self.dtype.kind == "f"

    def _count(self) -> int:
        store, at = _open(self.path)
        size = store.get_file_info(at).size - self.header
        if options_width := (self.width or 0):
            record = options_width * self.dtype.itemsize
        else:
            with store.open_input_file(at) as f:
                self.width = int(np.frombuffer(f.read(4), "<i4")[0])
            record = self.width * self.dtype.itemsize
        if size < 0 or size % record:
            raise ValueError(f"{self.path}: {size} bytes aren't whole records of {record}")
        return size // record

    def partitions(self) -> list[_Range]:
        n = self._count()
        wanted = [(max(0, a), min(n, b)) for a, b in self.ranges] if self.ranges else [(0, n)]
        return [_Range(i, min(i + self.step, b)) for a, b in wanted for i in range(a, b, self.step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, at = _open(self.path)
        record = self.width * self.dtype.itemsize
        with store.open_input_file(at) as f:
            for first in range(partition.first, partition.last, BATCH):
                last = min(first + BATCH, partition.last)
                f.seek(self.header + first * record)
                values = np.frombuffer(f.read((last - first) * record), self.dtype).reshape(-1, self.width)
                if self.columns is not None:
                    values = values[:, self.columns]
                flat = values.astype(np.float64).ravel() * (self.scale or 1.0) if self.wants_float else values.astype(np.int64).ravel()
                ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["idx", "values"])


class RecordFile(DataSource):
    """Options: path, layout (a name of FORMATS), width, header, columns, scale, ranges (a:b,c:d), split_records."""

    @classmethod
    def name(cls) -> str:
        return "recordfile"

    def schema(self) -> str:
        reader = _Reader(dict(self.options))
        return f"idx long, values array<{'double' if reader.wants_float else 'bigint'}>"

    def reader(self, schema) -> DataSourceReader:
        reader = _Reader(dict(self.options))
        reader._count()
        return reader


def read_records(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    """(idx, values) of a record file."""
    ship(spark)
    spark.dataSource.register(RecordFile)
    return spark.read.format("recordfile").options(path=path, layout=layout, **{k: str(v) for k, v in options.items()}).load()


def read_samples(spark: SparkSession, path: str, n_channels: int, channels: list[int] | None = None, scale: float | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(idx, channel, value) of interleaved samples; only the given channels and ranges of samples."""
    options: dict = {"width": n_channels}
    chosen = channels if channels is not None else list(range(n_channels))
    options["columns"] = ",".join(map(str, chosen))
    if scale is not None:
        options["scale"] = scale
    if ranges:
        options["ranges"] = ",".join(f"{a}:{b}" for a, b in ranges)
    rows = read_records(spark, path, "samples", **options)
    named = F.element_at(F.array(*map(F.lit, chosen)), F.col("pos") + 1)
    return rows.select("idx", F.posexplode("values").alias("pos", "value")).select("idx", named.alias("channel"), "value")


def read_spikes(spark: SparkSession, base: str, shanks: list[int], keep_noise: bool = False) -> DataFrame:
    """(shank, spike_id, sample, local) of the times and clusters of several shanks; clusters 0 and 1 go unless kept."""
    out = None
    for shank in shanks:
        times = read_records(spark, f"{base}.res.{shank}", "times").select("idx", F.col("values")[0].alias("sample"))
        ids = read_records(spark, f"{base}.clu.{shank}", "clusters").select("idx", F.col("values")[0].cast("int").alias("local"))
        one = times.join(ids, "idx").select(F.lit(shank).alias("shank"), F.col("idx").alias("spike_id"), "sample", "local")
        out = one if out is None else out.unionByName(one)
    return out if keep_noise else out.where("local > 1")


def write_records(rows: DataFrame, folder: str, layout: str, header: str | None = None, overwrite: bool = False) -> DataFrame:
    """Writes rows (file, idx, values) to one file for each name in `file`, records in the order of idx; returns (file, n).

    header: none, or `count` (number of records), `distinct` (number of distinct first values) or `width`, as 4 bytes.
    Each file is written by one task under another name and then renamed; an existing file is an error unless overwritten.
    """
    ship(rows.sparkSession)
    dtype = np.dtype(FORMATS[layout][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, out, held, seen, n, width = [], None, None, None, set(), 0, 0

        def finish() -> None:
            out.close()
            store, at = _open(f"{folder}/{now}")
            if header:
                value = {"count": n, "distinct": len(seen), "width": width}[header]
                with store.open_output_stream(held + ".h") as f, store.open_input_stream(held) as body:
                    f.write(np.array([value], "<i4").tobytes())
                    while block := body.read(1 << 22):
                        f.write(block)
                store.delete_file(held)
                store.move(held + ".h", at)
            else:
                store.move(held, at)
            done.append((now, n))

        for batch in batches:
            names, lists = batch.column(0).to_pylist(), batch.column(1)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if first == last:
                    continue
                name, some = names[first], lists.slice(first, last - first)
                if name != now:
                    if now is not None:
                        finish()
                    now, n, seen = name, 0, set()
                    store, at = _open(f"{folder}/{name}")
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
                        raise FileExistsError(at)
                    held = f"{at}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(held)
                out.write(some.flatten().to_numpy(zero_copy_only=False).astype(dtype).tobytes())
                starts = np.cumsum([0, *some.value_lengths().to_pylist()[:-1]]) if header == "distinct" else []
                n, width = n + len(some), int(some.value_lengths()[-1].as_py())
                if header == "distinct":
                    seen.update(np.unique(some.flatten().to_numpy(zero_copy_only=False)[starts]).tolist())
        if now is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "n"])

    dealt = rows.repartition("file").sortWithinPartitions("file", "idx").select("file", "values")
    made = dealt.mapInArrow(run, "file string, n long").collect()
    return rows.sparkSession.createDataFrame([(r.file, r.n) for r in made], "file string, n long")
