"""The instance bank as shards of fixed-length records: a data source that writes them once and reads single records by their place.

Crops ``idx`` from 0 on lie in shards of equally many, so shard and place of each follow from its index. ``tar`` shards hold one
member a crop, ``flat`` ones the records alone; both are read by ranges. Conditions on ``idx`` are pushed into the source: a batch of
draws opens only the shards it needs, and reads only its records.
"""

from __future__ import annotations

import json
import struct
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..workers import reach
from . import bank, storage

#: Fixed values of the layouts: names of shards and members, and a member's block.
SHARD, MEMBER, BLOCK = "shard-{:06d}.{}", "crop_{:08d}.bin", 512
#: Bytes of records that one task reads, and at once.
TASK_BYTES, STRIDE_BYTES = 128 << 20, 4 << 20
#: Indices that :func:`taken` accepts: a batch of draws, not a corpus.
BATCH = 1_000_000

SCHEMA = "idx long, class_id long, image binary, alpha binary, embedding_raw binary"
_ARROW = pa.schema([("idx", pa.int64()), ("class_id", pa.int64()), ("image", pa.binary()), ("alpha", pa.binary()), ("embedding_raw", pa.binary())])


@dataclass(frozen=True)
class Layout:
    """Where records lie, from a bank's metadata."""

    kind: str
    h: int
    w: int
    embedded: bool
    per_shard: int

    @classmethod
    def of(cls, meta: dict) -> Layout:
        return cls(meta["format"], *meta["crop_size"], meta["has_embeddings"], meta["crops_per_shard"])

    @property
    def record(self) -> int:
        return bank.record_size(self.h, self.w, self.embedded)

    @property
    def stride(self) -> int:
        """From one record to the next: tar members have a header and fill whole blocks."""
        return BLOCK + -(-self.record // BLOCK) * BLOCK if self.kind == "tar" else self.record

    @property
    def skip(self) -> int:
        return BLOCK if self.kind == "tar" else 0

    def shard(self, number: int) -> str:
        return SHARD.format(number, "tar" if self.kind == "tar" else "bin")


class Message(WriterCommitMessage):
    def __init__(self, shards: list[tuple[int, int]]):
        self.shards = shards


class Shards(DataSource):
    """``maskframe_shards``: the options ``path``, and for writing ``kind``, ``h``, ``w``, ``embedded``, ``per_shard`` and ``meta``."""

    @classmethod
    def name(cls) -> str:
        return "maskframe_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self.options["path"], json.loads(self.options["meta"]))


class ShardWriter(DataSourceArrowWriter):
    """A task writes whole shards, each moved to its name when it is complete: equal rows give equal bytes, so a repeated task
    changes nothing. The metadata, written last, lists the shards; without it there is no bank."""

    def __init__(self, path: str, meta: dict):
        self.path, self.meta, self.layout = path, meta, Layout.of(meta)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Message:
        system, path = storage.at(self.path)
        system.create_dir(f"{path}/index", recursive=True)
        done: list[tuple[int, int]] = []
        open_: OpenShard | None = None
        for b in iterator:
            for row in b.to_pylist():
                number = row["idx"] // self.layout.per_shard
                if open_ is None or open_.number != number:
                    done += [open_.close()] if open_ else []
                    open_ = OpenShard(system, path, number, self.layout)
                open_.add(row)
        done += [open_.close()] if open_ else []
        return Message(done)

    def commit(self, messages: list[Message | None]) -> None:
        system, path = storage.at(self.path)
        shards = sorted(s for m in messages if m is not None for s in m.shards)
        n, per = sum(k for _, k in shards), self.layout.per_shard
        if shards != [(i, min(per, n - i * per)) for i in range(-(-n // per))]:
            raise ValueError("the crops aren't numbered from 0 without gaps")
        meta = bank.stamped(self.meta | {"num_crops": n, "num_shards": len(shards)})
        storage.put(system, f"{path}/meta.json", json.dumps(meta, sort_keys=True).encode())

    def abort(self, messages: list[Message | None]) -> None:
        """Shards without metadata are no bank; those of an earlier run were given up when this one began."""


class OpenShard:
    """One shard being written, with the rows of its index."""

    def __init__(self, system, path: str, number: int, layout: Layout):
        self.system, self.path, self.number, self.layout = system, path, number, layout
        self.target = f"{path}/{layout.shard(number)}"
        self.part = f"{self.target}.{uuid.uuid4().hex[:8]}.part"
        self.stream = system.open_output_stream(self.part, compression=None)
        self.tar = tarfile.open(fileobj=self.stream, mode="w|", format=tarfile.USTAR_FORMAT) if layout.kind == "tar" else None
        self.classes: list[int] = []

    def add(self, row: dict) -> None:
        at, n = self.number * self.layout.per_shard + len(self.classes), self.layout.h * self.layout.w
        if row["idx"] != at:
            raise ValueError(f"crop {row['idx']} where {at} belongs: sort a shard's crops, and number them without gaps")
        data = b"".join([row["image"], row["alpha"], struct.pack("<q", row["class_id"]), row["embedding_raw"] or b""])
        if len(row["image"]) != 3 * n or len(row["alpha"]) != n or len(data) != self.layout.record:
            raise ValueError(f"crop {at} hasn't the bank's size")
        if self.tar:
            info = tarfile.TarInfo(MEMBER.format(at))
            info.size = len(data)  # everything else about a member stays zero, so that bytes repeat
            self.tar.addfile(info, _Bytes(data))
        else:
            self.stream.write(data)
        self.classes.append(row["class_id"])

    def close(self) -> tuple[int, int]:
        if self.tar:
            self.tar.close()
        self.stream.close()
        self.system.move(self.part, self.target)
        idx = np.arange(len(self.classes)) + self.number * self.layout.per_shard
        index = pa.table({"idx": idx, "shard_id": pa.array([self.number] * len(idx), pa.int32()), "member_name": [MEMBER.format(i) for i in idx], "class_id": pa.array(self.classes, pa.int64())})
        sink = pa.BufferOutputStream()
        pq.write_table(index, sink)
        storage.put(self.system, f"{self.path}/index/shard-{self.number:06d}.parquet", sink.getvalue().to_pybytes())
        return self.number, len(self.classes)


class _Bytes:
    """What a tar member is read from."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


class Ranges(InputPartition):
    """What one task reads: runs of neighbouring records (shard, first, past the last)."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = runs


class ShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        system, p = storage.at(path)
        if not storage.exists(system, f"{p}/meta.json"):
            raise FileNotFoundError(f"no finished bank in {path}")
        meta = bank.opened(json.loads(storage.get(system, f"{p}/meta.json")))
        self.layout, self.n = Layout.of(meta), meta["num_crops"]
        self.low, self.high, self.only = 0, self.n, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over conditions that compare ``idx`` with values; others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("idx",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                values.discard(None)
                self.only = values if self.only is None else self.only & values
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        """Runs of wanted records, cut at shards and at what one task reads."""
        per, most = self.layout.per_shard, max(1, TASK_BYTES // self.layout.stride)
        runs: list[tuple[int, int, int]] = []
        if self.only is None:
            for a in range(self.low // per * per, self.high, per):
                runs += [(a // per, max(a, self.low), min(a + per, self.high))]
        else:
            some = np.array(sorted(i for i in self.only if self.low <= i < self.high), np.int64)
            cuts = np.flatnonzero(np.r_[True, (np.diff(some) != 1) | (np.diff(some // per) != 0)]) if len(some) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(some)]):
                runs.append((int(some[a]) // per, int(some[a]), int(some[b - 1]) + 1))
        # A task reads one shard's records, up to so many.
        out: list[Ranges] = []
        size = 0
        for shard, a, b in runs:
            while a < b:
                if not out or out[-1].runs[-1][0] != shard or size >= most:
                    out.append(Ranges([]))
                    size = 0
                n = min(b - a, most - size)
                out[-1].runs.append((shard, a, a + n))
                a, size = a + n, size + n
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.runs:
            return
        system, p = storage.at(self.path)
        with system.open_input_file(f"{p}/{self.layout.shard(partition.runs[0][0])}") as f:
            for shard, a, b in partition.runs:
                most = max(1, STRIDE_BYTES // self.layout.stride)
                for first in range(a, b, most):
                    yield self.records(f, shard, first, min(b, first + most))

    def records(self, f: BinaryIO, shard: int, a: int, b: int) -> pa.RecordBatch:
        """The records from ``a`` up to ``b`` of a shard, in one read."""
        lay, n = self.layout, self.layout.h * self.layout.w
        f.seek((a - shard * lay.per_shard) * lay.stride)
        raw = f.read((b - a) * lay.stride)
        if len(raw) != (b - a) * lay.stride:
            raise ValueError(f"shard {shard} is cut off")
        out: list[tuple] = []
        for i in range(a, b):
            at = (i - a) * lay.stride
            if lay.kind == "tar" and raw[at : at + 100].rstrip(b"\0").decode("ascii", "replace") != MEMBER.format(i):
                raise ValueError(f"shard {shard} hasn't {MEMBER.format(i)} where it belongs")
            r = raw[at + lay.skip : at + lay.skip + lay.record]
            out.append((i, struct.unpack_from("<q", r, 4 * n)[0], r[: 3 * n], r[3 * n : 4 * n], r[4 * n + 8 :] if lay.embedded else None))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ARROW)], schema=_ARROW)


def write(crops: DataFrame, path: str, h: int, w: int, classes: int, kind: str = "tar", per_shard: int = bank.PER_SHARD, seed: int = 0, version: str = "0") -> dict:
    """Writes a bank of ``idx`` (from 0, no gaps), ``class_id``, ``image``, ``alpha`` and perhaps ``embedding_raw``; returns its metadata.

    Shards are dealt to tasks whole and sorted there; the metadata of a bank that is overwritten goes first.
    """
    if kind not in ("tar", "flat"):
        raise ValueError(f"unknown layout {kind!r}")
    spark = reach(crops.sparkSession)
    spark.dataSource.register(Shards)
    embedded = "embedding_raw" in crops.columns
    some = crops.select("idx", F.col("class_id").cast("long").alias("class_id"), "image", "alpha", (F.col("embedding_raw") if embedded else F.lit(None).cast("binary")).alias("embedding_raw"))
    system, p = storage.at(path)
    if storage.exists(system, f"{p}/meta.json"):
        system.delete_file(f"{p}/meta.json")
    meta = {"format": kind, "format_version": bank.FORMAT_VERSION, "num_classes": classes, "crop_size": [h, w], "has_embeddings": embedded, "base_seed": seed, "engine_version": version, "crops_per_shard": per_shard}
    dealt = some.withColumn("_shard", F.floor(F.col("idx") / per_shard)).repartition("_shard").sortWithinPartitions("idx").drop("_shard")
    dealt.write.format("maskframe_shards").option("path", path).option("meta", json.dumps(meta)).mode("append").save()
    return metadata(path)


def metadata(path: str) -> dict:
    system, p = storage.at(path)
    if not storage.exists(system, f"{p}/meta.json"):
        raise FileNotFoundError(f"no finished bank in {path}")
    return bank.opened(json.loads(storage.get(system, f"{p}/meta.json")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """:data:`SCHEMA` of a bank's crops. Conditions on ``idx`` reach the source; classes are found by :func:`index`."""
    spark = reach(spark)
    spark.dataSource.register(Shards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("maskframe_shards").option("path", path).load()


def index(spark: SparkSession, path: str) -> DataFrame:
    """(idx, shard_id, member_name, class_id), a Parquet table beside the shards."""
    return spark.read.parquet(f"{path}/index")


def taken(spark: SparkSession, path: str, idx: list[int]) -> DataFrame:
    """The crops of a batch of draws, each once; an index that the bank hasn't is an error, as is a batch beyond :data:`BATCH`."""
    n, some = metadata(path)["num_crops"], sorted(set(idx))
    if some and not 0 <= some[0] <= some[-1] < n:
        raise IndexError(f"the bank has crops 0 to {n - 1}")
    if len(some) > BATCH:
        raise ValueError("more than a batch: join the bank instead")
    return read(spark, path).where(F.col("idx").isin(some))
