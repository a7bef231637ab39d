"""Token shards: a data source of flat files of unsigned 16-bit ids, on any file system Arrow knows (local, hdfs, s3, gs).

``register(spark)``, then format("token_shards") with the options path and prefix. Reading gives a row per
shard; writing takes (shard, tokens) rows, one file each; both as Arrow batches. A task writes under a name of its own and the driver renames on
commit, so retried and speculative tasks leave nothing behind; stale shards of the prefix go only then.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.blocks import MAX_ID

_KIND = np.dtype("<u2")


@dataclass
class _Shard(InputPartition):
    path: str
    shard: int
    offset: int


@dataclass
class _Written(WriterCommitMessage):
    files: list


def shard_name(prefix: str, shard: int) -> str:
    return f"{prefix}_{shard:06d}.bin"


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def shard_files(folder: str, prefix: str) -> list:
    """The file infos of a prefix's shards, sorted by path."""
    from pyarrow import fs

    system, at = file_system(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f for f in found if f.base_name.startswith(f"{prefix}_") and f.extension == "bin"), key=lambda f: f.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.prefix = options["path"], options.get("prefix", "train")

    def partitions(self) -> list[InputPartition]:
        files = shard_files(self.folder, self.prefix)
        if not files:
            raise FileNotFoundError(f"no {self.prefix} shards in {self.folder}")
        out, at = [], 0
        for i, f in enumerate(files):
            out.append(_Shard(f.path, i, at))
            at += f.size // _KIND.itemsize
        return out

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        with file_system(self.folder)[0].open_input_file(partition.path) as f:
            tokens = np.frombuffer(f.read(), _KIND).astype(np.int32)
        whole = pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens))
        yield pa.RecordBatch.from_arrays([pa.array([partition.shard], pa.int32()), pa.array([partition.offset], pa.int64()), whole], ["shard", "offset", "tokens"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.prefix = options["path"], options.get("prefix", "train")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = file_system(self.folder)
        system.create_dir(folder, recursive=True)
        files = []
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("tokens"))
            for row, shard in enumerate(batch.column(batch.schema.get_field_index("shard")).to_pylist()):
                ids = lists[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() > MAX_ID):
                    raise ValueError(f"a token id of shard {shard} is out of 0..{MAX_ID}")
                name = shard_name(self.prefix, shard)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(ids.astype(_KIND).tobytes())
                files.append((part, f"{folder}/{name}"))
        return _Written(files)

    def commit(self, messages: list) -> None:
        system = file_system(self.folder)[0]
        files = [f for m in messages if m for f in m.files]
        if not files:
            raise ValueError("there are no tokens to write")
        for stale in shard_files(self.folder, self.prefix):
            system.delete_file(stale.path)
        for part, name in files:
            system.move(part, name)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system = file_system(self.folder)[0]
        for m in messages:
            for part, _ in m.files if m else []:
                if system.get_file_info(part).type != fs.FileType.NotFound:
                    system.delete_file(part)


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "shard int, offset bigint, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("token_shards") known; the classes travel by value, as planning processes have no shipped files."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TokenShards)
