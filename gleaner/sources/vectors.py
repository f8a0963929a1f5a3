"""Vector files as a data source: matrices (.npy) beside the ids of their rows.

    spark.dataSource.register(VectorFiles)
    spark.read.format("vectors").load(folder)              # id, embedding
    df.write.format("vectors").mode("overwrite").save(folder)

A folder holds vectors.npy with ids.txt (one id a line), or parts that meta.json names: pairs of such files of bounded size.
Each range of rows is a partition of its own and reads its own bytes of the matrix. Ids and rows must be equal in
number, or reading fails. Writing goes to files of fresh names; meta.json, put in place last, is what makes them the
folder's content, so a task that was lost or ran twice leaves files that nothing names, and a failed job leaves the old content.
"""

from __future__ import annotations

import ast
import json
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

META, VECTORS, IDS = "meta.json", "vectors.npy", "ids.txt"


def _files(folder: str):
    """(file system, path in it) of a folder, by its scheme; a path without one is local."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def npy_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, bytes before the data) of an open .npy file."""
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    size, fmt = (2, "<H") if magic[6] == 1 else (4, "<I")
    (n,) = struct.unpack(fmt, f.read(size))
    told = ast.literal_eval(f.read(n).decode("latin1"))
    if told["fortran_order"] or len(told["shape"]) != 2:
        raise ValueError("a matrix in the order of its rows is expected")
    return told["shape"], np.dtype(told["descr"]), 8 + size + n


def read_meta(folder: str) -> dict | None:
    from pyarrow import fs

    files, path = _files(folder)
    if files.get_file_info(f"{path}/{META}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{path}/{META}") as f:
        return json.loads(f.read())


@dataclass
class Rows(InputPartition):
    vectors: str
    ids: str
    low: int
    high: int
    last: bool

    def __init__(self, vectors: str, ids: str, low: int, high: int, last: bool):
        self.vectors, self.ids, self.low, self.high, self.last = vectors, ids, low, high, last


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.rows = options["path"].rstrip("/"), int(options.get("rowsPerPartition", 65_536))

    def partitions(self) -> list[Rows]:
        files, path = _files(self.folder)
        meta = read_meta(self.folder) or {}
        out = []
        for part in meta.get("parts") or [{"vectors": VECTORS, "ids": IDS}]:
            with files.open_input_file(f"{path}/{part['vectors']}") as f:
                (n, _), _, _ = npy_header(f)
            starts = range(0, max(n, 1), self.rows)
            out += [Rows(part["vectors"], part["ids"], lo, min(lo + self.rows, n), lo + self.rows >= n) for lo in starts]
        return out

    def read(self, part: Rows) -> Iterator:
        import pyarrow as pa

        files, path = _files(self.folder)
        ids = []
        with files.open_input_stream(f"{path}/{part.ids}") as raw:
            at = -1
            for at, line in enumerate(_lines(raw)):
                if part.low <= at < part.high:
                    ids.append(line)
                elif at >= part.high and not part.last:
                    break
        if len(ids) < part.high - part.low or (part.last and at + 1 != part.high):
            raise ValueError(f"{part.ids}: {at + 1} ids for {part.high} vectors or more" if len(ids) < part.high - part.low else f"{part.ids}: {at + 1} ids for {part.high} vectors")
        with files.open_input_file(f"{path}/{part.vectors}") as f:
            (_, dim), kind, start = npy_header(f)
            for lo in range(part.low, part.high, 4096):
                n = min(4096, part.high - lo)
                f.seek(start + lo * dim * kind.itemsize)
                x = np.frombuffer(f.read(n * dim * kind.itemsize), kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()) if dim else pa.array([0] * (n + 1), pa.int32()), pa.array(x, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo - part.low : lo - part.low + n], pa.string()), lists], ["id", "embedding"])


def _lines(raw) -> Iterator[str]:
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.rstrip(b"\r").decode() for x in whole)
    if rest:
        yield rest.decode()


@dataclass
class Written(WriterCommitMessage):
    partition: int
    parts: list
    seconds: float

    def __init__(self, partition: int, parts: list, seconds: float):
        self.partition, self.parts, self.seconds = partition, parts, seconds


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most, self.kind = int(options.get("bytesPerFile", 64_000_000)), np.dtype(options.get("dtype", "float32"))

    def write(self, batches: Iterator) -> Written:
        from pyspark import TaskContext

        files, path = _files(self.folder)
        files.create_dir(path, recursive=True)
        began, parts, held, ids, bytes_ = time.time(), [], [], [], 0

        def flush():
            nonlocal held, ids, bytes_
            if held:
                name, x = f"part-{uuid.uuid4().hex}", np.concatenate(held)
                with files.open_output_stream(f"{path}/{name}.npy") as f:
                    np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(x.dtype), "fortran_order": False, "shape": x.shape})
                    f.write(x.tobytes())
                with files.open_output_stream(f"{path}/{name}.txt") as f:
                    f.write(("\n".join(ids) + "\n").encode())
                parts.append({"vectors": f"{name}.npy", "ids": f"{name}.txt", "rows": len(x), "dim": x.shape[1]})
            held, ids, bytes_ = [], [], 0

        for batch in batches:
            names = batch.column(0).cast("string").to_pylist()
            if None in names or any("\n" in x or "\r" in x for x in names) or batch.column(1).null_count:
                raise ValueError("an id or vector is null, or an id has a line end")
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            dim = len(flat) // max(len(names), 1)
            if (np.diff(batch.column(1).offsets.to_numpy()) != dim).any() or (held and held[0].shape[1] != dim):
                raise ValueError("vectors of different lengths")
            step = max(1, self.most // max(1, dim * self.kind.itemsize))
            for lo in range(0, len(names), step):
                x = flat[lo * dim : (lo + step) * dim].reshape(-1, dim).astype(self.kind)
                held.append(x), ids.extend(names[lo : lo + step])
                bytes_ += x.nbytes
                if bytes_ >= self.most:
                    flush()
        flush()
        return Written(TaskContext.get().partitionId(), parts, time.time() - began)

    def commit(self, messages: list) -> None:
        files, path = _files(self.folder)
        old = read_meta(self.folder) or {}
        said = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        parts = [p for m in said for p in m.parts]
        kept = [] if self.overwrite else old.get("parts", [])
        if len({p["dim"] for p in [*kept, *parts]}) > 1:
            self.abort(messages)
            raise ValueError("vectors of different lengths")
        seconds, rows = sum(m.seconds for m in said), sum(p["rows"] for p in [*kept, *parts])
        dim = next((p["dim"] for p in [*kept, *parts]), 0)
        meta = {"rows": rows, "dim": dim, "dtype": str(self.kind), "seconds": round(seconds, 3), "per_second": round(sum(p["rows"] for p in parts) / max(seconds, 1e-9), 1), "size_mb": round(rows * dim * self.kind.itemsize / 1048576, 3), "parts": [*kept, *parts]}
        fresh = f"{path}/.{META}-{uuid.uuid4().hex}"
        files.create_dir(path, recursive=True)
        with files.open_output_stream(fresh) as f:
            f.write(json.dumps(meta, indent=1).encode())
        files.move(fresh, f"{path}/{META}")
        if self.overwrite:
            for p in old.get("parts", []):
                for name in (p["vectors"], p["ids"]):
                    files.delete_file(f"{path}/{name}")

    def abort(self, messages: list) -> None:
        files, path = _files(self.folder)
        for m in messages:
            for p in m.parts if m is not None else []:
                for name in (p["vectors"], p["ids"]):
                    files.delete_file(f"{path}/{name}")


class VectorFiles(DataSource):
    """Options: path; rowsPerPartition for reading; bytesPerFile and dtype (float32, float16) for writing."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "id string, embedding array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options, overwrite)
