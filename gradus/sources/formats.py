"""Python data sources: publications that one rename makes visible, and archives of fold arrays that filters prune."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PUBLICATION, FOLDS = "gradus_publication", "gradus_folds"
SIDECAR = "sidecar.json"
CHUNK = 4 << 20


def file_digest(store: pafs.FileSystem, path: str) -> str:
    """SHA-256 of a file, read in pieces."""
    found = hashlib.sha256()
    with store.open_input_stream(path) as stream:
        while piece := stream.read(CHUNK):
            found.update(piece)
    return found.hexdigest()


def exists(uri: str) -> bool:
    store, path = pafs.FileSystem.from_uri(uri)
    return store.get_file_info(path).type != pafs.FileType.NotFound


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int
    sha256: str | None


class Publication(DataSource):
    """Writes a table and its signed sidecar to the folder ``path`` at once; option ``about`` is the sidecar's JSON."""

    @classmethod
    def name(cls) -> str:
        return PUBLICATION

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        out = PublicationWriter(self.options["path"].rstrip("/"), json.loads(self.options["about"]), schema)
        out.prepare()
        return out


class PublicationWriter(DataSourceArrowWriter):
    """Tasks write parts to a folder of this attempt. ``commit`` adds the sidecar and renames the folder, the only step that shows anything."""

    def __init__(self, uri: str, about: dict, schema: StructType):
        self.uri, self.about, self.schema, self.attempt = uri, about, schema, uuid.uuid4().hex

    def _open(self) -> tuple[pafs.FileSystem, str, str]:
        store, path = pafs.FileSystem.from_uri(self.uri)
        return store, path, f"{path}.attempt-{self.attempt}"

    def prepare(self) -> None:
        """Makes the attempt's folder. Tasks don't, so that one which goes on after an abort brings nothing back."""
        store, _, staged = self._open()
        store.create_dir(f"{staged}/scores")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, _, staged = self._open()
        task = TaskContext.get()
        name, out, rows = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet", None, 0
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(store.open_output_stream(f"{staged}/scores/{name}"), batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Part(None, 0, None)
        out.close()
        return Part(name, rows, file_digest(store, f"{staged}/scores/{name}"))

    def commit(self, messages: list[Part | None]) -> None:
        store, path, staged = self._open()
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.name)
        if not parts:
            with pq.ParquetWriter(store.open_output_stream(f"{staged}/scores/empty.parquet"), to_arrow_schema(self.schema)):
                pass
            parts = [Part("empty.parquet", 0, file_digest(store, f"{staged}/scores/empty.parquet"))]
        named = {m.name for m in parts}
        for left in store.get_file_info(pafs.FileSelector(f"{staged}/scores")):
            if left.base_name not in named:  # of a task attempt that failed
                store.delete_file(left.path)
        said = self.about | {"rows": sum(m.rows for m in parts), "files": {m.name: m.sha256 for m in parts}}
        with store.open_output_stream(f"{staged}/{SIDECAR}") as out:
            out.write(json.dumps(said, sort_keys=True, allow_nan=False).encode())
        if exists(self.uri):
            raise FileExistsError(f"{self.uri} exists")
        store.move(staged, path)

    def abort(self, messages: list[Part | None]) -> None:
        store, _, staged = self._open()
        if store.get_file_info(staged).type != pafs.FileType.NotFound:
            store.delete_dir(staged)


@dataclass
class Archive(InputPartition):
    uri: str
    sweep: str
    fold: int

    def __post_init__(self) -> None:
        super().__init__(self.uri)


class FoldArchives(DataSource):
    """(sweep, fold, pos, id_code, test_true, test_raw) of files ``<sweep>/fold<k>.npz`` below ``path``; a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return FOLDS

    def schema(self) -> str:
        return "sweep string, fold int, pos int, id_code string, test_true int, test_raw double"

    def reader(self, schema: StructType) -> DataSourceReader:
        pruned = self.options.get("pushdown", "false") == "true"
        return (PrunedFolds if pruned else FoldReader)(self.options["path"].rstrip("/"))


class FoldReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri
        self.wanted: dict[str, set] = {}

    def partitions(self) -> list[Archive]:
        store, path = pafs.FileSystem.from_uri(self.uri)
        found = []
        for file in store.get_file_info(pafs.FileSelector(path, recursive=True)):
            name = re.fullmatch(r"(?:.*/)?([^/]+)/fold(\d+)\.npz", file.path)
            if name and all({"sweep": name[1], "fold": int(name[2])}[c] in values for c, values in self.wanted.items()):
                found.append(Archive(file.path, name[1], int(name[2])))
        return sorted(found, key=lambda a: (a.sweep, a.fold))

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        """The arrays are read one at a time, and must be equally long."""
        store, _ = pafs.FileSystem.from_uri(self.uri)
        with store.open_input_file(partition.uri) as stream, zipfile.ZipFile(stream) as archive:

            def array(name: str) -> np.ndarray:
                with archive.open(f"{name}.npy") as member:
                    return np.lib.format.read_array(member, allow_pickle=False)

            ids = pa.array(array("test_ids").astype(str).tolist(), pa.string())
            truth, raw = (pa.array(array(c).astype(t)) for c, t in (("test_true", np.int32), ("test_raw", np.float64)))
        n = len(ids)
        columns = [pa.array([partition.sweep] * n, pa.string()), pa.array(np.full(n, partition.fold, np.int32)), pa.array(np.arange(n, dtype=np.int32)), ids, truth, raw]
        yield pa.RecordBatch.from_arrays(columns, names=["sweep", "fold", "pos", "id_code", "test_true", "test_raw"])


class PrunedFolds(FoldReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equalities on sweep and fold: other archives are not opened."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("sweep",), ("fold",)):
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f
