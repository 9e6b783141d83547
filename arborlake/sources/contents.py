"""Contents that a manifest names instead of holding them.

A manifest may carry ``content_uri``, the place of each file's bytes, and leave ``content`` NULL
or out. Selection, layout and statistics then run on narrow rows, and tasks read the bytes of
those files alone whose lines are counted, whose text is shown or whose rules apply.

Files are read by name, so hidden names count and no directory is listed. A missing or
forbidden file, and one that a cell cannot hold (2 GiB and more), has NULL content; any other
failure is raised, and the task is tried again. Names are taken as they are written, without
percent signs decoded. A scheme that Arrow's file systems do not know is an error; ``hdfs``
needs the native client on every executor.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.operators.inventory import with_content_column
from arborlake.operators.scratch import materialize

URI = "content_uri"
#: What one task reads at most, as far as sizes are known: bytes and files.
TASK_BYTES = 256 << 20
TASK_FILES = 20_000
#: Bytes that a task gathers before it hands rows on.
BATCH_BYTES = 16 << 20
_CELL_BYTES = (1 << 31) - 1024

# The readers travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def refers(entries: DataFrame) -> bool:
    """Whether the manifest names contents."""
    return URI in entries.columns


class Places:
    """File systems by scheme and authority, opened once in a task."""

    def __init__(self) -> None:
        self.opened: dict = {}

    def of(self, uri: str) -> tuple:
        from pyarrow import fs

        if uri.startswith("file:"):
            uri = "/" + uri[len("file:") :].lstrip("/")
        scheme, found, rest = uri.partition("://")
        if not found:
            if "" not in self.opened:
                self.opened[""] = fs.LocalFileSystem()
            return self.opened[""], uri
        authority, _, path = rest.partition("/")
        base = f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/"
        if base not in self.opened:
            self.opened[base] = fs.FileSystem.from_uri(base)
        system, root = self.opened[base]
        return system, f"{root.rstrip('/')}/{path}"

    def read(self, uri: str, wanted: bool, largest: int) -> tuple[bytes | None, int | None]:
        """Bytes, if wanted and not larger than ``largest``, and size of a file; NULL where there is none."""
        from pyarrow import fs

        system, path = self.of(uri)
        try:
            info = system.get_file_info(path)
            if info.type != fs.FileType.File:
                return None, None
            if not wanted or info.size > largest:
                return None, info.size
            # without this argument a name such as ``a.gz`` would be unpacked
            with system.open_input_stream(path, compression=None) as stream:
                return stream.read(), info.size
        except (FileNotFoundError, PermissionError):
            return None, None

    def write(self, uri: str, content: bytes) -> None:
        """Write a file whose name tells its content: once, and whole or not at all."""
        from pyarrow import fs

        system, path = self.of(uri)
        if system.get_file_info(path).type == fs.FileType.File:
            return
        system.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(part, compression=None) as stream:
            stream.write(content)
        system.move(part, path)


def _reading(columns: list[str], flag: str, largest: int) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            uris, wanted, sizes = (batch.column(c).to_pylist() for c in (URI, flag, "size_bytes"))
            start, contents, found, held = 0, [], [], 0
            for k, uri in enumerate(uris):
                content, size = places.read(uri, wanted[k], largest)
                contents.append(content)
                found.append(size if sizes[k] is None else sizes[k])
                held += len(content or b"")
                if held >= BATCH_BYTES or k + 1 == len(uris):
                    rows = batch.slice(start, len(contents))
                    new = {"content": pa.array(contents, pa.binary()), "size_bytes": pa.array(found, pa.int64())}
                    yield pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(c) for c in columns], columns)
                    start, contents, found, held = k + 1, [], [], 0

    return read


def with_contents(entries: DataFrame, wanted: Column | None = None, largest: int | None = None) -> DataFrame:
    """Fill ``content``, as bytes, of the wanted files that only name it, and sizes not known.

    Files larger than ``largest`` are not read. The narrow rows are counted first, so that each
    task gets a bounded share of files and bytes, dealt by corpus and path; a file that many
    rows name is read by many tasks. Entries that name no contents are returned as they are.
    """
    if not refers(entries):
        return entries
    known = entries.withColumn("size_bytes", (F.col("size_bytes") if "size_bytes" in entries.columns else F.lit(None)).cast("bigint"))
    known = with_content_column(known).withColumn("content", F.col("content").cast("binary"))
    size = F.col("size_bytes")
    limit = _CELL_BYTES if largest is None else min(largest, _CELL_BYTES)
    read = F.coalesce(F.lit(True) if wanted is None else wanted, F.lit(False)) & F.coalesce(size <= limit, F.lit(True))
    is_file = ~F.coalesce(F.col("is_dir"), F.lit(False)) if "is_dir" in entries.columns else F.lit(True)
    asked = F.col(URI).isNotNull() & F.col("content").isNull() & is_file & (read | size.isNull())
    flag = "_wanted" + uuid.uuid4().hex
    narrow = known.where(asked).withColumn(flag, read).drop("content")
    share = narrow.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.when(F.col(flag), size)), F.lit(0)).alias("bytes")).first()
    if not share["files"]:
        return known
    cores = entries.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, share["files"]), math.ceil(share["files"] / TASK_FILES), math.ceil(share["bytes"] / TASK_BYTES))
    dealt = narrow.repartition(tasks, "corpus_id", "path")
    fetched = dealt.mapInArrow(_reading(known.columns, flag, limit), known.schema)
    return known.where(~asked).unionByName(fetched)


def _writing(columns: list[str]) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            for uri, content in zip(batch.column(URI), batch.column("content")):
                if uri.is_valid:
                    places.write(uri.as_py(), content.as_py())
            yield batch.select(columns)

    return write


def refer_contents(entries: DataFrame, folder: str) -> DataFrame:
    """Write every content as a file below ``folder`` and return the manifest that names them.

    A file is named by the digest of its bytes: equal contents share one file, and a task that
    is tried again finds what it wrote. The folder must be reached by all executors.
    """
    content = F.col("content").cast("binary")
    digest = F.sha2(content, 256)
    uri = F.concat(F.lit(folder.rstrip("/") + "/"), F.left(digest, F.lit(2)), F.lit("/"), digest)
    named = entries.withColumns({"content": content, URI: uri})
    columns = [c for c in named.columns if c != "content"]
    schema = T.StructType([f for f in named.schema.fields if f.name != "content"])
    return materialize(named.mapInArrow(_writing(columns), schema), "referred")
