"""Server-sent frames as a streaming source and sink.

The source (``FrameSource``, format ``sse_frames``) reads files of frames that grow while it reads: a frame is what two
line feeds end, wherever reads cut it. Offsets are bytes by file, so a stream goes on where its checkpoint says; a frame
belongs to the read that holds its end, and whoever reads looks back for where it begins, so nothing needs to be held
between reads and any range can be read again, by any executor. The sink writes each batch of a stream once, however often
it is delivered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from answerloom.sources.files import renamed, sse_encode
from answerloom.sources.scratch import remove

END = b"\n\n"
#: Bytes that one task reads, and that are looked back for at a time.
SPLIT, BACK = 32 << 20, 64 << 10


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def ends_of(data: bytes) -> Iterator[int]:
    """Where frames end in ``data``, from left to right: line feeds pair up from where a run of them begins."""
    at = data.find(END)
    while at >= 0:
        yield at + len(END)
        at = data.find(END, at + len(END))


def frames_in(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(where it ends, frame) of the frames that end in (start, end]. Frames are cut from the beginning of the last run of
    line feeds before ``start``, so pairs are the same whatever the range."""
    low, head = start, b""
    while low > 0:
        block = min(BACK, low)
        file.seek(low - block)
        head, low = file.read(block) + head, low - block
        at = head.rfind(END)
        while at > 0 and head[at - 1 : at] == b"\n":  # to the beginning of this run of line feeds
            at -= 1
        if at > 0:  # a run that begins inside of what was read
            low, head = low + at, head[at:]
            break
    file.seek(start)
    data, before = head + file.read(end - start), 0
    for at in ends_of(data):
        if low + at > start:
            yield low + at, data[before : at - len(END)]
        before = at


class Reader(DataSourceReader):
    """All frames that are there."""

    def __init__(self, path: str):
        self.path = path

    def sizes(self) -> dict[str, int]:
        """The bytes of each file; hidden ones are left out."""
        from pyarrow import fs

        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return [Range(file, at, min(at + SPLIT, size)) for file, size in sorted(end.items()) for at in range(start.get(file, 0), size, SPLIT)]

    def partitions(self) -> list[Range]:
        return self.ranges({}, self.sizes()) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        if partition.end <= partition.start:
            return
        with opened(self.path)[0].open_input_file(partition.file) as file:
            for at, frame in frames_in(file, partition.start, partition.end):
                data = frame.decode("utf-8", "replace").removeprefix("data: ").strip()
                if data:
                    yield partition.file, at, data


class StreamReader(Reader, DataSourceStreamReader):
    """The frames that came to an end since the last offset."""

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self.sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(json.loads(start["files"]), json.loads(end["files"]))

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """Format ``sse_frames``: (file, at, data) of each frame in the file or folder ``path``; ``at`` is where it ends. Empty
    frames are left out, the last one, ``[DONE]``, is not."""

    @classmethod
    def name(cls) -> str:
        return "sse_frames"

    def schema(self) -> str:
        return "file string, at long, data string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options["path"])


def once(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes a batch into the folder ``batch=ID`` of ``path``, aside and then renamed. A batch that is
    delivered again takes its own place."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder, aside = f"{path}/batch={batch_id}", f"{path}/_writing-{batch_id}"
        batch.write.mode("overwrite").parquet(aside)
        remove(spark, folder)
        renamed(spark, aside, folder)

    return write


def frames_once(path: str, data: str = "data") -> Callable[[DataFrame, int], None]:
    """``once`` for events whose JSON is in a column: their frames, in a column ``frame`` beside all others."""
    put = once(path)
    return lambda batch, batch_id: put(batch.withColumn("frame", sse_encode(F.col(data))), batch_id)
