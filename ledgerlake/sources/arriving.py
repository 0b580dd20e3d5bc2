"""Archives that keep arriving, as a streaming source of their own.

``spark.readStream.format("ledger_accounts")``, ``ledger_snapshot`` and ``ledger_archives`` read archives in the order of
their names, each once. What a step of the stream takes in is written down before Spark hears of it: a step is one file
in the folder `progress`, with the names and sizes of its archives, and the offset is the number of steps. So an offset
stays small however many archives there are, a batch that is run again takes the same archives, and a query that starts
anew goes on after the last step.

An archive is one compressed stream, which can only be read from its beginning: it is the least that a step takes, and
one that fails half-way is read again as a whole.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSourceStreamReader

from ledgerlake.sources.files import locate


class ArrivingArchives(DataSourceStreamReader):
    """Steps over the archives of a batch reader.

    `progress` is a folder on a shared file system that belongs to one query. With `most_bytes` a step takes archives
    up to so many compressed bytes, but one at least. Archives must appear whole, as after a rename.
    """

    def __init__(self, reader, progress: str | None, most_bytes: int = 0):
        if not progress:
            raise ValueError("a stream of archives needs the option progress: a folder of its own")
        self.reader, self.progress, self.most_bytes = reader, progress, most_bytes
        self.steps: list[list[list]] = []

    def _place(self, step: int) -> str:
        return posixpath.join(locate(self.progress)[1], f"step-{step:09d}.json")

    def _read_steps(self) -> list[list[list]]:
        """Archives of each step so far, as [uri, bytes]; those already read are not read again."""
        fs, path = locate(self.progress)
        there = {f.base_name for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))}
        while posixpath.basename(self._place(len(self.steps) + 1)) in there:
            with fs.open_input_stream(self._place(len(self.steps) + 1)) as file:
                self.steps.append(json.loads(file.read()))
        return self.steps

    def _arrived(self) -> list[tuple[str, int]]:
        """Archives that no step has taken, as many as the next one may take."""
        taken = {uri for step in self._read_steps() for uri, _ in step}
        new = sorted((uri, size) for uri, size in self.reader.found() if uri not in taken)
        if not self.most_bytes:
            return new
        total, some = 0, []
        for uri, size in new:
            if some and total + size > self.most_bytes:
                break
            some.append((uri, size))
            total += size
        return some

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        """One step on, if archives have arrived. A step that was written down and never run is part of the next batch."""
        new = self._arrived()
        if new:
            fs, path = locate(self.progress)
            fs.create_dir(path, recursive=True)
            place = self._place(len(self.steps) + 1)
            with fs.open_output_stream(place + ".tmp") as out:
                out.write(json.dumps(new).encode())
            fs.move(place + ".tmp", place)
        return {"step": len(self._read_steps())}

    def partitions(self, start: dict, end: dict) -> list:
        taken = [(uri, size) for step in self._read_steps()[start["step"] : end["step"]] for uri, size in step]
        return self.reader.packed_partitions(taken)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)
