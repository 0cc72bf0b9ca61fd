"""Writing of files in gzip blocks (BGZF), in any store that Arrow's file systems reach.

Every task writes its rows below ``_temporary``; what attempts that failed left there goes
with the folder, when the job is committed or aborted.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from strandloom.sources.bgzf import CONTENT, END, compressed
from strandloom.sources.ranges import STEP, located

#: Contents that are compressed at once.
BUFFER = 64 * CONTENT


class Written(WriterCommitMessage):
    def __init__(self, part: int, name: str) -> None:
        self.part, self.name = part, name


class BlockWriter(DataSourceArrowWriter):
    """Files ``part-00000.suffix`` and on in a folder, one for each task, each whole; or one file.

    With ``single`` the tasks' files hold blocks alone, and the commit puts them together, in
    the order of the tasks, after the blocks of ``head`` and before the end marker. That copy
    is made by one process in pieces of fixed size.
    """

    def __init__(self, path: str, suffix: str, head: bytes, content: Callable[[pa.RecordBatch], Iterator[bytes]], single: bool) -> None:
        self.path, self.suffix, self.head, self.content, self.single = path, suffix, head, content, single
        self.job = uuid.uuid4().hex
        self.folder = posixpath.join(posixpath.dirname(path) if single else path, "_temporary", self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = located(self.folder)
        store.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{folder}/{name}") as f:
            held, n = ([], 0) if self.single else ([self.head], len(self.head))
            for batch in iterator:
                for data in self.content(batch):
                    held, n = [*held, data], n + len(data)
                    if n >= BUFFER:
                        whole = b"".join(held)
                        cut = len(whole) // CONTENT * CONTENT
                        f.write(compressed(whole[:cut]))
                        held, n = [whole[cut:]], len(whole) - cut
            f.write(compressed(b"".join(held)))
            if not self.single:
                f.write(END)
        return Written(TaskContext.get().partitionId(), name)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = located(self.folder)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        if self.single:
            with store.open_output_stream(f"{folder}/whole") as out:
                out.write(compressed(self.head))
                for m in parts:
                    with store.open_input_stream(f"{folder}/{m.name}") as f:
                        while data := f.read(STEP):
                            out.write(data)
                out.write(END)
            store.move(f"{folder}/whole", located(self.path)[1])
        else:
            for m in parts:
                store.move(f"{folder}/{m.name}", f"{located(self.path)[1]}/part-{m.part:05d}-{self.job}.{self.suffix}")
        self.cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self.cleared()

    def cleared(self) -> None:
        """Remove the job's folder, and ``_temporary`` if no other job has one in it."""
        store, folder = located(self.folder)
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)
        above = posixpath.dirname(folder)
        if store.get_file_info(above).type == pafs.FileType.Directory and not store.get_file_info(pafs.FileSelector(above)):
            store.delete_dir(above)
