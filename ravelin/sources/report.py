"""A data source for reports: the ``value`` of every row, one after the other, in one file.

    spark.dataSource.register(Report)
    df.write.format("report").mode("overwrite").save(path)

Each task writes its rows to a file beside the target, in their order; the commit
joins the files of the tasks that succeeded, in the order of their partitions, by
copying streams, and removes them.  Rows that are sorted in ranges so make one
sorted file, and neither a task nor the driver holds more than its buffer.  The
path is local or a URI that pyarrow opens; tasks must reach it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


def _opened(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path if "://" in path else os.path.abspath(path)

    def write(self, iterator: Iterator[Row]) -> Part:
        context = TaskContext.get()
        part = Part(context.partitionId(), f"{self.path}.parts/{context.partitionId()}-{context.taskAttemptId()}")
        files, at = _opened(part.path)
        files.create_dir(os.path.dirname(at), recursive=True)
        with files.open_output_stream(at) as out:
            for row in iterator:
                out.write((row[0] or "").encode())
        return part

    def commit(self, messages: list[Part | None]) -> None:
        files, at = _opened(self.path)
        with files.open_output_stream(at) as out:
            for part in sorted((m for m in messages if m), key=lambda m: m.partition):
                with files.open_input_stream(_opened(part.path)[1]) as rows:
                    while piece := rows.read(1 << 20):
                        out.write(piece)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        """Removes what the tasks have written, attempts that failed included."""
        from pyarrow.fs import FileType

        files, at = _opened(f"{self.path}.parts")
        if files.get_file_info(at).type == FileType.Directory:
            files.delete_dir(at)


class Report(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:  # noqa: ARG002
        return ReportWriter(self.options["path"])


def write(pieces: DataFrame, order: list[str], path: str) -> None:
    """``pieces.value`` in the order of the columns, in one file."""
    pieces.sparkSession.dataSource.register(Report)
    ranged = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("value").write.format("report").mode("overwrite").save(path)
