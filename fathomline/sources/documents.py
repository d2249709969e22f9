"""Result documents: one JSON document for each condition, with its examples and its aggregate.

A Python data source writes them on the executors. A task writes under a folder of its own;
when all tasks are done the driver moves the documents into place, and if one fails all such
folders go, so a failed write leaves nothing. A condition's examples are streamed one by one
into its file, so no document is ever held in memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

EXAMPLES, AGGREGATE = "per_example", "aggregate"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task and the names of the documents in it."""

    folder: str
    names: tuple[str, ...]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, f"_writing-{uuid.uuid4().hex}"

    def _place(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, rows: Iterator[Row]) -> Written:
        """Rows (name, part, body), the parts of a name together, examples before the aggregate."""
        system, base = self._place(self.path)
        folder, names, out, first = f"{base}/{self.run}/{uuid.uuid4().hex}", [], None, True

        def close(last: str) -> None:
            out.write(f'\n], "{AGGREGATE}": {last}}}\n'.encode())
            out.close()

        last = "null"
        for row in rows:
            if not names or row.name != names[-1]:
                if out is not None:
                    close(last)
                system.create_dir(folder)
                names.append(row.name)
                out, first, last = system.open_output_stream(f"{folder}/{row.name}.json"), True, "null"
                out.write(f'{{"condition": {json.dumps(row.name)}, "{EXAMPLES}": ['.encode())
            if row.part == 1:
                last = row.body
            else:
                out.write((("" if first else ",") + "\n" + row.body).encode())
                first = False
        if out is not None:
            close(last)
        return Written(folder, tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, base = self._place(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{m.folder}/{name}.json", f"{base}/{name}.json")
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._place(self.path))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.run}")


class ResultDocuments(DataSource):
    """Format "result_documents": rows (name, part, body) as one document for each name."""

    @classmethod
    def name(cls) -> str:
        return "result_documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_documents(examples: DataFrame, aggregate: DataFrame, condition: str, path: str) -> None:
    """path/<condition>.json for each condition: {"condition", "per_example": [...], "aggregate": {...}}.

    examples: any number of rows a condition; aggregate: one. Both have the condition column;
    rows without a condition are left out. Documents of the same name are replaced, others
    stay. Examples lie in the order of their columns.
    """
    spark = examples.sparkSession
    spark.dataSource.register(ResultDocuments)

    def bodies(df: DataFrame, part: int) -> DataFrame:
        rest = [c for c in df.columns if c != condition]
        return df.where(F.col(condition).isNotNull()).select(F.col(condition).cast("string").alias("name"), F.lit(part).alias("part"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("body"), F.struct(*rest).alias("key") if part == 0 else F.lit(None).alias("key"))

    rows = bodies(examples, 0).withColumn("n", F.row_number().over(_in_order())).drop("key").unionByName(bodies(aggregate, 1).withColumn("n", F.lit(0)).drop("key"))
    laid = rows.repartition("name").sortWithinPartitions("name", "part", "n").select("name", "part", "body")
    laid.write.format("result_documents").mode("append").option("path", path).save()


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("name").orderBy("key")
