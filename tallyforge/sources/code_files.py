"""A data source that writes generated code as files: CWE/uuid/run_N/code_iterN.v or .c below a folder.

``spark.dataSource.register(CodeFiles)``, then ``df.write.format("code_files").mode("append").save(folder)``. The folder
must be one that driver and executors mount alike; where only Spark reaches a store, use ``sinks.write_code``.

Tasks write below a folder of their own in a staging folder of the job. Commit moves the files of the tasks that Spark
accepted, one rename each on the driver, and removes the staging folder; a task that is killed or runs twice, and a job
that fails, leave nothing. The same file written again replaces the one before.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "cwe_id string, uuid string, run_index int, iteration int, language string, code string"


def relative_path(row: Row) -> str:
    """The place of a row's file; names that would leave their folder are refused. A null run or iteration is 0."""
    names = [str(row["cwe_id"]), str(row["uuid"])]
    if any(n in ("", ".", "..", "None") or "/" in n or "\0" in n for n in names):
        raise ValueError(f"no folder name: {names}")
    ending = "v" if row["language"] == "verilog" else "c"
    return os.path.join(*names, f"run_{row['run_index'] or 0}", f"code_iter{row['iteration'] or 0}.{ending}")


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: its folder, and the files below it."""

    folder: str
    files: list[str]


class CodeFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = os.path.join(path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Staged:
        folder, files = os.path.join(self.staging, uuid.uuid4().hex), {}
        for row in iterator:
            name = relative_path(row)
            where = os.path.join(folder, name)
            os.makedirs(os.path.dirname(where), exist_ok=True)
            with open(where, "w", encoding="utf-8", newline="") as f:
                f.write(row["code"] or "")
            files[name] = None
        return Staged(folder, list(files))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite and os.path.isdir(self.path):
            for name in os.listdir(self.path):
                if not name.startswith("_staging-"):
                    where = os.path.join(self.path, name)
                    shutil.rmtree(where) if os.path.isdir(where) else os.remove(where)
        for message in messages:
            for name in message.files if message else ():
                where = os.path.join(self.path, name)
                os.makedirs(os.path.dirname(where), exist_ok=True)
                os.replace(os.path.join(message.folder, name), where)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class CodeFiles(DataSource):
    """Rows (SCHEMA) as code files."""

    @classmethod
    def name(cls) -> str:
        return "code_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {c.split()[0] for c in SCHEMA.split(", ")} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return CodeFileWriter(self.options["path"], overwrite)
