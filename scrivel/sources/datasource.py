"""Documents as a data source of Spark: files are listed once, filtered before any is opened, and dealt out by bytes; a sink that
shows its files only when the whole write has ended well; and new files as a stream.

    spark.dataSource.register(RtfFiles)
    spark.read.format("rtf_files").load("s3://bucket/docs").where("size < 100000 AND path LIKE 'bucket/docs/2024%'")

Files are opened with pyarrow's file systems, by the scheme of the path; where only Hadoop's clients reach a store, use read_files().
Filters on path and size are pushed down if spark.sql.python.filterPushdown.enabled is set. A file beyond limit_bytes, one that
isn't UTF-8, and one that can't be opened have an error and no text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "path string, size long, modified long, rtf string, read_error string"
#: Bytes of files that a task reads, about.
PART_BYTES = 64 << 20
TESTS = {
    EqualTo: lambda a, b: a == b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda a, b: b in a,
}


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit, self.suffix = options["path"], int(options.get("limit_bytes", 10 << 20)), options.get("suffix", ".rtf")
        self.part_bytes, self.filters = int(options.get("part_bytes", PART_BYTES)), []

    def pushFilters(self, filters):
        """Keeps those on path and size; gives back the others."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("path",), ("size",)):
                self.filters.append((f.attribute[0], TESTS[type(f)], f.value))
            else:
                yield f

    def listed(self) -> list[tuple[str, int, int]]:
        from pyarrow import fs

        system, root = store(self.path)
        info = system.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((i.path, i.size, i.mtime_ns or 0) for i in info if i.type == fs.FileType.File and i.path.endswith(self.suffix) and "/_" not in i.path[len(root) :])
        return [x for x in found if all(test({"path": x[0], "size": x[1]}[name], value) for name, test, value in self.filters)]

    def partitions(self):
        return dealt(self.listed(), self.part_bytes)

    def read(self, partition):
        system, _ = store(self.path)
        for path, size, modified in partition.found:
            text = error = None
            if size > self.limit:
                error = "input_too_large"
            else:
                try:
                    with system.open_input_stream(path) as f:
                        text = f.read().decode()
                except UnicodeDecodeError:
                    error = "invalid_utf8"
                except OSError:
                    error = "unreadable"
            yield path, size, modified, text, error


def dealt(found: list[tuple[str, int, int]], most: int) -> list[Files]:
    parts, total = [Files([])], 0
    for x in found:
        if parts[-1].found and total + x[1] > most:
            parts.append(Files([]))
            total = 0
        parts[-1].found.append(x)
        total += x[1]
    return parts


class Stream(DataSourceStreamReader):
    """Files by the time of their last change; each is read once."""

    def __init__(self, options: dict):
        self.files = Reader(options)

    def initialOffset(self):
        return {"modified": -1}

    def latestOffset(self):
        return {"modified": max((m for _, _, m in self.files.listed()), default=-1)}

    def partitions(self, start, end):
        return dealt([x for x in self.files.listed() if start["modified"] < x[2] <= end["modified"]], self.files.part_bytes)

    def read(self, partition):
        return self.files.read(partition)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """One file for each row (path, rtf), below a folder of this write until commit() moves them; names are relative."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        system, root = store(self.path)
        task, names = uuid.uuid4().hex, []
        for row in iterator:
            name = row["path"].lstrip("/")
            if ".." in name.split("/"):
                raise ValueError(f"{name} leaves the folder")
            held = f"{root}/_writing-{self.job}/{task}/{name}"
            system.create_dir(held.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(held) as f:
                f.write((row["rtf"] or "").encode())
            names.append((held, f"{root}/{name}"))
        return Written(names)

    def commit(self, messages):
        from pyarrow import fs

        system, _ = store(self.path)
        moves = [x for m in messages if m for x in m.names]
        there = [i.path for i in system.get_file_info([to for _, to in moves]) if i.type != fs.FileType.NotFound]
        if len({to for _, to in moves}) < len(moves) or there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{len(there)} files exist already, or a name is given twice")
        for held, to in moves:
            system.create_dir(to.rsplit("/", 1)[0], recursive=True)
            system.move(held, to)
        self.abort(messages)  # what is left are attempts that didn't count

    def abort(self, messages):
        from pyarrow import fs

        system, root = store(self.path)
        if system.get_file_info(f"{root}/_writing-{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_writing-{self.job}")


class RtfFiles(DataSource):
    @classmethod
    def name(cls):
        return "rtf_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))

    def streamReader(self, schema):
        return Stream(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def as_documents(files):
    """Rows of the source as documents for parse() and the converters: doc_id is the path."""
    return files.selectExpr("path AS doc_id", "rtf", "read_error")
