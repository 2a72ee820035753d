"""Data sources for source trees and Git history.

``source_tree`` lists a tree with pruning and reads files as partitions of
about ``PART_BYTES``; the driver opens folders until there are ``FOLDERS`` of
them, and tasks list what lies below. Spark's own file reader can't serve here, as it passes
over names that begin with a dot or an underscore. ``git_log`` reads commits of
one or more repositories, a partition to each. Paths must be visible to driver
and executors.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that a scan leaves out, besides all that begin with a dot but .git (fixed values).
EXCLUDED_DIRS = (
    "node_modules", "__pycache__", "build", "dist", "venv", "target", "out", "site-packages", "vendor", "third_party", "deps",
    "analysis", "tmp_scan_output", "scan_output", "reports", "outputs", "dist-info", "__generated__",
)
#: Endings that a scan leaves out (fixed values).
EXCLUDED_ENDS = (".pyc", ".pyo", ".class", ".so", ".min.js", ".bundle.js", ".map", ".coverage", "coverage.xml")
#: Bytes of files that one partition reads.
PART_BYTES = 64 << 20
#: Folders that the driver leaves to tasks at once.
FOLDERS = 512

TREE_DDL = "rel_path string, size long, content string"
LOG_DDL = (
    "repository string, sha string, parents array<string>, author string, email string, committed timestamp, "
    "message string, insertions long, deletions long"
)


def kept_dir(name: str) -> bool:
    return name not in EXCLUDED_DIRS and (name == ".git" or not name.startswith("."))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        super().__init__(len(files))
        self.files = files


class _Folder(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root.rstrip("/"), folders

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    @staticmethod
    def _listed(store, base: str, folder: str) -> tuple[list[str], list[tuple[str, str, int]]]:
        """Folders and files of a folder that a scan doesn't leave out."""
        from pyarrow import fs

        inside, files = [], []
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.Directory:
                if kept_dir(info.base_name):
                    inside.append(info.path)
            elif not info.base_name.endswith(EXCLUDED_ENDS):
                files.append((info.path, info.path[len(base) :].lstrip("/"), info.size))
        return inside, files

    def partitions(self) -> list[InputPartition]:
        store, base = self._open()
        todo, found = [base], []
        while todo and len(todo) < self.folders:
            inside, files = self._listed(store, base, todo.pop(0))
            todo += inside
            found += files
        parts, held, size = [_Folder(f) for f in todo], [], 0
        for item in sorted(found, key=lambda x: x[1].encode()):
            held.append(item)
            size += item[2]
            if size >= PART_BYTES:
                parts.append(_Files(held))
                held, size = [], 0
        return [*parts, _Files(held)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, base = self._open()
        todo, files = ([partition.path], []) if isinstance(partition, _Folder) else ([], partition.files)
        while todo or files:
            for path, rel, size in files:
                with store.open_input_stream(path) as f:
                    yield rel, size, f.read().decode("utf-8", "ignore")
            inside, files = self._listed(store, base, todo.pop()) if todo else ([], [])
            todo += inside


class SourceTree(DataSource):
    """Files of a tree: ``spark.read.format("source_tree").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE_DDL

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], int(self.options.get("folders", FOLDERS)))


class _Repository(InputPartition):
    pass


class _LogReader(DataSourceReader):
    def __init__(self, paths: list[str], since: str | None):
        self.paths, self.since = paths, since

    def partitions(self) -> list[_Repository]:
        return [_Repository(p) for p in self.paths]

    def read(self, partition: _Repository) -> Iterator[pa.RecordBatch]:
        # Unit and record separators can't occur in the fields before them.
        form = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%ct%x1f%B%x1f"
        call = ["git", "-C", partition.value, "log", "--numstat", f"--format={form}", *([f"--since={self.since}"] if self.since else [])]
        run = subprocess.Popen(call, stdout=subprocess.PIPE, encoding="utf-8", errors="replace")
        rows: list[tuple] = []
        for record in _records(run.stdout):
            sha, parents, author, email, seconds, message, stats = record.split("\x1f", 6)
            numbers = [line.split("\t")[:2] for line in stats.splitlines() if "\t" in line]
            added, removed = (sum(int(n[i]) for n in numbers if n[i].isdigit()) for i in (0, 1))
            rows.append((partition.value, sha, parents.split(), author, email, int(seconds) * 1_000_000, message, added, removed))
            if len(rows) == 1000:
                yield _log_batch(rows)
                rows = []
        if run.wait():
            raise ValueError(f"git log failed for {partition.value}")
        yield _log_batch(rows)


def _records(stream) -> Iterator[str]:
    """Texts between record separators, one at a time."""
    held = ""
    while block := stream.read(1 << 16):
        *whole, held = (held + block).split("\x1e")
        yield from (x for x in whole if x)
    if held:
        yield held


def _log_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int64(), pa.int64())
    names = ["repository", "sha", "parents", "author", "email", "committed", "message", "insertions", "deletions"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


class GitLog(DataSource):
    """Commits: ``spark.read.format("git_log").option("paths", "a,b").load()``;
    ``since`` is any date that Git takes."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG_DDL

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options["paths"].split(","), self.options.get("since"))


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").load(root)


def git_log(spark: SparkSession, paths: list[str], since: str | None = None) -> DataFrame:
    spark.dataSource.register(GitLog)
    reader = spark.read.format("git_log").option("paths", ",".join(paths))
    return (reader.option("since", since) if since else reader).load()
