"""Commits beside a table: readers see what is named in them, and nothing half written.

A commit is one small file, ``_manifest/<number>.json``, made by exclusive creation. It sets names
to values; a later commit may set them again, or to nothing. Data is written to a folder of its own
first and then named, so a job that fails in between leaves what readers saw before, and nothing is
ever deleted to make room. Every 64th commit repeats all names, so that readers need no more files.

For one writer at a time. Values are small: what is named is a folder, not its rows.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

SNAPSHOT_EVERY = 64


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._read = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        self.root, self.folder = root, self._path(f"{root}/_manifest")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.files.exists(self.folder)

    def _numbers(self) -> list[int]:
        if not self.exists():
            return []
        names = (status.getPath().getName() for status in self.files.listStatus(self.folder))
        return sorted(int(name[:-5]) for name in names if name.endswith(".json"))

    def _commit_of(self, number: int) -> dict | None:
        stream = self.files.open(self._path(self.folder, f"{number:020d}.json"))
        try:
            return json.loads(self._read(stream))
        except json.JSONDecodeError:  # its writer died: not a commit
            return None
        finally:
            stream.close()

    def _load(self) -> tuple[int, dict]:
        numbers, commits = self._numbers(), []
        for number in reversed(numbers):
            commit = self._commit_of(number)
            if commit is not None:
                commits.append(commit)
                if commit["all"]:
                    break
        names: dict = {}
        for commit in reversed(commits):
            names = {} if commit["all"] else names
            names.update(commit["set"])
        return numbers[-1] if numbers else 0, {k: v for k, v in names.items() if v is not None}

    def names(self) -> dict:
        """What is named now."""
        return self._load()[1]

    def commit(self, changes: dict, *, replace_all: bool = False) -> None:
        """Set names to values, ``None`` to take one out; ``replace_all`` takes out all others."""
        number, names = self._load()
        whole = replace_all or (number + 1) % SNAPSHOT_EVERY == 0
        if whole and not replace_all:
            changes = {k: v for k, v in (names | changes).items() if v is not None}
        stream = self.files.create(self._path(self.folder, f"{number + 1:020d}.json"), False)
        try:
            stream.write(bytearray(json.dumps({"all": whole, "set": changes}).encode()))
        finally:
            stream.close()
