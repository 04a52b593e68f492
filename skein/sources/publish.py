"""Puts a finished folder in the place of another, with a journal from which a stopped writer's work is taken up again.

Each step begins with an entry of the journal, a small file that is created without overwriting beside the folder:
`staged` (the new folder is whole), `retire` (the old one is being set aside), `place` (the new one is being put in
its place), `placed` (the old one goes). recover() reads the last entry and goes on from there: work that was never
staged goes away, staged work is put in place. Two writers of one folder can't both stage, so one of them fails.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

PHASES = ("begin", "staged", "retire", "place", "placed")


class PublishError(RuntimeError):
    pass


class Journal:
    """The journal of a folder, and the moves that it tells of."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.root = f"{self.folder}.journal"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def there(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _move(self, path: str, to: str) -> None:
        if not self._fs.rename(self._path(path), self._path(to)):
            raise PublishError(f"{path} could not be moved to {to}")

    def _note(self, phase: str, told: dict[str, str]) -> None:
        try:
            out = self._fs.create(self._path(f"{self.root}/{PHASES.index(phase)}-{phase}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise PublishError(f"{self.folder} is being published by another writer, or needs recover()") from e
            raise
        out.write(bytearray((json.dumps(told | {"phase": phase}) + "\n").encode()))
        out.close()

    def last(self) -> dict[str, str] | None:
        """The last entry that was written whole."""
        found = None
        for phase in PHASES:
            path = f"{self.root}/{PHASES.index(phase)}-{phase}.json"
            if self.there(path):
                text = self.spark.read.text(path, wholetext=True).first()
                if text is not None and text[0].endswith("\n"):
                    found = json.loads(text[0])
        return found

    def begin(self) -> dict[str, str]:
        """Names of the folders that a new publication stages in and sets the old one aside in."""
        mark = uuid.uuid4().hex[:8]
        told = {"staged": f"{self.folder}.staged-{mark}", "old": f"{self.folder}.old-{mark}"}
        self._note("begin", told)
        return told

    def give_up(self, told: dict[str, str]) -> None:
        self._drop(told["staged"])
        self._drop(self.root)

    def finish(self, told: dict[str, str]) -> None:
        """From a staged folder to a placed one; each step may have been taken already."""
        names = {"staged": told["staged"], "old": told["old"]}
        at = PHASES.index(told["phase"]) if "phase" in told else 0
        if at < 1:
            self._note("staged", names)
        if at < 2:
            self._note("retire", names)
        if at < 3:
            if self.there(self.folder) and not self.there(names["old"]) and self.there(names["staged"]):
                self._move(self.folder, names["old"])
            self._note("place", names)
        if at < 4:
            if not self.there(self.folder):
                self._move(names["staged"], self.folder)
            self._note("placed", names)
        self._drop(names["old"])
        self._drop(names["staged"])
        self._drop(self.root)


def recover(spark: SparkSession, folder: str) -> str | None:
    """Takes up what a stopped writer of a folder left: 'undone' or 'done', or null if there was nothing."""
    journal = Journal(spark, folder)
    if not journal.there(journal.root):
        return None
    told = journal.last()
    if told is None or told["phase"] == "begin":
        if told is not None:
            journal._drop(told["staged"])
        journal._drop(journal.root)
        return "undone"
    journal.finish(told)
    return "done"
