"""Folders of files that tasks write and one commit makes visible: what writers of this library share.

A task writes below `_staging/<job>`, under a name of its own, and sends the names back. The commit moves the files into the folder and then writes one small
file below `_commits` that lists them; readers open what commits list and nothing else. So a task that is killed, runs twice, or a job that fails leaves
no file that a reader sees. An overwrite is one commit that says so: what came before it does not count, and is removed after it.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql.datasource import WriterCommitMessage


def local(path: str) -> str:
    """The path of a folder that driver and executors have mounted."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"files are read and written by their path, so the folder must be mounted, not {path}")
    return path


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: for each its name, rows, bytes and whatever lets readers pass over it."""

    files: list[dict] = field(default_factory=list)


class Folder:
    """One such folder."""

    def __init__(self, path: str) -> None:
        self.path = local(path)

    def files(self) -> list[dict]:
        """What commits list, in the order of the commits."""
        found: list[dict] = []
        commits = f"{self.path}/_commits"
        for name in sorted(os.listdir(commits)) if os.path.isdir(commits) else []:
            if name.endswith(".json"):
                with open(f"{commits}/{name}", encoding="utf-8") as f:
                    commit = json.load(f)
                found = commit["files"] if commit["overwrite"] else found + commit["files"]
        return found


class Job:
    """One write into a folder. Made on the driver, carried to the tasks."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.id = local(path), overwrite, uuid.uuid4().hex
        self.staging = f"{self.path}/_staging/{self.id}"

    @contextmanager
    def file(self, suffix: str) -> Iterator[tuple[str, BinaryIO]]:
        """A new file of a task: its name and an open handle."""
        os.makedirs(self.staging, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}{suffix}"
        with open(f"{self.staging}/{name}", "xb") as f:
            yield name, f

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        before = Folder(self.path).files() if self.overwrite else []
        for f in files:
            for name in (f["name"], *f.get("beside", ())):
                os.replace(f"{self.staging}/{name}", f"{self.path}/{name}")
        commits = f"{self.path}/_commits"
        os.makedirs(commits, exist_ok=True)
        with open(f"{commits}/.{self.id}", "w", encoding="utf-8") as out:
            json.dump({"overwrite": self.overwrite, "files": files}, out)
        os.replace(f"{commits}/.{self.id}", f"{commits}/{time.time_ns():020d}-{self.id}.json")
        self.abort()
        for f in before:
            for name in (f["name"], *f.get("beside", ())):
                if os.path.exists(f"{self.path}/{name}"):
                    os.remove(f"{self.path}/{name}")

    def abort(self) -> None:
        """Remove what the tasks of this job have staged, whether they ended or not."""
        shutil.rmtree(self.staging, ignore_errors=True)
