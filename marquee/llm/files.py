"""Binary files in the shared folder, written and read by tasks (pyarrow's file systems: local, HDFS, object stores)."""

from __future__ import annotations

import re


def opened(uri: str):
    """File system and path of ``uri``."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def attempt_name() -> str:
    from pyspark import TaskContext

    c = TaskContext.get()
    return f".attempt-{c.taskAttemptId()}" if c else ".attempt-0"


class Writer:
    """A file that appears under its name only when complete; a lost or repeated task leaves at most a hidden attempt."""

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        folder, _, name = self.path.rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        self.temp = f"{folder}/.{name}{attempt_name()}"
        self.out = self.fs.open_output_stream(self.temp)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)
