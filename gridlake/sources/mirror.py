"""A sink of whole files: rows (path, body) become files below a folder, those that are new or changed.

Tasks write beside the target, into a staging folder of their own; when all have ended the driver moves the
files to their places. A lost task leaves only its staging folder, a lost job changes nothing.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Staged(WriterCommitMessage):
    """A task's staging folder, and how many files lie in it and how many needed no copy."""

    folder: str
    copied: int
    kept: int


def place(root: str, path: str) -> str:
    """root/path; a path that leads out of root is refused."""
    clean = posixpath.normpath(path)
    if not path or clean in (".", "..") or clean.startswith(("/", "../")):
        raise ValueError(f"{path!r} is no path below the folder")
    return f"{root.rstrip('/')}/{clean}"


class _MirrorWriter(DataSourceWriter):
    def __init__(self, folder: str, missing_only: bool):
        self.folder = folder if "://" in folder else os.path.abspath(folder)
        self.missing_only, self.staging = missing_only, f".staging-{uuid.uuid4().hex}"

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, rows: Iterator[Row]) -> _Staged:
        from pyarrow import fs

        system, root = self._at()
        stage, copied, kept = f"{root}/{self.staging}/{uuid.uuid4().hex}", 0, 0
        for path, body in rows:
            data = bytes(body) if isinstance(body, (bytes, bytearray)) else (body or "").encode()
            target = place(root, path)
            there = system.get_file_info(target)
            if there.type == fs.FileType.File and (self.missing_only or (there.size == len(data) and system.open_input_stream(target).readall() == data)):
                kept += 1
                continue
            aside = place(stage, path)
            system.create_dir(posixpath.dirname(aside), recursive=True)
            with system.open_output_stream(aside) as f:
                f.write(data)
            copied += 1
        return _Staged(stage, copied, kept)

    def commit(self, messages: list[_Staged | None]) -> None:
        from pyarrow import fs

        system, root = self._at()
        for m in messages:
            if m is None or not m.copied:
                continue
            for f in system.get_file_info(fs.FileSelector(m.folder, recursive=True)):
                if f.type == fs.FileType.File:
                    target = f"{root}/{posixpath.relpath(f.path, m.folder)}"
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    system.move(f.path, target)
        self._clean()

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        system, root = self._at()
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class MirrorFolder(DataSource):
    """df.write.format("mirror_folder").option("path", URI).mode("append").save(); columns path (below the folder) and body.

    Option only: "changed" (the default) writes files that are absent or differ, "missing" those that are absent.
    Other files stay. One row a path: of rows with equal paths any may be the one that stays.
    """

    @classmethod
    def name(cls) -> str:
        return "mirror_folder"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["path", "body"]:
            raise ValueError("columns path and body are expected")
        if overwrite:
            raise ValueError("files that aren't given stay; use mode append")
        return _MirrorWriter(self.options["path"], self.options.get("only", "changed") == "missing")
