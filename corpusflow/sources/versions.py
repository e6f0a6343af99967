"""Versioned folders: a commit without renames, for any store that can create a
file only where there is none."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import files

POINTERS = "_versions"


def _pointers(spark: SparkSession, path: str) -> list[str]:
    fs, p = files._fs(spark, f"{path}/{POINTERS}")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _named(spark: SparkSession, path: str, pointer: str) -> str | None:
    """The folder that a pointer names; null while it isn't written whole."""
    fs, p = files._fs(spark, f"{path}/{POINTERS}/{pointer}")
    try:
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    except Exception:  # Java's not-found error: taken away meanwhile
        if fs.exists(p):
            raise
        return None
    return f"{path}/{text[:-1]}" if text.endswith("\n") else None


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest whole version; null if there is none. What it names
    stays while `keep` - 1 newer versions are published."""
    while True:
        names = _pointers(spark, path)
        for pointer in reversed(names):
            if folder := _named(spark, path, pointer):
                return folder
        if names == _pointers(spark, path):
            return None


def publish(spark: SparkSession, path: str, write: Callable[[str], object], keep: int = 3, replace: bool = True) -> str:
    """Let `write` fill a new folder under path, then make it the current version.

    The commit is the creation of the next pointer, which fails where another
    writer has made it; the loser takes the number after. A reader finds the old
    version or the new one at any moment. Without `replace` an existing version
    is an error. If `write` fails its folder is deleted. The newest `keep`
    versions stay for readers that are under way.
    """
    if not replace and current(spark, path):
        raise FileExistsError(f"target already exists: {path}")
    name = f"data-{uuid.uuid4().hex}"
    try:
        write(f"{path}/{name}")
        while not _claimed(spark, path, name, replace):
            pass
    except BaseException:
        files.delete(spark, f"{path}/{name}")
        raise
    old = [p for p in _pointers(spark, path)[:-keep]]
    for pointer in old:
        if folder := _named(spark, path, pointer):
            files.delete(spark, folder)
        files.delete(spark, f"{path}/{POINTERS}/{pointer}")
    return f"{path}/{name}"


def _claimed(spark: SparkSession, path: str, name: str, replace: bool) -> bool:
    names = _pointers(spark, path)
    if names and not replace:
        raise FileExistsError(f"target already exists: {path}")
    fs, p = files._fs(spark, f"{path}/{POINTERS}/{int(names[-1]) + 1 if names else 0:012d}")
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    try:
        out.write(bytearray(f"{name}\n".encode()))
    finally:
        out.close()
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text as the new version of path."""

    def write(folder: str) -> None:
        fs, p = files._fs(spark, f"{folder}/text")
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    publish(spark, path, write)


def read_text(spark: SparkSession, path: str) -> str:
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(path)
    fs, p = files._fs(spark, f"{folder}/text")
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
