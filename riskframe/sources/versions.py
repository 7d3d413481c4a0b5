"""Versioned publishing: all outputs of a build or none, and names that move by compare-and-set.

A build writes to a folder of its own, ``<root>/versions/<n>-<token>``; only then does a small pointer file
``<root>/commits/<n>`` name that folder. Pointers are created, never changed: the store's create-if-absent decides
between writers that want the same number. Readers go through the newest pointer, so a build that broke half-way is never
seen, and a published version stays readable while and after the next one is built.

Aliases (such as the champion model) are pointers too, numbered per alias; moving one from what the caller has seen
is refused if somebody else moved it first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from riskframe.sources.io import delete_folder, _file_system


class Conflict(RuntimeError):
    """Somebody else committed first."""


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if it exists already."""
    fs, p = _file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _log(spark: SparkSession, folder: str) -> dict[int, str]:
    """{number: text} of the pointers in a folder; one that is being written (empty) does not count."""
    fs, p = _file_system(spark, folder)
    if not fs.exists(p):
        return {}
    found = {int(f.getPath().getName()): f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(p) if f.getLen() and f.getPath().getName().isdigit()}
    return {n: _read(spark, path) for n, path in found.items()}


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """{version: folder} of all published versions."""
    root = root.rstrip("/")
    return {n: f"{root}/versions/{name}" for n, name in sorted(_log(spark, f"{root}/commits").items())}


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest published version, None before the first."""
    found = versions(spark, root)
    return found[max(found)] if found else None


def folder_of(spark: SparkSession, root: str, version: int | None = None) -> str:
    """Folder of a published version (the newest by default)."""
    found = versions(spark, root)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no published version {'' if version is None else version} under {root}")
    return found[max(found) if version is None else version]


def publish(spark: SparkSession, root: str, write: Callable[[str], None], expected: int | None = None) -> int:
    """Run ``write(folder)`` and publish the folder as the next version; returns its number.

    If ``write`` fails nothing is published and its folder is removed. With ``expected`` (the version the caller built
    upon, 0 for none) another version published meanwhile raises ``Conflict``; without, the next free number is taken.
    """
    root = root.rstrip("/")
    newest = max(versions(spark, root), default=0)
    if expected is not None and newest != expected:
        raise Conflict(f"version {newest} of {root} is published, {expected} was expected")
    name = f"{newest + 1}-{uuid.uuid4().hex[:12]}"
    try:
        write(f"{root}/versions/{name}")
    except BaseException:
        delete_folder(spark, f"{root}/versions/{name}")
        raise
    number = newest + 1
    while not _create(spark, f"{root}/commits/{number}", name):
        if expected is not None:
            delete_folder(spark, f"{root}/versions/{name}")
            raise Conflict(f"version {number} of {root} was published by another writer")
        number += 1
    return number


def alias_state(spark: SparkSession, root: str, alias: str) -> tuple[int, int | None]:
    """(number of the alias's last move, version it points to)."""
    moves = _log(spark, f"{root.rstrip('/')}/aliases/{alias}")
    return (max(moves), int(moves[max(moves)])) if moves else (0, None)


def set_alias(spark: SparkSession, root: str, alias: str, version: int, expected: int | None = None) -> None:
    """Point ``alias`` at a published version; ``expected`` is the version it pointed to when the caller decided (None: nothing)."""
    folder_of(spark, root, version)
    move, now = alias_state(spark, root, alias)
    if now != expected or not _create(spark, f"{root.rstrip('/')}/aliases/{alias}/{move + 1}", str(version)):
        raise Conflict(f"{alias} of {root} has moved")
