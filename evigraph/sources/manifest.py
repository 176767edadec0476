"""Numbered manifests: the versions of a folder that several writers change.

A version is a small JSON file that is created only if no other writer has created it, whole or not at all. A reader takes
the last version and reads what it names, which is never changed. A writer that finds its number taken looks at the new
version and tries again on top of it."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_NAME = re.compile(r"v-(\d{10})\.json")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, folder: str) -> None:
    fs, p = _path(spark, folder)
    fs.delete(p, True)


def age(spark: SparkSession, folder: str) -> float:
    """Seconds since a folder was changed."""
    fs, p = _path(spark, folder)
    return spark._jvm.java.lang.System.currentTimeMillis() / 1000 - fs.getFileStatus(p).getModificationTime() / 1000


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file is now there with this text; False if it was there. The name appears with all of the text: by a
    link on a POSIX file system, elsewhere by a rename, which doesn't replace a file."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    draft = f"{path}.{uuid.uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        there = p.toUri().getPath()
        mine = f"{there}.{uuid.uuid4().hex}"
        with open(mine, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(mine, there)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(mine)
    _, d = _path(spark, draft)
    out = fs.create(d, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(p) and fs.rename(d, p):
        return True
    fs.delete(d, False)
    return False


def version(spark: SparkSession, folder: str, n: int | None = None) -> tuple[int, dict]:
    """The number and content of the last version, or of version n; 0 and nothing if there is none."""
    if n is None:
        n = max((int(m[1]) for x in names(spark, folder) if (m := _NAME.fullmatch(x))), default=0)
    if not n:
        return 0, {}
    fs, p = _path(spark, f"{folder}/v-{n:010d}.json")
    stream = fs.open(p)
    try:
        return n, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(m[1]) for x in names(spark, folder) if (m := _NAME.fullmatch(x))]


def change(spark: SparkSession, folder: str, step: Callable[[int, dict], dict | None], tries: int = 100) -> tuple[int, dict]:
    """step(number, content) gives the next content, or None if nothing is to be done. Called again on the version of
    another writer that was faster. Gives the version that holds then."""
    for _ in range(tries):
        n, held = version(spark, folder)
        new = step(n, held)
        if new is None:
            return n, held
        if _create(spark, f"{folder}/v-{n + 1:010d}.json", json.dumps(new, sort_keys=True)):
            return n + 1, new
    raise RuntimeError(f"{folder}: {tries} versions of other writers came first")
