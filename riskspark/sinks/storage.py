"""Small file-system steps around written tables: notes beside the data, renames, removal."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

NOTE = "_note-"  # names that start with an underscore are no data to Spark's readers


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _notes(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    return sorted((int(n.removeprefix(NOTE)), n) for n in _names(spark, path) if n.startswith(NOTE))


def read_note(spark: SparkSession, path: str, back: int = 0) -> tuple[int, dict | None]:
    """Number and content of the newest note (or the one ``back`` notes before it); (0, None) without.

    A folder that holds data but no note, and a note that cannot be read, are errors: whoever took
    them for an empty table would write over what is there.
    """
    notes = _notes(spark, path)
    if not notes and any(n[0] not in "_." for n in _names(spark, path)):
        raise ValueError(f"{path} holds data but no note: it is no such table, or its notes are lost")
    if len(notes) <= back:
        return 0, None
    number, name = notes[-1 - back]
    fs, note = _fs(spark, f"{path}/{name}")
    stream = fs.open(note)
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError as error:
        raise ValueError(f"{path}/{name} is damaged") from error
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, number: int, note: dict | None) -> None:
    """Add a note: written aside and renamed, so it appears whole or not at all. Two older ones stay.

    A number that is taken means that someone else wrote to the table meanwhile.
    """
    fs, aside = _fs(spark, f"{path}/_{uuid.uuid4().hex}")
    _, final = _fs(spark, f"{path}/{NOTE}{number:010d}")
    stream = fs.create(aside, True)
    stream.write(json.dumps(note).encode())
    stream.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise ValueError(f"{final} exists: another job wrote to the table")
    for older, name in _notes(spark, path):
        if older < max(number - 2, min(number, 1)):
            remove(spark, f"{path}/{name}")


def claim(spark: SparkSession, path: str) -> None:
    """Mark a new table's folder before its first rows, so that a first load that dies can be repeated.

    The mark is note 0 without content; the first real note takes it away.
    """
    if not _notes(spark, path):
        write_note(spark, path, 0, None)


ASIDE, REPLACED = "_replaced-", ".replaced"


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, jpath = _fs(spark, path)
        fs.delete(jpath, True)


def _leaf_folders(fs, folder, depth: int) -> list:
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]
    if depth == 1:
        return found
    return [leaf for part in found for leaf in _leaf_folders(fs, part, depth - 1)]


def recover_partitions(spark: SparkSession, path: str, depth: int = 1) -> None:
    """Finish what a job left that died while it swapped partition folders.

    A folder that was moved aside goes back if nothing took its place, and is removed otherwise.
    """
    for name in _names(spark, path):
        if name.startswith(ASIDE):
            fs, aside = _fs(spark, f"{path}/{name}")
            for old in _leaf_folders(fs, aside, depth):
                _, place = _fs(spark, f"{path}/{_relative(aside, old)}")
                fs.mkdirs(place.getParent())
                if not fs.exists(place) and not fs.rename(old, place):
                    raise OSError(f"cannot move {old} back")
            fs.delete(aside, True)


def _relative(folder, below) -> str:
    return below.toUri().getPath()[len(folder.toUri().getPath()) + 1 :]


def swap_partitions(spark: SparkSession, staged: str, path: str, depth: int = 1) -> None:
    """Put the staged partition folders in the place of the same folders of a table.

    Renames only: the rows are written once, as the staged folders. A replaced folder is moved aside
    first and removed last, so at no moment are both versions gone, and a job that dies in between
    is made good by the next one.
    """
    recover_partitions(spark, path, depth)
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, path)
    fs.mkdirs(target)
    source = fs.resolvePath(source)
    aside = spark._jvm.org.apache.hadoop.fs.Path(target, f"{ASIDE}{uuid.uuid4().hex}")
    for folder in _leaf_folders(fs, source, depth):
        relative = _relative(source, folder)
        place = spark._jvm.org.apache.hadoop.fs.Path(target, relative)
        if fs.exists(place):
            old = spark._jvm.org.apache.hadoop.fs.Path(aside, relative)
            fs.mkdirs(old.getParent())
            if not fs.rename(place, old):
                raise OSError(f"cannot move {place} aside")
        fs.mkdirs(place.getParent())
        if not fs.rename(folder, place):
            raise OSError(f"cannot move {folder} into place")
    fs.delete(aside, True)
    fs.delete(source, True)


def add_files(spark: SparkSession, staged: str, path: str, depth: int) -> None:
    """Move the files of staged partition folders beside those of the same folders of a table."""
    fs, source = _fs(spark, staged)
    source = fs.resolvePath(source)
    for folder in _leaf_folders(fs, source, depth):
        _, place = _fs(spark, f"{path}/{_relative(source, folder)}")
        fs.mkdirs(place)
        for status in fs.listStatus(folder):
            file = status.getPath()
            if not fs.rename(file, spark._jvm.org.apache.hadoop.fs.Path(place, file.getName())):
                raise OSError(f"cannot move {file} into {place}")
    fs.delete(source, True)


def replace_folder(spark: SparkSession, staged: str, path: str) -> None:
    """Put a staged folder in the place of another, which stays aside until the new one stands."""
    recover_folder(spark, path)
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, path)
    _, aside = _fs(spark, path + REPLACED)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"cannot move {staged} into place")
    fs.delete(aside, True)


def recover_folder(spark: SparkSession, path: str) -> None:
    """Finish what a job left that died while it replaced the folder."""
    fs, target = _fs(spark, path)
    _, aside = _fs(spark, path + REPLACED)
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        elif not fs.rename(aside, target):
            raise OSError(f"cannot move {path}{REPLACED} back")
