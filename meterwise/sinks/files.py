"""Files on any file system that a path or URL names."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs as arrow_fs

from ..options import BadSetting

#: The kinds of places where reports and exports may go.
SCHEMES = ("file", "s3", "s3a", "gs", "hdfs", "viewfs", "mock")


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it. s3a is s3."""
    scheme, there, _ = path.partition("://")
    if there and scheme not in SCHEMES:
        raise BadSetting(f"no place of the kind {scheme}; those known are {', '.join(SCHEMES)}")
    if not there:
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def exists(path: str) -> bool:
    where, file = file_system(path)
    return where.get_file_info(file).type != arrow_fs.FileType.NotFound


def read_text(path: str) -> str:
    where, file = file_system(path)
    with where.open_input_stream(file) as source:
        return source.read().decode()


def write_text(path: str, text: str) -> None:
    where, file = file_system(path)
    where.create_dir(file.rpartition("/")[0] or "/", recursive=True)
    with where.open_output_stream(file) as out:
        out.write(text.encode())


def create_text(path: str, text: str) -> bool:
    """Writes a file that is whole or not there; False if another has written it before.

    On a local file system the complete file gets its name by a link, which fails if the name is taken; elsewhere Hadoop's
    file system creates it without overwriting, in a driver's session.
    """
    where, file = file_system(path)
    if not isinstance(where, arrow_fs.LocalFileSystem):
        return _create_by_hadoop(path, text)
    os.makedirs(os.path.dirname(file) or "/", exist_ok=True)
    part = f"{os.path.dirname(file)}/.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(part, file)
    except FileExistsError:
        return False
    finally:
        os.remove(part)
    return True


def _create_by_hadoop(path: str, text: str) -> bool:
    from pyspark.errors.exceptions.captured import Py4JJavaError
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        out = store.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()) or store.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def names_in(path: str, folders: bool = False) -> list[str]:
    """The names of the files, or folders, in a folder; none if there is no such folder."""
    where, root = file_system(path)
    kind = arrow_fs.FileType.Directory if folders else arrow_fs.FileType.File
    return sorted(x.base_name for x in where.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)) if x.type == kind and not x.base_name.startswith("."))


def url(path: str) -> str:
    """The path as a URL, for readers that take nothing else."""
    return path if "://" in path else f"file://{path}"
