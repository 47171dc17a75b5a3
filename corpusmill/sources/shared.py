"""Files in the folder that the driver and all executors share, on any store that pyarrow opens by URI (file, hdfs, s3, gs)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir. Where that is unset, a local session takes a temporary folder; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def make_folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def listed(uri: str, ending: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder in the order of their names; hidden ones (`_`, `.`) are left out. Paths are of the URI's store."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = store.get_file_info(fs.FileSelector(path))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")) and i.base_name.endswith(ending))


class Replacement:
    """A file that is there in whole under its name once it is closed; a task that runs again writes the same one again."""

    def __init__(self, uri: str):
        self.store, self.path = opened(uri)
        head, _, name = self.path.rpartition("/")
        self.hidden = f"{head}/_{name}.{uuid.uuid4().hex}"
        self.stream = self.store.open_output_stream(self.hidden, compression=None)

    def write(self, content: bytes) -> None:
        self.stream.write(content)

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.hidden, self.path)
