"""Plain files in the shared folder, on any store that pyarrow opens by URI (file, hdfs, s3, gs)."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def make_folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def put(uri: str, content: bytes) -> int:
    store, path = opened(uri)
    with store.open_output_stream(path, compression=None) as f:  # a name like x.gz must not pack it again
        f.write(content)
    return len(content)


class Reader:
    """Random access by byte ranges."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self._file = store.open_input_file(path)
        self.size = self._file.size()

    def read(self, start: int, length: int) -> bytes:
        return self._file.read_at(max(0, min(length, self.size - start)), start) if start < self.size else b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()
