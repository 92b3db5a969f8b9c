"""Files in the shared folder, by URI."""

from __future__ import annotations

from pyarrow import fs as pafs


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def new_file(path: str):
    """A stream to a new file, its folder made if it isn't there."""
    fs, local = store(path)
    fs.create_dir(local.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(local, compression=None)


class Ranges:
    """Reads byte ranges; the last file stays open."""

    def __init__(self):
        self.path = self.file = None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            fs, local = store(path)
            self.path, self.file = path, fs.open_input_file(local)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None
