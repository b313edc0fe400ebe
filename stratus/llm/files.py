"""Files that tasks write and read themselves, in the folder all executors share."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file URI, or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class NewFile:
    """A file of a new name in ``folder``: a task that runs again writes another one, and
    only the names that finished tasks return are read."""

    def __init__(self, folder: str, suffix: str):
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}{suffix}"
        self.uri, self.out, self.size = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None), 0

    def write(self, data: bytes) -> int:
        """Appends; returns where the data begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


def opened(uri: str):
    """A file for reading at any place."""
    store, path = filesystem(uri)
    return store.open_input_file(path)
