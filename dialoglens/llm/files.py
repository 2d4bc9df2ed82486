"""Files that tasks write to and read from a folder that all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_whole(uri: str, parts: list[bytes]) -> None:
    """Write a file under its final name only when it is complete, so that a repeated task replaces it by the same."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    store.move(draft, path)


def read_whole(uri: str) -> memoryview:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return memoryview(file.read_buffer())
