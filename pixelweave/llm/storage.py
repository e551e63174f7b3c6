"""Files of our own formats in whatever store the shared folder's address names."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_store(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of an address such as file:, hdfs: or s3:."""
    if "://" not in address and not address.startswith("file:"):
        return pafs.LocalFileSystem(), address
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    return pafs.FileSystem.from_uri(address)


def write_whole(address: str, write) -> int:
    """Let ``write(stream)`` fill a file that appears under its name only when complete.

    Attempts of a rerun or speculative task write apart; the last move wins and
    all write the same bytes.
    """
    store, path = open_store(address)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    attempt = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        write(out)
        size = out.tell()
    store.move(attempt, path)
    return size
