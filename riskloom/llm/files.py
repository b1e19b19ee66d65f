"""Binary files on any store that executors reach, written under names of their own for each task attempt."""

from __future__ import annotations

import uuid

from pyarrow import fs


def new_file(folder: str, stem: str, suffix: str):
    """(path, open output stream). A retried or speculative task never shares a name with another attempt; only
    the names that its committed manifest rows carry count."""
    path = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return path, store.open_output_stream(inner, compression=None)


def open_file(path: str):
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)
