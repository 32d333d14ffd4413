"""Binary files in the shared folder, written by executors and read again by others."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs

from loomtext.plans.runtime import filesystem


@contextmanager
def new_file(uri: str) -> Iterator[BinaryIO]:
    """A file that appears under its name only when whole, so that a task may be tried again."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as out:
            yield out
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).type == fs.FileType.File:
            system.delete_file(part)
        raise


def open_file(uri: str):
    """A seekable file."""
    system, path = filesystem(uri)
    return system.open_input_file(path)


def files_in(folder: str, ending: str) -> list[str]:
    """The whole files of a folder, in order of name; none if there is no such folder."""
    system, path = filesystem(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f"{folder}/{x.base_name}" for x in found if x.type == fs.FileType.File and x.base_name.endswith(ending))


def give_back() -> None:
    """At a task's end: its worker goes on to other tasks, and what Arrow and malloc keep for later would count against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
