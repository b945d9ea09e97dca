"""Files by address, read inside tasks.

An address is a plain path or ``scheme:...``; what follows the scheme (and its authority) is taken literally, so names
may hold blanks, ``%`` and ``#``.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
import pyarrow.fs

#: Bytes that are held of a file while it is hashed.
CHUNK = 1 << 18
#: What a file or folder that can't be reached raises.
UNREADABLE = (OSError, pa.ArrowException)


@functools.lru_cache(maxsize=64)
def _system(scheme: str, authority: str) -> tuple[pa.fs.FileSystem, str]:
    if scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), ""
    return pa.fs.FileSystem.from_uri(f"{scheme}://{authority}")


def place(address: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of an address."""
    scheme, authority, path = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]+):)?(?://([^/]*))?(.*)", address).groups()
    system, base = _system(scheme or "", authority or "")
    return system, base.rstrip("/") + path


def digest(address: str, limit: int | None = None) -> tuple[str | None, int | None]:
    """SHA-256 of the first ``limit`` bytes, or of all, and how many bytes that were; nulls where the file can't be read.
    A chunk is held at a time, whatever the file's size."""
    made, done = hashlib.sha256(), 0
    try:
        system, path = place(address)
        with system.open_input_stream(path, compression=None) as f:
            while chunk := f.read(CHUNK if limit is None else min(CHUNK, limit - done)):
                made.update(chunk)
                done += len(chunk)
            return made.hexdigest(), done
    except UNREADABLE:
        return None, None
