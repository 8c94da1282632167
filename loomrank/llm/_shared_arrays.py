"""Arrays in the folder that driver and executors share, memory-mapped by Python workers."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np

#: Files that a worker keeps mapped at most; the ones used longest ago are let go. The system allows 65,530 maps a process.
OPEN = 8_192
_HEAD = 8


class SharedArrays:
    """Groups of named arrays below a folder URI, one file a group: the file's arrays are mapped at once.

    A ``file:`` folder is written and mapped in place. Any other store is reached through pyarrow's file
    systems; a worker then maps a private copy whose name is removed at once, so nothing stays behind.
    Writes go to a name of their own and are renamed, so a task that is run again or twice does no harm.
    """

    def __init__(self, uri: str):
        self.uri = uri
        part = urlparse(uri)
        self.local = unquote(part.path) if part.scheme in ("", "file") else None
        self._open: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()

    def __getstate__(self):
        return self.uri

    def __setstate__(self, uri):
        self.__init__(uri)

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, **arrays: np.ndarray) -> None:
        """A file starts with the length of its directory, then the directory, then the arrays, each at a multiple of 8."""
        data = {k: np.ascontiguousarray(a) for k, a in arrays.items()}
        place, at = {}, 0
        for k, a in data.items():
            place[k] = (a.dtype.str, len(a), at)
            at += -(-a.nbytes // 8) * 8
        head = json.dumps(place).encode()
        head += b" " * (-len(head) % 8)
        pieces = [len(head).to_bytes(_HEAD, "little"), head]
        for a in data.values():
            pieces += [a.data.cast("B") if a.nbytes else b"", b"\0" * (-a.nbytes % 8)]
        part = f".{name}-{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(os.path.join(self.local, part), "wb") as out:
                for piece in pieces:
                    out.write(piece)
            os.replace(os.path.join(self.local, part), os.path.join(self.local, name))
            return
        store, root = self._remote()
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{part}") as out:
            for piece in pieces:
                out.write(bytes(piece))
        store.move(f"{root}/{part}", f"{root}/{name}")

    def read(self, name: str) -> dict[str, np.ndarray]:
        """The arrays of a group by name."""
        found = self._open.pop(name, None)
        if found is None:
            found = self._map(name)
            while len(self._open) >= OPEN:
                self._open.popitem(last=False)
        self._open[name] = found
        return found

    def get(self, name: str) -> dict[str, np.ndarray] | None:
        """The arrays of a group, or None if nobody wrote it; to ask once all writers are done."""
        if name not in self._open:
            try:
                return self.read(name)
            except FileNotFoundError:
                self._open[name] = None
        return self.read(name) if self._open[name] is not None else None

    def _map(self, name: str) -> dict[str, np.ndarray]:
        if self.local is not None:
            raw = np.memmap(os.path.join(self.local, name), dtype=np.uint8, mode="r")
        else:
            store, root = self._remote()
            with store.open_input_stream(f"{root}/{name}") as source, tempfile.TemporaryFile() as copy:
                while block := source.read(1 << 22):
                    copy.write(block)
                copy.flush()
                raw = np.memmap(copy, dtype=np.uint8, mode="r")
        raw = np.asarray(raw)
        size = int.from_bytes(raw[:_HEAD].tobytes(), "little")
        base = _HEAD + size
        place = json.loads(raw[_HEAD:base].tobytes())
        return {k: raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in place.items()}


def least(values: np.ndarray) -> np.ndarray:
    """Unsigned values in the narrowest type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values.astype(np.uint8)


def narrow(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold unsigned values in a byte each; values from 255 on stand in a list beside, in 64 bits."""
    big = np.flatnonzero(values >= 255)
    small = values.astype(np.uint8)
    small[big] = 255
    return {name: small, f"{name}.at": big.astype(np.int64), f"{name}.big": values[big].astype(np.int64)}


def widened(group: dict[str, np.ndarray], name: str, at: np.ndarray | slice) -> np.ndarray:
    """Entries of an array that ``narrow`` made, as 64-bit integers."""
    small = group[name]
    out = small[at].astype(np.int64)
    if len(group[f"{name}.at"]):
        big = np.flatnonzero(out == 255)
        if len(big):
            where = big + (at.start or 0) if isinstance(at, slice) else at[big]
            out[big] = group[f"{name}.big"][np.searchsorted(group[f"{name}.at"], where)]
    return out
