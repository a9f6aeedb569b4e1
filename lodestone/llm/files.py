"""Binary files in the shared folder, written by tasks and committed by a manifest."""

from __future__ import annotations

import uuid

import zstandard


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class FileWriter:
    """Writes under a name that no other attempt has and moves the file to its place at the end. A task
    that runs twice leaves a file that no manifest names; readers take their files from the manifest."""

    def __init__(self, folder: str, name: str):
        self.uri = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
        self.fs, self.path = _open(self.uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".tmp")
        self.bytes = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".tmp", self.path)
        return self.uri


def open_input(uri: str):
    """A seekable stream over a file that :class:`FileWriter` or anyone else wrote."""
    fs, path = _open(uri)
    return fs.open_input_file(path)


def train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes; raw content if there is too little to train on."""
    total = sum(map(len, samples))
    if total > 16 * size and len(samples) >= 50:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8, f=18, accel=4).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]
