"""Zip archives of a stored network's files. They are made on the driver, one file after the other: for exchange, not for cluster-sized tables."""

from __future__ import annotations

import csv
import shutil
import tempfile
import urllib.request
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd

#: Columns of the table about members, the ending of its name, and names of compression methods.
COLUMNS = ("archive", "filename", "file_size", "compress_type", "compress_size", "CRC")
ENDING = "-info.tsv"
METHODS = {zipfile.ZIP_STORED: "store", zipfile.ZIP_DEFLATED: "deflate", zipfile.ZIP_BZIP2: "bzip2", zipfile.ZIP_LZMA: "lzma"}
CHUNK = 1 << 20


def members(root: str | Path, include: Iterable[str], exclude: Iterable[str] = (), also: Iterable[str] = ()) -> list[str]:
    """Files below root that match an include glob and no exclude glob, and those in also; relative, sorted."""
    root = Path(root)

    def matching(globs: Iterable[str]) -> set[str]:
        return {f.relative_to(root).as_posix() for g in globs for f in root.glob(g) if f.is_file()}

    return sorted((matching(include) - matching(exclude)) | set(also))


def _entry(archive: str, member: zipfile.ZipInfo) -> tuple:
    return archive, member.filename, member.file_size, METHODS.get(member.compress_type), member.compress_size, member.CRC


def info(paths: Iterable[str | Path]) -> pd.DataFrame:
    """A row about each member of the archives, from their central directories."""

    def entries() -> Iterator[tuple]:
        for path in map(Path, paths):
            with zipfile.ZipFile(path) as z:
                yield from (_entry(path.name, m) for m in z.filelist)

    return pd.DataFrame.from_records(list(entries()), columns=list(COLUMNS))


class Volumes:
    """Archives that are filled one after the other, and the table about their members, which grows with each."""

    def __init__(self, destination: Path, mode: str, compression: int, limit: float | None):
        self.destination, self.mode, self.compression, self.limit = destination, mode, compression, limit
        self.paths: list[Path] = []
        self.rows: list[tuple] = []
        self._open: zipfile.ZipFile | None = None

    def _volume(self) -> zipfile.ZipFile:
        """The archive to write to; a new one once the last holds `limit` bytes."""
        if self._open is not None and self.limit is not None and self._open.start_dir >= self.limit:
            self.close()
        if self._open is None:
            name = self.destination.name if self.limit is None else f"{self.destination.stem}-{len(self.paths):04d}{self.destination.suffix}"
            self.paths.append(self.destination.with_name(name))
            self._open = zipfile.ZipFile(self.paths[-1], self.mode, self.compression)
        return self._open

    def add(self, root: Path, name: str) -> None:
        volume = self._volume()
        member = zipfile.ZipInfo.from_file(root / name, name)
        member.compress_type = self.compression
        with (root / name).open("rb") as source, volume.open(member, "w") as target:
            shutil.copyfileobj(source, target, CHUNK)
        self.rows.append(_entry(self.paths[-1].name, member))

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
        self._open = None

    def describe(self) -> Path:
        path = self.destination.with_name(self.destination.name + ENDING)
        with path.open("w", newline="") as f:
            table = csv.writer(f, delimiter="\t", lineterminator="\n")
            table.writerow(COLUMNS)
            table.writerows(self.rows)
        return path


def create(destination: str | Path, root: str | Path, names: Iterable[str], mode: str = "x", compression: int = zipfile.ZIP_LZMA, split_gb: float | None = None) -> list[Path]:
    """Writes the archive and a TSV about its members; returns the TSV and the archives.

    With split_gb there are several archives (name-0000.zip, ...): one that has reached that size is followed by another.
    """
    volumes = Volumes(Path(destination), mode, compression, None if split_gb is None else split_gb * 1e9)
    try:
        if not (ordered := sorted(set(names))):
            volumes._volume()
        for name in ordered:
            volumes.add(Path(root), name)
    finally:
        volumes.close()
    return [volumes.describe(), *volumes.paths]


def create_from_store(destination: str | Path, root: str | Path, nodes: bool = True, edges: bool = True, permutations: bool = False, counts: bool = False, groups: bool = False, **how) -> list[Path]:
    """An archive of the parts of a stored network (a local folder): schema, and tables as asked for."""
    parts = {"schema": True, "nodes": nodes, "edges": edges, "permutations": permutations, "counts": counts, "groups": groups}
    include = [f"{part}/**/*" for part, wanted in parts.items() if wanted]
    return create(destination, root, members(root, include, ["**/*.crc", "**/.*"]), **how)


def load(path: str | Path, destination: str | Path, names: Iterable[str] | None = None) -> None:
    """Unpacks all members or those named, of a file or a URL. Members that would land outside the destination raise ValueError."""
    if "://" in str(path):
        with tempfile.NamedTemporaryFile(suffix=".zip") as local, urllib.request.urlopen(str(path)) as remote:
            shutil.copyfileobj(remote, local, CHUNK)
            local.flush()
            return load(local.name, destination, names)
    inside = Path(destination).resolve()
    with zipfile.ZipFile(path) as z:
        chosen = list(names) if names is not None else z.namelist()
        for name in chosen:
            if not (inside / name).resolve().is_relative_to(inside):
                raise ValueError(f"{name!r} lies outside the archive")
        z.extractall(inside, chosen)
