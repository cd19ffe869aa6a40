"""Finding input files and telling their format and compression by name."""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
from dataclasses import dataclass

#: Suffixes by format.
DATA = {"nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "nquads": "nquads", "ttl": "turtle", "turtle": "turtle", "trig": "trig", "rdf": "rdfxml", "owl": "rdfxml", "jsonld": "jsonld", "json": "jsonld", "n3": "n3"}
ONTOLOGY = {"ofn": "ofn", "owx": "owx", "nt": "ntriples", "ttl": "turtle", "rdf": "rdfxml", "owl": "rdfxml"}
CODECS = {"gz": "gz", "bz2": "bz2", "xz": "xz"}


@dataclass(frozen=True)
class Source:
    path: str
    format: str
    codec: str | None


def classify(path: str, formats: dict[str, str] = DATA) -> Source | None:
    name, codec = os.path.basename(path).lower(), None
    stem, dot, suffix = name.rpartition(".")
    if dot and suffix in CODECS:
        codec = CODECS[suffix]
        stem, dot, suffix = stem.rpartition(".")
    return Source(path, formats[suffix], codec) if dot and suffix in formats else None


def discover(path: str, formats: dict[str, str] = DATA) -> list[Source]:
    """The sources at a path: a file, or all known files below a folder in order of their paths; links are followed."""
    if os.path.isfile(path):
        if (one := classify(path, formats)) is None:
            raise ValueError(f"unsupported file: {path}")
        return [one]
    if not os.path.isdir(path):
        raise FileNotFoundError(f"no such file or folder: {path}")
    seen, found = set(), []
    for folder, folders, files in os.walk(path, followlinks=True):
        if (real := os.path.realpath(folder)) in seen:
            folders.clear()
            continue
        seen.add(real)
        found += [s for f in files if (s := classify(os.path.join(folder, f), formats))]
    if not found:
        raise ValueError(f"no supported file in {path}")
    return sorted(found, key=lambda s: s.path)


def unpack(data: bytes, codec: str | None) -> bytes:
    return {None: lambda x: x, "gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}[codec](data)


def read_bytes(source: Source) -> bytes:
    with open(source.path, "rb") as f:
        return unpack(f.read(), source.codec)
