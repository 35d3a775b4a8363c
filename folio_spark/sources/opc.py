"""Office packages: a zip reader with limits, and relationships between parts."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from xml.etree import ElementTree

MAX_ARCHIVE_BYTES, MAX_PIXELS = 500_000_000, 16_000_000
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
OFFICE_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class PackageError(ValueError):
    """A package that is broken, or beyond the limits."""


class Package:
    """Parts of a package by name. What all reads inflate to together is limited, each part counted once."""

    def __init__(self, data: bytes, limit: int = MAX_ARCHIVE_BYTES):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise PackageError(f"not a package: {e}") from e
        self.left, self.parts = limit, {}

    def names(self) -> list[str]:
        return self.zip.namelist()

    def read(self, name: str) -> bytes | None:
        """A part's bytes; None if there is none. Errors if it inflates past its declared size or the limit."""
        if name in self.parts:
            return self.parts[name]
        try:
            info = self.zip.getinfo(name)
        except KeyError:
            return None
        if info.file_size > self.left:
            raise PackageError(f"{name}: beyond the limit of decompressed bytes")
        try:
            with self.zip.open(info) as f:
                data = f.read(info.file_size + 1)
        except (zipfile.BadZipFile, EOFError, OSError, ValueError) as e:
            raise PackageError(f"{name}: {e}") from e
        if len(data) > info.file_size:
            raise PackageError(f"{name}: larger than declared")
        self.left -= len(data)
        self.parts[name] = data
        return data

    def xml(self, name: str) -> ElementTree.Element | None:
        """A part as XML; document types and entities are refused before parsing."""
        data = self.read(name)
        if data is None:
            return None
        if re.search(rb"<!(?:DOCTYPE|ENTITY)", data[:4096], re.IGNORECASE):
            raise PackageError(f"{name}: document types are not allowed")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise PackageError(f"{name}: {e}") from e

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id → (target part, kind, whether external) of a part's relationships."""
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", f"{name}.rels"))
        out = {}
        for r in root.iter(RELS) if root is not None else ():
            outside = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            out[r.get("Id", "")] = (target if outside else resolve(folder, target), r.get("Type", ""), outside)
        return out


def resolve(folder: str, target: str) -> str:
    """A relationship's target as a part name; absolute ones begin at the root, and none leaves it."""
    path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
    return re.sub(r"^(?:\.\./)+", "", path)


def pixels(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF or JPEG; None if it is none of them."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def image_allowed(data: bytes) -> bool:
    size = pixels(data)
    return size is not None and size[0] * size[1] <= MAX_PIXELS


def image_suffix(data: bytes) -> str:
    return "png" if data[:4] == b"\x89PNG" else "jpg" if data[:2] == b"\xff\xd8" else "bin"
