"""Folding the layers of one version of a document into another one."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.functions.labels import LAYER_ATTRIBUTES
from palimpsest.sources import archives

NAMESPACE = re.compile(r"^\{(.*)\}")


class NoMerge(ValueError):
    """Documents whose layers cannot be folded."""


class _Document:
    """An archive, its description, and its layers' files."""

    def __init__(self, content: bytes) -> None:
        self.entries = {path: data for _, path, _, _, data in archives.zip_entries(content)}
        try:
            self.text = self.entries["maindoc.xml"].decode()
            root = ET.fromstring(self.text)
        except (KeyError, UnicodeDecodeError, ET.ParseError) as why:
            raise NoMerge(f"no readable maindoc.xml: {why}") from None
        found = NAMESPACE.match(root.tag)
        self.space = found[0] if found else ""
        self.image = next(root.iter(f"{self.space}IMAGE"), None)
        self.layers = None if self.image is None else self.image.find(f"{self.space}layers")
        if self.layers is None:
            raise NoMerge("no layers in maindoc.xml")
        self.prefix = f"{self.image.get('name', '')}/layers/"

    def values(self, attribute: str) -> list[str]:
        """The distinct values of an attribute below the layers, in document order."""
        return _values(self.layers, attribute)

    def files(self) -> dict[str, list[tuple[str, bytes]]]:
        """By layer file: its entries, as what follows the file's name and their bytes."""
        out: dict[str, list[tuple[str, bytes]]] = {}
        for path, data in self.entries.items():
            if path.startswith(self.prefix):
                stem = re.match(r"[^./]*", path[len(self.prefix) :])[0]
                if stem:
                    out.setdefault(stem, []).append((path[len(self.prefix) + len(stem) :], data))
        return out

    def tops(self) -> list[ET.Element]:
        return self.layers.findall(f"{self.space}layer")

    def content(self, layer: ET.Element) -> list[bytes]:
        """What a layer and those in it hold, whatever their files are called and in whatever order their tiles lie."""
        files = self.files()
        return sorted(canonical(data) for name in _values(layer, "filename") for _, data in files.get(name, []))


def _values(node: ET.Element, attribute: str) -> list[str]:
    return list(dict.fromkeys(n.get(attribute) for n in node.iter() if n.get(attribute) is not None))


def canonical(data: bytes) -> bytes:
    """A tiled entry with its tiles by place; others as they are."""
    if not data.startswith(b"VERSION "):
        return data
    try:
        tiles = archives.parse_tiles(data)
    except (ValueError, KeyError, IndexError):
        return data
    width, height, pixel_size = tiles[0][:3] if tiles else (64, 64, 4)
    return archives.tiled_block(sorted((x, y, c, raw) for _, _, _, _, x, y, c, raw in tiles), width, height, pixel_size)


def signature(layer: ET.Element) -> tuple[str, ...]:
    return tuple(layer.get(k, "") for k in LAYER_ATTRIBUTES)


def merged(base: bytes, incoming: bytes, ancestor: bytes | None = None) -> bytes:
    """`base` with the top layers of `incoming` above its own, but for those that are as they were in `ancestor`.

    Files, ids and clashing names of the incoming layers are made new. Colour spaces must be the same.
    """
    own, other = _Document(base), _Document(incoming)
    spaces = [d.image.get("colorspacename", "") for d in (own, other)]
    if spaces[0] != spaces[1]:
        raise NoMerge(f"different colour spaces: {spaces[0] or '?'} and {spaces[1] or '?'}")
    was = {}
    if ancestor is not None:
        before = _Document(ancestor)
        was = {layer.get("uuid"): (signature(layer), before.content(layer)) for layer in before.tops() if layer.get("uuid") is not None}
    names, ids = set(own.values("name")), set(own.values("uuid"))
    taken = {*own.values("filename"), *own.files()}
    number = 1 + max((int(m[1]) for f in taken if (m := re.fullmatch(r"layer([0-9]+)", f))), default=0)
    counter, renamed, fragments = 0, {}, []
    ET.register_namespace("", own.space[1:-1] if own.space else "")
    for layer in other.tops():
        if was.get(layer.get("uuid")) == (signature(layer), other.content(layer)):
            continue
        fresh: dict[str, dict[str, str]] = {"filename": {}, "uuid": {}}
        for old in _values(layer, "filename"):
            fresh["filename"][old], number = f"layer{number}", number + 1
        renamed |= fresh["filename"]
        for old in _values(layer, "uuid"):
            while (new := _uuid(old, counter)) in ids:
                counter += 1
            fresh["uuid"][old], counter = new, counter + 1
        for node in layer.iter():
            for attribute, table in fresh.items():
                if node.get(attribute) is not None:
                    node.set(attribute, table[node.get(attribute)])
        if (name := layer.get("name")) is not None:
            k = 2
            while layer.get("name") in names:
                layer.set("name", f"{name} [{k}]")
                k += 1
            names.add(layer.get("name"))
        layer.tail = None
        fragments.append(ET.tostring(layer, encoding="unicode"))
    if not fragments:
        raise NoMerge("no layer has changed")
    at = own.text.index(">", own.text.index("<layers")) + 1
    opened = own.text[:at]
    ending = ""
    if opened.endswith("/>"):  # no layers of its own yet
        opened, ending = f"{opened[:-2]}>", "</layers>"
    text = opened + "".join(f"\n{f}" for f in fragments) + ending + own.text[at:]
    entries = {**own.entries, "maindoc.xml": text.encode()}
    for stem, parts in other.files().items():
        for rest, data in parts if stem in renamed else ():
            entries[f"{own.prefix}{renamed[stem]}{rest}"] = data
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for path, data in entries.items():
            archive.writestr(path, data, zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _uuid(seed: str, counter: int) -> str:
    digits = hashlib.sha256(f"merge\0{seed}\0{counter}".encode()).hexdigest()
    return "{" + "-".join((digits[:8], digits[8:12], digits[12:16], digits[16:20], digits[20:32])) + "}"


def merged_documents(triples: DataFrame) -> DataFrame:
    """(file, content, problem) of rows (file, base, incoming, ancestor): the merged archive, or why there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, base, incoming, ancestor in zip(*(batch[c].tolist() for c in ("file", "base", "incoming", "ancestor")), strict=True):
                try:
                    rows.append((file, merged(base, incoming, ancestor), None))
                except NoMerge as why:
                    rows.append((file, None, str(why)))
            yield pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(("file", "content", "problem"), zip(*rows, strict=True) if rows else ((), (), ()), strict=True)})

    return triples.select("file", "base", "incoming", "ancestor").mapInPandas(run, "file string, content binary, problem string")
