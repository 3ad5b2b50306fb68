"""Headers of raw volume files: where the payload starts, its dimensions, type and byte order."""

from __future__ import annotations

import ast
import gzip
import posixpath
import re
from dataclasses import dataclass

import numpy as np

#: Accepted names of the element types (fixed values).
TYPE_NAMES = {
    "u1": ("uint8", "uchar", "unsigned char", "uint8_t", "UInt8"),
    "u2": ("uint16", "ushort", "unsigned short", "uint16_t", "unsigned short int", "UInt16"),
    "u4": ("uint32", "uint", "unsigned int", "uint32_t", "unsigned", "UInt32"),
    "u8": ("uint64", "ulonglong", "unsigned long", "unsigned long long", "uint64_t", "UInt64"),
}
_TYPES = {name.lower(): code for code, names in TYPE_NAMES.items() for name in names}
HEADER_BYTES = 1 << 16


@dataclass(frozen=True)
class Layout:
    """Dimensions (x fastest), numpy type and the payload's place."""

    width: int
    height: int
    depth: int
    dtype: str
    offset: int
    path: str
    compressed: bool = False


def type_code(name: str) -> str:
    code = _TYPES.get(name.strip().lower())
    if code is None:
        raise ValueError(f"unknown element type {name!r}")
    return code


def open_file(path: str):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_bytes(path: str, n: int | None = None, offset: int = 0) -> bytes:
    system, where = open_file(path)
    with system.open_input_file(where) as f:
        f.seek(offset)
        return f.read() if n is None else f.read(n)


def _vraw(head: bytes, path: str) -> Layout:
    first, second, _ = head.split(b"\n", 2)
    offset = len(first) + len(second) + 2
    lines = [first.decode().strip(), second.decode().strip()]
    dims, kind = lines if re.fullmatch(r"\d+\s+\d+\s+\d+", lines[0]) else lines[::-1]
    return Layout(*map(int, dims.split()), "<" + type_code(kind), offset, path)


def _nrrd(head: bytes, path: str) -> Layout:
    text, found, _ = head.partition(b"\n\n")
    lines = text.decode("latin-1").splitlines()
    if not lines or not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x and not x.startswith("#"))}
    if fields.get("dimension") != "3" or fields.get("encoding", "").lower() != "raw":
        raise ValueError("only raw three-dimensional NRRD files are read")
    order = ">" if fields.get("endian", "little") == "big" else "<"
    where, offset = path, len(text) + 2 if found else len(text)
    data = fields.get("data file") or fields.get("datafile")
    if data:
        where, offset = posixpath.join(posixpath.dirname(path), data), 0
    return Layout(*map(int, fields["sizes"].split()), order + type_code(fields["type"]), offset, where)


def _vti(head: bytes, path: str) -> Layout:
    text = head.decode("latin-1")
    extent = list(map(int, re.search(r'WholeExtent="([^"]+)"', text)[1].split()))
    array = re.search(r"<DataArray[^>]*>", text)[0]
    order = ">" if 'byte_order="BigEndian"' in text else "<"
    mark = text.index("_", text.index("<AppendedData"))
    cells = 0 if "<PointData" in text and "DataArray" in text[text.index("<PointData") : text.index("</PointData")] else 1
    width = {"UInt32": 4, "UInt64": 8}.get((re.search(r'header_type="([^"]+)"', text) or [0, ""])[1], 0)
    dims = [b - a + 1 - cells for a, b in zip(extent[::2], extent[1::2])]
    return Layout(*dims, order + type_code(re.search(r'type="([^"]+)"', array)[1]), mark + 1 + width, path)


def _npy(head: bytes, path: str) -> Layout:
    version = head[6]
    size = int.from_bytes(head[8:10] if version == 1 else head[8:12], "little")
    start = 10 if version == 1 else 12
    info = ast.literal_eval(head[start : start + size].decode("latin-1"))
    if info["fortran_order"] or len(info["shape"]) != 3:
        raise ValueError("only C-ordered three-dimensional arrays (z, y, x) are read")
    depth, height, width = info["shape"]
    return Layout(width, height, depth, info["descr"], start + size, path)


_READERS = {".vraw": _vraw, ".raw": _vraw, ".nrrd": _nrrd, ".nhdr": _nrrd, ".vti": _vti, ".npy": _npy}
_MISSING = {".h5": "h5py", ".hdf5": "h5py", ".tif": "tifffile", ".tiff": "tifffile", ".nii": "nibabel"}


def layout(path: str) -> Layout:
    """The layout of a file, by its extension; ``.gz`` around it is looked through."""
    compressed = path.endswith(".gz")
    kind = posixpath.splitext(path.removesuffix(".gz"))[1].lower()
    if kind in _MISSING:
        raise NotImplementedError(f"{kind} files need the package {_MISSING[kind]}, which is not installed")
    if kind not in _READERS:
        raise ValueError(f"unknown volume format {kind!r}")
    head = gzip.decompress(read_bytes(path))[:HEADER_BYTES] if compressed else read_bytes(path, HEADER_BYTES)
    found = _READERS[kind](head, path)
    return Layout(found.width, found.height, found.depth, found.dtype, found.offset, found.path, compressed and found.path == path)


def header(kind: str, dims: tuple[int, int, int], dtype: str, data_file: str | None = None) -> bytes:
    """The bytes before the payload."""
    width, height, depth = dims
    name = TYPE_NAMES[np.dtype(dtype).str[1:]][0]
    if kind in (".vraw", ".raw"):
        return f"{width} {height} {depth}\n{name}\n".encode()
    if kind in (".nrrd", ".nhdr"):
        lines = ["NRRD0004", f"type: {name}", "dimension: 3", f"sizes: {width} {height} {depth}", "endian: little", "encoding: raw"]
        return ("\n".join([*lines, *([f"data file: {data_file}"] if data_file else [])]) + ("\n" if data_file else "\n\n")).encode()
    if kind == ".npy":
        info = f"{{'descr': '{np.dtype(dtype).newbyteorder('<').str}', 'fortran_order': False, 'shape': ({depth}, {height}, {width}), }}"
        info += " " * (-(10 + len(info) + 1) % 64) + "\n"
        return b"\x93NUMPY\x01\x00" + len(info).to_bytes(2, "little") + info.encode()
    if kind == ".vti":
        kind_name = TYPE_NAMES[np.dtype(dtype).str[1:]][-1]
        return (
            f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">\n<ImageData WholeExtent="0 {width} 0 {height} 0 {depth}" Origin="0 0 0" Spacing="1 1 1">\n'
            f'<Piece Extent="0 {width} 0 {height} 0 {depth}">\n<CellData Scalars="labels">\n<DataArray type="{kind_name}" Name="labels" format="appended" offset="0"/>\n</CellData>\n</Piece>\n</ImageData>\n<AppendedData encoding="raw">\n_'
        ).encode()
    raise ValueError(f"unknown volume format {kind!r}")


FOOTERS = {".vti": b"\n</AppendedData>\n</VTKFile>\n"}
