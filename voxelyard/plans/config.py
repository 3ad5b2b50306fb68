"""Configurations: material lists as text files of ``Label: values`` lines under sections."""

from __future__ import annotations

from dataclasses import fields

from ..operators.materials import Material

VERSION = "1"


def dump(materials: list[Material]) -> str:
    lines = [f"version: {VERSION}"]
    for k, m in enumerate(materials):
        lines.append(f"[Material {k}]")
        lines += [f"{f.name}: {getattr(m, f.name)}" for f in fields(m)]
    return "\n".join(lines) + "\n"


def load(text: str) -> list[Material]:
    """Unknown labels are refused; those that are missing keep their defaults.  ``;`` may stand for a
    line's end, for configurations given inline."""
    out: list[dict] = []
    kinds = {f.name: f.type for f in fields(Material)}
    for line in filter(None, (x.strip() for x in text.replace(";", "\n").splitlines())):
        if line.startswith("["):
            out.append({})
            continue
        label, _, value = (p.strip() for p in line.partition(":"))
        if label == "version":
            if value != VERSION:
                raise ValueError(f"configuration version {value}")
        elif label not in kinds or not out:
            raise ValueError(f"unknown setting {label!r}")
        elif label in ("attribute", "tf_attribute"):
            out[-1][label] = int(value) if value.lstrip("-").isdigit() else value
        else:
            out[-1][label] = int(value) if label == "wrapping" else float(value)
    return [Material(**m) for m in out]
