"""Evaluation records, template logs and experiment products."""

from __future__ import annotations

import itertools
import os
import shutil
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

# Names of the metrics a record holds (fixed values).
KEYS = (
    ["name", "time", "args", "comprate", "comprate_pcnt", "comp_s", "comp_mainpass_s", "comp_prepass_s", "comp_gb_per_s", "csgv_gb", "orig_gb", "orig_bytes_per_voxel", "volume_dim", "volume_labels", "decomp_cpu_gb_per_s", "decomp_cpu_s", "decomp_gpu_gb_per_s", "decomp_gpu_s"]
    + ["min_spp", "max_spp", "frame_min_ms", "frame_avg_ms", "frame_sdv_ms", "frame_med_ms", "frame_max_ms"]
    + [f"frame_ms_{k:02d}" for k in range(16)]
    + ["render_total_max", "rendered_frames", "mem_framebuffer_mb", "mem_uniformbuffer_mb", "mem_materials_mb", "mem_encoding_Mb", "mem_cache_mb", "mem_cache_used_mb", "mem_cache_fillrate", "mem_cache_fillrate_pcnt", "mem_emptyspace_mb", "mem_total_mb"]
)
#: Documented names for some of them.
ALIASES = {"render_total_ms": "render_total_max", "mem_encoding_mb": "mem_encoding_Mb"}
PREFIX = "#fmt:"


def record(**values) -> dict:
    """All keys with the given values, 0 for the others; percentages and totals follow."""
    out = dict.fromkeys(KEYS, 0) | {"name": "", "args": "", "volume_dim": "", "time": time.strftime("%Y-%m-%d %H:%M:%S")}
    for k, v in values.items():
        k = ALIASES.get(k, k)
        if k not in out:
            raise KeyError(k)
        out[k] = v
    out["comprate_pcnt"] = 100 * out["comprate"]
    out["mem_cache_fillrate_pcnt"] = 100 * out["mem_cache_fillrate"]
    return out


def frame_values(times: list[float]) -> dict:
    return {f"frame_ms_{k:02d}": times[k] if k < len(times) else 0.0 for k in range(16)}


def default_template() -> str:
    return ",".join(f"{{{k}}}" for k in KEYS)


def render(template: str, values: dict) -> str:
    """The template with keys (documented names too) or positions filled in."""
    named = values | {a: values[k] for a, k in ALIASES.items()}
    return template.format(*[values[k] for k in KEYS], **named)


def append(path: str, values: dict, template: str | None = None) -> str:
    """Adds a row to a log.  A log's own leading template lines win; a new log starts with the
    template and a header of its names."""
    if os.path.exists(path):
        with open(path) as f:
            lines = list(itertools.takewhile(lambda x: x.startswith(PREFIX), f))
        template = "\n".join(x[len(PREFIX) :].rstrip("\n") for x in lines) or template or default_template()
    else:
        template = template or default_template()
        with open(path, "w") as f:
            f.writelines(f"{PREFIX}{x}\n" for x in template.split("\n"))
            if template == default_template():
                f.write(",".join(KEYS) + "\n")
    row = render(template, values)
    with open(path, "a") as f:
        f.write(row + "\n")
    return row


def prepare(path: str, policy: str) -> None:
    """What becomes of an existing log: ABORT, APPEND, MOVE (aside) or DELETE."""
    if not os.path.exists(path) or policy == "APPEND":
        return
    if policy == "ABORT":
        raise FileExistsError(path)
    if policy == "MOVE":
        shutil.move(path, f"{path}.{time.strftime('%Y%m%d-%H%M%S')}")
    elif policy == "DELETE":
        os.remove(path)
    else:
        raise ValueError(policy)


def formatted_copy(source: str, target: str, replace: dict[str, str] | None = None) -> None:
    """The log without template lines, with replacements."""
    with open(source) as f, open(target, "w") as out:
        for line in f:
            if not line.startswith(PREFIX):
                for a, b in (replace or {}).items():
                    line = line.replace(a, b)
                out.write(line)


@dataclass(frozen=True)
class ArgumentSet:
    """One choice of a dimension of an experiment: arguments, an identifier, and its rank in names."""

    name: str
    args: dict = field(default_factory=dict, hash=False)
    priority: int = 0


def experiments(*dimensions: Iterable[ArgumentSet]) -> list[tuple[str, dict]]:
    """(identifier, arguments) of every combination; names join by priority."""
    out = []
    for choice in itertools.product(*dimensions):
        merged: dict = {}
        for c in choice:
            merged |= c.args
        out.append(("_".join(c.name for c in sorted(choice, key=lambda c: c.priority) if c.name), merged))
    return out


def run_all(todo: list[tuple[str, dict]], call: Callable[..., dict], log: str, fallback: str | None = None) -> list[str]:
    """Runs every experiment and logs its record; a failure logs the fallback line, if any, or raises."""
    rows = []
    for name, args in todo:
        try:
            rows.append(append(log, record(name=name, args=str(args), **call(**args))))
        except Exception:
            if fallback is None:
                raise
            with open(log, "a") as f:
                f.write(fallback.format(name=name) + "\n")
            rows.append(fallback.format(name=name))
    return rows


#: Preset dimensions: encodings, brick sides and cache modes.
ENCODINGS = [ArgumentSet(m, {"mode": m}, 1) for m in ("nibble", "random", "rans", "rans2", "wavelet", "huffman")]
BRICKS = [ArgumentSet(f"b{b}", {"side": b}, 2) for b in (16, 32, 64)]
SYNTHETIC = [ArgumentSet(f"r{a}-{b}", {"path": f"+synth_1024x1024x1024_r{a}-{b}"}, 0) for a, b in ((6, 10), (24, 40), (96, 160), (384, 640))]
