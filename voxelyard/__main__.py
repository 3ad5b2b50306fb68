"""Command line: compress a volume, export one, relabel, test and log.

    python -m voxelyard INPUT [-c FOLDER] [-d FILE] [-s 0|1|2] [-b SIDE] [-o OPERATIONS] ...

INPUT is a volume file, a pattern with ``--chunked``, a ``+synth`` description, or a folder that
``-c`` wrote.  Without a display there is nothing to render: the options of the viewer end with the
code for what is not supported.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import evaluation
from .codec import bricks, ops, store
from .operators import labels, stats
from .sources import tables, volumes
from .volume import Volume

# Exit codes (fixed values).
SUCCESS, INVALID_ARGUMENT, NOT_SUPPORTED, COMPRESSION_ERROR, RENDER_ERROR, IO_ERROR = range(6)

#: Options of the viewer, known but not served here.
VIEWER = ("image", "video", "record-in", "config", "resolution")


class Invalid(Exception):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Invalid(message)


def parser() -> Parser:
    p = Parser(prog="voxelyard", description="Compress, export and check labelled volumes.")
    p.add_argument("input", nargs="?", help="volume file, +synth description or compressed folder")
    p.add_argument("-c", "--compress", metavar="FOLDER", help="write the compressed volume there")
    p.add_argument("-d", "--decompress", metavar="FILE", help="export the volume to a file")
    p.add_argument("--chunked", metavar="X,Y,Z", help="last chunk on each axis; the input then has three {}")
    p.add_argument("-s", "--strength", type=int, default=0, choices=(0, 1, 2))
    p.add_argument("-b", "--brick-size", type=int, default=32, choices=(2, 4, 8, 16, 32, 64))
    p.add_argument("-o", "--operations", default="o", help="of p, n, x, y, z, l, d, d-, s; a for all, o for the usual ones")
    p.add_argument("--random-access", action="store_true")
    p.add_argument("--freq-sampling", type=int, default=8, help="count symbols on every n-th brick an axis")
    p.add_argument("--relabel", action="store_true", help="number labels by first appearance")
    p.add_argument("-a", "--attribute", metavar="FILE[,TABLE][,COLUMN]", help="CSV or SQLite attributes, stored beside the bricks")
    p.add_argument("-t", "--test", action="store_true", help="compare the decoded volume with its input")
    p.add_argument("--stats", action="store_true", help="print statistics of the bricks")
    p.add_argument("--eval-logfiles", metavar="FILES", help="comma-separated logs to append a record to")
    p.add_argument("--eval-name", default="")
    p.add_argument("--eval-print-keys", action="store_true")
    p.add_argument("--threads", type=int, default=0, help="local threads, where no cluster is given")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--headless", action="store_true", help="accepted; there is no window")
    p.add_argument("--verbose", action="store_true")
    for name in VIEWER:
        p.add_argument(f"--{name}", help=argparse.SUPPRESS)
    return p


def checked(argv: list[str]) -> argparse.Namespace:
    args = parser().parse_args(argv)
    if args.eval_print_keys:
        return args
    if not args.input:
        raise Invalid("an input is needed")
    if args.random_access and args.operations != "o":
        raise Invalid("random access stores all operations it needs; --operations does not apply")
    if args.chunked and not re.fullmatch(r"\d+,\d+,\d+", args.chunked):
        raise Invalid("--chunked takes three numbers")
    if args.freq_sampling < 1:
        raise Invalid("--freq-sampling is 1 or more")
    ops.parse_mask(args.operations)
    return args


def _session(args: argparse.Namespace) -> SparkSession:
    found = SparkSession.getActiveSession()
    return found or SparkSession.builder.master(f"local[{args.threads or '*'}]").appName("voxelyard").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def is_store(path: str) -> bool:
    return os.path.isdir(os.path.join(path, "bricks"))


def _read(spark: SparkSession, args: argparse.Namespace) -> Volume:
    if is_store(args.input):
        return store.volume(spark, args.input)
    if args.chunked:
        return volumes.read_chunks(spark, args.input, tuple(map(int, args.chunked.split(","))))
    return volumes.read_volume(spark, args.input)


def _attributes(spark: SparkSession, text: str):
    """(table, label column) of ``file[,table][,column]``; a CSV file has no table."""
    path, *rest = text.split(",")
    if path.endswith(".csv"):
        with open(path) as f:
            first = f.readline().lstrip("#").split(",")[0].strip()
        label = rest[0] if rest else first
        return tables.read_attributes_csv(spark, path, label), label
    name, _, key = tables.sqlite_schema(path, rest[0] if rest else None)
    return tables.read_sqlite(spark, path, name), rest[1] if len(rest) > 1 else key


def work(args: argparse.Namespace) -> int:
    spark = _session(args)
    volume, record = _read(spark, args), {}
    if args.compress:
        began, original = time.time(), volume
        if args.relabel or args.attribute:
            ids = labels.first_appearance(volume)
            volume = labels.remap_strict(volume, ids)
        mode = bricks.select_mode(args.strength, args.random_access)
        store.save(volume, args.compress, args.brick_size, mode, args.operations, args.freq_sampling, args.overwrite)
        if args.relabel or args.attribute:
            found, label = _attributes(spark, args.attribute) if args.attribute else (ids.select("label"), "label")
            info = labels.volume_info(original, (args.brick_size,) * 3, label)
            tables.save_attributes(labels.attribute_table(ids, found, label), info, args.compress)
        encoded, _ = store.load(spark, args.compress)
        size = encoded.selectExpr("sum(length(ops) + length(detail) + 8 * size(palette) + 4 * size(starts)) AS b").first().b or 0
        rate = stats.compression_rate(volume, int(size)).first()
        record = {"comprate": rate.rate or 0, "comp_s": time.time() - began, "csgv_gb": size / 1e9, "orig_gb": rate.original_bytes / 1e9, "orig_bytes_per_voxel": rate.bytes_per_voxel, "volume_labels": rate.labels}
        print(f"{rate.voxels} voxels, {rate.labels} labels: {size} of {rate.original_bytes} bytes")
        if args.stats:
            bricks.statistics(encoded).orderBy("brick_z", "brick_y", "brick_x").show(20, False)
        if args.test:
            wrong = stats.errors(volume, store.volume(spark, args.compress)).first()
            print(f"{wrong.wrong or 0} of {wrong.voxels} voxels differ")
            if wrong.wrong:
                return COMPRESSION_ERROR
    if args.decompress:
        kind = "uint64" if (volume.df.agg({"label": "max"}).first()[0] or 0) > 0xFFFFFFFF else "uint32"
        volumes.write_volume(volume, args.decompress, kind, args.overwrite)
    for path in filter(None, (args.eval_logfiles or "").split(",")):
        evaluation.append(path, evaluation.record(name=args.eval_name, args=" ".join(sys.argv[1:]), volume_dim="x".join(map(str, volume.dims)), **record))
    return SUCCESS


def main(argv: list[str] | None = None) -> int:
    """The exit code; messages go to standard error."""
    try:
        args = checked(sys.argv[1:] if argv is None else argv)
    except (Invalid, ValueError) as e:
        print(e, file=sys.stderr)
        return INVALID_ARGUMENT
    if args.eval_print_keys:
        print("\n".join(evaluation.KEYS))
        return SUCCESS
    asked = [name for name in VIEWER if getattr(args, name.replace("-", "_")) is not None]
    if asked:
        print(f"nothing is rendered here: --{asked[0]}", file=sys.stderr)
        return NOT_SUPPORTED
    if args.compress and not args.overwrite and os.path.exists(args.compress):
        print(f"{args.compress} exists", file=sys.stderr)
        return IO_ERROR
    try:
        return work(args)
    except NotImplementedError as e:
        print(e, file=sys.stderr)
        return NOT_SUPPORTED
    except OSError as e:
        print(e, file=sys.stderr)
        return IO_ERROR
    except (PySparkException, ValueError, TypeError) as e:
        print(e, file=sys.stderr)
        return COMPRESSION_ERROR


if __name__ == "__main__":
    sys.exit(main())
