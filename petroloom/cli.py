"""python -m petroloom FRAMES -o OUT: mosaics of a folder of images or a Parquet table of frames."""

from __future__ import annotations

import argparse
import dataclasses
import sys
from dataclasses import fields

from petroloom.settings import Settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="petroloom", description=__doc__)
    p.add_argument("frames")
    p.add_argument("-o", "--out", default="mosaic")
    p.add_argument("--circle", help="cx,cy,radius of the field of view")
    p.add_argument("--config", help="settings as JSON")
    p.add_argument("--fps", type=float, default=30.0)
    p.add_argument("--detect-only", action="store_true")
    for f in fields(Settings):
        kind = type(f.default) if f.default is not None else str
        flag = (lambda s: s.lower() in ("1", "true", "yes")) if kind is bool else kind
        p.add_argument("--" + f.name.replace("_", "-"), type=flag, default=None)
    return p


def settings(args: argparse.Namespace) -> Settings:
    """Defaults, then the file's, then the flags'."""
    s = Settings.from_json(open(args.config).read()) if args.config else Settings()
    return s.replace(**{f.name: v for f in fields(Settings) if (v := getattr(args, f.name)) is not None})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from petroloom.functions.fov import FieldOfView
    from petroloom.plans import pipeline
    from petroloom.sources.images import image_sequence

    spark, s = SparkSession.builder.appName("petroloom").getOrCreate(), settings(args)
    frames = spark.read.parquet(args.frames) if args.frames.rstrip("/").endswith(".parquet") else image_sequence(spark, args.frames, fps=args.fps)
    first = frames.select("width", "height").first()
    fov = FieldOfView(*map(float, args.circle.split(",")), first["width"], first["height"], s.mask_margin) if args.circle else pipeline.detect_fov(frames, s.mask_margin)
    print(dataclasses.asdict(fov))
    if not args.detect_only:
        result = pipeline.run(frames, args.out, s, fov, args.fps, lambda share, what: print(f"{share:4.0%} {what}", file=sys.stderr))
        print("\n".join([*result.log, *result.warnings]))
    return 0
