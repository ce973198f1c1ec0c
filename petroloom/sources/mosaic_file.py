"""A sink for one tiled TIFF file, written by many tasks.

Tiles are a stored table. Where each will lie follows from the sizes of those before it, so every task writes
its own tiles, and their entries of the index, into the file at their places; no tile passes the driver. Tasks that run
again write the same bytes to the same places. The file has a name of its own until it is whole: the commit adds the head and
the directory and renames it, a failure deletes it. Driver and executors must see the file's folder as one that
allows writing at a place, as local and network file systems do."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from petroloom.sources import tiff

RUN = 4096  # numbers whose sizes are summed together: a row of one window for each run


@dataclass
class Written(WriterCommitMessage):
    tiles: int
    only: tuple[int, int] | None


def place(tiles: DataFrame, made: tiff.Layout) -> tuple[DataFrame, int, bool]:
    """tiles (number, data) as (number, at, size, data) of all numbers, where the last one ends, and whether some are
    missing: those have no data and share the black tile behind all others."""
    run = (F.col("number") / RUN).cast("long")
    sizes = tiles.select("number", F.length("data").cast("long").alias("size")).withColumn("run", run)
    runs = sizes.groupBy("run").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = runs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("run", before("bytes", Window.orderBy("run")).alias("start"))
    at = made.first + F.col("start") + before("size", Window.partitionBy("run").orderBy("number"))
    known = sizes.join(starts, "run").select("number", at.alias("at"), "size").join(tiles.select("number", "data"), "number")
    end = made.first + total["b"]
    blank = len(made.blank()) if total["n"] < made.count else 0
    every = tiles.sparkSession.range(made.count).withColumnRenamed("id", "number")
    return every.join(known, "number", "left").select("number", F.coalesce("at", F.lit(end)).alias("at"), F.coalesce("size", F.lit(blank)).cast("long").alias("size"), "data"), end + blank, blank > 0


def write(tiles: DataFrame, path: str, width: int, height: int, tile: int = 256, compress: bool = True, big: bool | None = None) -> None:
    """Writes a stored table of tiles (number, data) as the file at `path`; what was there is replaced at the end."""
    made = tiff.layout(width, height, tile, compress, big)
    placed, end, blank = place(tiles, made)
    tiles.sparkSession.dataSource.register(MosaicFile)
    options = {"path": os.path.abspath(path), "width": width, "height": height, "tile": tile, "compress": int(compress), "big": int(made.big), "end": end, "blank": int(blank)}
    placed.write.format("mosaic_file").mode("append").options(**options).save()


class MosaicFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mosaic_file"

    def schema(self) -> str:
        return "number long, at long, size long, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        made = tiff.Layout(int(o["width"]), int(o["height"]), int(o["tile"]), o["compress"] == "1", o["big"] == "1")
        return Writer(o["path"], made, int(o["end"]), o["blank"] == "1")


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, made: tiff.Layout, end: int, blank: bool) -> None:
        self.path, self.part, self.made, self.end, self.blank = path, f"{path}.writing", made, end, blank
        with open(self.part, "wb") as out:
            out.truncate(made.spots(end)["directory"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        spots, tiles, only = self.made.spots(self.end), 0, None
        with open(self.part, "r+b") as out:
            for batch in iterator:
                numbers, ats, sizes, data = (batch.column(c) for c in ("number", "at", "size", "data"))
                for number, place, size, body in zip(numbers.to_pylist(), ats.to_pylist(), sizes.to_pylist(), data, strict=True):
                    if body.is_valid:
                        if len(body.as_buffer()) != size:
                            raise ValueError("a tile has another size than the one it was placed by")
                        out.seek(place)
                        out.write(body.as_buffer())
                    for name, value in (("at", place), ("sizes", size)):
                        if name in spots:
                            out.seek(spots[name] + self.made.room * number)
                            out.write(value.to_bytes(self.made.room, "little"))
                    if number == 0:
                        only = (place, size)
                tiles += batch.num_rows
        return Written(tiles, only)

    def commit(self, messages: list[Written | None]) -> None:
        if sum(m.tiles for m in messages if m) != self.made.count:
            raise ValueError("tiles are missing")
        (only,) = [m.only for m in messages if m and m.only]
        with open(self.part, "r+b") as out:
            black = self.made.blank() if self.blank else b""
            for place, data in [(self.end - len(black), black), *self.made.closing(self.end, only)]:
                out.seek(place)
                out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)
