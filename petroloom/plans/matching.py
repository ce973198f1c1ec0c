"""Registration of tables of frame pairs on the cluster."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from petroloom.functions.fov import FieldOfView
from petroloom.functions.registration import Registrar
from petroloom.operators.matching import top_per
from petroloom.plans.keyframes import image
from petroloom.plans.posegraph import MATCH
from petroloom.settings import Settings

PAIRS = "i long, j long, dx double, dy double, phi double"
FOUND = "i long, j long, dx double, dy double, phi double, quality double, ncc double, second double, overlap double"


class Prepared(OrderedDict):
    """Prepared frames by id, the last `most` that were asked for."""

    def __init__(self, reg: Registrar, specimen: bool, most: int = 81) -> None:
        super().__init__()
        self.reg, self.specimen, self.most = reg, specimen, most

    def of(self, key: int, data: bytes, w: int, h: int):
        if key in self:
            self.move_to_end(key)
        else:
            p = self.reg.prepare(image(data, w, h))
            self[key] = self.reg.specimen(p) if self.specimen else p
            if len(self) > self.most:
                self.popitem(last=False)
        return self[key]


class SparkMatcher:
    """Matches pairs of keyframes (id, width, height, data: the crop). A table of pairs is joined with its
    frames on both sides and registered batch by batch; pairs lie in order of their left frame, and a task
    keeps the frames it has prepared last, so neighbours are prepared about once."""

    def __init__(self, crops: DataFrame, fov: FieldOfView, settings: Settings) -> None:
        self.crops, self.fov, self.settings, self.spark = crops, fov, settings, crops.sparkSession
        self._content: dict[int, float] = {}

    def _pairs(self, pairs: pd.DataFrame) -> DataFrame:
        p = self.spark.createDataFrame(pairs[["i", "j", "dx", "dy", "phi"]].astype({"i": "int64", "j": "int64"}), PAIRS)
        side = lambda x: self.crops.select(F.col("id").alias(x), F.col("width").alias(f"w{x}"), F.col("height").alias(f"h{x}"), F.col("data").alias(f"d{x}"))
        return p.join(side("j"), "j").join(side("i"), "i").repartitionByRange("i").sortWithinPartitions("i", "j")

    def _run(self, pairs: pd.DataFrame, specimen: bool, strict: bool, radius: float | None) -> DataFrame:
        fov, settings = self.fov, self.settings

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reg = Registrar(fov, settings)
            held = Prepared(reg, specimen)
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    a, b = held.of(r.i, r.di, r.wi, r.hi), held.of(r.j, r.dj, r.wj, r.hj)
                    if specimen and min(a.content, b.content) < settings.link_min_content:
                        continue
                    peak, pose = reg.register(a, b, None if radius is None else (r.dx, r.dy), radius, strict)
                    if pose:
                        out.append((r.i, r.j, pose.dx, pose.dy, pose.phi, pose.quality, pose.ncc, peak.second, pose.overlap))
                yield pd.DataFrame(out, columns=MATCH)

        return self._pairs(pairs).mapInPandas(run, FOUND)

    def local(self, pairs: pd.DataFrame, radius: float) -> pd.DataFrame:
        return self._run(pairs, True, False, radius).toPandas()

    def register(self, pairs: pd.DataFrame, radius: float) -> pd.DataFrame:
        return self._run(pairs, False, False, radius).toPandas()

    def screen(self, main: list[int], samples: list[int]) -> pd.DataFrame:
        """Each main frame meets all samples (link_samples at most), which are sent with the task; its own
        bytes stay where they are."""
        fov, settings = self.fov, self.settings
        sent = [(r["id"], bytes(r["data"]), r["width"], r["height"]) for r in self.crops.filter(F.col("id").isin(samples)).orderBy("id").collect()]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reg = Registrar(fov, settings)
            held = Prepared(reg, True, len(sent) + 1)
            for pdf in batches:
                out = []
                for m in pdf.itertuples(index=False):
                    a = reg.specimen(reg.prepare(image(m.data, m.width, m.height)))
                    for key, *crop in sent if a.content >= settings.link_min_content else ():
                        b = held.of(key, *crop)
                        if b.content < settings.link_min_content:
                            continue
                        peak, pose = reg.register(a, b, None, None, True)
                        if pose:
                            out.append((m.id, key, pose.dx, pose.dy, pose.phi, pose.quality, pose.ncc, peak.second, pose.overlap))
                yield pd.DataFrame(out, columns=MATCH)

        asked = self.spark.createDataFrame([(int(m),) for m in main], "id long")
        found = self.crops.select("id", "width", "height", "data").join(F.broadcast(asked), "id").mapInPandas(run, FOUND)
        best = top_per(found, "j", [F.desc("ncc"), F.col("i")], settings.link_candidates_per_sample)
        return best.select(*MATCH).orderBy("j", "rank").toPandas()

    def content(self, ids: list[int]) -> np.ndarray:
        fov, settings = self.fov, self.settings
        if missing := [i for i in ids if i not in self._content]:

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                reg = Registrar(fov, settings)
                for pdf in batches:
                    yield pd.DataFrame({"id": pdf["id"], "content": [reg.specimen(reg.prepare(image(d, w, h))).content for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True)]})

            rows = self.crops.filter(F.col("id").isin(missing)).select("id", "width", "height", "data").mapInPandas(run, "id long, content double").collect()
            self._content |= {r["id"]: r["content"] for r in rows}
        return np.array([self._content[i] for i in ids])
