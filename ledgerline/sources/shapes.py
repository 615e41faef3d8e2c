"""Polygon layers (shapefiles in archives): attributes and drawn outlines, one row per feature."""

from __future__ import annotations

import io
import math
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Projection = Callable[[np.ndarray], np.ndarray]


def albers(low: float = 52.0, high: float = 64.0, lat: float = 0.0, lon: float = 105.0, radius: float = 6_371_000.0) -> Projection:
    """An equal-area conic projection of (longitude, latitude) in degrees with two standard parallels, on a sphere."""
    a, b, f = math.radians(low), math.radians(high), math.radians(lat)
    n = (math.sin(a) + math.sin(b)) / 2
    c = math.cos(a) ** 2 + 2 * n * math.sin(a)
    top = radius * math.sqrt(c - 2 * n * math.sin(f)) / n

    def project(p: np.ndarray) -> np.ndarray:
        theta = n * np.radians((p[:, 0] - lon + 180) % 360 - 180)
        rho = radius * np.sqrt(c - 2 * n * np.sin(np.radians(p[:, 1]))) / n
        return np.column_stack([rho * np.sin(theta), top - rho * np.cos(theta)])

    return project


def polygons(shp: bytes) -> Iterator[list[np.ndarray]]:
    """The rings of each record of a polygon file; a record without a shape has none."""
    if struct.unpack_from(">I", shp)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(shp):
        words = struct.unpack_from(">I", shp, at + 4)[0]
        kind = struct.unpack_from("<I", shp, at + 8)[0]
        if kind not in (0, 5, 15, 25):
            raise ValueError(f"shape type {kind}")
        rings = []
        if kind:
            parts, points = struct.unpack_from("<II", shp, at + 44)
            starts = struct.unpack_from(f"<{parts}I", shp, at + 52)
            xy = np.frombuffer(shp, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2)
            rings = [xy[a:b] for a, b in zip(starts, [*starts[1:], points], strict=True)]
        yield rings
        at += 8 + 2 * words


def attributes(dbf: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """Each record of a table file as texts, blanks at the ends dropped."""
    rows, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at, place = [], 32, 1
    while dbf[at] != 0x0D:
        name, width = dbf[at : at + 11].split(b"\0")[0].decode("ascii"), dbf[at + 16]
        fields.append((name, place, width))
        place, at = place + width, at + 32
    for r in range(rows):
        row = dbf[head + r * size : head + (r + 1) * size]
        yield {name: row[a : a + w].decode(encoding, "replace").strip() for name, a, w in fields}


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The ring with only the points that stand out by more than the tolerance; its first and its farthest point stay."""
    if tolerance <= 0 or len(ring) < 5:
        return ring
    keep = np.zeros(len(ring), bool)
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    keep[[0, far, len(ring) - 1]] = True
    todo = [(0, far), (far, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, rel = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = math.hypot(*base)
        off = np.abs(base[0] * rel[:, 1] - base[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep]


def _layer(data: bytes) -> tuple[bytes, bytes, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".shp")]
        if len(names) != 1:
            raise ValueError(f"one layer is needed, found {names}")
        stem = names[0][:-4]
        by = {n.lower(): n for n in z.namelist()}
        table, pages = by.get(stem.lower() + ".dbf"), by.get(stem.lower() + ".cpg")
        if table is None:
            raise ValueError("no attributes")
        return z.read(names[0]), z.read(table), z.read(pages).decode("ascii").strip() if pages else "utf-8"


def features_of(files: DataFrame, project: Projection | None = None, tolerance: float = 0.0) -> DataFrame:
    """path, feature, attributes, rings (lists of flat x, y), low_x, low_y, high_x, high_y of layers given as (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                shp, dbf, encoding = _layer(bytes(data))
                out = []
                for i, (rings, own) in enumerate(zip(polygons(shp), attributes(dbf, encoding), strict=True)):
                    drawn = [simplified(project(r) if project else r, tolerance) for r in rings]
                    every = np.concatenate(drawn) if drawn else np.full((1, 2), np.nan)
                    out.append((name, i, own, [r.ravel().tolist() for r in drawn], *(None if not drawn else float(v) for v in (*every.min(axis=0), *every.max(axis=0)))))
                yield pd.DataFrame(out, columns=["path", "feature", "attributes", "rings", "low_x", "low_y", "high_x", "high_y"])

    return files.select("path", "content").mapInPandas(run, "path string, feature int, attributes map<string,string>, rings array<array<double>>, low_x double, low_y double, high_x double, high_y double")


def drawn(features: DataFrame, width: float = 1000.0, height: float = 600.0, padding: float = 10.0) -> DataFrame:
    """path, feature, attributes, box, outline: SVG paths scaled together to the picture of their layer; features without a shape are left out."""
    w = Window.partitionBy("path")
    box = {"x0": F.min("low_x").over(w), "y0": F.min("low_y").over(w), "x1": F.max("high_x").over(w), "y1": F.max("high_y").over(w)}
    f = features.filter("low_x is not null").withColumns(box)
    scale = F.least((width - 2 * padding) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)), (height - 2 * padding) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)))
    f = f.withColumn("_s", F.coalesce(scale, F.lit(1.0)))
    f = f.withColumns({"_ox": padding + ((width - 2 * padding) - (F.col("x1") - F.col("x0")) * F.col("_s")) / 2, "_oy": padding + ((height - 2 * padding) - (F.col("y1") - F.col("y0")) * F.col("_s")) / 2})
    x, y = (lambda v: F.col("_ox") + (v - F.col("x0")) * F.col("_s")), (lambda v: F.col("_oy") + (F.col("y1") - v) * F.col("_s"))
    point = lambda r, i: F.format_string("%.1f,%.1f", x(F.get(r, 2 * i)), y(F.get(r, 2 * i + 1)))
    # the last point of a ring is its first again
    ring = lambda r: F.when(F.size(r) >= 8, F.concat(F.lit("M"), F.array_join(F.transform(F.sequence(F.lit(0), (F.size(r) / 2).cast("int") - 2), lambda i: point(r, i)), "L"), F.lit("Z"))).otherwise("")
    corner = F.array(F.round(x(F.col("low_x")), 1), F.round(y(F.col("high_y")), 1), F.round((F.col("high_x") - F.col("low_x")) * F.col("_s"), 1), F.round((F.col("high_y") - F.col("low_y")) * F.col("_s"), 1))
    return f.select("path", "feature", "attributes", corner.alias("box"), F.array_join(F.transform("rings", ring), "").alias("outline"))


def compose(features: list[tuple[dict[str, str], list[list[tuple[float, float]]]]]) -> bytes:
    """An archive of one layer: its features are (attributes, closed rings)."""
    shp, count = b"", len(features)
    for i, (_, rings) in enumerate(features):
        points = [p for r in rings for p in r]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        starts = np.cumsum([0, *(len(r) for r in rings[:-1])]).tolist()
        body = struct.pack("<I4dII", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}I", *starts) + struct.pack(f"<{2 * len(points)}d", *(v for p in points for v in p))
        shp += struct.pack(">II", i + 1, len(body) // 2) + body
    header = struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(shp)) // 2) + struct.pack("<II8d", 1000, 5, *[0.0] * 8)
    names = list(features[0][0]) if features else []
    width = 64
    dbf = struct.pack("<4BIHH", 3, 0, 0, 0, count, 33 + 32 * len(names), 1 + width * len(names)) + b"\0" * 20
    dbf += b"".join(n.encode("ascii").ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for n in names) + b"\r"
    dbf += b"".join(b" " + b"".join(str(own[n]).encode()[:width].ljust(width) for n in names) for own, _ in features) + b"\x1a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("layer.shp", header + shp)
        z.writestr("layer.dbf", dbf)
        z.writestr("layer.cpg", "utf-8")
    return out.getvalue()
