"""Images, sound, mail and signed claims as rows of features.

Pixels come as raw arrays (``gray``: bytes, width, height; ``rgb`` likewise), as
this box has no decoder; where one is installed, it fills the same columns.
Everything else here is a scan of bytes.  All functions work on Arrow batches.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from email.parser import BytesHeaderParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from glyphmill.functions import text as T

# Extensions by kind.
IMAGE = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff")
AUDIO = (".wav", ".mp3", ".m4a", ".aac", ".flac", ".ogg", ".opus")
VIDEO = (".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v")
OFFICE = (".docx", ".docm", ".pptx", ".pptm", ".xlsx", ".xlsm")
TEXT = (".txt", ".md", ".csv", ".json", ".xml", ".html", ".htm", ".js", ".ts", ".tsx", ".jsx", ".py", ".java", ".c", ".cpp", ".cs", ".go", ".rs", ".php", ".rb", ".sql", ".sh", ".yaml", ".yml")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.\\/]+)$", 1))


def route(name: Column) -> Column:
    """Which analysis a file takes."""
    e = extension(name)
    return F.when(e.isin(*IMAGE), "image").when(e == ".pdf", "pdf").when(e.isin(*AUDIO), "audio").when(e.isin(*VIDEO), "video").when(e.isin(*OFFICE), "office").when(e == ".eml", "mail").when(e.isin(*TEXT), "text").otherwise("other")


def magic(content: Column) -> Column:
    """Kind of a file by its first bytes."""
    h = F.lower(F.hex(F.substring(content, 1, 12)))
    return F.when(h.startswith("504b0304"), "ZIP / OOXML container").when(h.startswith("255044462d"), "PDF").when(h.startswith("89504e470d0a1a0a"), "PNG").when(h.startswith("ffd8ff"), "JPEG").when(h.startswith("d0cf11e0a1b11ae1"), "OLE Compound Binary").otherwise("Unknown / text-like")


@F.pandas_udf(DoubleType())
def byte_entropy(contents: pd.Series) -> pd.Series:
    """Bits a byte, three decimals; 0 for no bytes."""

    def one(b):
        n = np.bincount(np.frombuffer(b or b"", np.uint8), minlength=256)
        p = n[n > 0] / max(n.sum(), 1)
        return round(float(-(p * np.log2(p)).sum()) + 0.0, 3)

    return contents.map(one)


def identity(files: DataFrame) -> DataFrame:
    """files with extension, kind, size, sha256, entropy and magic."""
    return files.withColumns({"extension": extension(F.col("name")), "kind": route(F.col("name")), "size": F.octet_length("content"), "sha256": F.sha2("content", 256), "entropy": byte_entropy("content"), "magic": magic(F.col("content"))})


# --- containers --------------------------------------------------------------

MARKERS = "asset_id string, kind string, segment string, offset long, length long, trailing long"


def jpeg_segments(b: bytes) -> tuple[list[tuple[str, int, int]], int]:
    """(marker, offset, length) up to the scan, and bytes after the end of the image."""
    out, i = [], 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        marker = b[i + 1]
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            i += 2
            continue
        if marker == 0xD9:
            break
        n = struct.unpack(">H", b[i + 2 : i + 4])[0]
        out.append((f"FF{marker:02X}", i, n))
        if marker == 0xDA:
            break
        i += 2 + max(n, 2)
    end = b.rfind(b"\xff\xd9")
    return out, len(b) - end - 2 if end >= 0 else 0


def png_chunks(b: bytes) -> tuple[list[tuple[str, int, int]], int]:
    """(type, offset, length), and bytes after IEND."""
    out, i, trailing = [], 8, 0
    while i + 12 <= len(b):
        n, kind = struct.unpack(">I", b[i : i + 4])[0], b[i + 4 : i + 8].decode("latin-1")
        out.append((kind, i, n))
        i += 12 + n
        if kind == "IEND":
            trailing = max(0, len(b) - i)
            break
    return out, trailing


def _segments(batches):
    for frame in batches:
        rows = []
        for asset, b in zip(frame["asset_id"], frame["content"]):
            b = b or b""
            kind = "jpeg" if b[:2] == b"\xff\xd8" else "png" if b[:8] == b"\x89PNG\r\n\x1a\n" else None
            if kind:
                found, trailing = jpeg_segments(b) if kind == "jpeg" else png_chunks(b)
                rows += [(asset, kind, s, o, n, trailing) for s, o, n in found]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MARKERS.split(", ")])


def container_segments(assets: DataFrame) -> DataFrame:
    """A row a segment or chunk of JPEG and PNG files."""
    return assets.select(F.col("asset_id").cast("string").alias("asset_id"), "content").mapInPandas(_segments, MARKERS)


def container_scores(assets: DataFrame) -> DataFrame:
    """asset_id, markers of generators, container signal score."""
    text = F.decode("content", "ISO-8859-1")
    names = T.tool_names(text)
    seg = container_segments(assets).groupBy("asset_id").agg(F.max("trailing").alias("trailing"), F.bool_or(F.col("segment") == "FFED").alias("photoshop"), F.bool_or(F.col("segment") == "FFE1").alias("app1"), F.count("*").alias("segments"))
    j = assets.select(F.col("asset_id").cast("string").alias("asset_id"), names.alias("generators")).join(seg, "asset_id")
    score = F.when(F.size("generators") > 0, 85).otherwise(0) + F.when(F.col("trailing") > 0, 10).otherwise(0) + F.when(F.col("photoshop"), 8).otherwise(0)
    return j.withColumn("container_score", F.least(F.lit(100), score).cast("long"))


def office_media(media_parts: DataFrame) -> DataFrame:
    """asset_id, entries, images, best_image: a package's embedded media (asset_id, position, name, content), those that are images scored by their containers."""
    one = F.concat_ws("#", "asset_id", F.col("position").cast("string"))
    rows = media_parts.withColumn("part_id", one).withColumn("is_image", extension(F.col("name")).isin(*IMAGE))
    images = rows.where("is_image").select(F.col("part_id").alias("asset_id"), "content")
    scores = container_scores(images).select(F.col("asset_id").alias("part_id"), "container_score")
    return rows.join(scores, "part_id", "left").groupBy("asset_id").agg(F.count("*").alias("entries"), F.count_if("is_image").alias("images"), F.max("container_score").alias("best_image"))


RECOMPRESSION = StructType().add("mean", DoubleType()).add("std", DoubleType()).add("largest", IntegerType()).add("score", IntegerType())


@F.pandas_udf(RECOMPRESSION)
def recompression(gray: pd.Series, again: pd.Series) -> pd.DataFrame:
    """How far a grey image lies from itself after it was saved anew; null pixels give nulls.

    The pixels of both come from a decoder, of up to 384 a side.
    """

    def one(a, b):
        if a is None or b is None:
            return (None, None, None, None)
        n = min(len(a), len(b))
        d = np.abs(np.frombuffer(a, np.uint8)[:n].astype(float) - np.frombuffer(b, np.uint8)[:n])
        mean = float(d.mean()) if n else 0.0
        std = float(np.sqrt(max(0.0, float((d * d).mean()) - mean * mean))) if n else 0.0
        return round(mean, 3), round(std, 3), int(d.max(initial=0)), int(min(100, max(0, np.floor(mean * 4 + std * 2 + 0.5))))

    return pd.DataFrame([one(a, b) for a, b in zip(gray, again)], columns=["mean", "std", "largest", "score"])


def mail(files: DataFrame) -> DataFrame:
    """asset_id, headers (last one of a name counts, folded lines joined), body."""
    whole = F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n"))
    cut = F.split(whole, "\n\n", 2)
    lines = F.split(F.regexp_replace(cut[0], r"\n[ \t]+", " "), "\n")
    pairs = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 1), lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), T.trimmed(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))
    return files.select("asset_id", last.alias("headers"), F.coalesce(F.get(cut, 1), F.lit("")).alias("body"))


def headers_of(raw: bytes) -> dict[str, str]:
    """The standard library's reading of headers, for comparison in tests."""
    return {k.lower(): v for k, v in BytesHeaderParser().parsebytes(raw).items()}


# --- pixels ------------------------------------------------------------------


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def gray_stats(g: np.ndarray) -> dict[str, float]:
    """Moments, entropy, clipping, edges, 8-pixel block edges and noise of a grey image."""
    g = g.astype(float)
    n = np.bincount(g.astype(int).ravel(), minlength=256) / max(g.size, 1)
    c = g[1:-1, 1:-1]
    dx, dy = np.abs(c - g[1:-1, :-2]), np.abs(c - g[:-2, 1:-1])
    ys, xs = np.mgrid[1 : g.shape[0] - 1, 1 : g.shape[1] - 1]
    around = (g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1]) / 4
    at_x, at_y = xs % 8 == 0, ys % 8 == 0
    blocks = at_x.sum() + at_y.sum()
    mean = lambda a: float(a.mean()) if a.size else 0.0
    return {
        "mean": g.mean(), "std": g.std(), "entropy": _entropy(n), "clipped": 100 * float(((g < 3) | (g > 252)).mean()),
        "edge": (mean(dx) + mean(dy)) / 2, "block_edge": (dx[at_x].sum() + dy[at_y].sum()) / max(blocks, 1), "noise": mean(np.abs(c - around)),
    }


def copied_patches(g: np.ndarray, tile: int = 16) -> int:
    """Pairs of tiles with like mean and spread that lie more than two tiles apart."""
    h, w = g.shape[0] // tile, g.shape[1] // tile
    t = g[: h * tile, : w * tile].astype(float).reshape(h, tile, w, tile).swapaxes(1, 2).reshape(h, w, -1)
    mean, std = np.floor(t.mean(-1) / 4 + 0.5) * 4, np.floor(t.std(-1) / 4 + 0.5) * 4
    at = np.argwhere(std >= 6)
    key = mean[tuple(at.T)] * 1000 + std[tuple(at.T)]
    pairs = 0
    for k in np.unique(key):
        p = at[key == k] * tile
        far = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) > 2 * tile
        pairs += int(np.triu(far, 1).sum())
    return pairs


def tile_stats(rgb: np.ndarray, x0: int, y0: int, x1: int, y1: int, step: int = 2) -> dict[str, float]:
    """Noise, edge, colour, sensor-pattern and compression statistics of a tile, over every second pixel."""
    h, w = rgb.shape[:2]
    xs = np.arange(max(1, x0 + 1), min(w - 1, x1 - 1), step)
    ys = np.arange(max(1, y0 + 1), min(h - 1, y1 - 1), step)
    if not len(xs) or not len(ys):
        return dict.fromkeys(TILE, 0.0)
    lum = rgb.astype(float) @ np.array([0.2126, 0.7152, 0.0722])
    at = lambda dy, dx: lum[np.ix_(ys + dy, xs + dx)]
    m, left, right, up, down = at(0, 0), at(0, -1), at(0, 1), at(-1, 0), at(1, 0)
    r, g, b = (rgb[np.ix_(ys, xs)][..., i].astype(float) for i in range(3))
    res, gx, gy = m - (left + right + up + down) / 4, np.abs(m - right), np.abs(m - down)
    colour, most = np.abs(r - g) + np.abs(b - g), np.maximum(np.maximum(r, g), b)
    hist = np.bincount(np.minimum(31, (m / 8).astype(int)).ravel(), minlength=32) / m.size
    grid = (xs[None] % 8 == 0) | (ys[:, None] % 8 == 0)
    even = (xs[None] + ys[:, None]) % 2 == 0
    phases = np.array([np.abs(m - left)[:, xs % 8 == k].mean() if (xs % 8 == k).any() else 0.0 for k in range(8)])
    flat, lap = gx + gy < 8, 4 * m - left - right - up - down
    return {
        "high_pass": np.abs(res).mean(), "edge": (gx + gy).mean() / 2, "chroma": colour.mean(), "chroma_std": colour.std(), "entropy": _entropy(hist), "std": m.std(),
        "grid8": (gx + gy)[grid].sum() / (2 * max(grid.sum(), 1)), "saturation": np.where(most > 0, (most - np.minimum(np.minimum(r, g), b)) / np.maximum(most, 1), 0).mean(),
        "flat_noise": np.abs(res)[flat].mean() if flat.any() else 0.0, "diag": np.abs(left + down - right - up).mean(), "orientation": abs(gx.sum() - gy.sum()) / (gx.sum() + gy.sum() + 1e-6),
        "cfa": abs(colour[even].sum() - colour[~even].sum()) / (colour.sum() + 1e-6), "red_green_std": (r - g).std(), "blue_green_std": (b - g).std(),
        "laplacian": np.abs(lap).mean(), "laplacian_bias": abs(lap.mean()), "jpeg_phase": (phases.max() - phases.min()) / (np.median(phases) + 1e-6),
    }


TILE = ("high_pass", "edge", "chroma", "chroma_std", "entropy", "std", "grid8", "saturation", "flat_noise", "diag", "orientation", "cfa", "red_green_std", "blue_green_std", "laplacian", "laplacian_bias", "jpeg_phase")


def hex_bits(bits: np.ndarray) -> str:
    return np.packbits(bits.astype(bool).ravel()).tobytes().hex()


def shrunk(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over the boxes that a pixel of the small image covers."""
    ys, xs = np.linspace(0, g.shape[0], h + 1), np.linspace(0, g.shape[1], w + 1)
    sums = np.pad(g.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, y1, x0, x1 = ys[:-1].astype(int), np.maximum(np.ceil(ys[1:]).astype(int), 1), xs[:-1].astype(int), np.maximum(np.ceil(xs[1:]).astype(int), 1)
    area = np.outer(y1 - y0, x1 - x0)
    return (sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]) / area


def image_hashes(g: np.ndarray) -> dict[str, str]:
    """Average and difference hash of 256 bits; DCT and centre difference hash of 64."""
    a, d = shrunk(g, 16, 16), shrunk(g, 16, 17)
    small = shrunk(g, 32, 32)
    k = np.arange(32)
    basis = np.cos((2 * k[None] + 1) * np.arange(8)[:, None] * np.pi / 64)
    dct = (basis @ small.T @ basis.T).ravel()
    bits = dct >= np.sort(dct[1:])[31]
    bits[0] = False
    z = max(8, int(min(g.shape) * 0.6))
    top, left = max(0, (g.shape[0] - z) // 2), max(0, (g.shape[1] - z) // 2)
    c = shrunk(g[top : top + z, left : left + z], 8, 9)
    return {"ahash256": hex_bits(a >= a.mean()), "dhash256": hex_bits(d[:, 1:] >= d[:, :-1]), "phash64": hex_bits(bits), "center_dhash64": hex_bits(c[:, 1:] >= c[:, :-1])}


GRAY = "asset_id string, mean double, std double, entropy double, clipped double, edge double, block_edge double, noise double, copied_pairs long, ahash256 string, dhash256 string, phash64 string, center_dhash64 string"


def _gray(batches):
    for frame in batches:
        rows = []
        for asset, b, w, h in zip(frame["asset_id"], frame["gray"], frame["width"], frame["height"]):
            g = np.frombuffer(b, np.uint8).reshape(h, w)
            rows.append({"asset_id": asset, **gray_stats(g), "copied_pairs": copied_patches(g), **image_hashes(g)})
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in GRAY.split(", ")])


def gray_features(images: DataFrame) -> DataFrame:
    """A row an image of (asset_id, gray, width, height)."""
    return images.select("asset_id", "gray", "width", "height").mapInPandas(_gray, GRAY)


TILES = "asset_id string, columns int, gx int, gy int, x0 int, y0 int, x1 int, y1 int, " + ", ".join(f"{k} double" for k in TILE)
PASSES = (7, 11, 17, 23)


def _tiles(batches):
    for frame in batches:
        rows = []
        for asset, b, w, h in zip(frame["asset_id"], frame["rgb"], frame["width"], frame["height"]):
            rgb = np.frombuffer(b, np.uint8).reshape(h, w, 3)
            rows.append({"asset_id": asset, "columns": 1, "gx": 0, "gy": 0, "x0": 0, "y0": 0, "x1": w, "y1": h, **tile_stats(rgb, 0, 0, w, h)})
            for cols, least in zip(PASSES, (5, 7, 10, 13)):
                n = max(least, round(cols * h / w))
                for gy in range(n):
                    for gx in range(cols):
                        box = {"x0": int(gx * w / cols), "y0": int(gy * h / n), "x1": int(np.ceil((gx + 1) * w / cols)), "y1": int(np.ceil((gy + 1) * h / n))}
                        rows.append({"asset_id": asset, "columns": cols, "gx": gx, "gy": gy, **box, **tile_stats(rgb, **box)})
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")])


def tiles(images: DataFrame) -> DataFrame:
    """A row a tile of each of four grids, and one (columns = 1) for the whole image."""
    return images.select("asset_id", "rgb", "width", "height").mapInPandas(_tiles, TILES)


# --- sound -------------------------------------------------------------------

SOUND = "asset_id string, available boolean, seconds double, rms double, dc double, clipped double, crossings double, identical_blocks long"
RATE, MOST_SECONDS = 16_000, 60


def pcm_stats(x: np.ndarray, rate: int = RATE) -> dict:
    """Level, offset, clipping, zero crossings and identical seconds of samples in -1..1."""
    x = x[: MOST_SECONDS * rate]
    if not len(x):
        return {"available": False}
    whole = np.floor(x * 127 + 0.5).astype(np.int16)[: len(x) // rate * rate].reshape(-1, rate)
    hashes = [hashlib.sha1(s.tobytes()).digest() for s in whole]
    return {"available": True, "seconds": round(len(x) / rate, 2), "rms": round(float(np.sqrt((x * x).mean())), 5), "dc": round(float(x.mean()), 5), "clipped": round(float((np.abs(x) > 0.995).mean() * 100), 4), "crossings": round(float(((x[1:] >= 0) != (x[:-1] >= 0)).sum() / (len(x) / rate)), 2), "identical_blocks": len(hashes) - len(set(hashes))}


def _sound(batches):
    for frame in batches:
        rows = []
        for asset, b in zip(frame["asset_id"], frame["content"]):
            try:
                with wave.open(io.BytesIO(b)) as f:
                    data = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()) / 32768
                    rows.append({"asset_id": asset, **pcm_stats(data.mean(1), f.getframerate())})
            except (wave.Error, EOFError, ValueError, TypeError):
                rows.append({"asset_id": asset, "available": False})
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SOUND.split(", ")])


def sound_features(assets: DataFrame) -> DataFrame:
    """A row a WAV file; other formats need a decoder and are available = false."""
    return assets.select("asset_id", "content").mapInPandas(_sound, SOUND)


def frame_ranges(frames: DataFrame) -> DataFrame:
    """asset_id, frames, noise and edge range over a video's sampled frames."""
    return frames.groupBy("asset_id").agg(F.count("*").alias("frames"), F.round(F.max("noise") - F.min("noise"), 3).alias("noise_range"), F.round(F.max("edge") - F.min("edge"), 3).alias("edge_range"))


def sample_points(duration: Column) -> Column:
    """Seconds at which a video's frames are taken; by whole percents, as 0.28 of 100 is more than 28 in doubles."""
    return F.when(duration > 0, F.transform(F.array(*map(F.lit, (8, 28, 50, 72, 92))), lambda x: x * duration / 100)).otherwise(F.array(*map(F.lit, (0.0, 1.0, 2.0))))


# --- signed claims -----------------------------------------------------------

STORE = "active_manifest string, validation_state string, validation_status array<struct<code:string>>, manifests map<string,struct<title:string,assertions:array<struct<label:string,data:struct<actions:array<struct<digitalSourceType:string>>>>>>>"


def claims(stores: DataFrame, json: str = "store") -> DataFrame:
    """present, valid, trusted, ai_declared of a manifest store; only the active manifest's actions count."""
    s = F.from_json(json, STORE)
    active = F.try_element_at(s["manifests"], s["active_manifest"])
    actions = F.flatten(F.transform(F.filter(active["assertions"], lambda a: a["label"].rlike(r"^c2pa\.actions(?:\.v[0-9]+)?$")), lambda a: a["data"]["actions"]))
    ai = F.exists(actions, lambda x: x["digitalSourceType"].rlike(r"(?i)(?:^|/)(?:compositeWith)?TrainedAlgorithmicMedia$|(?:^|/)algorithmicMedia$"))
    present = active.isNotNull()
    valid = present & s["validation_state"].isin("Valid", "Trusted") & (F.coalesce(F.size(s["validation_status"]), F.lit(0)) <= 0)
    f = lambda c: F.coalesce(c, F.lit(False))
    return stores.withColumns({"present": f(present), "valid": f(valid), "trusted": f(valid & (s["validation_state"] == "Trusted")), "ai_declared": f(present & ai)})
