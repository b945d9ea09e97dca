"""Numpy image functions: perceptual hashes, colour grid, gradient histogram, alignment, orientation."""

from __future__ import annotations

import atexit
import functools
import hashlib
import importlib
import math
import os
import shutil
import struct
import tempfile
from dataclasses import dataclass

import numpy as np

#: Side of the luma plane, kept frequencies, grid cells; descriptor side, cell side, bins.
PLANE, FREQ, GRID = 32, 8, 4
#: Input height from which a model wants standardised pixels; least bytes of a model, its output lengths.
LARGE_INPUT, MODEL_BYTES, MODEL_DIMS = 150, 1024, (32, 2048)
HOG_SIDE, HOG_CELL, HOG_BINS = 64, 8, 8
#: Eye positions on the 112-pixel template.
TEMPLATE, LEFT_EYE, RIGHT_EYE = 112, (38.2946, 51.6963), (73.5318, 51.5014)
_BASIS = np.cos(np.pi / PLANE * np.outer(np.arange(FREQ), np.arange(PLANE) + 0.5))


def _bits(flags: np.ndarray) -> int:
    value = int.from_bytes(np.packbits(flags.ravel(), bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear rescale with pixel centres aligned."""
    ys = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    xs = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    gx = 1 - fx

    def along(rows: np.ndarray) -> np.ndarray:
        some = image[rows].astype(np.float64)
        return some[:, x0] * gx + some[:, x1] * fx

    return along(y0) * (1 - fy) + along(y1) * fy


def phash(plane: np.ndarray) -> int:
    """64 low frequencies of a 32 x 32 plane against the middle of the 63 non-constant ones."""
    low = (_BASIS @ plane @ _BASIS.T).ravel()
    rest = np.sort(low[1:])
    flags = low > (rest[30] + rest[31]) / 2
    flags[0] = False
    return _bits(flags)


def dhash(plane: np.ndarray) -> int:
    """A bit per neighbouring pair of an 8 x 9 plane: left brighter than right."""
    return _bits(plane[:, :-1] > plane[:, 1:])


def color_grid(rgb: np.ndarray) -> list[int]:
    """Integer means of 4 x 4 cells of a 32 x 32 image, red, green, blue."""
    cells = rgb.astype(np.int64).reshape(GRID, PLANE // GRID, GRID, PLANE // GRID, 3).sum((1, 3)) // (PLANE // GRID) ** 2
    return cells.ravel().tolist()


def signature(rgb: np.ndarray) -> tuple[int, int, list[int]]:
    """(dhash, phash, colour grid) of an image of any size."""
    small = np.floor(resize(rgb, PLANE, PLANE) + 0.5)
    return dhash(luma(np.floor(resize(rgb, 8, 9) + 0.5))), phash(luma(small)), color_grid(small)


def hog(rgb: np.ndarray) -> np.ndarray:
    """Unit gradient-histogram descriptor: 8 unsigned directions per cell, overlapping 2 x 2 blocks normalised."""
    gray = luma(resize(rgb, HOG_SIDE, HOG_SIDE))
    gx, gy = gray[1:-1, 2:] - gray[1:-1, :-2], gray[2:, 1:-1] - gray[:-2, 1:-1]
    size = np.hypot(gx, gy)
    angle = np.arctan2(gy, gx)
    angle = np.where(angle < 0, angle + np.pi, angle)
    direction = np.clip((angle / np.pi * HOG_BINS).astype(int), 0, HOG_BINS - 1)
    n = HOG_SIDE // HOG_CELL
    at = np.arange(1, HOG_SIDE - 1) // HOG_CELL * HOG_BINS
    cells = np.bincount((at[:, None] * n + at + direction).ravel(), weights=np.where(size < 1e-4, 0, size).ravel(), minlength=n * n * HOG_BINS).reshape(n, n, HOG_BINS)
    blocks = np.stack([cells[:-1, :-1], cells[:-1, 1:], cells[1:, :-1], cells[1:, 1:]], 2)
    out = (blocks / np.sqrt((blocks**2).sum((2, 3), keepdims=True) + 1e-6)).ravel()
    norm = np.linalg.norm(out)
    return out if norm < 1e-8 else out / norm


def eye_transform(left: tuple[float, float], right: tuple[float, float], size: int = TEMPLATE) -> np.ndarray:
    """2 x 3 similarity transform that puts the eyes on the template, the one further left on the left (the first given of two
    above each other); eyes under a pixel apart give the box fit around whole pixels."""
    (ax, ay), (bx, by) = sorted((left, right), key=lambda eye: eye[0])
    gap = math.hypot(bx - ax, by - ay)
    if gap < 1:
        return box_transform(int(ax) - 40, int(ay) - 40, int(ax) + 40, int(ay) + 40, size)
    k = size / TEMPLATE
    scale, turn = (RIGHT_EYE[0] - LEFT_EYE[0]) * k / gap, -math.atan2(by - ay, bx - ax)
    c, s = scale * math.cos(turn), scale * math.sin(turn)
    mx, my = (ax + bx) / 2, (ay + by) / 2
    tx, ty = (LEFT_EYE[0] + RIGHT_EYE[0]) / 2 * k, (LEFT_EYE[1] + RIGHT_EYE[1]) / 2 * k
    return np.array([[c, -s, tx - c * mx + s * my], [s, c, ty - s * mx - c * my]])


def box_transform(l: float, t: float, r: float, b: float, size: int = TEMPLATE) -> np.ndarray:  # noqa: E741
    side = 1.35 * max(r - l, b - t)
    cx, cy, k = (l + r) / 2, (t + b) / 2 - 0.05 * (b - t), size / side
    return np.array([[k, 0, size / 2 - k * cx], [0, k, size / 2 - k * cy]])


@functools.lru_cache(maxsize=4)
def _grid(size: int) -> np.ndarray:
    """Places of a square's pixels, as columns."""
    y, x = np.mgrid[0:size, 0:size]
    return np.stack([x.ravel(), y.ravel(), np.ones(size * size)])


def warp(image: np.ndarray, transform: np.ndarray, size: int = TEMPLATE) -> np.ndarray:
    """Render the aligned crop; outside the image is black."""
    inverse = np.linalg.inv(np.vstack([transform, [0, 0, 1]]))[:2]

    def sides(s: np.ndarray, n: int) -> tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]:
        """The part of an axis that is read; both neighbours in it and their weights, none outside the image."""
        low = np.floor(s)
        part, low = s - low, low.astype(int)
        start, stop = max(0, min(n - 1, int(low.min()))), max(1, min(n, int(low.max()) + 2))
        return start, stop, [(np.clip(at, start, stop - 1) - start, np.where((at >= 0) & (at < n), 1 - abs(part - d), 0)) for d in (0, 1) for at in (low + d,)]

    sx, sy = inverse @ _grid(size)
    left, right, columns = sides(sx, image.shape[1])
    top, bottom, rows = sides(sy, image.shape[0])
    # by channel: rows of numbers, which numpy takes at once
    planes = np.ascontiguousarray(image[top:bottom, left:right].transpose(2, 0, 1)).reshape(3, -1)
    out = np.zeros((3, size * size))
    for x, u in columns:
        for y, v in rows:
            out += np.take(planes, y * (right - left) + x, axis=1) * (u * v)
    return out.reshape(3, size, size).transpose(1, 2, 0)


def orientation_degrees(content: bytes) -> int:
    """Rotation stated by a JPEG's orientation tag: 90, 180, 270, else 0 (mirrored ones too)."""
    if content[:2] != b"\xff\xd8":
        return 0
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                start = struct.unpack(order + "I", tiff[4:8])[0]
                for k in range(struct.unpack(order + "H", tiff[start : start + 2])[0]):
                    tag, _, _, value = struct.unpack(order + "HHIH", tiff[start + 2 + 12 * k : start + 12 + 12 * k])
                    if tag == 0x0112:
                        return {3: 180, 6: 90, 8: 270}.get(value, 0)
            except struct.error:
                return 0
        if kind == 0xDA:
            break
        at += 2 + size
    return 0


def normalise_pixels(rgb: np.ndarray, mode: str) -> np.ndarray:
    """Model input: raw bytes, fixed scale, or standardised per image."""
    if mode == "raw":
        return rgb.astype(np.uint8)
    x = rgb.astype(np.float32)
    return (x - 127.5) / 128 if mode == "fixed" else (x - x.mean()) / max(float(x.std()), 1 / math.sqrt(x.size))


def input_mode(quantised: bool, height: int) -> str:
    """How a model wants its pixels: raw bytes when quantised, standardised by image for large inputs, else scaled."""
    return "raw" if quantised else "standard" if height >= LARGE_INPUT else "fixed"


def dequantised(values: np.ndarray, zero: int, scale: float) -> np.ndarray:
    """Real values of a quantised model's output bytes."""
    return (values.astype(np.float32) - np.float32(zero)) * np.float32(scale)


def subsampled(rgb: np.ndarray, least_short: int, most_long: int | None = None) -> np.ndarray:
    """Means of k x k pixels, with k from ``sample_size``; what is left at the edges is cut off."""
    k = sample_size(rgb.shape[1], rgb.shape[0], least_short, most_long)
    if k == 1:
        return rgb
    h, w = rgb.shape[0] // k, rgb.shape[1] // k
    return rgb[: h * k, : w * k].reshape(h, k, w, k, rgb.shape[2]).astype(np.int64).sum((1, 3)) // (k * k)


def upright(rgb: np.ndarray, degrees: int) -> np.ndarray:
    """Turn a picture clockwise by a multiple of 90 degrees."""
    return np.rot90(rgb, -degrees // 90)


def thumbnail_box(l: int, t: int, r: int, b: int, unit: int = 10_000, least: float = 0.02) -> tuple[float, float, float, float]:  # noqa: E741
    """Left, top, width and height, as shares of a picture, of a stored box; no side under ``least``."""
    return l / unit, t / unit, max((r - l) / unit, least), max((b - t) / unit, least)


def sample_size(width: int, height: int, least_short: int, most_long: int | None = None) -> int:
    """Power-of-two subsampling of a decode."""
    k = 1
    while min(width, height) / (2 * k) >= least_short:
        k *= 2
    while most_long and max(width, height) / k > most_long:
        k *= 2
    return k


def synthetic_id(uri: str) -> int:
    """FNV-1a over UTF-16 units, 46 bits kept, bit 62 set."""
    h, raw = 0xCBF29CE484222325, uri.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = ((h ^ (raw[k] | raw[k + 1] << 8)) * 0x100000001B3) & (1 << 64) - 1
    return h & 0x3FFFFFFFFFFF | 1 << 62


#: Embedders by name: function of an aligned RGB crop, its length, its version.
EMBEDDERS = {"hog": (hog, (HOG_SIDE // HOG_CELL - 1) ** 2 * 4 * HOG_BINS, 1)}


def register_embedder(name: str, function, dim: int, version: int) -> None:
    """Add an embedder after one probe inference; the length must be between 32 and 2048."""
    probe = np.asarray(function(np.zeros((TEMPLATE, TEMPLATE, 3))))
    if not MODEL_DIMS[0] <= dim <= MODEL_DIMS[1] or probe.shape != (dim,):
        raise ValueError(f"embedder {name}: expected {dim} values, got {probe.shape}")
    EMBEDDERS[name] = (function, dim, version)


def load_model(path: str):
    """Function, length and input height of an ONNX model; needs onnxruntime, which is optional."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    asked, given = session.get_inputs()[0], session.get_outputs()[0]
    shape = [x if isinstance(x, int) else 1 for x in asked.shape]
    channels_first = shape[1] == 3
    height = shape[2] if channels_first else shape[1]
    quantised = "uint8" in asked.type

    def embed(rgb: np.ndarray) -> np.ndarray:
        x = normalise_pixels(resize(rgb, height, height), input_mode(quantised, height))
        x = x.transpose(2, 0, 1) if channels_first else x
        out = np.asarray(session.run([given.name], {asked.name: x[None]})[0], np.float32).ravel()
        return out / max(float(np.linalg.norm(out)), 1e-8)

    return embed, int(given.shape[-1]), height


def model_fault(path: str, load=load_model) -> str | None:
    """What keeps a model file from being used, or None: too small, can't be loaded, odd output length, a failed probe."""
    if not os.path.isfile(path) or os.path.getsize(path) < MODEL_BYTES:
        return "too small"
    try:
        embed, dim, _ = load(path)
    except Exception as e:  # noqa: BLE001  any failure of a foreign file is a fault of that file
        return f"can't be loaded: {type(e).__name__}"
    if not MODEL_DIMS[0] <= dim <= MODEL_DIMS[1]:
        return f"output of {dim} values"
    try:
        probe = np.asarray(embed(np.zeros((TEMPLATE, TEMPLATE, 3))))
    except Exception as e:  # noqa: BLE001
        return f"probe failed: {type(e).__name__}"
    return None if probe.shape == (dim,) and np.isfinite(probe).all() else "probe gave odd values"


def choose_embedder(*paths: str | None, load=load_model) -> str:
    """Register the first usable model of the given files (the imported one, then the bundled one) and return its name;
    the gradient histogram where none is."""
    from millrace.config import model_version

    for path in paths:
        if path and model_fault(path, load) is None:
            embed, dim, _ = load(path)
            register_embedder(path, embed, dim, model_version(os.path.getsize(path), dim))
            return path
    return "hog"


#: Loader of shipped models: ``module:function``, as workers import it.
LOADER = "millrace.functions.images:load_model"


@functools.lru_cache(maxsize=4)
def _loaded(file: str, loader: str):
    """A model's function, loaded once a process."""
    from pyspark import SparkFiles

    module, name = loader.split(":")
    return getattr(importlib.import_module(module), name)(SparkFiles.get(file))[0]


@dataclass(frozen=True)
class Shipped:
    """An embedder that stands for a file of the session: tasks get the two names, and each worker loads the model itself."""

    file: str
    loader: str = LOADER

    def __call__(self, rgb: np.ndarray) -> np.ndarray:
        return _loaded(self.file, self.loader)(rgb)


def ship_model(spark, path: str, loader: str = LOADER) -> str:
    """Check a staged model file, send it to all workers and register it under its path; an error says what is wrong with it,
    and then nothing has changed. The name among the session's files comes from the content, so that a new file under an
    old path is another model."""
    from millrace.config import model_version

    module, name = loader.split(":")
    load = getattr(importlib.import_module(module), name)
    fault = model_fault(path, load)
    if fault:
        raise ValueError(f"model {path}: {fault}")
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    folder = tempfile.mkdtemp(prefix="millrace-model-")  # the driver's own: workers fetch the file from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = os.path.join(folder, f"{digest}.model")
    shutil.copyfile(path, file)
    spark.sparkContext.addFile(file)
    dim = load(path)[1]
    EMBEDDERS[path] = (Shipped(os.path.basename(file), loader), dim, model_version(os.path.getsize(path), dim))
    return path


def promote(spark, path: str, faces, face_scan, loader: str = LOADER):
    """Take a staged model into use: ``ship_model``, and the faces and scans without what other models made. Returns the
    embedder's name and both tables."""
    from millrace.operators.snapshot import purge_versions

    name = ship_model(spark, path, loader)
    return name, purge_versions(faces, EMBEDDERS[name][2]), purge_versions(face_scan, EMBEDDERS[name][2])


def shipped_embedder(spark, *paths: str | None, loader: str = LOADER) -> str:
    """Ship the first usable model of the given files and return its name; the gradient histogram where none is."""
    for path in paths:
        if path:
            try:
                return ship_model(spark, path, loader)
            except ValueError:
                continue
    return "hog"
