"""Pixel kernels over RGBA rasters, and their use on image rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import RedactionError
from .redact import permitted

BLOCK, PADDING = 12, 2
HATCH = (34, 12)  # tones of the stripes


def _seed(text: str) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")))


def box(rect: dict, width: int, height: int, padding: float = PADDING) -> tuple[int, int, int, int]:
    """The padded rectangle, snapped outward and clamped: x0, y0, x1, y1."""
    x0, y0 = np.floor(rect["x"] - padding), np.floor(rect["y"] - padding)
    x1, y1 = np.ceil(rect["x"] + rect["width"] + padding), np.ceil(rect["y"] + rect["height"] + padding)
    clamp = lambda v, top: int(min(max(v, 0), top))
    return clamp(x0, width), clamp(y0, height), clamp(x1, width), clamp(y1, height)


def blackout(part: np.ndarray, op_id: str) -> None:
    part[...] = (0, 0, 0, 255)


def scramble(part: np.ndarray, op_id: str) -> None:
    """Noise that depends on the operation alone."""
    part[..., :3] = _seed(op_id).integers(0, 256, part.shape[:2] + (3,), dtype=np.uint8)
    part[..., 3] = 255


def hatch(part: np.ndarray, op_id: str) -> None:
    y, x = np.indices(part.shape[:2])
    part[..., :3] = np.where(((x + y) // 6 % 2 == 0)[..., None], HATCH[0], HATCH[1]).astype(np.uint8)
    part[..., 3] = 255


def noise_mosaic(part: np.ndarray, op_id: str) -> None:
    """Blocks of one random tone each; nothing of the original enters."""
    h, w = part.shape[:2]
    tones = _seed(op_id).integers(0, 256, (-(-h // BLOCK), -(-w // BLOCK), 3), dtype=np.uint8)
    part[..., :3] = tones.repeat(BLOCK, 0).repeat(BLOCK, 1)[:h, :w]
    part[..., 3] = 255


def _means(part: np.ndarray) -> np.ndarray:
    out = part.astype(float)
    for y in range(0, part.shape[0], BLOCK):
        for x in range(0, part.shape[1], BLOCK):
            out[y : y + BLOCK, x : x + BLOCK] = part[y : y + BLOCK, x : x + BLOCK].reshape(-1, 4).mean(axis=0)
    return out


def pixelate(part: np.ndarray, op_id: str) -> None:
    """Block means: recoverable, refused unless allowed."""
    part[...] = np.rint(_means(part)).astype(np.uint8)


def synthetic_mosaic(part: np.ndarray, op_id: str) -> None:
    """Block means with an offset in [-30, 29] of the operation's seed: recoverable as well."""
    part[..., :3] = np.clip(_means(part)[..., :3] + int(_seed(op_id).integers(-30, 30)), 0, 255).astype(np.uint8)


KERNELS = {"blackout": blackout, "scramble": scramble, "hatch": hatch, "noise-mosaic": noise_mosaic, "pixelate": pixelate, "synthetic-mosaic": synthetic_mosaic}


def burn(pixels: bytes, width: int, height: int, ops: list[dict], allow_recoverable: bool = False) -> bytes:
    """RGBA pixels with every region operation done."""
    if len(pixels) != width * height * 4:
        raise RedactionError("E_PARSE", f"{len(pixels)} bytes are not {width} x {height} RGBA pixels")
    image = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 4).copy()
    for op in ops:
        permitted(op["strategy"], allow_recoverable)
        if op["strategy"] not in KERNELS:
            raise RedactionError("E_UNSUPPORTED", f"{op['strategy']} has no kernel")
        x0, y0, x1, y1 = box(op["rect"], width, height)
        if x1 > x0 and y1 > y0:
            KERNELS[op["strategy"]](image[y0:y1, x0:x1], op["op_id"])
    return image.tobytes()


def redact_rasters(images: DataFrame, ops: DataFrame, allow_recoverable: bool = False) -> DataFrame:
    """``(doc_id, width, height, pixels, error)`` of ``images(doc_id, width, height, pixels)`` after ``ops(doc_id, op_id, strategy, rect)``; a bad image is an error row."""

    def run(key, left, right):
        todo = sorted(right.to_pylist(), key=lambda o: o["op_id"])
        out = []
        for r in left.to_pylist():
            try:
                out.append((r["doc_id"], r["width"], r["height"], burn(r["pixels"], r["width"], r["height"], todo, allow_recoverable), None))
            except RedactionError as e:
                out.append((r["doc_id"], r["width"], r["height"], None, str(e)))
        kinds = [("doc_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(kinds)})

    return images.groupBy("doc_id").cogroup(ops.groupBy("doc_id")).applyInArrow(run, "doc_id string, width int, height int, pixels binary, error string")
