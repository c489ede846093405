"""Image functions that need a neighbourhood of pixels: vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

WINDOW, SIGMA, C1, C2 = 11, 1.5, 1e-4, 9e-4


def _window(size: int = WINDOW, sigma: float = SIGMA) -> np.ndarray:
    at = np.arange(size) - size // 2
    w = np.exp(-(at**2) / (2 * sigma * sigma))
    return w / w.sum()


def _filtered(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Separable filter with zeros outside, over the last two axes."""
    half = len(w) // 2
    p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(half, half), (half, half)])
    rows = sum(k * p[..., i : i + x.shape[-2], :] for i, k in enumerate(w))
    return sum(k * rows[..., i : i + x.shape[-1]] for i, k in enumerate(w))


def ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity of arrays (..., channels, height, width), one for each of the leading axes."""
    w = _window()
    ma, mb = _filtered(a, w), _filtered(b, w)
    va, vb, cov = _filtered(a * a, w) - ma * ma, _filtered(b * b, w) - mb * mb, _filtered(a * b, w) - ma * mb
    return (((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))).mean(axis=(-3, -2, -1))


def sobel(x: np.ndarray) -> np.ndarray:
    """Edge magnitude with zeros outside, over the last two axes."""
    p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(1, 1), (1, 1)])
    down = p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :]
    across = p[..., :-2] + 2 * p[..., 1:-1] + p[..., 2:]
    gx, gy = down[..., 2:] - down[..., :-2], across[..., 2:, :] - across[..., :-2, :]
    return np.sqrt(gx * gx + gy * gy + 1e-12)


def edge_l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(sobel(a) - sobel(b)).mean(axis=(-3, -2, -1))


def _linear(t: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - t)


def _cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    """Keys' cubic convolution kernel."""
    near = (a + 2) * t**3 - (a + 3) * t**2 + 1
    far = a * (t**3 - 5 * t**2 + 8 * t - 4)
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


Taps = tuple[np.ndarray, np.ndarray]


@cache
def taps(n: int, m: int, kernel: Callable[[np.ndarray], np.ndarray] = _linear) -> Taps:
    """Sparse weights that bring n values to m: which values each result takes (m x k), and their shares (m x k), which sum to 1. Shrinking widens the kernel, so that nothing is passed over."""
    scale = max(n / m, 1.0)
    reach = (2.0 if kernel is _cubic else 1.0) * scale
    centre = (np.arange(m) + 0.5) * n / m
    first = np.floor(centre - reach).astype(int)
    at = first[:, None] + np.arange(int(np.ceil(2 * reach)) + 2)
    w = np.where((at >= 0) & (at < n), kernel(np.abs((at + 0.5 - centre[:, None]) / scale)), 0.0)
    used = np.flatnonzero(w.any(axis=0))
    at, w = at[:, used[0] : used[-1] + 1], w[:, used[0] : used[-1] + 1]
    return np.clip(at, 0, n - 1), w / w.sum(axis=1, keepdims=True)


def resized(x: np.ndarray, height: int, width: int, kernel: Callable[[np.ndarray], np.ndarray] = _linear) -> np.ndarray:
    """Antialiased resampling of (..., height, width), one axis after the other; bilinear unless another kernel is given."""
    at, w = taps(x.shape[-2], height, kernel)
    x = sum(x[..., at[:, i], :] * w[:, i, None] for i in range(at.shape[1]))
    at, w = taps(x.shape[-1], width, kernel)
    return sum(x[..., at[:, i]] * w[:, i] for i in range(at.shape[1]))


def square(x: np.ndarray, size: int) -> np.ndarray:
    """Bicubic to size x size, whatever the shape was; values stay in [0, 1]."""
    return np.clip(resized(x, size, size, _cubic), 0.0, 1.0)


def short_side_crop(x: np.ndarray, size: int) -> np.ndarray:
    """Short side to `size`, the other in proportion (rounded down), then the middle square of that size."""
    h, w = x.shape[-2:]
    y = resized(x, size * h // min(h, w), size * w // min(h, w))
    top, left = round((y.shape[-2] - size) / 2), round((y.shape[-1] - size) / 2)
    return y[..., top : top + size, left : left + size]


#: Bytes of images of one shape that are resampled side by side.
SIDE_BY_SIDE = 32 << 20


def with_prepared(df: DataFrame, size: int, how: Callable[[np.ndarray, int], np.ndarray] = short_side_crop, values: str = "values", height: str = "height", width: str = "width", name: str = "prepared", channels: int = 3) -> DataFrame:
    """df with `name`: images of any shapes (channels x height x width values, planes after each other) prepared to size x size by `short_side_crop` or `square`.

    Images of one shape in a batch are resampled together. Null for an image that is null, holds a null, or whose number of values is not that of its shape.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ws = (np.nan_to_num(batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(int) for c in (height, width))
            found: list[np.ndarray | None] = [None] * len(batch)
            for h, w in {(h, w) for h, w in zip(hs.tolist(), ws.tolist()) if h > 0 and w > 0}:
                at = np.flatnonzero((hs == h) & (ws == w))
                step = max(1, SIDE_BY_SIDE // (8 * channels * h * w))
                for lo in range(0, len(at), step):
                    own = at[lo : lo + step]
                    x, whole = _stacked(batch[values].take(pa.array(own)), channels * h * w, (channels, h, w))
                    for i, y in zip(own[whole].tolist(), how(x, size).reshape(len(x), channels * size * size)):
                        found[i] = y
            yield batch.append_column(name, pa.array(found, pa.list_(pa.float64())))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def _stacked(col: pa.Array, size: int, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold `size` values, none of them null, as images; and which rows these are."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(col), size), False).to_numpy(zero_copy_only=False)
    flat = col.filter(pa.array(whole)).flatten().cast(pa.float64())
    full = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)
    whole[np.flatnonzero(whole)[~full]] = False
    return flat.to_numpy(zero_copy_only=False).reshape(-1, *shape)[full], whole


def with_pair_score(df: DataFrame, name: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray], a: str = "pred", b: str = "target", shape: tuple[int, int, int] = (1, 8, 8)) -> DataFrame:
    """df with a double column `name`: score of two array columns as images of one shape, a batch at a time; null if one is null, of another size or holds a null."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, has_x), (y, has_y) = (_stacked(batch[c], size, shape) for c in (a, b))
            both = has_x & has_y
            out = np.full(len(batch), np.nan)
            out[both] = score(x[both[has_x]], y[both[has_y]])
            yield batch.append_column(name, pa.array(out, pa.float64(), mask=~both))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width and values (red, green, blue planes, 0 to 1) of the images below path that Spark can decode."""
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, n, data in zip(*(b[c].to_pylist() for c in ("height", "width", "nChannels", "data"))):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = np.repeat(x, 3, axis=2) if n == 1 else x[:, :, 2::-1]
                out.append((rgb.transpose(2, 0, 1) / 255.0).ravel())
            yield pa.RecordBatch.from_arrays([b["origin"], b["height"], b["width"], pa.array(out, pa.list_(pa.float64()))], ["path", "height", "width", "values"])

    return raw.mapInArrow(run, "path string, height int, width int, values array<double>")
