"""Properties of images: stencils in NumPy on decoded pixels, one Arrow batch at a time.

Images come as rows of Spark's image source (``image`` struct with BGR bytes; a height of
-1 marks an image that cannot be decoded). Pixels never leave the task; results are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of blue, green and red in a gray value.
GRAY_WEIGHTS = (0.114, 0.587, 0.299)
#: Bounds of the low-quality heuristics and of a blurry image.
LEAST_SIDE, WIDEST, NARROWEST, LEAST_CONTRAST, BLURRY = 64, 3.0, 0.33, 0.05, 100.0

PROPERTY_SCHEMA = "path string, is_corrupt boolean, resolution long, width int, height int, brightness double, contrast double, blur double, noise double, compression double, saturation double"
METADATA_SCHEMA = "path string, width int, height int, aspect_ratio double, mean_brightness double, std_brightness double, num_channels int, mode string, is_corrupt boolean, color_histogram array<double>, error string"
HEURISTIC_SCHEMA = "path string, filename string, width int, height int, aspect_ratio double, contrast double, low_quality_flag boolean"


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def gray_of(bgr: np.ndarray) -> np.ndarray:
    """Gray values 0..255, rounded half up: thousandths in whole numbers, so that ties fall alike everywhere."""
    thousand = np.rint(1000 * np.array(GRAY_WEIGHTS)).astype(np.int64)
    return ((bgr.astype(np.int64) @ thousand + 500) // 1000).astype(np.float64)


def _shift(g: np.ndarray, dy: int, dx: int, mode: str) -> np.ndarray:
    p = np.pad(g, 1, mode=mode if min(g.shape) > 1 else "edge")
    return p[1 + dy : 1 + dy + g.shape[0], 1 + dx : 1 + dx + g.shape[1]]


def laplacian_variance(g: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian; borders mirror without repeating the edge."""
    lap = sum(_shift(g, y, x, "reflect") for y, x in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4 * g
    return float(lap.var())


def noise_level(g: np.ndarray) -> float:
    """Population deviation of the difference to the 3 x 3 median; borders repeat the edge."""
    stack = np.stack([_shift(g, y, x, "edge") for y in (-1, 0, 1) for x in (-1, 0, 1)])
    return float((g - np.median(stack, axis=0)).std())


def blockiness(g: np.ndarray, block: int = 8) -> float:
    """Mean step at block borders minus mean step at other columns; 0 for images below two blocks."""
    h, w = g.shape
    if h < 2 * block or w < 2 * block:
        return 0.0
    step = np.abs(np.diff(g, axis=1)).mean(0)
    border = np.zeros(w - 1, bool)
    border[np.arange(block, w - 1, block) - 1] = True
    return float(step[border].mean() - step[~border].mean())


def saturation_mean(bgr: np.ndarray) -> float:
    """Mean of 255 (max - min) / max, rounded half up per pixel, 0 for black."""
    x = bgr.astype(np.int64)
    high, low = x.max(2), x.min(2)
    safe = np.maximum(high, 1)
    return float(((510 * (high - low) + safe) // (2 * safe)).mean())


def pixels(row: dict) -> np.ndarray | None:
    """Height x width x 3 BGR bytes of an image struct; null for a corrupt image."""
    if row is None or row["height"] is None or row["height"] <= 0 or not row["data"]:
        return None
    x = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(x, 3, 2) if x.shape[2] == 1 else x[:, :, :3]


def _one_by_one(batch: pa.RecordBatch) -> Iterator[tuple[str, dict | None]]:
    """Path and image of each row; only one row's bytes become a Python object at a time."""
    for i in range(batch.num_rows):
        yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def _map(images: DataFrame, one: Callable[[str, np.ndarray | None, dict], dict], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(path, pixels(image), image or {}) for path, image in _one_by_one(b)]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")])
    return images.select("path", "image").mapInArrow(run, schema)


def quality_properties(images: DataFrame) -> DataFrame:
    """The seven quality properties of each image; a corrupt one has nulls and ``is_corrupt``."""

    def one(path: str, x: np.ndarray | None, image: dict) -> dict:
        if x is None:
            return {"path": path, "is_corrupt": True}
        g = gray_of(x)
        return {
            "path": path, "is_corrupt": False, "resolution": x.shape[0] * x.shape[1], "width": x.shape[1], "height": x.shape[0], "brightness": float(g.mean()), "contrast": float(g.std()),
            "blur": laplacian_variance(g), "noise": noise_level(g), "compression": blockiness(g), "saturation": saturation_mean(x),
        }

    return _map(images, one, PROPERTY_SCHEMA)


def image_metadata(images: DataFrame, histogram: bool = False) -> DataFrame:
    """Size, brightness and, on demand, a colour histogram of 256 bins for red, green and blue, adding to 1."""

    def one(path: str, x: np.ndarray | None, image: dict) -> dict:
        if x is None:
            return {"path": path, "is_corrupt": True, "error": "cannot be decoded"}
        rgb = x[:, :, ::-1].reshape(-1, 3).astype(np.float64)
        hist = None
        if histogram:
            counts = np.concatenate([np.bincount(x[:, :, c].ravel(), minlength=256) for c in (2, 1, 0)]).astype(float)
            hist = (counts / (counts.sum() + 1e-9)).tolist()
        return {
            "path": path, "width": x.shape[1], "height": x.shape[0], "aspect_ratio": x.shape[1] / x.shape[0], "mean_brightness": float(rgb.mean(0).mean()),
            "std_brightness": float(rgb.std(0).mean()), "num_channels": 3, "mode": "RGB", "is_corrupt": False, "color_histogram": hist,
        }

    return _map(images, one, METADATA_SCHEMA)


def fill_metadata(records: DataFrame, images: DataFrame, histogram: bool = False) -> DataFrame:
    """Records (``path, metadata``) with the metadata of those that have none; only their images are decoded."""
    open_ = records.where(F.col("metadata").isNull())
    found = image_metadata(images.join(open_.select("path").distinct(), "path", "left_semi"), histogram)
    cols = [f.split()[0] for f in METADATA_SCHEMA.split(", ")][1:]
    made = found.select("path", F.struct(*cols).alias("_m"))
    kind = dict(records.dtypes)["metadata"]
    return records.join(made, "path", "left").withColumn("metadata", F.coalesce("metadata", F.col("_m").cast(kind))).drop("_m")


def quality_heuristics(images: DataFrame) -> DataFrame:
    """Size, contrast on a 0..1 scale and a low-quality flag, decided before rounding. Corrupt images: zeros and the flag."""

    def one(path: str, x: np.ndarray | None, image: dict) -> dict:
        name = path.rsplit("/", 1)[-1]
        if x is None:
            return {"path": path, "filename": name, "width": 0, "height": 0, "aspect_ratio": 0.0, "contrast": 0.0, "low_quality_flag": True}
        h, w = x.shape[:2]
        contrast = float((x.astype(np.float64) @ np.array(GRAY_WEIGHTS) / 255).std())
        ratio = w / h
        low = w < LEAST_SIDE or h < LEAST_SIDE or ratio > WIDEST or ratio < NARROWEST or contrast < LEAST_CONTRAST
        return {"path": path, "filename": name, "width": w, "height": h, "aspect_ratio": round(ratio, 2), "contrast": round(contrast, 3), "low_quality_flag": low}

    return _map(images, one, HEURISTIC_SCHEMA)


def sharpness(images: DataFrame, threshold: float = BLURRY) -> DataFrame:
    """``path, variance, quality_label`` of readable images: ``blurry`` below the threshold, else ``good``."""

    def one(path: str, x: np.ndarray | None, image: dict) -> dict:
        return {"path": path, "variance": None if x is None else laplacian_variance(gray_of(x))}

    out = _map(images, one, "path string, variance double").where(F.col("variance").isNotNull())
    return out.withColumn("quality_label", F.when(F.col("variance") < threshold, "blurry").otherwise("good"))


class Embedder(Protocol):
    """Turns decoded images into vectors of one length; created once per Python worker."""

    def embed(self, images: list[np.ndarray]) -> np.ndarray: ...


class HistogramEmbedder:
    """Colour and gradient histograms: deterministic, needs no weights. Vectors are not normalised."""

    def __init__(self, bins: int = 16) -> None:
        self.bins = bins

    def embed(self, images: list[np.ndarray]) -> np.ndarray:
        out = []
        for x in images:
            color = [np.histogram(x[:, :, c], self.bins, (0, 256))[0] / x[:, :, c].size for c in range(3)]
            g = gray_of(x)
            dy, dx = np.gradient(g) if min(g.shape) > 1 else (np.zeros_like(g), np.zeros_like(g))
            turn = np.histogram(np.arctan2(dy, dx), self.bins, (-np.pi, np.pi), weights=np.hypot(dy, dx))[0]
            out.append(np.concatenate([*color, turn / (turn.sum() + 1e-9)]))
        return np.array(out)


#: Side, means and deviations (red, green, blue) of the pictures that image networks are usually trained on.
NETWORK_SIDE, NETWORK_MEAN, NETWORK_DEVIATION = 224, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def resized(x: np.ndarray, side: int) -> np.ndarray:
    """Square picture of ``side`` by bilinear interpolation between pixel centres."""
    out = x.astype(np.float32)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = at.astype(int)
        high, part = np.minimum(low + 1, n - 1), (at - low).astype(np.float32)
        part = part.reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


class NetworkEmbedder:
    """A network in ONNX form without its last layer; the file must lie where every executor can read it.

    ``device`` is ``cpu``, ``cuda`` or ``auto`` (CUDA where the runtime offers it).
    ``session`` may replace the runtime's own, with the same ``run`` and ``get_inputs``.
    """

    def __init__(self, model: str, device: str = "auto", side: int = NETWORK_SIDE, session: object | None = None) -> None:
        if device not in ("cpu", "cuda", "auto"):
            raise ValueError(f"device={device!r}: cpu, cuda or auto")
        self.side = side
        if session is None:
            import onnxruntime

            offered = onnxruntime.get_available_providers()
            cuda = ["CUDAExecutionProvider"] if device == "cuda" or (device == "auto" and "CUDAExecutionProvider" in offered) else []
            session = onnxruntime.InferenceSession(model, providers=[*cuda, "CPUExecutionProvider"])
        self.session, self.name = session, session.get_inputs()[0].name

    def embed(self, images: list[np.ndarray]) -> np.ndarray:
        rgb = np.stack([resized(x[:, :, ::-1], self.side) for x in images]) / 255
        x = (rgb - np.array(NETWORK_MEAN, np.float32)) / np.array(NETWORK_DEVIATION, np.float32)
        out = self.session.run(None, {self.name: x.transpose(0, 3, 1, 2).astype(np.float32)})[0]
        return np.asarray(out).reshape(len(images), -1)


#: Embedders by name; ``register_embedder`` adds more.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"histogram": HistogramEmbedder}


def register_embedder(name: str, make: Callable[[], Embedder]) -> None:
    EMBEDDERS[name] = make


def embed_images(images: DataFrame, embedder: str | Callable[[], Embedder] = "histogram", batch: int = 32, normalize: bool = False) -> DataFrame:
    """``path, embedding`` of every image that can be decoded; each vector keeps its path, so failures shift nothing."""
    if isinstance(embedder, str) and embedder not in EMBEDDERS:
        raise ValueError(f"embedder={embedder!r}: one of {sorted(EMBEDDERS)}")
    make = EMBEDDERS[embedder] if isinstance(embedder, str) else embedder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def embedded(part: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
            v = np.asarray(model.embed([x for _, x in part]))
            if normalize:
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in part]), pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["path", "embedding"])

        for b in batches:
            held: list[tuple[str, np.ndarray]] = []
            for path, image in _one_by_one(b):
                x = pixels(image)
                if x is not None:
                    held.append((path, x))
                if len(held) == batch:
                    yield embedded(held)
                    held = []
            if held:
                yield embedded(held)

    return images.select("path", "image").mapInArrow(run, "path string, embedding array<float>")


def tile_properties(tiles: DataFrame, id_col: str, values: str, width: int, threshold: float = BLURRY) -> DataFrame:
    """Gray properties of pixel lists (row by row, ``width`` wide): ``brightness, contrast, variance, noise, compression, quality_label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                g = np.array(v, float).reshape(-1, width)
                out.append((float(g.mean()), float(g.std()), laplacian_variance(g), noise_level(g), blockiness(g)))
            cols = [pa.array([o[i] for o in out], pa.float64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "brightness", "contrast", "variance", "noise", "compression"])

    src = tiles.where(F.col(values).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(values).cast("array<double>").alias("v"))
    out = src.mapInArrow(run, "id long, brightness double, contrast double, variance double, noise double, compression double")
    return out.withColumn("quality_label", F.when(F.col("variance") < threshold, "blurry").otherwise("good"))
