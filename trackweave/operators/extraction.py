"""Dense features of images: a registry of models, the identity model, and extraction of only what is required."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.interpolation import bilinear
from trackweave.operators.sampling import PATCH, extract_patches

Model = Callable[[np.ndarray], np.ndarray]
MODELS: dict[str, Callable[..., Model]] = {}


def register(name: str) -> Callable[[Callable[..., Model]], Callable[..., Model]]:
    """Names a factory of models: settings -> function from an image (h, w, c) to features (h', w', c')."""

    def add(factory: Callable[..., Model]) -> Callable[..., Model]:
        MODELS[name] = factory
        return factory

    return add


@register("image")
def image_model(gray: bool = False) -> Model:
    """The pixels themselves, in 0..1, or their luminance."""
    weights = np.array([0.299, 0.587, 0.114])
    return lambda image: (image @ weights)[:, :, None] if gray and image.shape[2] == 3 else image


def resized(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, pixel centres kept in place."""
    rows, cols = np.meshgrid((np.arange(h) + 0.5) * image.shape[0] / h - 0.5, (np.arange(w) + 0.5) * image.shape[1] / w - 0.5, indexing="ij")
    return bilinear(image[None], np.stack([rows.ravel(), cols.ravel()], axis=1))[0].reshape(h, w, -1)


def dense_features(images: DataFrame, model: str = "image", max_edge: int = 1600, pyramid: tuple[float, ...] = (1.0,), l2_normalize: bool = False, **settings) -> DataFrame:
    """PATCH rows of dense maps (kp_id NULL), a level per pyramid scale, from images (image_name, h, w, c, data ARRAY<FLOAT>)."""
    order = [f.strip().split(" ")[0] for f in PATCH.split(",")]
    factory = MODELS[model]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compute = factory(**settings)
        for part in parts:
            rows = []
            for name, h, w, c, data in zip(part["image_name"], part["h"], part["w"], part["c"], part["data"]):
                image = np.asarray(data, np.float64).reshape(h, w, c)
                for level, scale in enumerate(pyramid):
                    factor = min(max_edge / max(w, h), 1.0) * scale
                    fw, fh = max(1, round(w * factor)), max(1, round(h * factor))
                    features = compute(image if (fw, fh) == (w, h) else resized(image, fw, fh))
                    if l2_normalize:
                        size = np.linalg.norm(features, axis=2, keepdims=True)
                        features = features / np.where(size > 0, size, 1)
                    rows.append((level, name, None, *features.shape, 0, 0, features.shape[1] / w, features.shape[0] / h, 1.0, features.astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=order).astype({"kp_id": "Int32"})

    fit = images.where(F.size("data") == F.col("h") * F.col("w") * F.col("c"))
    return fit.select("image_name", "h", "w", "c", "data").mapInPandas(run, PATCH)


def required_features(images: DataFrame, keypoints: DataFrame, patch: int = 16, **model) -> DataFrame:
    """Patches of the required keypoints (image_name, kp_id, x, y) only; images without any are not touched."""
    needed = images.join(keypoints.select("image_name").distinct(), "image_name", "left_semi")
    return extract_patches(dense_features(needed, **model), keypoints, patch)
