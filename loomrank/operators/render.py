"""Image features and embedding behind plain interfaces; images are arrays of gray values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K

# Fixed values of the glyph sheet: grid, size, baseline within a cell, the least gray value without ink, places of glyphs.
GRID = (6, 4)
SIZE = 224
BASELINE = 44
INK = 128
GLYPHS = {"A": 0, "e": 9, "n": 11, "o": 12}


def runs(mask: np.ndarray) -> np.ndarray:
    """Lengths of the runs of true values."""
    edge = np.diff(np.concatenate([[0], np.asarray(mask, np.int8), [0]]))
    return np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)


def cell_bounds(index: int, size: int = SIZE) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of a grid cell."""
    row, col = divmod(index, GRID[0])
    high = size // GRID[1]
    return round(col * size / GRID[0]), row * high, round((col + 1) * size / GRID[0]), (row + 1) * high


def cell_center(index: int, size: int = SIZE) -> tuple[float, float]:
    """Middle of a grid cell."""
    left, top, right, bottom = cell_bounds(index, size)
    return (left + right) / 2, (top + bottom) / 2


def _span(flags: np.ndarray) -> tuple[int, int] | None:
    """First and last true place."""
    at = np.flatnonzero(flags)
    return (int(at[0]), int(at[-1])) if len(at) else None


def _cell(image: np.ndarray, index: int) -> np.ndarray:
    left, top, right, bottom = cell_bounds(index)
    return image[top:bottom, left:right] < INK


def _height(ink: np.ndarray) -> int | None:
    """From the top of a glyph's ink down to the baseline."""
    rows = _span(ink.any(axis=1))
    return BASELINE - rows[0] if rows else None


def stroke_contrast(ink: np.ndarray) -> float:
    """(thick - thin) / thick of a round glyph's strokes: the two widest runs along its middle row and middle column; 0 without ink."""
    rows, cols = _span(ink.any(axis=1)), _span(ink.any(axis=0))
    if not rows:
        return 0.0
    across, down = ink[sum(rows) // 2, cols[0] : cols[1] + 1], ink[rows[0] : rows[1] + 1, sum(cols) // 2]
    strokes = [n for line in (across, down) for n in sorted(runs(line).tolist())[-2:]]
    return (max(strokes) - min(strokes)) / max(strokes) if strokes else 0.0


def aperture(ink: np.ndarray) -> float:
    """Share of a glyph's rows whose right edge lies more than two pixels behind the farthest one; 0 without ink."""
    rows = _span(ink.any(axis=1))
    if not rows:
        return 0.0
    part = ink[rows[0] : rows[1] + 1]
    edge = np.where(part.any(axis=1), part.shape[1] - 1 - np.argmax(part[:, ::-1], axis=1), -1)
    return float(((edge >= 0) & (edge < edge.max() - 2)).mean())


def aspect(ink: np.ndarray) -> float | None:
    """Width of a glyph's ink over its height."""
    rows, cols = _span(ink.any(axis=1)), _span(ink.any(axis=0))
    return (cols[1] - cols[0] + 1) / (rows[1] - rows[0] + 1) if rows else None


def glyph_features(image: np.ndarray) -> dict[str, float | None]:
    """xh (height of n over that of A), contrast and o_aspect of the o, aperture of the e; all null without the letters that xh needs."""
    cap, x = _height(_cell(image, GLYPHS["A"])), _height(_cell(image, GLYPHS["n"]))
    if cap is None or cap <= 0 or x is None:
        return {"xh": None, "contrast": None, "aperture": None, "o_aspect": None}
    o, e = _cell(image, GLYPHS["o"]), _cell(image, GLYPHS["e"])
    found = {"xh": x / cap, "contrast": stroke_contrast(o), "aperture": aperture(e), "o_aspect": aspect(o)}
    return {k: None if v is None else round(float(v), 4) for k, v in found.items()}


def legibility_of(xh, ap, co):
    """Mean of the rank-normalized x-height, aperture and lack of stroke contrast."""
    return (xh + ap + 1.0 - co) / 3.0


def feature_rows(images: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, xh, contrast, aperture, o_aspect) of rows (id, pixels binary of gray values); a row that isn't an image of the size has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [glyph_features(np.frombuffer(p, np.uint8).reshape(size, size)) if p is not None and len(p) == size * size else dict.fromkeys(("xh", "contrast", "aperture", "o_aspect")) for p in batch["pixels"]]
            frame = pd.DataFrame(rows, columns=["xh", "contrast", "aperture", "o_aspect"]).astype(float)
            frame.insert(0, "id", batch["id"].to_numpy())
            yield frame

    return images.select("id", "pixels").mapInPandas(run, "id long, xh double, contrast double, aperture double, o_aspect double").select("id", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("xh", "contrast", "aperture", "o_aspect")])


def grid_image(draw: Callable[[str, int], np.ndarray], glyphs: str, size: int = SIZE) -> np.ndarray:
    """A sheet of glyphs on the grid: ``draw(glyph, height)`` gives a gray picture whose last row is the baseline's.

    A glyph stands on the baseline of its cell, centred, and is cut at the cell's edges.
    """
    sheet = np.full((size, size), 255, np.uint8)
    for index, glyph in enumerate(glyphs):
        left, top, right, bottom = cell_bounds(index, size)
        picture = draw(glyph, bottom - top)[-BASELINE:, : right - left]
        begin = left + (right - left - picture.shape[1]) // 2
        sheet[top + BASELINE - picture.shape[0] : top + BASELINE, begin : begin + picture.shape[1]] = picture
    return sheet


def fitted_size(measure: Callable[[int], tuple[int, int]], size: int = SIZE, margin: int = 16, sizes: range = range(96, 11, -4)) -> tuple[int, tuple[int, int]] | None:
    """(pixels, (left, top)) of a string centred at the largest size whose box ``measure(pixels)`` keeps the margin; None if none does."""
    for pixels in sizes:
        width, height = measure(pixels)
        if width <= size - 2 * margin and height <= size - 2 * margin:
            return pixels, ((size - width) // 2, (size - height) // 2)
    return None


def wanted_faces(instances: DataFrame, wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, missing): of each wanted family the first eligible 400 normal instance whose file exists, and the families without one."""
    from .corpus import first_by

    there = instances.where("eligible and weight = 400 and style = 'normal'").join(files.select("file").distinct(), "file", "left_semi")
    faces = first_by(there.join(wanted.select("family").distinct(), "family", "left_semi"), ["family"], F.col("id")).select("family", "id", "file")
    return faces, wanted.select("family").distinct().join(faces, "family", "left_anti")


#: image preparations that ``preprocess`` knows
MODES = ("caffe", "rgb_mean", "imagenet", "raw255", "raw01")


def preprocess(image: np.ndarray, mode: str) -> np.ndarray:
    """Float channels (channel, row, column) of an RGB image.

    caffe turns the channels round and rgb_mean doesn't; both subtract the same three numbers in the same order.
    """
    x = image.astype(np.float32)
    if mode == "caffe":
        x = x[..., ::-1] - np.array(K.CHANNEL_MEAN, np.float32)
    elif mode == "rgb_mean":
        x = x - np.array(K.CHANNEL_MEAN, np.float32)
    elif mode == "imagenet":
        x = (x / 255.0 - np.array(K.UNIT_MEAN, np.float32)) / np.array(K.UNIT_DEVIATION, np.float32)
    elif mode == "raw01":
        x = x / 255.0
    elif mode != "raw255":
        raise ValueError(f"no image preparation {mode!r}")
    return np.moveaxis(x, -1, 0)


def stub_embedder(dim: int = 384, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic stand-in for a vision backbone: a fixed random projection of a coarse image."""
    table = np.random.default_rng(seed).standard_normal((256, dim)) / 16.0

    def embed(images: np.ndarray) -> np.ndarray:
        coarse = images.reshape(len(images), 16, images.shape[1] // 16, 16, images.shape[2] // 16).mean(axis=(2, 4))
        return (coarse.reshape(len(images), 256) / 255.0) @ table

    return embed


def embed_images(images: DataFrame, embedder: Callable[[np.ndarray], np.ndarray], size: int = SIZE, batch: int = 16) -> DataFrame:
    """(id, embedding, error) of rows (id, pixels binary); a row that fails keeps its error and no vector.

    The embedder gets ``batch`` images at a time; where it fails on a batch the images are tried one by one.
    """

    def vectors_of(stack: np.ndarray) -> list[tuple[list | None, str | None]]:
        try:
            return [(v.tolist(), None) for v in embedder(stack)]
        except Exception as error:  # noqa: BLE001  a model's own errors are data here
            return [(None, f"{type(error).__name__}: {error}")] if len(stack) == 1 else [r for i in range(len(stack)) for r in vectors_of(stack[i : i + 1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple[list | None, str | None]] = [(None, "no image of the size")] * len(rows)
            good = [i for i, raw in enumerate(rows["pixels"]) if raw is not None and len(raw) == size * size]
            for a in range(0, len(good), batch):
                some = good[a : a + batch]
                stack = np.stack([np.frombuffer(rows["pixels"].iloc[i], np.uint8).reshape(size, size) for i in some])
                for i, result in zip(some, vectors_of(stack), strict=True):
                    out[i] = result
            yield pd.DataFrame({"id": rows["id"], "embedding": [v for v, _ in out], "error": [e for _, e in out]})

    return images.select("id", "pixels").mapInPandas(run, "id long, embedding array<double>, error string")


def space_sweep(images: DataFrame, embedder: Callable[[np.ndarray], np.ndarray], modes: tuple[str, ...] = MODES, size: int = SIZE) -> DataFrame:
    """(mode, scaled, id, unit): one space for each image preparation, from raw vectors and from vectors scaled to length 1 first.

    ``images`` has (id, pixels binary of RGB values); ``embedder`` maps prepared images to vectors. Each space can
    go through ``learn.fit_pca`` and the neighbour diagnostics.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, raw in zip(rows["id"], rows["pixels"]):
                if raw is None or len(raw) != 3 * size * size:
                    continue
                image = np.frombuffer(raw, np.uint8).reshape(size, size, 3)
                vectors = [np.asarray(embedder(preprocess(image, m)[None])[0], float) for m in modes]
                scaled = [v / (np.linalg.norm(v) or 1.0) for v in vectors]
                yield pd.DataFrame({"mode": [*modes, *modes], "scaled": [False] * len(modes) + [True] * len(modes), "id": key, "vector": [v.tolist() for v in [*vectors, *scaled]]})

    return images.select("id", "pixels").mapInPandas(run, "mode string, scaled boolean, id long, vector array<double>")
