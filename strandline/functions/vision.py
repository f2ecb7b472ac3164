"""Perceptual hashes and picture geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_W, HASH_H = 9, 8
#: Bits that a frame must differ by, for each sensitivity.
SENSITIVITY = {"low": 10, "normal": 6, "high": 3}


def dhash(pixels: Column) -> Column:
    """64 bits of a 9 x 8 grey picture (an array of 72), row by row: whether each pixel is brighter than its right neighbour."""

    def bit(acc: Column, i: Column) -> Column:
        at = (F.floor(i / 8) * HASH_W + i % 8).cast("int")
        brighter = F.get(pixels, at) > F.get(pixels, at + 1)
        return F.shiftleft(acc, 1).bitwiseOR(F.when(brighter, 1).otherwise(0).cast("long"))

    return F.when(F.size(pixels) == HASH_W * HASH_H, F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def tile_boxes(grid: int = 2) -> list[tuple[float, float, float, float]]:
    """Tiles that are read on their own: a grid, and one over the middle where the grid's seams cross."""
    step = 1 / grid
    return [(x * step, y * step, step, step) for y in range(grid) for x in range(grid)] + [(0.2, 0.2, 0.6, 0.6)]


def to_frame(box: Column, tile: Column) -> Column:
    """A box in fractions of a tile, in fractions of its frame."""
    return F.struct((tile["x"] + box["x"] * tile["w"]).alias("x"), (tile["y"] + box["y"] * tile["h"]).alias("y"), (box["w"] * tile["w"]).alias("w"), (box["h"] * tile["h"]).alias("h"))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """Whole pixels of a fractional box, inside the picture."""
    left, top = F.greatest(F.lit(0), F.floor(box["x"] * width)), F.greatest(F.lit(0), F.floor(box["y"] * height))
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(F.lit(1), F.least(width - left, F.ceil(box["w"] * width))).alias("width"), F.greatest(F.lit(1), F.least(height - top, F.ceil(box["h"] * height))).alias("height"))


def sheet_place(index: Column, cols: int = 3, tile_w: int = 480, tile_h: int = 270, gap: int = 4) -> Column:
    """Where a frame (from 1) sits: its sheet and tile (from 1), row, column, left and top."""
    per = cols * cols
    at = (index - 1) % per
    row, col = F.floor(at / cols), at % cols
    return F.struct((F.floor((index - 1) / per) + 1).alias("sheet"), (at + 1).alias("tile"), row.alias("row"), col.alias("col"), (col * (tile_w + gap)).alias("left"), (row * (tile_h + gap)).alias("top"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(size == 0, 1.0).otherwise(size))
