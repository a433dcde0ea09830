"""Image sizes, ruler ticks, input normalisation and the fixed tables of models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output dimensions by backbone, input sizes by model (one number: the shorter side), ImageNet statistics.
COSPLACE = {"ResNet18": 512, "ResNet50": 2048, "ResNet101": 2048, "ResNet152": 2048, "VGG16": 512, "EfficientNet-B0": 1280, "EfficientNet-B7": 2560}
EIGENPLACES = {"ResNet18": 512, "ResNet50": 2048, "ResNet101": 2048, "ResNet152": 2048, "VGG16": 512}
ATTENTION = {
    "ResNet18": 512, "ResNet50": 2048, "ResNet101": 2048, "ResNet152": 2048, "VGG16": 512, "EfficientNet-B0": 1280, "EfficientNet-B1": 1280,
    "EfficientNet-B2": 1408, "EfficientNet-B3": 1536, "EfficientNet-B4": 1792, "EfficientNet-B5": 2048, "EfficientNet-B6": 2304, "EfficientNet-B7": 2560,
}
INPUTS = {
    "Cosplace": (512,), "EigenPlaces": (512,), "NetVLAD": (480, 640), "PatchNetVLAD": (480, 640), "MixVPR": (320, 320), "Salad": (322, 322), "Salad512": (322, 322), "CricaVPR": (518, 518),
}
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
DEFAULT_DIMENSION = 2048


def dimension(backbone: Column, table: dict[str, int], default: int | None = DEFAULT_DIMENSION) -> Column:
    """The backbone's output dimension; others get the default (None: NULL)."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), backbone)
    return found if default is None else F.coalesce(found, F.lit(default))


def feature_dimension(declared: Column, features: Column) -> Column:
    """The declared dimension, else the length of the features."""
    return F.coalesce(declared, F.size(features))


def normalised(values: Column, channel: Column) -> Column:
    """A channel's values in 0..1 against the ImageNet mean and deviation."""
    pick = lambda t: F.get(F.array(*map(F.lit, t)), channel)
    return F.transform(values, lambda v: (v.cast("double") - pick(MEAN)) / pick(STD))


def input_size(model: Column, width: Column, height: Column) -> Column:
    """struct(width, height) that a model's input has: a fixed size, or the shorter side set and the other in proportion (cut)."""
    out = F.lit(None).cast("struct<width:int,height:int>")
    for name, size in INPUTS.items():
        if len(size) == 1:
            other = lambda a, b, s=size[0]: F.floor(F.lit(float(s)) * a / b).cast("int")
            made = F.struct(F.when(width <= height, F.lit(size[0])).otherwise(other(width, height)).alias("width"), F.when(width <= height, other(height, width)).otherwise(F.lit(size[0])).alias("height"))
        else:
            made = F.struct(F.lit(size[1]).alias("width"), F.lit(size[0]).alias("height"))
        out = F.when(model == name, made).otherwise(out)
    return out


def _scaled(width: Column, height: Column, most: int) -> Column:
    return F.lit(float(most)) / F.greatest(width, height)


def resize_size(width: Column, height: Column, most: int = 1024) -> Column:
    """struct(width, height): the longer side brought down to ``most``, digits cut off; smaller images stay."""
    scale = _scaled(width, height, most)
    side = lambda x: F.when(scale < 1, F.floor(x * scale).cast("int")).otherwise(x)
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def ruler_size(width: Column, height: Column, most: int = 1024) -> Column:
    """The same for the ruler overlay, rounded half to even."""
    scale = F.least(_scaled(width, height, most), F.lit(1.0))
    side = lambda x: F.bround(x * scale, 0).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def thumbnail_size(width: Column, height: Column, most: int = 512) -> Column:
    """struct(width, height) within most x most, in proportion: the shorter side is whichever whole number keeps the ratio best, at least 1."""
    ratio = width / height
    near = lambda x, err: F.greatest(F.when(err(F.floor(x)) <= err(F.ceil(x)), F.floor(x)).otherwise(F.ceil(x)), F.lit(1)).cast("int")
    flat = near(most / ratio, lambda n: F.abs(ratio - F.try_divide(F.lit(float(most)), n)))
    tall = near(most * ratio, lambda n: F.abs(ratio - n / F.lit(float(most))))
    small = (width <= most) & (height <= most)
    return F.struct(
        F.when(small, width).when(width >= height, F.lit(most)).otherwise(tall).cast("int").alias("width"),
        F.when(small, height).when(width >= height, flat).otherwise(F.lit(most)).cast("int").alias("height"),
    )


def ticks(grid: Column) -> Column:
    """Ruler positions i / n from 0 to 1; a grid of 0 has five intervals (and no lines)."""
    n = F.when(grid == 0, 5).otherwise(grid)
    return F.transform(F.sequence(F.lit(0), n), lambda i: i / n)


def grid_lines(grid: Column) -> Column:
    return grid > 0
