"""Class vocabularies, palettes and label arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names and colours, in class-id order.
CLASS_NAMES = ["background", "wall", "door", "floor", "window", "ceiling"]
CLASS_COLORS = [
    (128, 128, 128),
    (255, 64, 64),
    (255, 200, 64),
    (180, 220, 255),
    (64, 200, 255),
    (200, 100, 255),
]
NAME_TO_ID = {name: i for i, name in enumerate(CLASS_NAMES)}
STRUCTURAL = (1, 3, 5)

# Building-element vocabulary and its ids, and our bridge to the six classes.
ELEMENT_CLASSES = {"IfcWall": 0, "IfcWallStandardCase": 0, "IfcDoor": 1, "IfcSlab": 2, "IfcWindow": 3, "IfcCovering": 4, "IfcColumn": 5}
ELEMENT_TO_SIX = {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 0}

# The 52-class palette (one extra last colour has no class id).
PALETTE52 = [
    (0, 0, 0), (174, 199, 232), (152, 223, 138), (31, 119, 180), (255, 187, 120), (188, 189, 34),
    (140, 86, 75), (255, 152, 150), (214, 39, 40), (197, 176, 213), (148, 103, 189),
    (196, 156, 148), (23, 190, 207), (178, 76, 76), (247, 182, 210), (66, 188, 102),
    (219, 219, 141), (140, 57, 197), (202, 185, 52), (51, 176, 203), (200, 54, 131),
    (92, 193, 61), (78, 71, 183), (172, 114, 82), (255, 127, 14), (91, 163, 138),
    (153, 98, 156), (140, 153, 101), (158, 218, 229), (100, 125, 154), (178, 127, 135),
    (120, 185, 128), (146, 111, 194), (44, 160, 44), (112, 128, 144), (96, 207, 209),
    (227, 119, 194), (213, 92, 176), (94, 106, 211), (82, 84, 163), (100, 85, 144),
    (100, 218, 200), (128, 0, 0), (0, 128, 0), (128, 128, 0), (0, 0, 128),
    (128, 0, 128), (0, 128, 128), (128, 128, 128), (64, 0, 0), (192, 0, 0),
    (192, 128, 0), (64, 0, 128),
]
# Dataset class id of each palette index.
PALETTE52_CLASS = [
    0, 3, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22, 23, 26, 29, 31,
    34, 35, 37, 40, 44, 47, 52, 54, 56, 59, 60, 61, 62, 63, 64, 65, 70, 71, 76, 78,
    79, 80, 82, 83, 87, 88, 91, 92, 93, 95, 97, 98,
]


def nearest_color(r: Column, g: Column, b: Column, palette=CLASS_COLORS, norm: str = "l2") -> Column:
    """Index of the closest palette entry; ties go to the lowest index. The entries are written out, so the choice stays in generated code."""

    def cost(i: int, entry) -> Column:
        d = [c - F.lit(float(v)) for c, v in zip((r, g, b), entry)]
        terms = [F.abs(c) if norm == "l1" else c * c for c in d]
        return F.struct((terms[0] + terms[1] + terms[2]).alias("d"), F.lit(i).alias("id"))

    costs = [cost(i, entry) for i, entry in enumerate(palette)]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["id"]


def int_map(key: Column, mapping: dict[int, int], default: int | None) -> Column:
    """Fixed small dictionary lookup with a default, as a constant map."""
    pairs = [F.lit(int(x)) for kv in sorted(mapping.items()) for x in kv]
    hit = F.create_map(*pairs)[key.cast("int")]
    return hit if default is None else F.coalesce(hit, F.lit(default))


def palette_class(index: Column) -> Column:
    """Palette index to dataset class id; -1 where the palette entry has none."""
    ids = F.array(*[F.lit(c) for c in PALETTE52_CLASS])
    return F.coalesce(F.get(ids, index), F.lit(-1))


def pixel_label(raw: Column, classes: list[int], override: dict[int, int] | None = None) -> Column:
    """Raw pixel id to dense class index: the override wins, unlisted ids become 0."""
    dense = int_map(raw, {c: i for i, c in enumerate(classes)}, 0)
    return dense if not override else F.coalesce(int_map(raw, override, None), dense)


def depth_to_mm(depth_m: Column) -> Column:
    """Metres to millimetres, truncated towards zero, in the unsigned 16-bit range."""
    return F.pmod((depth_m * 1000.0).cast("int"), F.lit(65536))


def argmax(values: Column, truncate: bool = False) -> Column:
    """0-based position of the first maximum of an array, optionally of its integer parts."""
    v = F.transform(values, lambda a: a.cast("long")) if truncate else values
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
