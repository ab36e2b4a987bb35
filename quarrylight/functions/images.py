"""Image bytes: size from the file's own header, identity, names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import urls


def _number(body: Column, at: int, size: int, little: bool = False) -> Column:
    """Unsigned number of ``size`` bytes at offset ``at``."""
    order = range(size - 1, -1, -1) if little else range(size)
    return F.conv(F.concat(*(F.hex(F.substring(body, at + 1 + k, 1)) for k in order)), 16, 10).cast("int")


def dimensions(body: Column) -> Column:
    """STRUCT<width, height> of PNG, GIF and JPEG files; NULL for other or truncated ones.

    Only JPEG, whose size stands behind segments of any length, needs a function outside the JVM.
    """
    n = F.length(body)
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    png = F.hex(F.substring(body, 1, 8)) == "89504E470D0A1A0A"
    gif = F.hex(F.substring(body, 1, 6)).isin("474946383761", "474946383961")
    jpeg = F.hex(F.substring(body, 1, 3)) == "FFD8FF"
    return (F.when(png & (n >= 24), size(_number(body, 16, 4), _number(body, 20, 4))).when(gif & (n >= 10), size(_number(body, 6, 2, True), _number(body, 8, 2, True)))
            .when(jpeg, _jpeg()(F.when(jpeg, body))))


def _jpeg():

    @F.pandas_udf("struct<width:int,height:int>")
    def frame(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_frame(b) if b is not None else (None, None) for b in bodies], columns=["width", "height"])

    return frame


def jpeg_frame(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the start-of-frame segment, by walking the segments before it."""
    place, end = 2, len(data)
    while place + 9 < end:
        if data[place] != 0xFF:
            place += 1
            continue
        kind = data[place + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[place + 7:place + 9], "big"), int.from_bytes(data[place + 5:place + 7], "big")
        standalone = 0xD0 <= kind <= 0xD9
        place += 2 if standalone else 2 + int.from_bytes(data[place + 2:place + 4], "big")
    return None, None


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def is_image(status: Column, content_type: Column) -> Column:
    return (status < 400) & F.coalesce(content_type, F.lit("")).startswith("image/")


def large_enough(size: Column, min_width: int, min_height: int) -> Column:
    """Whether an image of known size has the least width and height; one of unknown size passes, 0 asks for nothing."""
    return size.isNull() | size["width"].isNull() | ((size["width"] >= min_width) & (size["height"] >= min_height))


def file_name(url: Column, content_type: Column) -> Column:
    """Name of an address's file, with the ending its content type calls for."""
    name = F.element_at(F.filter(F.concat(F.array(F.lit("image")), F.split(urls.path(url), "/")), lambda x: x != ""), -1)
    suffix = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)).otherwise(F.lit(""))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    mime = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    known = F.lit(None).cast("array<string>")
    for m, ends in rules.CONTENT_TYPE_EXTENSIONS.items():
        known = F.when(mime == m, F.array(*map(F.lit, ends))).otherwise(known)
    return F.when(known.isNotNull() & ~F.coalesce(F.array_contains(known, F.lower(suffix)), F.lit(False)), F.concat(stem, F.get(known, F.lit(0)))).otherwise(name)
