"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK_RATE = 60_000
SAFE_INTEGER = (1 << 53) - 1

#: Label, frames per second as a ratio, and ticks of a frame.
CADENCES = (
    (0, "0.10", 1, 10, 600_000), (1, "0.5", 1, 2, 120_000), (2, "1", 1, 1, 60_000), (3, "3", 3, 1, 20_000), (4, "6", 6, 1, 10_000), (5, "12", 12, 1, 5_000),
    (6, "15", 15, 1, 4_000), (7, "24", 24, 1, 2_500), (8, "30", 30, 1, 2_000), (9, "48", 48, 1, 1_250), (10, "60", 60, 1, 1_000),
)
#: Legal palette depths by id.
PALETTE_DEPTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256)
MOST_COLUMNS, MOST_ROWS, MOST_CELLS = 512, 512, 262_144


def varuint_length(n: Column) -> Column:
    """Bytes of the canonical base-128 form of an unsigned 32-bit value; null outside."""
    size = F.when(n < 0, None)
    for i in range(1, 5):
        size = size.when(n < 1 << 7 * i, i)
    return size.when(n < 1 << 32, 5).cast("int")


def index_bits(depth: Column) -> Column:
    """Bits that number ``depth`` values."""
    return F.ceil(F.log2(depth)).cast("int")


def samples_to_ticks(sample: Column, rate: Column) -> Column:
    """Exact ticks of a sample, or null where there are none."""
    scaled = sample * TICK_RATE
    return F.when((scaled % rate == 0) & (scaled <= SAFE_INTEGER), (scaled - scaled % rate) / rate).cast("long")


#: Luma weights.
LUMA = (0.2126, 0.7152, 0.0722)


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def decibels(level: Column) -> Column:
    """20 log10 of a level; null at or below 0."""
    return F.when(level > 0, 20 * F.log10(level))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """OKLab of 8-bit sRGB, by its published matrices."""

    def linear(v: Column) -> Column:
        u = v / 255.0
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    # The published matrices.
    x, y, z = linear(r), linear(g), linear(b)
    l = F.cbrt(0.4122214708 * x + 0.5363325363 * y + 0.0514459929 * z)  # noqa: E741
    m = F.cbrt(0.2119034982 * x + 0.6806995451 * y + 0.1073969566 * z)
    s = F.cbrt(0.0883024619 * x + 0.2817188376 * y + 0.6299787005 * z)
    return (
        0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s,
        1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s,
        0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s,
    )


def rows_for(columns: Column, aspect: Column) -> Column:
    """Grid rows of cells twice as high as wide; half a row rounds up, one row at least."""
    return F.greatest(F.lit(1), F.floor(columns / aspect / 2 + 0.5)).cast("int")


def contained_size(aspect: Column, box_width: int, box_height: int) -> tuple[Column, Column, Column, Column]:
    """(width, height, left, top) of a picture of that aspect ratio fitted into a box and centred; parts of a pixel go."""
    wide = aspect >= box_width / box_height
    clamp = lambda n, most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(n)))
    w = F.when(wide, F.lit(box_width)).otherwise(clamp(box_height * aspect, box_width)).cast("int")
    h = F.when(wide, clamp(box_width / aspect, box_height)).otherwise(F.lit(box_height)).cast("int")
    return w, h, F.floor((F.lit(box_width) - w) / 2).cast("int"), F.floor((F.lit(box_height) - h) / 2).cast("int")


def rotated(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height as shown after a turn by quarter circles."""
    turned = F.pmod(degrees, F.lit(180)) == 90
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def display_aspect(stored: Column, degrees: Column) -> Column:
    """The aspect ratio of the box around a picture turned by any angle."""
    angle = F.pmod(degrees, F.lit(360))
    cosine, sine = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    tilted = (stored * cosine + sine) / (stored * sine + cosine)
    return F.when(angle.isin(0, 180), stored).when(angle.isin(90, 270), 1 / stored).otherwise(tilted)


def scanline(y: Column, offset: Column, period: int, phase: int) -> Column:
    """Whether a raster row is a dark scan line."""
    return F.pmod(y + offset, F.lit(period)) == phase


def blind_code(text: Column) -> Column:
    """Eight upper-case hex digits of a text's SHA-256."""
    return F.upper(F.substring(F.sha2(text, 256), 1, 8))


#: Offset and prime of the 64-bit FNV-1a hash, whose prime is 2^40 and this.
FNV_OFFSET, FNV_LOW_PRIME = (0xCBF29CE4, 0x84222325), 0x1B3


def fnv1a(raw: Column) -> Column:
    """The 64-bit FNV-1a hash of a BINARY column, as 16 hex digits.

    The hash is kept in two halves, as 64-bit products overflow.
    """
    word = F.lit((1 << 32) - 1)
    text = F.hex(raw)
    every = F.transform(F.sequence(F.lit(0), F.octet_length(raw) - 1), lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    values = F.when(F.octet_length(raw) > 0, every).otherwise(F.array().cast("array<bigint>"))

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b)
        product = low * FNV_LOW_PRIME
        high = (h["high"] * FNV_LOW_PRIME + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(word)
        return F.struct(high.alias("high"), product.bitwiseAND(word).alias("low"))

    start = F.struct(F.lit(FNV_OFFSET[0]).cast("long").alias("high"), F.lit(FNV_OFFSET[1]).cast("long").alias("low"))
    digits = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")
    return F.aggregate(values, start, step, lambda h: F.concat(digits(h["high"]), digits(h["low"])))


def opus_samples(toc: Column, frames_in_code3: Column) -> Column:
    """Samples at 48 kHz of an Opus packet, from its first byte (and second, for code 3)."""
    config, code = F.shiftright(toc, 3), toc.bitwiseAND(F.lit(3))
    small = config.bitwiseAND(F.lit(3))
    frame = (
        F.when(config < 12, F.element_at(F.array(*map(F.lit, (480, 960, 1920, 2880))), small + 1))
        .when(config < 16, F.when(config.bitwiseAND(F.lit(1)) == 0, 480).otherwise(960))
        .otherwise(F.element_at(F.array(*map(F.lit, (120, 240, 480, 960))), small + 1))
    )
    count = F.when(code == 0, 1).when(code == 3, frames_in_code3.bitwiseAND(F.lit(63))).otherwise(2)
    total = frame * count
    return F.when((count > 0) & (total <= 5760), total)


def is_identifier(text: Column) -> Column:
    return text.rlike("^[a-z0-9][a-z0-9-]{2,63}$")
