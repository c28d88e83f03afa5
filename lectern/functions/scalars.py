"""Scalar expressions: canvas geometry, time and number text, UTF-8 helpers. All arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDTH, HEIGHT = 800, 600


def relative(client: Column, edge: Column) -> Column:
    """Page coordinate to canvas coordinate: the distance from the canvas's left or top edge."""
    return client.cast("double") - edge.cast("double")


def backbuffer(page: Column, scroll: Column, edge: Column, size: Column, shown: Column) -> Column:
    """Page coordinate to a canvas of ``size`` pixels that is shown ``shown`` wide."""
    return (page.cast("double") - scroll.cast("double") - edge.cast("double")) * size.cast("double") / shown.cast("double")


def to_clip(cx: Column, cy: Column, width: float = WIDTH, height: float = HEIGHT) -> tuple[Column, Column]:
    """Canvas pixels to [-1, 1]; y grows upwards."""
    return F.lit(2.0) * cx.cast("double") / float(width) - 1.0, F.lit(1.0) - F.lit(2.0) * cy.cast("double") / float(height)


def distance(x: Column, y: Column, gx: Column, gy: Column, single: bool = False) -> Column:
    """Distance in the plane; ``single`` rounds every step to 32 bits."""
    kind = "float" if single else "double"
    dx, dy = (x.cast(kind) - gx.cast(kind)).cast(kind), (y.cast(kind) - gy.cast(kind)).cast(kind)
    return F.sqrt(((dx * dx).cast(kind) + (dy * dy).cast(kind)).cast(kind)).cast(kind)


def seconds(ms: Column) -> Column:
    return ms.cast("double") / 1000.0


def two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


def table_name(kind: str, method: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), method)


def utf8_length(s: Column) -> Column:
    return F.octet_length(s)


def utf8_bytes(s: Column, most: int | None = None) -> Column:
    """UTF-8 with a closing zero byte, cut after the last whole character that fits into ``most`` bytes with it."""
    whole = F.encode(s, "UTF-8")
    if most is not None:
        if most < 1:
            return F.lit(b"")
        room = most - 1
        cut = F.substring(whole, 1, room)
        # a continuation byte (10xxxxxx) after the cut means that the last character is split: drop its bytes
        lead = F.regexp_extract(F.hex(cut), "^((?:[0-9A-F]{2})*?)(?:[C-F][0-9A-F](?:[89AB][0-9A-F])*)?$", 1)
        split = F.substring(F.hex(F.substring(whole, room + 1, 1)), 1, 1).isin("8", "9", "A", "B")
        whole = F.when(F.octet_length(whole) <= room, whole).when(split, F.unhex(lead)).otherwise(cut)
    return F.concat(whole, F.lit(b"\x00"))


def utf8_text(b: Column) -> Column:
    """Text up to the first zero byte."""
    return F.substring_index(F.decode(b, "UTF-8"), "\x00", 1)


def pointer(n: Column) -> Column:
    """An address as at least eight lower-case hex digits."""
    digits = F.lower(F.hex(n))
    return F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)
