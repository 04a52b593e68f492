"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside(x: Column, y: Column, centre_x: float, centre_y: float, half_width: float, half_height: float, margin: float = 0.0) -> Column:
    """Whether a point is in a box with a margin, ends included."""
    return x.between(centre_x - half_width - margin, centre_x + half_width + margin) & y.between(centre_y - half_height - margin, centre_y + half_height + margin)


def position_of(text: Column, offset: int) -> tuple[Column, Column]:
    """Line (from 1) and UTF-8 byte column (from 0) of a character offset."""
    before = F.substring(text, 1, offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.octet_length(F.substring_index(before, "\n", -1))


def to_segment(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> tuple[Column, Column]:
    """Where along a segment (0 to 1) it is nearest to a point, and how near."""
    dx, dy = x2 - x1, y2 - y1
    t = F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / float(dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    off_x, off_y = x - (x1 + t * dx), y - (y1 + t * dy)
    return t, F.sqrt(off_x * off_x + off_y * off_y)


def module_name(path: Column) -> Column:
    """Dotted module name of a Python path; a package's is its folder's."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def digest(text: Column, bits: int = 256, digits: int | None = None) -> Column:
    """The hexadecimal SHA-256 (or, for 160 bits, SHA-1) of a text's UTF-8 bytes, or its first digits."""
    whole = F.sha1(text) if bits == 160 else F.sha2(text, bits)
    return whole if digits is None else F.substring(whole, 1, digits)


#: Languages by how a name or a modifier tells who may see it.
MODIFIED = ("java", "csharp", "kotlin", "swift", "php")
DASHED = ("lua", "perl", "r", "julia", "elixir", "haskell", "groovy", "vbnet", "fortran", "pascal", "zig", "solidity")


def visibility(name: Column, language: Column, modifiers: Column) -> Column:
    """public, private or unknown: by modifiers, by the first letter's case in Go, else by a leading underscore (or dash)."""
    says = lambda *words: F.coalesce(modifiers.rlike(r"\b(" + "|".join(words) + r")\b"), F.lit(False))
    modified = F.when(says("private", "protected", "fileprivate"), "private").when(says("public", "open"), "public").otherwise("unknown")
    go = F.when(F.substring(name, 1, 1).rlike(r"^\p{Lu}"), "public").otherwise("private")
    dashed = F.when(name.rlike("^[_-]"), "private").otherwise("public")
    plain = F.when(F.startswith(name, F.lit("_")), "private").otherwise("public")
    return F.when(language.isin(*MODIFIED), modified).when(language == "go", go).when(language.isin(*DASHED), dashed).otherwise(plain)
