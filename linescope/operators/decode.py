"""Bytes to text with JVM functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte order marks.
UTF8_BOM, UTF16LE_BOM, UTF16BE_BOM = (bytes.fromhex(mark) for mark in ("efbbbf", "fffe", "feff"))

# Bytes 0x80-0x9F read as windows-1252; the five undefined ones stay.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0))
_PAIRS = [(c, w) for c, w in zip(_C1, _WINDOWS) if w != "�"]


def has_bom(content: Column) -> Column:
    return (
        F.startswith(content, F.lit(UTF8_BOM))
        | F.startswith(content, F.lit(UTF16LE_BOM))
        | F.startswith(content, F.lit(UTF16BE_BOM))
    )


def encoding(content: Column) -> Column:
    """Encoding label: a byte order mark decides, then strict UTF-8, then
    windows-1252."""
    return (
        F.when(F.startswith(content, F.lit(UTF8_BOM)), "utf-8-bom")
        .when(F.startswith(content, F.lit(UTF16LE_BOM)), "utf-16le")
        .when(F.startswith(content, F.lit(UTF16BE_BOM)), "utf-16be")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .when(content.isNotNull(), "windows-1252")
    )


def _after(content: Column, mark: bytes) -> Column:
    return F.substring(content, len(mark) + 1, 2**31 - 1)


def text(content: Column, label: Column) -> Column:
    """Decoded text; null where decoding fails (bad bytes after a UTF-8 mark)."""
    windows = F.translate(
        F.decode(content, "ISO-8859-1"), "".join(c for c, _ in _PAIRS), "".join(w for _, w in _PAIRS)
    )
    return (
        F.when(label == "utf-8", content.cast("string"))
        .when(label == "utf-8-bom", F.try_validate_utf8(_after(content, UTF8_BOM).cast("string")))
        .when(label == "utf-16le", F.decode(_after(content, UTF16LE_BOM), "UTF-16LE"))
        .when(label == "utf-16be", F.decode(_after(content, UTF16BE_BOM), "UTF-16BE"))
        .when(label == "windows-1252", windows)
    )


def warnings(content: Column, label: Column, decoded: Column) -> Column:
    """Decoding warnings.  A UTF-16 text that does not encode back to its
    bytes has lost something."""
    lossy = F.when(label == "utf-16le", F.encode(decoded, "UTF-16LE") != _after(content, UTF16LE_BOM)).when(
        label == "utf-16be", F.encode(decoded, "UTF-16BE") != _after(content, UTF16BE_BOM)
    )
    return F.array_compact(
        F.array(
            F.when(lossy, F.concat(label, F.lit(" decode contained replacement characters"))),
            F.when(label == "windows-1252", "decoded using windows-1252 fallback"),
        )
    )
