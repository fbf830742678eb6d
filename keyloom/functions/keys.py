"""Keys: fixed-width little-endian byte strings, and the virtual disk that each routes to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 8


def _hex_pairs(hexes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(hexes), F.lit(2)), lambda i: F.substring(hexes, i, F.lit(2)))


def reversed_bytes(key: Column) -> Column:
    """The bytes in the other order: as binary, little-endian keys then sort as numbers."""
    return F.unhex(F.array_join(F.reverse(_hex_pairs(F.hex(key))), ""))


def from_number(n: Column, width: int = KEY_BYTES) -> Column:
    """A whole number, up to 64 bits, as a little-endian key."""
    hexes = F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0")
    return padded(reversed_bytes(F.unhex(hexes)), width)


def from_hex(text: Column, width: int = KEY_BYTES) -> Column:
    """0x… text: pairs are taken from the right, so an odd number of digits is fine."""
    digits = F.substring(text, F.lit(3), F.length(text))
    even = F.lpad(digits, (F.ceil(F.length(digits) / 2) * 2).cast("int"), F.lit("0"))
    return padded(F.when(F.length(digits) == 0, F.lit(b"\x00")).otherwise(reversed_bytes(F.unhex(even))), width)


def from_guid(text: Column, width: int = KEY_BYTES) -> Column:
    """A GUID in the byte order of its text."""
    return padded(F.unhex(F.regexp_replace(text, "[{}-]", "")), width)


def padded(key: Column, width: int) -> Column:
    """Zero bytes up to the width; bytes beyond it must be zero, else null."""
    beyond = F.hex(F.substring(key, F.lit(width + 1), F.octet_length(key)))
    fits = (F.octet_length(key) <= width) | (F.regexp_replace(beyond, "0", "") == "")
    whole = F.unhex(F.rpad(F.hex(F.substring(key, 1, width)), 2 * width, "0"))
    return F.when(fits, whole)


def parse(text: Column, width: int = KEY_BYTES) -> Column:
    """Key of a text: a GUID (in braces or with hyphens), 0x and hex digits, or a decimal
    number of up to 64 bits; null for anything else."""
    return (
        F.when(text.rlike(r"^\{.*\}$") | text.contains("-"), from_guid(text, width))
        .when(text.startswith("0x"), from_hex(text, width))
        .when(text.rlike(r"^[0-9]+$"), from_number(text, width))
    )


def text(key: Column) -> Column:
    return F.hex(key)


def fits(n: Column, width: int) -> Column:
    """Whether a number has room in a key of so many bytes, up to 7."""
    return (n >= 0) & (n <= 256**width - 1)


def vdisk_of_number(n: Column, vdisks: int) -> Column:
    return F.pmod(n, F.lit(vdisks)).cast("long")


def vdisk(key: Column, vdisks: int) -> Column:
    """The little-endian number of any width, modulo the number of virtual disks."""
    digits = F.transform(F.reverse(_hex_pairs(F.hex(key))), lambda p: F.conv(p, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 256 + d) % vdisks)


#: Fixed: the 64 letters of owner names, in ASCII order.
OWNER_LETTERS = "+-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def owner_hash(node: Column, chars: int = 10) -> Column:
    """Letters for the SHA-256 of a node's name, four for each three bytes: of the 24 bits the
    first, second and last six as they stand, and for the third letter the middle byte's low
    four bits below the last byte's high two."""
    digest = F.sha2(node, 256)
    n = (chars + 3) // 4

    def letters(i: Column) -> Column:
        byte = lambda k: F.conv(F.substring(digest, i * 6 + 1 + 2 * k, F.lit(2)), 16, 10).cast("int")
        a, b, c = byte(0), byte(1), byte(2)
        places = (F.shiftright(a, 2), F.shiftleft(a.bitwiseAND(F.lit(3)), 4).bitwiseOR(F.shiftright(b, 4)), b.bitwiseAND(F.lit(15)).bitwiseOR(F.shiftright(c, 2).bitwiseAND(F.lit(48))), c.bitwiseAND(F.lit(63)))
        return F.concat(*(F.substring(F.lit(OWNER_LETTERS), p + 1, F.lit(1)) for p in places))

    return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), letters), ""), 1, chars)


def lenient(text: Column, size: int) -> Column:
    """A key of ``size`` bytes from the pairs of hex digits from the left; a pair that is none,
    or is not there, is a byte 0. As lower-case hex."""
    pair = lambda i: F.lower(F.substring(text, 2 * i + 1, 2))
    return F.concat(*(F.when(pair(i).rlike("^[0-9a-f]{2}$"), pair(i)).otherwise("00") for i in range(size)))
