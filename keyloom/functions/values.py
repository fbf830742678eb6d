"""Scalar rules on payloads, states, codes, permissions and templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: leading bytes, in hex, of payload types.
MAGIC = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "25504446": "application/pdf", "504B0304": "application/zip", "1F8B": "application/gzip", "3C21444F43545950452068746D6C": "text/html", "3C68746D6C": "text/html"}
#: Fixed: gRPC and HTTP codes of error kinds; others are INTERNAL and 400.
GRPC_CODES = {"KeyNotFound": "NOT_FOUND", "VDiskNotFound": "NOT_FOUND", "DuplicateKey": "ALREADY_EXISTS", "Timeout": "DEADLINE_EXCEEDED", "Unauthorized": "UNAUTHENTICATED", "HolderTemporaryUnavailable": "UNAVAILABLE"}
HTTP_CODES = {"DuplicateKey": 409, "Internal": 500, "VDiskIsNotReady": 500, "KeyNotFound": 404, "HolderTemporaryUnavailable": 503}


def looked_up(key: Column, table: Mapping, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def mime_type(payload: Column) -> Column:
    head = F.hex(F.substring(payload, 1, 16))
    out = F.lit("*/*")
    for magic, kind in MAGIC.items():
        out = F.when(head.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def encode_record(ts: Column, payload: Column) -> Column:
    """Eight big-endian bytes of seconds, then the payload."""
    return F.concat(F.unhex(F.lpad(F.hex(ts), 16, "0")), payload)


def decode_record(raw: Column) -> tuple[Column, Column]:
    """(seconds, payload)"""
    return F.conv(F.hex(F.substring(raw, 1, 8)), 16, 10).cast("long"), F.substring(raw, F.lit(9), F.octet_length(raw))


def conditional_status(last_modified: Column, modified_since: Column, unmodified_since: Column) -> Column:
    """304 if nothing newer than asked for, 412 if something newer than allowed, else 200."""
    return F.when(modified_since > last_modified, 304).when(unmodified_since < last_modified, 412).otherwise(200)


def permissions(claims: Mapping[str, Column], role: Mapping[str, Column]) -> Column:
    """Bits 1, 2, 4, 8 for read, write, read_rest, write_rest; a user's claim beats the role."""
    out = F.lit(0)
    for bit, name in enumerate(("read", "write", "read_rest", "write_rest")):
        out = out + F.when(F.coalesce(claims[name], role[name], F.lit(False)), 1 << bit).otherwise(0)
    return out


def password_ok(password: Column, stored: Column, stored_hash: Column, salt: str) -> Column:
    """Plain equality where a password is stored, else the SHA-512 of password and salt."""
    return F.when(stored.isNotNull(), stored == password).otherwise(F.coalesce(F.sha2(F.concat(password, F.lit(salt)), 512) == F.lower(stored_hash), F.lit(False)))


def metric_prefix(template: Column, address: Column, node: Column, metrics: Column) -> Column:
    """Fills a prefix template; spaces and dots of the values become underscores."""
    for name, value in (("{local_address}", address), ("{node_name}", node), ("{metrics_name}", metrics)):
        template = F.replace(template, F.lit(name), F.translate(value, " .", "__"))
    return template


def error_of_status(message: Column) -> tuple[Column, Column]:
    """(error kind, its detail) of a status text: the first word names the kind; the other
    words are joined without spaces."""
    words = F.filter(F.split(message, r"\s+"), lambda w: w != "")
    kinds = ["KeyNotFound", "DuplicateKey", "Timeout", "VDiskNotFound", "Storage", "VDiskIsNotReady", "Failed", "Internal", "PearlChangeState", "Unauthorized", "HolderTemporaryUnavailable"]
    first = F.get(words, F.lit(0))
    kind = F.when(first.isin(kinds), first).otherwise("Failed")
    return kind, F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), "")


def keys_of_range(text: Column) -> Column:
    """Keys of n, a-b (both included, none unless a < b) or a,b,c."""
    ends = F.transform(F.split(text, "-"), lambda x: x.cast("long"))
    span = F.when(ends[0] < ends[1], F.sequence(ends[0], ends[1])).otherwise(F.array().cast("array<bigint>"))
    return F.when(text.contains("-"), span).otherwise(F.transform(F.split(text, ","), lambda x: x.cast("long")))
