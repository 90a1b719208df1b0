"""Sizes of the record encoding: a 16-byte header (seq u64, key length u32, value length i32), key, value."""
from __future__ import annotations

import struct

from pyspark.sql import Column, functions as F

HEADER = struct.Struct("<QIi")  # fixed format: little-endian seq, key length, value length
TOMBSTONE_LENGTH = -1  # fixed value: the value length that marks a delete


def value_length(value: Column, tombstone: Column) -> Column:
    """-1 for a tombstone, 0 for an empty value."""
    return F.when(tombstone, F.lit(TOMBSTONE_LENGTH)).otherwise(F.octet_length(value)).cast("int")


def encoded_size(key: Column, value: Column) -> Column:
    return (F.lit(HEADER.size) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def payload_size(key: Column, value: Column) -> Column:
    """What an in-memory buffer accounts for: key and value bytes without the header."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def encode(key: str, value: bytes | None, seq: int) -> bytes:
    raw = key.encode()
    return HEADER.pack(seq, len(raw), TOMBSTONE_LENGTH if value is None else len(value)) + raw + (value or b"")


def decode(buffer: bytes):
    """Yields (key, value or None, seq); a torn tail ends the stream, a malformed record raises ValueError."""
    at = 0
    while at + HEADER.size <= len(buffer):
        seq, klen, vlen = HEADER.unpack_from(buffer, at)
        if vlen < TOMBSTONE_LENGTH:
            raise ValueError(f"value length {vlen} at byte {at}")
        body, end = at + HEADER.size, at + HEADER.size + klen + max(vlen, 0)
        if end > len(buffer):
            return
        yield buffer[body:body + klen].decode(), None if vlen < 0 else buffer[body + klen:end], seq
        at = end
