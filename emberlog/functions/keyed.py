"""Keyed pseudonyms for exports, out of built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A text has a character for each byte in this charset.
_BYTES = "ISO-8859-1"
#: Stands for a zero byte, since translate() deletes what it should turn into one.
_ZERO = "\u0100"


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal out of built-in functions: null if key or message is. A key of more than
    a block of 64 bytes stands for its digest; the pads are the key's bytes, translated at once by a table of all bytes."""
    key, message = key.cast("binary"), message.cast("binary")
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    block = F.rpad(F.decode(short, _BYTES), 64, "\0")

    def padded(byte: int) -> Column:
        turned = F.translate(block, "".join(map(chr, range(256))), "".join(chr(i ^ byte) if i != byte else _ZERO for i in range(256)))
        return F.encode(F.replace(turned, F.lit(_ZERO), F.lit("\0")), _BYTES)

    inner = F.unhex(F.sha2(F.concat(padded(0x36), message), 256))
    return F.when(key.isNotNull() & message.isNotNull(), F.sha2(F.concat(padded(0x5C), inner), 256))


def export_pseudonym(salt: Column, name: Column, prefix: str = "p") -> Column:
    """A name for one export: it can't be told from another export's without the salt, which is random a export."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(hmac_sha256(salt, name), 1, 16))
