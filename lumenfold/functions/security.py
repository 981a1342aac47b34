"""Signatures and share tokens, from Spark's own hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _xor(key: bytes, pad: int) -> Column:
    return F.lit(bytes(b ^ pad for b in key))


def hmac_sha256(key: bytes, message: Column | str) -> Column:
    """HMAC-SHA256 as lower-case hex: two nested hashes over the padded key, so no Python runs."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    key = key.ljust(_BLOCK, b"\0")
    m = F.col(message) if isinstance(message, str) else message
    inner = F.unhex(F.sha2(F.concat(_xor(key, 0x36), m.cast("binary")), 256))
    return F.sha2(F.concat(_xor(key, 0x5C), inner), 256)


def base64_url(data: Column) -> Column:
    return F.translate(F.rtrim(F.base64(data), F.lit("=")), "+/", "-_")


def share_token(key: bytes, payload: Column | str) -> Column:
    """``rs.`` with the payload and the signature over it, both base64 for URLs."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.concat(F.lit("rs."), base64_url(p.cast("binary")), F.lit("."), base64_url(F.unhex(hmac_sha256(key, p))))


def token_payload(key: bytes, token: Column | str) -> Column:
    """The payload of a token whose signature holds, else null."""
    t = F.col(token) if isinstance(token, str) else token
    parts = F.split(t, r"\.")
    plain = F.translate(F.try_element_at(parts, F.lit(2)), "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    payload = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    fits = (F.size(parts) == 3) & (F.element_at(parts, 1) == "rs") & (F.try_element_at(parts, F.lit(3)) == base64_url(F.unhex(hmac_sha256(key, payload))))
    return F.when(fits, payload)

