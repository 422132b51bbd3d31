"""Pseudonyms and signed tokens. Spark has no HMAC, so these are Arrow functions; the key is a parameter, never data."""

from __future__ import annotations

import base64
import hashlib
import hmac
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN_DAYS = 365


def _mac(key: bytes, domain: str, value: bytes) -> bytes:
    return hmac.new(key, domain.encode() + b"\0" + value, hashlib.sha256).digest()


def pseudonym(value: Column, key: bytes, domain: str) -> Column:
    """HMAC-SHA256 in hex, under a domain of its own."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else _mac(key, domain, v.encode()).hex() for v in values])

    return of(value)


@F.pandas_udf(StringType())
def canonical_ip(values: pd.Series) -> pd.Series:
    """An address in its shortest form, IPv4 inside IPv6 as IPv4; null for what is none."""
    out = []
    for v in values:
        try:
            ip = ipaddress.ip_address((v or "").strip())
            out.append(str(getattr(ip, "ipv4_mapped", None) or ip))
        except ValueError:
            out.append(None)
    return pd.Series(out)


def _encode(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def issue_token(identity: Column, issued: Column, key: bytes) -> Column:
    """v1.id.seconds.signature of 32 bytes of identity (hex) and a time."""

    @F.pandas_udf("string")
    def of(ids: pd.Series, times: pd.Series) -> pd.Series:
        bodies = [f"v1.{_encode(bytes.fromhex(i))}.{int(t)}" for i, t in zip(ids, times, strict=True)]
        return pd.Series([f"{b}.{_encode(_mac(key, 'token', b.encode()))}" for b in bodies])

    return of(identity, issued)


def token_is_valid(token: Column, now: Column, key: bytes, days: int = TOKEN_DAYS) -> Column:
    """Four parts, version 1, a 32-byte identity, a right signature, not from the future and not too old."""

    @F.pandas_udf("boolean")
    def of(tokens: pd.Series, nows: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(tokens, nows, strict=True):
            parts, ok = (t or "").split("."), False
            if len(parts) == 4 and parts[0] == "v1" and parts[2].isdigit():
                body = ".".join(parts[:3])
                try:
                    size = len(base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4)))
                except ValueError:
                    size = 0
                signed = hmac.compare_digest(_encode(_mac(key, "token", body.encode())), parts[3])
                ok = size == 32 and signed and 0 <= int(n) - int(parts[2]) <= days * 86400
            out.append(ok)
        return pd.Series(out)

    return of(token, now)
