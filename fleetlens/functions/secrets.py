"""Column encryption and session token columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

# Token payload fields.
TOKEN_PAYLOAD = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("jwt_session_id", T.LongType()),
        T.StructField("iat", T.LongType()),
        T.StructField("exp", T.LongType()),
    ]
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row however often it is used."""
    return F.transform(F.array(value), use)[0]


def encrypt_column(text: Column | str, key: Column) -> Column:
    """AES-CBC with a random IV: ``struct(text, iv)``, both base64, from one cipher text."""
    sealed = F.aes_encrypt(_col(text), key, F.lit("CBC"), F.lit("PKCS"))
    return _once(
        sealed,
        lambda raw: F.struct(
            F.base64(F.substring(raw, 17, 2**31 - 1)).alias("text"),
            F.base64(F.substring(raw, 1, 16)).alias("iv"),
        ),
    )


def decrypt_column(text: Column | str, iv: Column | str, key: Column) -> Column:
    """Inverse of ``encrypt_column``; a 16-byte key means AES-128."""
    raw = F.concat(F.unbase64(_col(iv)), F.unbase64(_col(text)))
    return F.aes_decrypt(raw, key, F.lit("CBC"), F.lit("PKCS")).cast("string")


def jwt_payload(token: Column | str, mode: str = "failfast") -> Column:
    """Payload struct of a three-part token; other keys are dropped.

    A malformed token raises, or gives NULL with ``mode="quarantine"``.
    """
    if mode not in ("failfast", "quarantine"):
        raise ValueError(f"mode is failfast or quarantine, not {mode!r}")
    invalid = F.raise_error(F.lit("invalid token")) if mode == "failfast" else F.lit(None)

    def read(parts: Column) -> Column:
        part = F.translate(F.get(parts, F.lit(1)), "-_=", "+/")
        padded = F.rpad(part, F.ceil(F.length(part) / 4).cast("int") * 4, F.lit("="))
        body = F.try_to_binary(padded, F.lit("base64")).cast("string")
        return F.when(F.size(parts) == 3, F.from_json(body, TOKEN_PAYLOAD))

    def check(payload: Column) -> Column:
        missing = F.greatest(*[payload[name].isNull() for name in TOKEN_PAYLOAD.names])
        return F.when(missing, invalid.cast(TOKEN_PAYLOAD)).otherwise(payload)

    return _once(_once(F.split(_col(token), r"\."), read), check)


def token_status(payload: Column | str, now: Column) -> Column:
    """``expired``, ``renew`` (less than half its life is left) or ``valid``.

    ``now`` is epoch seconds, as are ``iat`` and ``exp``.
    """
    payload = _col(payload)
    left, life = payload["exp"] - now, payload["exp"] - payload["iat"]
    return F.when(left <= 0, "expired").when(left * 2 < life, "renew").otherwise("valid")
