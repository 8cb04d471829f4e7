import base64
import json
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import arrays, formatting, keypad_text, paths, secrets
from fleetlens.functions.intervals import interval_seconds, spark_interval


def column(spark, values, dtype, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("text, expected", [("20m", "20 minutes"), ("2h", "2 hours"), ("30d", "30 days"), ("1w", "1 weeks")])
def test_interval(text, expected):
    assert spark_interval(text) == expected


def test_interval_seconds():
    assert [interval_seconds(t) for t in ("5m", "2h", "7d", "1w")] == [300, 7200, 604800, 604800]


@pytest.mark.parametrize("text", ["1μ", "5 min", "5min", "m", "", "1mh", None, "٣m"])
def test_interval_rejects(text):
    with pytest.raises(ValueError):
        spark_interval(text)


def test_human_time(spark):
    given = [0.02, 200.0, 30000.0, 255000.0, 4320000.0]
    assert column(spark, given, "double", formatting.human_time) == ["20 µs", "200 ms", "30 s", "4.250 m", "1.200 h"]
    assert column(spark, [200.0], "double", lambda c: formatting.human_time(c, 2)) == ["200.00 ms"]


def test_human_bytes(spark):
    given = [512, 1024, 4096, 20 * 1024**2, int(2.345 * 1024**3)]
    expected = ["512.000 b", "1024.000 b", "4.000 kb", "20.000 mb", "2.345 gb"]
    assert column(spark, given, "bigint", formatting.human_bytes) == expected


def test_fixed_rounds_the_exact_value(spark):
    rng = random.Random(7)
    given = [1.2345, 1.0005, 1.0625, 0.0, 0.0005, 1234.5, 99.9995, 2.5, 1023.9999]
    given += [rng.uniform(0, 2000) for _ in range(300)] + [rng.randrange(20000) / 16 for _ in range(300)]
    given += [rng.randrange(2000000) / 10000 for _ in range(500)]
    expected = [str(Decimal(v).quantize(Decimal("0.001"), ROUND_HALF_UP)) for v in given]
    assert column(spark, given, "double", lambda c: formatting.fixed(c, 3)) == expected


def test_date_formats(spark):
    df = spark.sql("select timestamp'2024-02-27 21:45:06.789' a, timestamp'2024-02-27 00:04:00' b")
    got = {s: df.select(formatting.format_date("a", s)).first()[0] for s in formatting.DATE_FORMATS}
    assert got == {
        "report": "[02-27-2024] 09:45 PM",
        "file": "02272024_2145",
        "lexical": "2024-02-27_21-45-06",
        "debug": "[02-27-2024] 21:45:06.789",
        "day": "Tue",
        "clock": "21:45:06",
    }
    assert df.select(formatting.format_date("b", "file")).first()[0] == "02272024_2404"


def test_bar(spark):
    draw = lambda c: formatting.bar(c, F.lit(10.0), F.lit(30.0))
    assert column(spark, [10.0, 20.0, 30.0], "double", draw) == ["", "=" * 25, "=" * 50]
    flat = lambda c: formatting.bar(c, F.lit(1.0), F.lit(1.0))
    assert column(spark, [1.0], "double", flat) == [""]
    padded = lambda c: formatting.bar(c, F.lit(0.0), F.lit(1.0), 30, pad=True)
    assert column(spark, [0.5], "double", padded) == ["=" * 15 + " " * 15]


def test_extname(spark):
    given = ["/r/.bashrc", "/r/a.", "/r/a.b.c", "/r/x", "..", "/r/..foo", "/r.d/x", "/r/A.TXT", "/r/a.txt/"]
    assert column(spark, given, "string", paths.extname) == ["", ".", ".c", "", "", ".foo", "", ".TXT", ".txt"]


def test_parent_and_components(spark):
    assert column(spark, ["/a/b/c", "/a", "/"], "string", paths.parent) == ["/a/b", "/", "/"]
    assert column(spark, ["/a//b/"], "string", paths.components) == [["a", "b"]]


def test_digits(spark):
    given = ["hello", "HeLLo", "it's", "a@b c", "é"]
    assert column(spark, given, "string", keypad_text.to_digits) == ["43556", "43556", "48?7", "21202", "?"]
    assert column(spark, ["qweasdzxc "], "string", keypad_text.keys_to_digits) == ["1234567890"]
    with pytest.raises(Exception, match="not a keypad key"):
        column(spark, ["qwr"], "string", keypad_text.keys_to_digits)


def test_encrypt_and_decrypt(spark):
    key = F.lit(b"0123456789abcdef")
    plain = [f"secret ü {i}" for i in range(50)]
    df = spark.createDataFrame([(p,) for p in plain], "p string").withColumn("e", secrets.encrypt_column("p", key))
    back = df.select("p", "e.iv", secrets.decrypt_column("e.text", "e.iv", key).alias("d")).collect()
    assert all(r.p == r.d for r in back)
    assert len({r.iv for r in back}) == 50
    assert all(len(base64.b64decode(r.iv)) == 16 for r in back)


def test_decrypt_known_text(spark):
    """AES-128-CBC test vector of NIST SP 800-38A F.2.1, first block, sealed with PKCS padding."""
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    iv = base64.b64encode(bytes(range(16))).decode()
    sealed = spark.range(1).select(
        F.base64(F.substring(F.aes_encrypt(F.lit("hello"), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(bytes(range(16)))), 17, 99))
    ).first()[0]
    df = spark.createDataFrame([(sealed, iv)], "t string, iv string")
    assert df.select(secrets.decrypt_column("t", "iv", F.lit(key))).first()[0] == "hello"


def token(payload):
    part = base64.urlsafe_b64encode(json.dumps(payload).encode()).decode().rstrip("=")
    return f"e30.{part}.c2ln"


def test_tokens(spark):
    now = 1_700_000_000
    base = {"user_id": "u?>~ÿ", "user_name": "n", "jwt_session_id": 7, "more": 1}
    given = [
        token({**base, "iat": now, "exp": now + 3600}),
        token({**base, "iat": 1000186620, "exp": 1000193280}),
        token({**base, "iat": now - 35 * 60, "exp": now + 25 * 60}),
        token({**base, "iat": now - 30 * 60, "exp": now + 30 * 60}),
        token({**base, "iat": now - 60, "exp": now}),
    ]
    status = lambda c: secrets.token_status(secrets.jwt_payload(c), F.lit(now))
    assert column(spark, given, "string", status) == ["valid", "expired", "renew", "valid", "expired"]
    first = column(spark, given[:1], "string", secrets.jwt_payload)[0]
    assert (first.user_id, first.jwt_session_id) == ("u?>~ÿ", 7)


@pytest.mark.parametrize("bad", ["a.b", "a.b.c.d", "e30.e30.c2ln", "e30.!!.c2ln", token({"user_id": "1"})])
def test_bad_tokens(spark, bad):
    quiet = lambda c: secrets.jwt_payload(c, "quarantine")
    assert column(spark, [bad], "string", quiet) == [None]
    with pytest.raises(Exception, match="invalid token"):
        column(spark, [bad], "string", secrets.jwt_payload)


def test_chunk(spark):
    given = [[], [1], [1, 2, 3], [1, 2, 3, 4]]
    got = column(spark, given, "array<int>", lambda c: arrays.chunk(c, 2))
    assert got == [[], [[1]], [[1, 2], [3]], [[1, 2], [3, 4]]]


def test_half_up(spark):
    assert column(spark, [0.5, 1.5, -0.5, 2.4], "double", formatting.half_up) == [1, 2, 0, 2]
    assert math.isclose(column(spark, [12.34567], "double", lambda c: formatting.half_up(c, 3))[0], 12.346)
