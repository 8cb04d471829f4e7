"""Finding secrets: patterns, and encodings that are confirmed by their structure.

Assignments, access keys and hex runs are reported as they stand. Encoded candidates
are reported only if what they encode is well-formed: a signed token's header must be
a JSON object that names its algorithm, a key's bytes must be nested lengths that fit
into each other to the end, an OpenSSH key must start with its magic string. A key is
looked for wherever its first bytes may stand within a run, over line ends; its own
lengths say where it ends. An encrypted PEM body is confirmed by its headers and size.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm import common

# The patterns and shortest lengths of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12

#: Dotted runs of the URL alphabet with at least two dots. What can begin a header: a brace, white space before it too.
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]*+){2,}")
HEADER = re.compile(r"e[w-z0-9_-]|I[A-P]|C[Q-v]|D[Q-f]")
OBJECT = re.compile(rb"[ \t\r\n]*(?:\{[ \t\r\n]*(?:\"|\Z)|\Z)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_HEADER = re.compile(r"^[ \t]*([A-Za-z0-9-]+): *(\S[^\n]*)$", re.MULTILINE)
#: A line's end within an encoding, as it is or escaped (as in JSON), and an escaped slash's mark.
GAP = re.compile(r"[ \t]*(?:(?:[\r\n]|\\+[rn])[ \t]*)+|\\+(?=/)")
#: Characters of an encoding; where a key may begin in it: with a sequence or as OpenSSH's own.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_]|-(?!----))+")
BASE64_START = re.compile(r"M[A-I]|b3Bl")
PADDING = re.compile(r"={0,2}")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
HEXADECIMAL_START = re.compile(r"30(?=[0-8][0-9A-Fa-f])|6[Ff]70")
#: Characters that tell whether a key may stand there, and the fewest bytes of one.
HEAD_CHARS, KEY_BYTES = 32, 30
#: Algorithms that keys are encrypted with: PKCS #5 and #12.
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH = b"openssh-key-v1\0"

_JSON, _BLANK = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "derhex")


def decoded(text: str) -> bytes | None:
    """The bytes of a base64 text of either alphabet, padded or not."""
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at ``at``; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if length < 0x80:
            return None  # the short form was due
    return (tag, at, at + length) if at + length <= end else None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER elements that fill ``data`` exactly; None if they don't."""
    out, at = [], 0
    while at < len(data):
        found = element(data, at, len(data))
        if found is None:
            return None
        out.append((found[0], data[found[1] : found[2]]))
        at = found[2]
    return out


def broken(data: bytes) -> list[int] | None:
    """None if every constructed element is filled by its own elements, however deep they lie.

    Else where the constructed elements begin that hold what doesn't fit: none of them is sound on its own.
    """
    at, open_ends, starts = 0, [len(data)], []
    if not data:
        return [0]
    while True:
        while len(open_ends) > 1 and at == open_ends[-1]:
            open_ends.pop()
            starts.pop()
        if at == len(data):
            return None
        found = element(data, at, open_ends[-1])
        if found is None:
            return starts or [0]
        tag, content, end = found
        if tag & 0x20 and content < end:
            open_ends.append(end)
            starts.append(at)
            at = content
        else:
            at = end


def private_key(data: bytes | None) -> bool:
    """A DER private key: one sequence that starts with a small version number and holds more, or an OpenSSH key."""
    if not data:
        return False
    if data.startswith(OPENSSH):
        return True
    top = elements(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or broken(data) is not None:
        return False
    inner = elements(top[0][1]) or []
    if len(inner) == 2 and inner[0][0] == 0x30 and inner[1][0] == 0x04:
        algorithm = elements(inner[0][1]) or [(0, b"")]
        return algorithm[0][0] == 0x06 and algorithm[0][1].startswith(ENCRYPTIONS) and len(inner[1][1]) > 0
    return len(inner) >= 3 and inner[0][0] == 0x02 and inner[0][1] in (b"\0", b"\1")


def der_size(head: bytes) -> int:
    """Bytes of the key that may begin so, zero if none does: a sequence that starts with a version, or an algorithm's sequence.

    The headers alone tell: lengths must fit into each other.
    """
    if len(head) < 8 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    length, body = (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]), head[2 + n :]
    begins = body[:3] in (b"\x02\x01\0", b"\x02\x01\1")
    if body[:1] == b"\x30":
        inner = element(body + bytes(8), 0, length)
        # The algorithm is named first.
        begins = inner is not None and (body[inner[1] : inner[1] + 1] in (b"\x06", b"") or inner[1] >= len(body))
    return 2 + n + length if n <= 4 and begins and 2 + n + length >= KEY_BYTES else 0


def openssh_size(data: bytes) -> tuple[int, bool]:
    """Bytes that an OpenSSH key has at least, by what ``data`` shows of it, and whether that is all of them."""
    at, left, counted = len(OPENSSH), 3, False  # cipher, derivation and its options; then the counted public keys, private ones
    while left or not counted:
        if len(data) < at + 4:
            return at + 4, False
        number, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if left:
            at, left = at + number, left - 1
        else:
            left, counted = number + 1, True
    return at, True


def joined(text: str, at: int, chars: re.Pattern, count: int) -> tuple[str, int]:
    """At most ``count`` characters of the encoding at ``at``, over line ends, and where they end."""
    out, end = [], at
    while count:
        m = chars.match(text, at, at + count)
        if not m:
            break
        out.append(m[0])
        count, end = count - len(m[0]), m.end()
        gap = GAP.match(text, end) if count else None
        if not gap:
            break
        at = gap.end()
    return "".join(out), end


def unhex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


class Runs:
    """Runs of an encoding over line ends, each looked at once however many places in it are asked about."""

    def __init__(self, text: str, chars: re.Pattern):
        self.text, self.chars = text, chars
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.before: list[int] = []

    def left(self, at: int) -> int:
        """Characters of the encoding from ``at`` to the end of its run."""
        if not self.ends or not self.starts[0] <= at < self.ends[-1]:
            self.starts, self.ends, self.before, total, place = [], [], [], 0, at
            while m := self.chars.match(self.text, place):
                self.starts.append(place)
                self.ends.append(m.end())
                self.before.append(total)
                total += m.end() - place
                gap = GAP.match(self.text, m.end())
                if not gap:
                    break
                place = gap.end()
        i = bisect_right(self.starts, at) - 1
        return self.before[-1] + self.ends[-1] - self.starts[-1] - self.before[i] - (at - self.starts[i])


def key_end(text: str, at: int, chars: re.Pattern, decode, per_byte: tuple[int, int], runs: Runs, doomed: set[int]) -> int:
    """Where the private key ends whose encoding begins at ``at``, or -1.

    ``doomed``: places where an element begins that has been found unsound as a part of another.
    """

    def read(size: int) -> tuple[bytes, int]:
        some, end = joined(text, at, chars, -(-size * per_byte[0] // per_byte[1]))
        return (decode(some) or b"")[:size], end

    if at in doomed:
        return -1
    head = decode(joined(text, at, chars, HEAD_CHARS)[0]) or b""
    if head.startswith(OPENSSH):
        size, data, end = 256, b"", at
        while True:
            before = len(data)
            data, end = read(size)
            need, whole = openssh_size(data)
            if whole and need <= len(data):
                return read(need)[1]
            if len(data) < size or len(data) == before:
                return chars.match(text, at).end()  # cut off: the rest of its line
            size = max(need, 2 * size)
    size = der_size(head)
    if not size or -(-size * per_byte[0] // per_byte[1]) > runs.left(at):
        return -1
    data, end = read(size)
    if len(data) != size:
        return -1
    if private_key(data):
        return end
    # In one line, bytes that begin with a character lie at known places.
    if end - at == -(-size * per_byte[0] // per_byte[1]):
        for start in broken(data) or ():
            if start * per_byte[0] % per_byte[1] == 0:
                doomed.add(at + start * per_byte[0] // per_byte[1])
    return -1


def keys_in(text: str, start: re.Pattern, chars: re.Pattern, decode, per_byte: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Places of encoded private keys, wherever in a run of ``chars`` they begin."""
    at, runs, doomed = 0, Runs(text, chars), set()
    while m := start.search(text, at):
        end = key_end(text, m.start(), chars, decode, per_byte, runs, doomed)
        if end > 0:
            yield m.start(), end
        at = max(m.start() + 1, end)


def pem_keys(text: str) -> Iterator[tuple[int, int]]:
    """Places of private keys between PEM lines, those with headers and with escaped line ends too."""
    for m in PEM.finditer(text):
        to = text.find("-----", m.end())
        last = f"-----END {m[1]}-----"
        if to < 0 or not text.startswith(last, to):
            continue
        body = re.sub(r"\\+(?=/)", "", re.sub(r"\\+[rnt]|\r", "\n", text[m.end() : to]))
        headers = {h[1].lower(): h[2] for h in PEM_HEADER.finditer(body)}
        data = decoded(PEM_HEADER.sub("", body))
        encrypted = headers.get("proc-type", "").endswith("ENCRYPTED") and "dek-info" in headers
        if private_key(data) or encrypted and data and len(data) % 8 == 0:
            yield m.start(), to + len(last)


def tokens_in(text: str) -> Iterator[tuple[int, int]]:
    """Places of signed tokens, wherever in a run their header begins."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(len(parts) - 2):
            start = header_in(parts[i], parts[i + 1])
            if start >= 0:
                yield at + start, at + sum(map(len, parts[i : i + 3])) + 2
            at += len(parts[i]) + 1


def header_in(part: str, payload: str) -> int:
    """Where in a part a token's header begins that reaches to its end, or -1.

    Places of one remainder by four are suffixes of the same bytes, which are decoded once; an object that
    ends early, or breaks off, is given up where it does.
    """
    bodies: dict[int, tuple[int, str | None]] = {}
    checked = False
    for h in HEADER.finditer(part):
        at = h.start()
        if not OBJECT.match(decoded(part[at : at + HEAD_CHARS]) or b"x"):
            continue
        if not checked:
            if json_object(payload) is None:
                return -1  # whatever the header is
            checked = True
        if at % 4 not in bodies:
            data = decoded(part[at:])
            bodies[at % 4] = (at, data and data.decode("latin-1"))
        first, body = bodies[at % 4]
        if not body:
            continue
        offset = (at - first) // 4 * 3
        try:
            _, end = _JSON.raw_decode(body, _BLANK.match(body, offset).end())
        except (ValueError, RecursionError):
            continue
        if _BLANK.match(body, end).end() == len(body):
            head = json_object(part[at:])
            if head and isinstance(head.get("alg"), str):
                return at
    return -1


def json_object(part: str) -> dict | None:
    """What a part of a token encodes, if it is a JSON object."""
    try:
        made = json.loads(decoded(part) or b"")
    except (ValueError, RecursionError):  # also bytes that are no UTF-8
        return None
    return made if isinstance(made, dict) else None


def spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (exclusive) of every secret, by start and then kind; positions in code points."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += [("derhex", a, b) for a, b in keys_in(text, HEXADECIMAL_START, HEXADECIMAL, unhex, (2, 1))]
    found += [("jwt", a, b) for a, b in tokens_in(text)]
    keys = list(pem_keys(text)) if "-----BEGIN " in text else []
    found += [("pem", a, b) for a, b in keys]
    for a, b in keys_in(text, BASE64_START, BASE64, decoded, (4, 3)):
        if not any(x <= a < y for x, y in keys):
            found.append(("der", a, b + len(PADDING.match(text, b)[0])))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each secret's place taken by its kind; of secrets that overlap, the first names it."""
    out, at, i = [], 0, 0
    while i < len(found):
        kind, start, end = found[i]
        i += 1
        while i < len(found) and found[i][1] < end:
            end, i = max(end, found[i][2]), i + 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans, redacted`` of every row of ``docs``, whole texts.

    ``spans``: kind, start and end of each secret in code points, end exclusive,
    by start and then kind. ``redacted``: the text with secrets replaced by their
    kind in brackets. A null text is an empty one and has none. Repeated and null
    ids are kept; columns other than ``doc_id`` and ``text`` are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.portions(batches):
            found = [spans(t) for t in texts]
            listed = [[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found]
            clean = [redact(t, f) if f else t for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(listed, _SPANS), pa.array(clean, pa.string())], ["doc_id", "spans", "redacted"]
            )

    texts = common.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind string, start long, end long>>, redacted string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, ``n_chars`` (if there) to match, other columns as they are.

    Null texts stay null.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, spans(t)))

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out


def span_list(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their list, and the list of all spans."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(span_list(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
