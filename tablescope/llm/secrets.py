"""Secret scanning with structural confirmation.

Base patterns report assignments, access keys and hexadecimal runs. Beyond these, base64 and hexadecimal runs are only
candidates: they are decoded, and reported if what they hold is built like a secret, i.e. nested DER lengths that fill
the bytes exactly and have the fields of a private key, the length-prefixed fields of an OpenSSH private key, a block
with such a key between its marks, or one of these encoded once more; a base64 run may be wrapped over lines. Tokens are
reported whose header is a JSON object that names an algorithm: signed ones with a JSON payload, and encrypted ones of
five parts whose header names the content's encryption, too. Blocks of armoured packets have a secret key packet first.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
#: Kinds in their order at equal starts.
KINDS = (*BASE_KINDS, "signed_token", "encrypted_token", "key_block", "key_base64", "key_hex")

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones may be passed over

# runs are maximal, so each text is read once
BASE64_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{38,}+={0,2}")
# the first line of a wrapped key: a DER sequence starts with byte 0x30, that is M in base64, others with their names
FIRST_LINE = re.compile(
    r"(?<![A-Za-z0-9+/])(?:M[A-Z]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)[A-Za-z0-9+/]{14,}+(?=\r?\n)"
)
NEXT_LINE = re.compile(r"\r?\n[\x20\t]*+([A-Za-z0-9+/]++={0,2})")
HEX_CANDIDATE = re.compile(r"(?<![0-9A-Fa-f])(?:30|2[Dd]2[Dd]2[Dd]2[Dd]2[Dd]42)[0-9A-Fa-f]{52,}+")
# the body has no run of five hyphens, so each text is read once, however many blocks never end
BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----((?:[^-]|-(?!----))*+)-----END \1-----")
# what strings of JSON and of programs write for a line break and for a slash, escaped once or more
ESCAPED_BREAK = re.compile(r"\\+(?:[nrt]|\r?\n)")
ESCAPED_SLASH = re.compile(r"\\+/")
# base64 of an opening brace, after white space or not, and what may follow it
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])((?:e[wy]|I[ACH]|C[Qgn]|DQ)[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]*+)(?:\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++))?")

SEQUENCE, INTEGER, BITS, OCTETS, NULL, OBJECT_ID = 0x30, 0x02, 0x03, 0x04, 0x05, 0x06
OPENSSH_NAME = b"openssh-key-v1\0"


def from_base64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64 without regard to padding; null if it is neither."""
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each field if their lengths fill ``data`` exactly, else null."""
    fields, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size = int.from_bytes(data[at : at + more], "big")
            at += more
        if at + size > len(data):
            return None
        fields.append((tag, data[at : at + size]))
        at += size
    return fields


def is_private_der(data: bytes) -> bool:
    """Whether ``data`` is one DER sequence with the fields of a private key."""
    outer = der_fields(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    fields = der_fields(outer[0][1])
    if not fields:
        return False
    tags = [t for t, _ in fields]
    if tags[0] == SEQUENCE and tags[1:] == [OCTETS]:  # encrypted: algorithm, ciphertext
        algorithm = der_fields(fields[0][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID and len(fields[1][1]) >= 16
    if tags[0] != INTEGER or len(fields[0][1]) != 1:
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:  # version, algorithm, wrapped key
        algorithm = der_fields(fields[1][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID
    if tags[1:2] == [OCTETS]:  # version, elliptic-curve scalar, parameters
        return len(fields[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return len(tags) >= 5 and set(tags) == {INTEGER}  # version and the numbers of the key


def is_private_openssh(data: bytes) -> bool:
    """Whether the length-prefixed fields of an OpenSSH private key fill ``data`` up to padding."""
    if not data.startswith(OPENSSH_NAME):
        return False
    at = len(OPENSSH_NAME)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(field() is None for _ in range(3)):  # cipher, key derivation, its options
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= count <= 64 and all(field() is not None for _ in range(count + 1)) and len(data) - at < 256


def is_private_key(data: bytes | None) -> bool:
    return bool(data) and (is_private_der(data) or is_private_openssh(data))


def is_secret_packet(data: bytes | None) -> bool:
    """Whether armoured packets start with a secret key (tag 5, in the old or the new format) that fits in them."""
    if not data or len(data) < 8 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:
        tag, first = data[0] & 0x3F, data[1]
        if first >= 224:  # a length in parts is not used for keys, except for 255 with four octets
            head, size = (6, int.from_bytes(data[2:6], "big")) if first == 255 else (0, 0)
        else:
            head, size = (2, first) if first < 192 else (3, ((first - 192) << 8) + data[2] + 192)
    else:
        tag, wide = data[0] >> 2 & 0xF, data[0] & 3
        head, size = (1 + (1 << wide), int.from_bytes(data[1 : 1 + (1 << wide)], "big")) if wide < 3 else (0, 0)
    return tag == 5 and size > 6 and 0 < head and head + size <= len(data) and data[head] in (3, 4, 5, 6)


def is_private_block(body: str) -> bool:
    """Whether the lines between the marks of a PEM block are a private key, or a ciphertext whose header says so.

    Line breaks may be escaped. Header lines have colons, a checksum line of armoured packets starts with an equals sign.
    """
    lines = ESCAPED_SLASH.sub("/", ESCAPED_BREAK.sub("\n", body)).splitlines()
    lines = [line for line in lines if not line.startswith("=")]
    data = from_base64("".join("".join(line for line in lines if ":" not in line).split()))
    return is_private_key(data) or is_secret_packet(data) or bool(data) and any(":" in line and "ENCRYPTED" in line for line in lines)


def holds_key(data: bytes | None, again: bool = True) -> bool:
    """Whether decoded bytes are a private key, a block of one, or, if ``again``, either of them encoded once more."""
    if not data:
        return False
    if is_private_key(data):
        return True
    if data.startswith(b"-----BEGIN ") and data.isascii():
        return any(is_private_block(m[2]) for m in BLOCK.finditer(data.decode()))
    if not again or data[:1] not in (b"M", b"b", b"L", b"3", b"2") or not data.isascii():
        return False
    bare = "".join(data.decode().split())
    if HEX_CANDIDATE.fullmatch(bare):
        return len(bare) % 2 == 0 and holds_key(bytes.fromhex(bare), False)
    return holds_key(from_base64(bare), False)


def der_size(data: bytes | None) -> int:
    """Bytes of the DER value that ``data`` starts with, as its length says; 0 if it can't be read."""
    if not data or len(data) < 6 or data[0] != SEQUENCE:
        return 0
    more = data[1] & 0x7F if data[1] & 0x80 else 0
    return 2 + more + int.from_bytes(data[2 : 2 + more], "big") if 1 <= more <= 4 else 0 if more else 2 + data[1]


def wrapped_key(text: str, start: int, end: int) -> int:
    """The end of a key in base64 lines of equal width and a last one, whose first line is given; 0 if there is none.

    A DER key's own length tells where it ends; other keys end with the first line of another width, or before it.
    """
    width = end - start
    head = from_base64(text[start : start + width // 4 * 4])
    size = der_size(head)
    need = -(-size * 4 // 3)
    if head[0] == SEQUENCE and not width < need < len(text) - start:
        return 0
    parts, ends, have = [text[start:end]], [end], width
    while (line := NEXT_LINE.match(text, ends[-1])) and not 0 < need <= have:
        parts.append(line[1])
        ends.append(line.end())
        have += len(line[1].rstrip("="))
        if len(line[1]) != width:
            break
    if need:
        return ends[-1] if have == need and holds_key(from_base64("".join(parts))) else 0
    for count in (len(parts), len(parts) - 1):
        if count > 1 and holds_key(from_base64("".join(parts[:count]))):
            return ends[count - 1]
    return 0


def json_object(text: str) -> dict | None:
    data = from_base64(text)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every secret of a text, in order of start and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for m in TOKEN.finditer(text) if "." in text else ():
        header = json_object(m[1])
        if not header or not isinstance(header.get("alg"), str):
            continue
        if m[4] and isinstance(header.get("enc"), str):
            found.append((m.start(), m.end(), "encrypted_token"))
        elif m[2] and json_object(m[2]) is not None:
            found.append((m.start(), m.end(3), "signed_token"))
    if "-----BEGIN " in text:
        found += [(m.start(), m.end(), "key_block") for m in BLOCK.finditer(text) if is_private_block(m[2])]
    blocks = [(start, end) for start, end, kind in found if kind == "key_block"]
    found += [(m.start(), m.end(), "key_base64") for m in BASE64_CANDIDATE.finditer(text) if holds_key(from_base64(m[0]))]
    for m in FIRST_LINE.finditer(text):
        if not any(start < m.start() < end for start, end in blocks) and (end := wrapped_key(text, m.start(), m.end())):
            found.append((m.start(), end, "key_base64"))
    found += [
        (m.start(), m.end(), "key_hex")
        for m in HEX_CANDIDATE.finditer(text)
        if len(m[0]) % 2 == 0 and holds_key(bytes.fromhex(m[0]))
    ]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, spans``: the secrets of every whole text as ``array<struct<kind,start,end>>``.

    Offsets count code points, the end is exclusive. Null and empty texts have none. Texts are scanned one by one, so
    memory is that of a batch. Equal rows give equal rows; other columns are not read; an empty table gives an empty
    result. Spans of different kinds may overlap.
    """
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t.as_py())] if t.is_valid else []
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text)).mapInArrow(
        scanned, f"doc_id {key_type}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars``, where present, counted anew.

    Overlapping spans become one mark. Documents without secrets, and null texts, stay as they are. Other columns, of
    any name, stay as they are.
    """
    place = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cleaned(text: str) -> str:
        out, at = [], 0
        for start, end, _ in spans_of(text):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(place).to_pylist()
            new = [t if t is None else cleaned(t) for t in old]
            arrays = list(batch.columns)
            arrays[place] = pa.array(new, arrays[place].type)
            if count is not None:
                sizes = [c if a == b else len(b) for a, b, c in zip(old, new, arrays[count].to_pylist())]
                arrays[count] = pa.array(sizes, arrays[count].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots would be taken for fields
    return plain.mapInArrow(redacted, plain.schema).toDF(*docs.columns)
