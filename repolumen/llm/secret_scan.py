"""Secrets in texts: plain patterns, and keys and tokens confirmed by decoding their structure."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_text, fresh

#: Kinds in the order in which spans with the same start are listed; the structural kinds come last.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

#: The plain patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Object identifiers of private keys: RSA, elliptic curve, Ed25519, X25519, DSA.
KEY_TYPES = ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e", "2a8648ce380401")
OPENSSH = b"openssh-key-v1\x00"

SPAN = "array<struct<kind:string,start:int,end:int>>"


def secret_spans(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """The table with ``into``: the secrets of the whole text as (kind, start, end) in code points, end exclusive.

    ``assign``, ``access`` and ``hex`` are the plain patterns, leftmost and without overlap within a kind. Runs of
    base64 (either alphabet, also over lines) or hexadecimal digits (either case) are decoded and reported only if what
    they hold is confirmed: ``pem`` is a private key block whose body parses as one of these or, under a DEK-Info
    header, is whole cipher blocks; ``der`` a key in nested ASN.1 whose lengths fit; ``ssh`` an OpenSSH key whose
    length-prefixed fields fit; ``jwt`` a signed token with a header that names an algorithm and a payload
    that is an object. Spans are ordered by start, then kind, then end. Null and empty texts have none. One pass over
    the rows, with no exchange.
    """
    kept = docs.drop(into) if into != text else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T._parse_datatype_string(SPAN))])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.decode("utf-8", "replace"))]
                     for t in each_text(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The table with every secret of ``text`` replaced by ``mark`` and, if there is such a column, ``length`` anew.

    Spans that overlap or touch are replaced once. Null texts stay null.
    """
    into, rows = fresh(docs, "secrets"), docs
    spans = F.col(into)
    merged = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))),
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= s["a"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"),
                             F.greatest(F.get(acc, F.size(acc) - 1)["b"], s["b"]).alias("b"))),
        )).otherwise(F.concat(acc, F.array(s))))
    pieces = F.aggregate(
        merged, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark)).alias("out"),
            s["b"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = secret_spans(docs, text, into)
    clean = F.when(F.size(spans) > 0, pieces).otherwise(F.col(text))
    rows = rows.withColumn(text, clean)
    if length and length in docs.columns:
        size = F.when(F.size(spans) > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length))
        rows = rows.withColumn(length, size)
    return rows.select(*docs.columns)


def _patterns():
    """Compiled once in each worker."""
    import re
    import sys

    store = sys.__dict__.setdefault("_repolumen_llm", {})
    if "secrets" not in store:
        store["secrets"] = {
            "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
            # a shorter run fails as a whole, so asking for the length at once finds the same matches
            "access": re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4)),
            "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % LEAST_HEX),
            "anyhex": re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{%d,}" % LEAST_HEX),
            "pem": re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----"
                              r"((?:(?:\s|\\[nr])*[A-Za-z][A-Za-z0-9-]*:(?:(?!\\n)[^\n])*(?:\n|\\n))*)"
                              r"([A-Za-z0-9+/=\s\\]+)-----END \1-----"),
            "dek": re.compile(r"DEK-Info:\x20*([A-Za-z0-9-]+),\x20*([0-9A-Fa-f]+)"),
            # lines of digits of either alphabet, with indents and line ends, also escaped ones, between them
            "lines": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}"),
            "wrap": re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"),
            "base64": re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}"),
            "jwt": re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{20,})"),
        }
    return store["secrets"]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """The (kind, start, end) of the secrets of one text."""
    find, spans = _patterns(), []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in find["assign"].finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in find["access"].finditer(text)]
    spans += [("hex", *m.span()) for m in find["hex"].finditer(text)]
    keys = set()  # the structural spans outside key blocks: a run can be found by several patterns
    for name in ("hex", "anyhex"):
        for m in find[name].finditer(text):
            if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
                keys.add((kind, *m.span()))
    blocks = []
    if "PRIVATE KEY-----" in text:
        for m in find["pem"].finditer(text):
            body = _decoded(m[3].replace("\\r", "").replace("\\n", ""))
            if _key_kind(body) or _is_encrypted(find["dek"].search(m[2]), body):
                blocks.append(m.span())
                spans.append(("pem", *m.span()))
    for m in find["base64"].finditer(text):
        if not any(a <= m.start() < b for a, b in blocks) and (kind := _key_kind(_decoded(m[0]))):
            keys.add((kind, *m.span()))
    taken = {start for _, start, _ in keys}
    for m in find["lines"].finditer(text):
        if m.start() not in taken and not any(a <= m.start() < b for a, b in blocks) and (found := _wrapped_key(m[0], find["wrap"])):
            keys.add((found[0], m.start(), m.start() + found[1]))
    spans += keys
    if "eyJ" in text or "ey" in text and "." in text:
        at = 0
        while m := find["jwt"].search(text, at):
            if _is_signed(m[1], m[2]):
                spans.append(("jwt", *m.span()))
                at = m.end()
            else:
                at = m.start(2)  # the word before the dot may not be the header
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _decoded(digits: str, url: bool = False) -> bytes:
    """What base64 digits hold; nothing if they are none."""
    import base64
    import binascii

    digits = "".join(digits.split()).rstrip("=")
    if len(digits) % 4 == 1:
        digits = digits[:-1] if not url else ""
    try:
        return base64.b64decode(digits + "=" * (-len(digits) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def _is_encrypted(dek, body: bytes) -> bool:
    """The body of a block with a DEK-Info header is whole cipher blocks, and the starting value is at least 8 bytes."""
    if not dek or not body or len(dek[2]) < 16:
        return False
    return len(body) % (16 if dek[1].upper().startswith("AES") else 8) == 0


def _wrapped_key(run: str, wrap) -> tuple[str, int] | None:
    """(kind, length) of the private key that a run of base64 lines starts with, in either alphabet.

    The key's own lengths tell where it ends, so words after its last line do not matter.
    """
    head = _decoded(run[:40].replace("-", "+").replace("_", "/"))
    if head[:1] != b"\x30" and not head.startswith(OPENSSH):
        return None
    digits, places, at = [], [], 0
    for gap in [*wrap.finditer(run), None]:
        end = gap.start() if gap else len(run.rstrip("="))
        digits.append(run[at:end])
        places.append((places[-1][0] + places[-1][2] - places[-1][1] if places else 0, at, end))
        at = gap.end() if gap else end
    data = _decoded("".join(digits).replace("-", "+").replace("_", "/"))
    size = _fields_end(data, len(OPENSSH)) if head.startswith(OPENSSH) else (_element(data, 0, len(data)) or (0, 0, 0))[2]
    if not size or not (kind := _key_kind(data[:size])):
        return None
    need = -(-size * 4 // 3)
    before, start, _ = next(p for p in places if p[0] + p[2] - p[1] >= need)
    end = start + need - before
    while run[end:end + 1] == "=":
        end += 1
    return kind, end


def _is_signed(header: str, payload: str) -> bool:
    """A token header names its algorithm, and its payload is an object."""
    import json

    try:
        head, body = json.loads(_decoded(header, True)), json.loads(_decoded(payload, True))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at a place, if its length fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        count = size & 0x7F
        if not 1 <= count <= 4 or at + count > end:
            return None
        size, at = int.from_bytes(data[at:at + count]), at + count
    return (tag, at, at + size) if at + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a stretch without a gap."""
    found = []
    while at < end:
        if (e := _element(data, at, end)) is None:
            return None
        found.append(e)
        at = e[2]
    return found


def _key_kind(data: bytes) -> str | None:
    """``der`` or ``ssh`` if the bytes are a private key of that encoding."""
    if data.startswith(OPENSSH):
        return "ssh" if _fields_end(data, len(OPENSSH)) else None
    outer = _element(data, 0, len(data)) if data[:1] == b"\x30" else None
    # up to two bytes may follow, as a run of base64 digits ends on no byte
    if outer is None or len(data) - outer[2] > 2:
        return None
    parts = _elements(data, outer[1], outer[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    if len(tags) >= 9 and set(tags[:9]) == {2}:
        return "der"  # RSA: version and eight numbers
    if tags == [2] * 6 and data[parts[0][1]:parts[0][2]] == b"\0":
        return "der"  # DSA: version and five numbers
    if tags[:2] == [2, 4] and {0xA0, 0xA1} & {*tags[2:]}:
        return "der"  # elliptic curve: version, number, then the curve
    if tags[:3] == [2, 0x30, 4]:  # version, algorithm, wrapped key
        inner = _elements(data, parts[1][1], parts[1][2])
        if inner and inner[0][0] == 6 and data[inner[0][1]:inner[0][2]].hex() in KEY_TYPES:
            return "der"
    if tags[:2] == [0x30, 4] and len(tags) == 2:  # encrypted: scheme, data
        inner = _elements(data, parts[0][1], parts[0][2])
        return "der" if inner and inner[0][0] == 6 else None
    return None


def _fields_end(data: bytes, at: int) -> int:
    """Cipher, derivation, its options, number of keys, public key, private part: each with its length before it; 0 if they do not fit."""
    for field in range(5):
        if at + 4 > len(data):
            return 0
        if field == 3:
            keys, at = int.from_bytes(data[at:at + 4]), at + 4
            if keys != 1:
                return 0
        size, at = int.from_bytes(data[at:at + 4]), at + 4
        if at + size > len(data):
            return 0
        at += size
    return at
