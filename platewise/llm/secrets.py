"""Secret scans with structural confirmation."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import FOLD_BYTES, batches

# The base patterns, and the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
# A line end as such or as written in a string literal, and what else string literals escape in base64.
_BREAK = r"(?<!\\)(?:\\*\r?\n|(?:\\+r)?\\+n|\\+r|\\+u000[aAdD])"
_ESCAPES = ((re.compile(_BREAK + r"|(?<!\\)\\+t"), "\n"), (re.compile(r"(?<!\\)\\+(?:/|u002[fF])"), "/"), (re.compile(r"(?<!\\)\\+u002[bB]"), "+"), (re.compile(r"(?<!\\)\\+u003[dD]"), "="))
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)(?=-----)")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,\\-]*")
# The patterns begin with their letters, which is faster than to look behind first.  A run of base64 begins where none goes on, or
# behind an escaped line end or tab.  Base64 of a sequence (0x30, then a short length or the size of a long one) is M and one of A to I.
_BASE64 = re.compile(r"[MAb](?:(?<![A-Za-z0-9+/_-].)|(?<=\\[nrt].))(?:(?<=M)[A-I]|(?<=A)AAA|(?<=b)3Blbn)[A-Za-z0-9+/_-]{26,}={0,2}")
_CODED_PEM = re.compile(r"L(?:(?<![A-Za-z0-9+/_-].)|(?<=\\[nrt].))S0tLS1CRUdJTi[A-Za-z0-9+/_-]+(?:" + _BREAK + r"[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_DER_HEX = re.compile(r"30(?<![0-9A-Fa-f]..)[0-9A-Fa-f]{22,}")
# A full stop may stand on either side if no more of a token lies behind it.
_TOKEN = re.compile(r"(e[wy](?:(?<![A-Za-z0-9_.-]..)|(?<![A-Za-z0-9_-]\...)(?<=\...)|(?<=\\[nrt]..))[A-Za-z0-9_-]+)\.(e[wy][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)"
                    r"(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")
_SSH_NAMES = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-[a-z0-9-]+|sk-[a-z0-9@.-]+)")
_DEPTH = 16


def unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the items that fill `data` exactly; None if their lengths do not add up."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
            if size < 128:
                return None
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_der_key(data: bytes, depth: int = 0) -> bool:
    """One sequence that fills the data, whose nested sequences and sets fill theirs, holding an integer or an
    object name and a string or integer of key size: the shape of public and private keys and certificates."""
    top = _der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    named = large = False
    todo = [(top[0][1], 1)]
    while todo:
        body, depth = todo.pop()
        items = _der_items(body)
        if items is None or (depth == 1 and len(items) < 2) or depth > _DEPTH:
            return False
        for tag, content in items:
            named |= tag == 0x06 or (tag == 0x02 and len(content) > 0)
            large |= tag in (0x02, 0x03, 0x04) and len(content) >= 16
            if tag & 0x20:
                todo.append((content, depth + 1))
    return named and large


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the data after a key name, or a private key file of that kind."""
    magic = b"openssh-key-v1\0"
    private = data.startswith(magic)
    at, fields = len(magic) if private else 0, []
    while at + 4 <= len(data) and not (private and len(fields) == 3):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4:at + 4 + size])
        at += 4 + size
    if private:
        return len(fields) == 3 and at + 8 <= len(data) and int.from_bytes(data[at:at + 4], "big") >= 1
    return at == len(data) and len(fields) >= 2 and bool(_SSH_NAMES.fullmatch(fields[0])) and all(fields)


def is_signed_token(head: str, body: str, signature: str) -> bool:
    """Header and payload decode to JSON objects, the header names an algorithm and the signature decodes."""
    try:
        header, payload = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return (isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)
            and (header["alg"].lower() == "none" or len(unbase64(signature) or b"") >= 16))


def is_pem_key(body: str) -> bool:
    """What lies between the marks of a PEM block, with line ends as such or escaped."""
    for escape, plain in _ESCAPES:
        body = escape.sub(plain, body)
    data = unbase64("".join("".join(x for x in body.splitlines() if ":" not in x).split()))
    return bool(data) and (is_der_key(data) or is_ssh_key(data) or "ENCRYPTED" in body and len(data) >= 32)


def pem_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of every END mark with the mark right before it, if that begins the same kind of block.

    Each mark is met once and bodies do not overlap, so the time is linear in the text, however many blocks stay open.
    """
    begun = None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
            continue
        if begun and begun[2] == m[2] and begun.end() + 5 <= m.start():
            body = text[begun.end() + 5:m.start()]
            if _PEM_BODY.fullmatch(body):
                yield begun.start(), m.end() + 5, body
        begun = None


def coded_pem_end(run: str) -> int | None:
    """The end in `run`, base64 that may be wrapped, of the first PEM key it decodes to; None if there is none."""
    lines, at = [], 0
    for gap in [*re.finditer(_BREAK + r"[ \t]*", run), None]:
        lines.append((at, gap.start() if gap else len(run)))
        at = gap.end() if gap else at
    plain = "".join(run[a:b] for a, b in lines).rstrip("=")
    text = (unbase64(plain[:len(plain) - (len(plain) % 4 == 1)]) or b"").decode("latin-1")
    for _, end, body in pem_blocks(text):
        if is_pem_key(body):
            need = -(-end * 4 // 3)
            for a, b in lines:  # the line that holds the last of it goes whole
                if need <= b - a:
                    return b
                need -= b - a
    return None


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all findings by start, then kind; code points, end exclusive.

    The base kinds are reported as they match.  Candidates of the other kinds are reported only if what they
    decode to has the structure of a key or a signed token.  Hex of a key may have upper-case digits, PEM may have
    its line ends escaped or be base64 as a whole.
    """
    found = []
    folded = text.encode().translate(FOLD_BYTES)
    if any(name in folded for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append((m.start(), 4, m.end()))
    for m in _DER_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and not HEX.fullmatch(m[0]) and is_der_key(bytes.fromhex(m[0])):
            found.append((m.start(), 4, m.end()))
    if "-----BEGIN " in text:
        found += [(start, 3, end) for start, end, body in pem_blocks(text) if is_pem_key(body)]
    if "LS0tLS1CRUdJTi" in text:
        found += [(m.start(), 3, m.start() + end) for m in _CODED_PEM.finditer(text) if (end := coded_pem_end(m[0]))]
    for m in _BASE64.finditer(text):
        if m[0][0] == "M":
            if (data := unbase64(m[0])) and is_der_key(data):
                found.append((m.start(), 4, m.end()))
        elif (data := unbase64(m[0])) and is_ssh_key(data):
            found.append((m.start(), 5, m.end()))
    found += [(m.start(), 6, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    base_sha256 is taken of the base findings as listed, spans lists all of them.  Null and empty texts have no
    findings and the digest of the empty list.  Rows with null or repeated doc_id are scanned as they are; an
    empty table gives no rows.  Nothing moves between partitions.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            counts, digests, lists = ([], [], []), [], []
            for t in batch.column(1).to_pylist():
                found = spans(t or "")
                base = [f for f in found if f[1] < 3]
                for k in range(3):
                    counts[k].append(sum(f[1] == k for f in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _masked(text: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The documents with every finding replaced by a mark (overlapping ones by one) and the length counted anew where
    the text changed.  All rows and columns stay; texts without findings, null and empty ones are not touched."""
    names = docs.columns
    at, count = names.index(text), names.index(n_chars) if n_chars in names else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            old = batch.column(at).to_pylist()
            new = [t and _masked(t, mark) for t in old]
            changed = [k for k, (a, b) in enumerate(zip(old, new)) if a is not b]
            if changed:
                columns = batch.columns
                columns[at] = pa.array(new, columns[at].type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    for k in changed:
                        sizes[k] = len(new[k])
                    columns[count] = pa.array(sizes, columns[count].type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch

    return docs.mapInArrow(run, docs.schema)
