"""Secret scan with structural confirmation of candidates."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import slices, texts

#: Fixed values of the contract; letters of the keywords in either case, ASCII only.
KINDS = ("assign", "access", "hex")
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Candidates of the structural step: dotted URL-safe base64 (signed tokens) and armoured or bare base64.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)KEY-----([A-Za-z0-9+/=\s]*)-----END \1KEY-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
#: Object identifiers that name a key algorithm in DER: RSA, elliptic curve, Ed25519.
KEY_OIDS = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01", b"\x2a\x86\x48\xce\x3d\x02\x01", b"\x2b\x65\x70")

SPAN = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's three kinds, leftmost and non-overlapping for each kind; short matches are dropped after matching."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the items that fill data exactly; None if a length doesn't fit."""
    at, out = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def key_encoding(data: bytes) -> str | None:
    """'der-key' or 'ssh-key' if data parses as one: every nested length fits and a key algorithm or key integers are there."""
    if data[:15] == b"openssh-key-v1\0":
        return "ssh-key"
    if data[:4] in (b"\0\0\0\x07", b"\0\0\0\x0b", b"\0\0\0\x13"):
        at, fields = 0, []
        while at + 4 <= len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            fields.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        return "ssh-key" if at == len(data) and len(fields) >= 2 and fields[0][:4] in (b"ssh-", b"ecds") else None
    if data[:1] != b"\x30" or (top := der_items(data)) is None or len(top) != 1:
        return None
    items = der_items(top[0][1])
    if not items:
        return None
    if len(items) >= 6 and all(t == 2 for t, _ in items):
        return "der-key"
    for tag, content in items[:2]:
        if tag == 0x30 and (inner := der_items(content)) and inner[0][0] == 6 and inner[0][1] in KEY_OIDS:
            return "der-key"
    return "der-key" if items[0] == (2, b"\1") and len(items) >= 2 and items[1][0] == 4 and len(items[1][1]) >= 20 else None


def unbase64(s: str, urlsafe: bool = False) -> bytes | None:
    s = "".join(s.split()).rstrip("=")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(header: str, payload: str) -> bool:
    """A JSON header with an algorithm and a JSON payload, both URL-safe base64."""
    try:
        head, body = (json.loads(unbase64(x, urlsafe=True) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def confirmed_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that structure confirms: signed tokens, armoured keys, bare base64 or hex that decodes to a key."""
    out = []
    if "." in text:
        out += [("signed-token", m.start(), m.end()) for m in TOKEN.finditer(text) if m[1].startswith("ey") and signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        out += [(kind, m.start(), m.end()) for m in ARMOUR.finditer(text) if (kind := key_encoding(unbase64(m[2]) or b""))]
    out += [(kind, m.start(), m.end()) for m in BASE64.finditer(text) if (data := unbase64(m[0])) and (kind := key_encoding(data))]
    for _, start, end in (s for s in base if s[0] == "hex"):
        if (end - start) % 2 == 0 and (kind := key_encoding(bytes.fromhex(text[start:end]))):
            out.append((kind, start, end))
    return sorted(set(out), key=lambda s: (s[1], s[0], s[2]))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add base_spans and spans (base plus confirmed) to every row; all columns of docs are kept.

    Offsets are code points, ends exclusive; base spans come by start, then kind as listed, and
    in `spans` confirmed kinds follow base kinds at the same start. Null and empty texts have no
    spans. Texts are scanned whole, row by row in Arrow batches, without any shuffle; repeated
    rows are scanned alike. The names base_spans and spans replace columns of docs so named.
    """
    docs = docs.drop("base_spans", "spans")
    schema = f"{docs._jdf.schema().toDDL()}, base_spans {SPAN}, spans {SPAN}" if docs.columns else None
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            own = texts(batch, text)
            base = [base_spans(t) for t in own]
            more = [confirmed_spans(t, b) for t, b in zip(own, base, strict=True)]
            order = {k: i for i, k in enumerate(KINDS)}
            both = [sorted(b + m, key=lambda s: (s[1], order.get(s[0], 9), s[0], s[2])) for b, m in zip(base, more, strict=True)]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in rows], kind) for rows in (base, both)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "base_spans", "spans"])

    return docs.mapInArrow(run, schema)


def span_text(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """Replace every span, overlapping ones together, by mark; rows and columns, whatever their names, stay as they are. Null text stays null."""
    found = scan_secrets(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text].alias("text")), "text")
    step = F.aggregate(
        F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("done"), s["end"].alias("at")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    clean = F.when(F.size("spans") > 0, step).otherwise(F.col("text"))
    return found.select(*((clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
