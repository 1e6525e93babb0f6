"""Secret scans: patterns find candidates, and their structure confirms them.

Base kinds (assign, access, hex) follow patterns alone. The method adds kinds that are reported only when their decoded
bytes parse: 'der' (base64 or hex of an ASN.1 SEQUENCE whose nested lengths fill it exactly, as key encodings do), 'ssh'
(base64 of an SSH public key blob or OpenSSH private key, read field by field), 'pem' (a private key armour whose body
is one of these) and 'jwt' (a signed token whose header and claims are JSON objects, with an algorithm and a signature).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import map_slices, table

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

#: Bytes of the shortest DER value that is taken for a key: an integer pair of a small elliptic-curve signature key has more.
LEAST_DER = 24

_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_PEM_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
# Where base64 of a key may begin: an ASN.1 SEQUENCE, an SSH key type, or the magic of an OpenSSH private key. What stands before is no letter or digit.
_BASE64_HEAD = re.compile(r"(?<![A-Za-z0-9])(?:M[A-I]|AAAA|b3BlbnNzaC1rZXktdjEA)(?=[A-Za-z0-9+/_-]{28})")
_RUN, _FOLD = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"(?:\r?\n[ \t]*|\\n)(?=[A-Za-z0-9+/_-])")
_HEX_ANY = re.compile(r"(?<![A-Za-z0-9])30(?:[0-9a-fA-F]{2}){%d,}(?![A-Za-z0-9])" % (LEAST_DER - 1))
_JWT_HEAD, _JWT_REST = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]*"), re.compile(r"\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_INSIDE = re.compile(r"(?<![A-Za-z0-9])eyJ")
_SSH_TYPE = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d+|sk-[a-z0-9@.-]+)")
_FIRST = (0x02, 0x30)  # tags that a key encoding may begin with inside
#: Bytes that the name of an SSH key type may have.
_SSH_LONGEST = 255
_SSH_MAGIC = b"openssh-key-v1\x00"
# Fields of an SSH public key after its type, by the beginning of the type.
_SSH_FIELDS = {b"ssh-rsa": 2, b"ssh-dss": 4, b"ssh-ed25519": 1, b"ecdsa-": 2, b"sk-ssh-ed25519": 2, b"sk-ecdsa-": 3}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds: leftmost non-overlapping per kind, then those too short are dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of hex digits is matched whole, so asking for its least length at once finds the same spans
    out += [(m.start(), m.end(), "hex") for m in _HEX_RUN.finditer(text)]
    return out


def unbase64(s: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = s.rstrip("=")
    if len(body) % 4 == 1 or (set("+/") & set(body) and set("-_") & set(body)):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_value(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the DER value at `at`, if its length has the shortest form and stays before `end`."""
    if end - at < 2:
        return None
    tag, n = b[at], b[at + 1]
    at += 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or end - at < size:
            return None
        n = int.from_bytes(b[at : at + size], "big")
        if n < 0x80 or (size > 1 and b[at] == 0):
            return None
        at += size
    return (tag, at, at + n) if at + n <= end and not (tag == 2 and n == 0) else None


class Values:
    """DER values of one buffer, each parsed once: end(at) is where the value at `at` ends if its nested values fill it exactly, else 0."""

    def __init__(self, b: bytes) -> None:
        self.b, self.ends, self.stops = b, {}, {}

    def end(self, at: int) -> int:
        todo = [(at, -1)]  # a place, and how far the values inside it have been followed
        while todo:
            here, inside = todo.pop()
            if here in self.ends:
                continue
            value = der_value(self.b, here, len(self.b))
            if value is None or not value[0] & 0x20:
                self.ends[here] = value[2] if value else 0
                continue
            _, start, last = value
            inside, seen = max(inside, start), []
            while inside < last:
                # a row of values that is known to break off before `last` is not followed again
                if self.stops.get(inside, last) < last:
                    inside = 0
                elif inside not in self.ends:
                    todo += [(here, inside), (inside, -1)]
                    break
                else:
                    seen.append(inside)
                    inside = self.ends[inside]
                if not inside:
                    stop = self.stops.get(seen[-1], seen[-1]) if seen else start
                    self.stops |= dict.fromkeys(seen, stop)
                    self.ends[here] = 0
                    break
            else:
                self.ends[here] = last if inside == last else 0
        return self.ends[at]


def der_size(values: Values, at: int = 0) -> int:
    """Bytes of the key encoding at `at`: one SEQUENCE whose nested values fill it exactly, an INTEGER or a SEQUENCE first; 0 if there is none."""
    b = values.b
    top = der_value(b, at, len(b)) if b[at : at + 1] == b"\x30" else None
    if top is None or top[2] - at < LEAST_DER or b[top[1]] not in _FIRST:
        return 0
    return max(values.end(at) - at, 0)


def der_key(b: bytes) -> bool:
    """Whether b is one key encoding, from its first byte to its last."""
    return bool(b) and der_size(Values(b)) == len(b)


def ssh_size(b: bytes, at: int = 0) -> int:
    """Bytes of an SSH public key blob or OpenSSH private key at `at`, read field by field without a copy of long ones; 0 if it is none."""

    def past(here: int) -> int:
        """Where the field at `here` ends, 0 if that is not in b."""
        end = here + 4 + int.from_bytes(b[here : here + 4], "big")
        return end if here and here + 4 <= len(b) and end <= len(b) else 0

    if b.startswith(_SSH_MAGIC, at):
        here = at + len(_SSH_MAGIC)
        for _ in range(3):  # cipher, key derivation and its options
            here = past(here)
        fields = 2 if here and b[here : here + 4] == b"\0\0\0\1" else 0  # a public key, then the private part
        here += 4
    else:
        size = int.from_bytes(b[at : at + 4], "big")
        kind = b[at + 4 : at + 4 + size] if size <= _SSH_LONGEST else b""
        fields = next((n for k, n in _SSH_FIELDS.items() if kind.startswith(k)), 0) if len(kind) == size and _SSH_TYPE.fullmatch(kind) else 0
        here = at + 4 + size
    for _ in range(fields):
        here = past(here)
    return here - at if fields and here else 0


def ssh_key(b: bytes) -> bool:
    """Whether b is one SSH public key blob or OpenSSH private key, from its first byte to its last."""
    return bool(b) and ssh_size(b) == len(b)


def _json_object(part: str) -> dict | None:
    raw = unbase64(part)
    try:
        got = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def pem_spans(text: str) -> list[tuple[int, int, str]]:
    """Private key armours: each end mark with the last begin mark of its label since the mark of an end before it."""
    out, open_ = [], {}
    for m in _PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            open_[m[2]] = m
        elif (begin := open_.get(m[2])) is not None:
            body = "".join(x for x in text[begin.end() : m.start()].replace("\\n", "\n").split("\n") if ":" not in x)
            b = unbase64(re.sub(r"\s+", "", body))
            if b and (der_key(b) or ssh_key(b)):
                out.append((begin.start(), m.end(), "pem"))
            open_ = {}
    return out


def object_at(s: str, at: int) -> tuple[dict, int] | None:
    """The JSON object at `at` and its end. Ever longer parts are read, so that what is no object costs no more than where it fails."""
    size, reader = 64, json.JSONDecoder()
    while True:
        part = s[at : at + size]
        try:
            got, end = reader.raw_decode(part)
            return (got, at + end) if isinstance(got, dict) else None
        except RecursionError:
            return None
        except json.JSONDecodeError as e:
            if at + size >= len(s) or not (e.msg.startswith(("Unterminated", "Invalid \\")) or e.pos > size - 8):
                return None
        size *= 4


def jwt_spans(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens. A head is looked for at every likely start of its run, which is decoded once for each of four alignments."""
    out = []
    for m in _JWT_HEAD.finditer(text):
        rest = _JWT_REST.match(text, m.end())
        if rest is None:
            continue
        decoded: dict[int, str] = {}
        for start in (x.start() for x in _INSIDE.finditer(m[0])):
            r = start % 4
            if r not in decoded:
                decoded[r] = (unbase64(m[0][r:]) or b"").decode("latin-1")
            head = object_at(decoded[r], (start - r) // 4 * 3)
            if head and head[1] == len(decoded[r]) and _json_object(m[0][start:]) is not None and isinstance(head[0].get("alg"), str):
                if _json_object(rest[1]) is not None and unbase64(rest[2]):
                    out.append((m.start() + start, rest.end(), "jwt"))
                break
    return out


class Flat:
    """Base64 of a text from one place up to where it ends, its folds taken out, decoded once for each of four alignments."""

    def __init__(self, text: str, at: int) -> None:
        self.starts, self.places, parts, n = [], [], [], 0
        while run := _RUN.match(text, at):
            self.starts.append(n)
            self.places.append(at)
            parts.append(run[0])
            n, at = n + len(run[0]), run.end()
            fold = _FOLD.match(text, at)
            if fold is None:
                break
            at = fold.end()
        self.chars, self.end, self._decoded = "".join(parts), at, {}

    def index(self, place: int) -> int:
        k = bisect_right(self.places, place) - 1
        return self.starts[k] + place - self.places[k]

    def place_after(self, index: int) -> int:
        """Where in the text the character before `index` ends."""
        k = bisect_right(self.starts, index - 1) - 1
        return self.places[k] + index - self.starts[k]

    def decoded(self, r: int) -> Values:
        if r not in self._decoded:
            body = self.chars[r:].replace("-", "+").replace("_", "/")
            body = body[: len(body) - (len(body) % 4 == 1)]
            self._decoded[r] = Values(base64.b64decode(body + "=" * (-len(body) % 4)))
        return self._decoded[r]


def base64_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64, on one line or folded, that begin after no letter or digit and end before none. Their own lengths say where.

    Nested lengths are followed up to the first that is wrong; bytes are decoded and values parsed once, however many heads claim them.
    """
    out, past, flat = [], 0, None
    for m in _BASE64_HEAD.finditer(text):
        at = m.start()
        if at < past:
            continue
        if flat is None or at >= flat.end:
            flat = Flat(text, at)
        i = flat.index(at)
        values, byte = flat.decoded(i % 4), i // 4 * 3
        kind, size = ("der", der_size(values, byte)) if m[0][0] == "M" else ("ssh", ssh_size(values.b, byte))
        if size:
            n = -(-size * 4 // 3)
            end, pads = flat.place_after(i + n), -n % 4
            while pads and text.startswith("=", end):
                end, pads = end + 1, pads - 1
            if (end == len(text) or not (text[end].isascii() and text[end].isalnum())) and unbase64(flat.chars[i : i + n]) is not None:
                out.append((at, end, kind))
                past = end
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded structure confirms a key or signed token."""
    out = pem_spans(text) if "-----BEGIN " in text else []
    if "eyJ" in text:
        out += jwt_spans(text)
    armours = [x for x in out if x[2] == "pem"]
    out += [x for x in base64_spans(text) if not any(a <= x[0] and x[1] <= b for a, b, _ in armours)]
    out += [(m.start(), m.end(), "der") for m in _HEX_ANY.finditer(text) if der_key(bytes.fromhex(m[0]))]
    return list(dict.fromkeys(out))


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed; offsets in code points, end exclusive."""
    text = text or ""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end) for every document; a null text is empty, ids may be null or repeat."""

    def work(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "spans": [[{"kind": k, "start": a, "end": b} for a, b, k in find(t)] for t in rows["text"]]}

    return map_slices(docs.select("doc_id", "text"), work, 'doc_id long, spans array<struct<kind:string,start:long,end:long>>')


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by `mark` (overlapping spans by one); other columns as they are, n_chars anew if there is one."""
    cols = [c for c in docs.columns if c != "n_chars"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def work(rows: dict) -> dict:
        texts = []
        for t in rows["text"]:
            merged: list[list[int]] = []
            for a, b, _ in find(t):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in reversed(merged):
                t = t[:a] + mark + t[b:]
            texts.append(t)
        out = {c: rows[c] for c in cols} | {"text": texts}
        if "n_chars" in rows:
            out["n_chars"] = [None if t is None else len(t) for t in texts]
        return out

    return map_slices(docs, work, schema)


def op2_secret_scan(spark, sf_dir):
    """Secrets of every whole text of documents: counts and a hash of the base kinds, and all spans. A null text is empty; null and repeated ids give a row each."""

    def work(rows: dict) -> dict:
        found = [find(t) for t in rows["text"]]
        out = {"doc_id": rows["doc_id"]}
        for kind in ("assign", "access", "hex"):
            out[f"n_{kind}"] = [sum(k == kind for _, _, k in f) for f in found]
        out["base_sha256"] = [hashlib.sha256(digest([x for x in f if x[2] in LEAST]).encode()).hexdigest() for f in found]
        out["spans"] = [digest(f) for f in found]
        return out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_slices(docs, work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
