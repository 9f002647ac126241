"""Secrets in texts: three kinds of single finding, and credentials in several parts.

Base kinds are found by their patterns in every whole text.  Besides them there
are *weak* parts, which alone mean nothing: an access identifier, a secret value
or an endpoint that a name before it announces, or that has the right form.  A
text is cut into scopes (stretches without an empty line, at most SCOPE code
points between neighbouring parts).  Within a scope parts are linked by an
interval join on their places: an identifier and a secret value, or an endpoint
and either of these, no further apart than REACH.  Parts that link with a part
of another role are reported, alone they are not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_key
from .textscan import ASCII_LOWER, slabs, tidied

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_WORDS = re.compile(rb"password|passwd|secret|token|api_?key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ("assign", "access", "hex")

#: Weak parts: role, pattern, group that is the part.
WEAK = (
    ("id", re.compile(rb"(?<![a-z0-9_])((?:client|app|account|access|user|tenant|aws)[_-]?(?:key[_-]?)?id|username|login|user)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([a-z0-9][a-z0-9_.@-]{3,}+)"), 2),
    ("value", re.compile(rb"(?<![a-z0-9_])((?:client|app|account|access|shared|private|auth|signing)[_-]?(?:key|pass|pwd|credential)|pwd|passphrase|credential|bearer|signature)[\"']?\x20{0,3}[:=\x20]\x20{0,3}[\"']?([a-z0-9+/_=-]{8,}+(?:\.[a-z0-9+/_=-]+)*+)"), 2),
    ("endpoint", re.compile(rb"(?<![a-z0-9_])((?:https?|ftp|amqp|redis|mongodb|postgres(?:ql)?|mysql|s3)://[a-z0-9._-]{3,}+|(?<![.-])[a-z0-9-]++(?:\.[a-z0-9-]++)*\.(?:amazonaws|azure|googleapis|database\.windows)\.[a-z]{2,3})"), 1),
)
#: What any weak part has; texts without it have none.
WEAK_SIGN = re.compile(rb"[:=]|bearer|passphrase|credential|signature|\.amazonaws|\.azure|\.googleapis|\.windows\.")
SCOPE = 400
REACH = 200

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def base_spans(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, in order."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(s, "hex", e) for s, e in runs(np.frombuffer(text, np.uint8), HEX_CHARS)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def runs(b: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of [0-9a-f] of at least so many bytes."""
    flag = np.diff(np.concatenate([[False], _HEX[b], [False]]).astype(np.int8))
    s, e = np.flatnonzero(flag == 1), np.flatnonzero(flag == -1)
    long = e - s >= least
    return list(zip(s[long].tolist(), e[long].tolist()))


def weak_parts(text: bytes) -> list[tuple[int, str, int]]:
    """(start, role, end) in bytes, in order; values and identifiers have a digit."""
    low = text.translate(ASCII_LOWER)
    out = []
    for role, pattern, group in WEAK:
        for m in pattern.finditer(low):
            part = m.group(group)
            if role != "value" or re.search(rb"[0-9]", part):
                out.append((m.start(group), role, m.end(group)))
    return sorted(out)


def scopes(text: bytes, parts: list[tuple[int, str, int]]) -> list[list[tuple[int, str, int]]]:
    """Parts in order, cut where an empty line or more than SCOPE bytes lie between neighbours."""
    out: list[list[tuple[int, str, int]]] = []
    for p in parts:
        if out and p[0] - out[-1][-1][2] <= SCOPE and b"\n\n" not in text[out[-1][-1][2] : p[0]]:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def linked(text: bytes, strong: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Weak parts with a complement within reach: (start, "pair-" + role, end).

    Base findings complement too: access stands for an identifier, the others for
    values.  Parts inside a base finding are that finding.
    """
    roles = {"access": "id", "assign": "value", "hex": "value"}
    begun = [s for s, _, _ in strong]
    furthest = list(accumulate((e for _, _, e in strong), max))
    weak = [w for w in weak_parts(text) if not ((k := bisect_right(begun, w[0])) and furthest[k - 1] >= w[2])]
    if not weak:
        return []
    both = sorted([(s, roles[k], e) for s, k, e in strong] + weak)
    new, out = set(weak), set()
    for scope in scopes(text, both):
        by = {r: [p for p in scope if p[1] == r] for r in ("id", "value", "endpoint")}
        starts = {r: [p[0] for p in ps] for r, ps in by.items()}
        ends = {r: np.maximum.accumulate([p[2] for p in ps]).tolist() for r, ps in by.items()}
        for s, role, e in scope:
            if (s, role, e) not in new:
                continue
            # Parts of the other roles that begin at most REACH after its end and end at most REACH before its start.
            for other in by:
                if other != role and bisect_left(ends[other], s - REACH) < bisect_right(starts[other], e + REACH):
                    out.add((s, f"pair-{role}", e))
    return sorted(out)


def points(text: bytes, places: list[int]) -> list[int]:
    """Code points before each of the given places in bytes."""
    if text.isascii():
        return places
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(starts)])
    return sums[places].tolist()


def in_points(text: bytes, spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    flat = points(text, [x for s, _, e in spans for x in (s, e)])
    return [(flat[2 * i], k, flat[2 * i + 1]) for i, (_, k, _) in enumerate(spans)]


def texts_with(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Numbers of a slab's texts that may have anything at all to report.

    A line feed, which no pattern has, is put between texts, so that no find goes
    on from one text into the next.
    """
    apart = np.insert(np.frombuffer(data, np.uint8), offsets[1:-1], 10)
    begin = offsets[:-1] + np.arange(len(offsets) - 1)
    data = apart.tobytes()
    low = data.translate(ASCII_LOWER)
    at = [m.start() for m in ASSIGN_WORDS.finditer(low)] + [m.start() for m in re.finditer(b"AKIA", data)]
    at += [s for s, _ in runs(apart, HEX_CHARS)]
    at += [m.start() for m in WEAK_SIGN.finditer(low)]
    return np.unique(np.searchsorted(begin, np.array(at, np.int64), "right") - 1)


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(batches):
    for batch in batches:
        for lo, hi, data, offsets in slabs(batch.column("text")):
            out: list[list[dict]] = [[] for _ in range(hi - lo)]
            for k in texts_with(data, offsets).tolist():
                text = data[offsets[k] : offsets[k + 1]]
                strong = base_spans(text)
                spans = strong + linked(text, strong)
                if spans:
                    out[k] = [{"kind": kind, "start": s, "end": e} for s, kind, e in in_points(text, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(out, SPAN_TYPE)], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs: base findings, then linked weak parts; code points, ends exclusive.

    Null texts are empty; other columns are not looked at; repeated rows repeat.
    """
    return with_key(docs).select("doc_id", "text").mapInArrow(tidied(_scanned), SPANS)


def counted(found: DataFrame, kinds: tuple[str, ...], by_start: bool) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans, from (doc_id, spans).

    In text form spans come by start and then kind, or by kind and then start;
    kinds that are not base come last, and a "+" that marks an added span of a
    base kind is left out.
    """
    order = F.array(*map(F.lit, kinds))

    def text(spans):
        plain = lambda s: F.rtrim(s["kind"], F.lit("+"))
        rank = lambda s: F.coalesce(F.nullif(F.array_position(order, plain(s)), F.lit(0)), F.lit(len(kinds) + 1))
        keyed = F.transform(spans, lambda s: F.struct(*((s["start"].alias("p"), rank(s).alias("q")) if by_start else (rank(s).alias("p"), s["start"].alias("q"))), s["end"].alias("e"), plain(s).alias("k"), s["start"].alias("s")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    base = F.filter("spans", lambda s: F.array_contains(order, s["kind"]))
    return found.withColumn("base", base).select("doc_id", *map(count, kinds), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """What query op4_secrets returns: a row a document.

    Null and empty texts have no spans; texts of any length are searched whole;
    repeated rows repeat, an empty table gives an empty one.
    """
    return counted(scan(docs), KINDS, by_start=True)


