"""Personal data: base patterns in whole texts, and more spans from a BiLSTM with a CRF.

The base kinds (email, ip, card, phone) are found by rule.  The network is
trained in numpy from labelled spans, made from templates with a fixed seed:
the kinds' usual forms and those that the rules miss (spelled-out signs in
addresses, phone numbers without a plus, other separators), and, without label,
what looks like them (versions, dates, prices, hexadecimal keys).

Every labelled form has a digit, an at sign or a bracket, so windows of text
around such characters are decoded and no others.  Windows overlap by half.  A
stretch's windows are reconciled globally: each character's tag scores are the
windows' scores, weighted by how far inside the window it lies, and one Viterbi
path runs over the whole stretch.  A span of the network is added if it
touches no base span and has what its kind cannot do without (signs, numbers, a
checksum).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .crf import BiLstmCrf
from .secret_scan import SPAN_TYPE, SPANS, counted, points
from .shared import with_key
from .textscan import slabs, tidied

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Digits before a match's first one would be part of it, so looking back changes no match.
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What every taught form has.
_SIGN = re.compile(r"[0-9@]|[\[(](?=[a-z.])")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")
_AT = re.compile(r"@|\bat\b", re.I | re.A)
_DOT = re.compile(r"\.|\bdot\b", re.I | re.A)

WINDOW = 64
#: Code points around a sign that are decoded with it.
AROUND = 32
#: Windows decoded at a time.
BATCH = 1024


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(b: bytes) -> str:
    return re.sub(rb"[^0-9]", b"", b).decode()


def emails(text: bytes):
    """An address begins as far left of its at sign as local characters go, but not within the address before."""
    free, at = 0, text.find(b"@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at) if s < at else None
        if m:
            yield s, m.end()
            free = m.end()
        at = text.find(b"@", max(at + 1, free))


def base_spans(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, by kind and start."""
    out = [(s, "email", e) for s, e in emails(text)]
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(x.lstrip(b"0")) <= 3 and int(x.lstrip(b"0") or b"0") <= 255 for x in m[0].split(b"."))]
    out += [(m.start(), "card", m.end()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the network -------------------------------------------------------------

SIGNS = "@.-_+()[]{}:;,/\\'\"#%&*=|<>!?$~ \n"
OTHER_LETTER, OTHER = 1, 0


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point below 256: other, other letter, digit, a-z, A-Z, signs."""
    table = np.full(256, OTHER, np.int64)
    table[192:] = OTHER_LETTER
    table[48:58] = 2
    table[97:123] = np.arange(3, 29)
    table[65:91] = np.arange(29, 55)
    for k, c in enumerate(SIGNS):
        table[ord(c)] = 55 + k
    return table


def encode(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 256, _symbols()[np.minimum(cp, 255)], OTHER_LETTER)


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Texts of WINDOW code points with their labelled spans."""
    r = np.random.default_rng(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ä ö ü ñ ción que eau sch ung".split()
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(str(int(x)) for x in r.integers(0, 10, k))

    def word(plain: bool = False) -> str:
        if r.random() < 0.4:
            w = "".join(pick("aabcdeeefghiijklmnoopqrsttuuvwxyz" if plain or r.random() < 0.7 else "aäbcdeéfghiíjklmnñoöpqrsßtuüvwxyz") for _ in range(int(r.integers(2, 11))))
        else:
            w = "".join(pick(syllables) for _ in range(int(r.integers(1, 5))))
        if plain:
            w = w.encode("ascii", "ignore").decode() or "x"
        return w.capitalize() if r.random() < 0.15 else w

    def card() -> str:
        d = pick("3456") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def email() -> str:
        at = pick(["@", "@", "@", " [at] ", " (at) ", "(at)", "[at]", " @ "])
        dot = "." if at == "@" else pick([".", ".", " [dot] ", " (dot) ", "(dot)", "[dot]"])
        local = pick(["", "", pick("abcdefghijklmnoprstw") + pick([".", "_", ""]), word(True) + pick([".", "_", "-"])]) + "".join(word(True) for _ in range(pick([1] * 9 + [6]))) + pick(["", "", "", num(2), "." + num(2), "_" + num(1)])
        host = pick(["mail", "web", "host", "post", word(True), word(True)]) + pick(["", "", num(1), "-" + word(True)]) + pick(["", "", dot + "example", dot + word(True)])
        return (local + at + host + dot + pick(["com", "org", "net", "de", "fr", "es", "edu", "info", "io"])).lower()

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"00{num(2)} {a} {b} {c}", f"+{num(2)}-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])

    def ip() -> str:
        x = [str(int(v)) for v in r.integers(0, 256, 4)]
        return pick([".", ".", "[.]", " . ", "(.)"]).join(x)

    def cards() -> str:
        c = card()
        return pick([c, *(sign.join(c[i : i + 4] for i in range(0, 16, 4)) for sign in " -./")])

    def plain() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(r.integers(8, 40))))
        return pick([
            f"Version {num(1)}.{num(1)}.", f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}.{num(2)}.20{num(2)}", f"${num(2)}.{num(2)}", hexes, f"password={hexes}", f"token = \"{hexes}\"", "AKIA" + num(4) + "QZ" + num(6),
            num(int(r.integers(1, 13))), f"({word()})", f"[{word()}]", f"v{num(1)}.{num(1)}.{num(1)}.{num(4)}", f"{num(1)}, {num(2)}, {num(2)} ({num(4)})", f"CC BY-NC {num(1)}.0.", f"@{word()} ", f"{word()}@@@ {word()}&&&", f"{num(5)} {num(3)}", f"[{num(1)}] {word()} ({num(4)})", f"http://{word()}.com/{num(5)}", f"{num(3)}:{num(2)}:{num(2)}",
        ])

    makers = {"email": email, "ip": ip, "card": cards, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(int(r.integers(0, 7)))), []
        while len(text) < WINDOW:
            text += pick([" ", " ", " ", ", ", ".\n", ": ", "\n"]) if text else ""
            kind = pick([*KINDS, "plain", "plain", "words", "words"])
            if kind in makers:
                s = makers[kind]()
                spans.append((len(text), kind, len(text) + len(s)))
            else:
                s = plain() if kind == "plain" else " ".join(word() for _ in range(int(r.integers(1, 6))))
            text += s
        cut = int(r.integers(0, len(text) - WINDOW + 1))
        spans = [(max(0, s - cut), k, min(WINDOW, e - cut)) for s, k, e in spans if s - cut < WINDOW and e > cut]
        out.append((text[cut : cut + WINDOW], spans))
    return out


def tags_of(spans: list[tuple[int, str, int]]) -> np.ndarray:
    """0: outside; 1 + 2 k: begin of kind k; 2 + 2 k: inside it."""
    t = np.zeros(WINDOW, np.int64)
    for s, k, e in spans:
        t[s:e] = 2 + 2 * KINDS.index(k)
        t[s] = 1 + 2 * KINDS.index(k)
    return t


@lru_cache(1)
def trained(n: int = 6000, epochs: int = 12) -> BiLstmCrf:
    """The network, from n examples; the same at every call."""
    made = examples(n, 3)
    model = BiLstmCrf(55 + len(SIGNS), 1 + 2 * len(KINDS))
    model.fit(np.stack([encode(t) for t, _ in made]), np.stack([tags_of(s) for _, s in made]), epochs, batch=64, rate=0.02)
    return model


def stretches(text: str) -> list[tuple[int, int]]:
    """Where texts have a digit, an at sign or an opening bracket before a small letter or full stop, with AROUND code points on both sides and what is left of the words there.

    Every taught form has one of these, and what of it lies further away is one word with what lies near.
    """
    out: list[list[int]] = []
    for m in _SIGN.finditer(text):
        if out and m.end() + AROUND <= out[-1][1]:
            continue
        s, e = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and s <= out[-1][1]:
            s = out.pop()[0]
        elif s and not text[s].isspace():
            # Words end at ASCII white space; what the last stretch has need not be looked at again.
            s = max((text.rfind(c, out[-1][1] if out else 0, s) for c in " \t\n\r\x0b\x0c"), default=-1) + 1 or (out.pop()[0] if out else 0)
        found = _SPACE.search(text, e)
        out.append([s, found.start() if found else len(text)])
    return [(s, e) for s, e in out]


def emissions(model: BiLstmCrf, pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Tag scores of whole pieces, from windows that overlap by half."""
    step, where, windows = WINDOW // 2, [], []
    for k, ids in enumerate(pieces):
        for s in range(0, max(1, len(ids) - step), step):
            w = ids[s : s + WINDOW]
            where.append((k, s, len(w)))
            windows.append(np.pad(w, (0, WINDOW - len(w)), constant_values=55 + SIGNS.index(" ")))
    inside = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    sums = [np.zeros((len(p), 1 + 2 * len(KINDS)), np.float32) for p in pieces]
    weights = [np.zeros((len(p), 1), np.float32) for p in pieces]
    for lo in range(0, len(windows), BATCH):
        e = model.emissions(np.stack(windows[lo : lo + BATCH]))
        for (k, s, n), x in zip(where[lo : lo + BATCH], e):
            sums[k][s : s + n] += x[:n] * inside[:n, None]
            weights[k][s : s + n] += inside[:n, None]
    return [s / w for s, w in zip(sums, weights)]


def spans_of(tags: np.ndarray) -> list[tuple[int, str, int]]:
    out: list[tuple[int, str, int]] = []
    for k, t in enumerate(tags.tolist()):
        if t == 0:
            continue
        kind = KINDS[(t - 1) // 2]
        if t % 2 == 0 and out and out[-1][2] == k and out[-1][1] == kind:
            out[-1] = (out[-1][0], kind, k + 1)
        else:
            out.append((k, kind, k + 1))
    return out


def plausible(kind: str, s: str) -> bool:
    """Whether a span of the network has what its kind cannot do without: signs, numbers, a checksum. Its form is the network's matter."""
    if s != s.strip() or "\n" in s:
        return False
    numbers = re.findall("[0-9]+", s)
    digits = sum(map(len, numbers))
    if kind == "email":
        at = _AT.search(s, 1)
        return bool(at and _DOT.search(s, at.end()))
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 13 <= digits <= 19 and luhn("".join(numbers))
    return 10 <= digits <= 15


def free_of(spans: list[tuple[int, str, int]]):
    """Whether a stretch touches none of the spans."""
    whole: list[list[int]] = []
    for s, _, e in sorted(spans):
        if whole and s <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], e)
        else:
            whole.append([s, e])
    begins = [s for s, _ in whole]

    def free(s: int, e: int) -> bool:
        k = bisect_left(begins, e)
        return not k or whole[k - 1][1] <= s

    return free


def model_spans(model: BiLstmCrf, texts: list[str], base: list[list[tuple[int, str, int]]]) -> list[list[tuple[int, str, int]]]:
    """For each text the spans that the network adds to the base ones, in code points."""
    pieces, where = [], []
    for k, text in enumerate(texts):
        for s, e in stretches(text):
            pieces.append(encode(text[s:e]))
            where.append((k, s))
    out: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    free = list(map(free_of, base))
    for (k, at), e in zip(where, emissions(model, pieces)):
        for s, kind, end in spans_of(model.viterbi(e)):
            s, end = s + at, end + at
            if plausible(kind, texts[k][s:end]) and free[k](s, end):
                out[k].append((s, kind, end))
    return out


def _scanned(shared):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slabs(batch.column("text")):
                b = np.frombuffer(data, np.uint8)
                sign = ((b >= 48) & (b <= 57)) | (b == 64) | (b == 40) | (b == 91)
                rows = np.unique(np.searchsorted(offsets, np.flatnonzero(sign), "right") - 1).tolist()
                texts, base = [], []
                for k in rows:
                    text = data[offsets[k] : offsets[k + 1]]
                    found = base_spans(text)
                    flat = points(text, [x for s, _, e in found for x in (s, e)])
                    texts.append(text.decode("utf-8", "surrogateescape"))
                    base.append([(flat[2 * i], kind, flat[2 * i + 1]) for i, (_, kind, _) in enumerate(found)])
                out: list[list[dict]] = [[] for _ in range(hi - lo)]
                for k, mine, more in zip(rows, base, model_spans(shared.value, texts, base)):
                    out[k] = [{"kind": kind, "start": s, "end": e} for s, kind, e in mine] + [{"kind": f"{kind}+", "start": s, "end": e} for s, kind, e in more]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(out, SPAN_TYPE)], ["doc_id", "spans"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs: base spans, then the network's; code points, ends exclusive.

    The network's spans have a kind that ends in "+" (in text form the plain kind).  Null texts are empty;
    other columns are not looked at; repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    return with_key(docs).select("doc_id", "text").mapInArrow(tidied(_scanned(shared)), SPANS)


def digest(docs: DataFrame) -> DataFrame:
    """What query op1_pii returns: a row for every row of docs.

    Null and empty texts have no spans; texts of any length are searched whole;
    repeated rows repeat, an empty table gives an empty one.
    """
    return counted(scan(docs), KINDS, by_start=False)
