"""Personal data (operator 2): base patterns, and spans that a semi-Markov conditional random field adds.

The base patterns are fixed. The field looks at stretches around what they left over (digits, ``@``, a spelt-out "dot"). It
cuts a stretch into segments: single tokens of no kind, or whole spans of one kind, scored by features of the span as a whole
(digit groups, check sums, separators, the words before it) and by the kinds of neighbours. Dynamic programming over segments
of bounded length finds the best cut, so boundaries and kinds are chosen jointly. Base spans are kept as they are and stretches
end at them. The weights are learnt here by gradient ascent on the likelihood of generated, labelled stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, map_rows, read_table

KINDS = ("email", "ip", "card", "phone")

# --- base patterns: leftmost, not overlapping within a kind; matches that fail their test are dropped without another try.
# Written so that no text takes more than linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _octets(span: str) -> bool:
    return all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for part in span.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind and then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if any(map(text.__contains__, "0123456789")):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# --- the field
#: Tokens in a span, signs around an anchor.
MOST_TOKENS, AROUND = 24, 48
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_SAID_AT = r"[\[({<]\s{0,3}[Aa][Tt]\s{0,3}[\])}>]|(?<=\w)\s{1,3}[Aa][Tt]\s{1,3}[\w-]{1,64}\.[A-Za-z]"
_ANCHOR = re.compile(rf"(?<![0-9])[0-9]|@|\b[Dd][Oo][Tt]\b|{_SAID_AT}")
#: What every candidate has: seven digits near each other, four short groups with dots between, or a sign or word of an address.
_GATE = re.compile(rf"[0-9](?:[^0-9\n]{{0,3}}[0-9]){{6}}|[0-9]{{1,3}}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{{1,3}}){{3}}|@|\b[Dd][Oo][Tt]\b|{_SAID_AT}")
_CUES = {
    "phone": frozenset("phone tel telephone call mobile cell fax telefon tél teléfono móvil whatsapp sms number dial".split()),
    "email": frozenset("email mail e contact write address correo courriel".split()),
    "ip": frozenset("ip host server addr gateway subnet".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta pan".split()),
    "other": frozenset("isbn issn doi version v id order invoice no nr ref page token key sha commit hash date year build serial model tracking article".split()),
}
_AT = re.compile(r"@|[\[({<]\s*at\s*[\])}>]|\s+at\s+", re.I)
_DOT = re.compile(r"[\[({<]\s*dot\s*[\])}>]|\s+dot\s+", re.I)
_ADDRESS = re.compile(r"[\w.%+-]+(?:\s*@\s*|\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+)[\w-]+(?:(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)[\w-]+)*(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)[A-Za-z]{2,10}", re.I)
_NANP = re.compile(r"(?:1[ .-]?)?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}")
_TRUNK = re.compile(r"\(?(?:0|00)\d{1,5}\)?(?:[ ./-]\d{2,8}){1,5}")
_DOTTED = re.compile(r"\d{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\s+dot\s+)\s?\d{1,3}){3}", re.I)
_DATE = re.compile(r"(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d")


def features(text: str, start: int, end: int, cue: frozenset[str]) -> list[int]:
    """Numbers of the binary features that hold for a span."""
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    n = len(digits)
    letters = sum(c.isalpha() for c in span)
    seps = {c for c in span if not c.isalnum()}
    before, after = text[start - 1 : start], text[end : end + 1]
    address = _ADDRESS.fullmatch(span) is not None
    said = _DOT.search(span) is not None or _AT.search(span) is not None
    found = (
        True, n == 0, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 16, 17 <= n <= 19, n > 19, 0 < n < 7,
        address, address and said, address and "@" in span, address and span[-1:].isalpha() and span.rpartition(".")[2][:1].islower(),
        _NANP.fullmatch(span) is not None, _TRUNK.fullmatch(span) is not None, _DOTTED.fullmatch(span) is not None and all(len(g) < 4 and int(g) < 256 for g in groups), _DATE.fullmatch(span) is not None,
        13 <= n <= 19 and luhn(digits), 13 <= n <= 19 and not luhn(digits), len(groups) == 4 and all(len(g) == 4 for g in groups), len(groups) == 1, len(groups) > 6,
        span[:1] == "+", span[:1] == "(", letters > 0 and n > 0 and not address, letters == 0 and n > 0, len(seps) <= 1, len(seps) > 2, "/" in seps, "." in seps and letters == 0,
        *(bool(cue & _CUES[k]) for k in (*KINDS, "other")),
        before.isalnum() or before in ("_", "-", "."), after.isalnum() or after in ("_", "@") or after in (".", "-", ",") and text[end + 1 : end + 2].isdigit(),
        span[:1].isspace() or span[-1:].isspace() or not (span[-1:].isalnum()), not (span[:1].isalnum() or span[:1] in ("+", "(")),
        len(span) > 40, "\n" in span,
    )
    return [i for i, x in enumerate(found) if x]


N_FEATURES = 40


def _candidates(text: str, ends: list[int], i: int) -> Iterator[tuple[int, list[int]]]:
    """``(j, features)`` of the segments from token ``i`` up to token ``j`` that may be a span; ``ends`` are the tokens' ends."""
    a = ends[i]
    if not (text[a].isalnum() or text[a] in "+(") or i and text[a].isdigit() and text[a - 1].isalpha():
        return
    cue = None
    for j in range(i + 1, min(i + MOST_TOKENS, len(ends) - 1) + 1):
        b = ends[j]
        if not text[b - 1].isalnum() or "\n" in text[ends[j - 1] : b]:
            continue
        span = text[a:b]
        n = sum(c.isdigit() for c in span)
        mail = _ADDRESS.fullmatch(span) is not None
        if mail or n >= 7 and sum(c.isalpha() for c in span) <= 9 or _DOTTED.fullmatch(span):
            if cue is None:
                cue = frozenset(w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, a - 32) : a])[-3:])
            yield j, features(text, a, b, cue)


class Stretch:
    """The tokens of a stretch and the candidate segments that end at each, with their features."""

    def __init__(self, text: str, start: int, end: int):
        self.ends = _token_ends(text, start, end)
        self.spans: list[list[tuple[int, list[int]]]] = [[] for _ in self.ends]
        for i in range(len(self.ends) - 1):
            for j, found in _candidates(text, self.ends, i):
                self.spans[j].append((i, found))


def _token_ends(text: str, start: int, end: int) -> list[int]:
    return [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]


class SpanField:
    """Weights of span features by kind and of neighbouring kinds (0 is a token of no kind), with inference."""

    def __init__(self):
        self.weights = np.zeros((len(KINDS), N_FEATURES))
        self.next = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _scores(self, stretch: Stretch) -> list[list[tuple[int, list[int], np.ndarray]]]:
        return [[(i, f, self.weights[:, f].sum(axis=1)) for i, f in at] for at in stretch.spans]

    def best(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """The spans of the best segmentation; at a tie, the fewest spans.

        Candidates are made as the tokens come and live no longer than the longest span, so memory is a few numbers a token.
        """
        ends = _token_ends(text, start, end)
        n, size = len(ends) - 1, len(KINDS) + 1
        top = np.full((n + 1, size), -np.inf)
        top[0, 0] = 0
        came_from = np.zeros((n + 1, size, 2), np.int32)
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
        plain = True
        for j in range(n + 1):
            if j and plain and j not in waiting:  # no span so far
                top[j, 0], came_from[j, 0] = top[j - 1, 0] + self.next[0, 0], (j - 1, 0)
            elif j:
                plain = False
                came = top[j - 1] + self.next[:, 0]
                k = int(np.argmax(came))
                top[j, 0], came_from[j, 0] = came[k], (j - 1, k)
                for i, s in waiting.pop(j, ()):
                    came = top[i][:, None] + self.next[:, 1:] + s[None, :]
                    for kind in range(1, size):
                        k = int(np.argmax(came[:, kind - 1]))
                        if came[k, kind - 1] > top[j, kind]:
                            top[j, kind], came_from[j, kind] = came[k, kind - 1], (i, k)
            if j < n:
                for e, found in _candidates(text, ends, j):
                    waiting.setdefault(e, []).append((j, self.weights[:, found].sum(axis=1)))
        if plain:
            return []
        out, j, kind = [], n, int(np.argmax(top[n]))
        while j > 0:
            i, before = came_from[j, kind].tolist()
            if kind:
                out.append((KINDS[kind - 1], ends[i], ends[j]))
            j, kind = i, before
        return out[::-1]

    def _gradient(self, stretch: Stretch, gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: what the labelled segmentation has less what is expected, by forward and backward sums."""
        n, size = len(stretch.ends) - 1, len(KINDS) + 1
        scores = self._scores(stretch)
        fore = np.full((n + 1, size), -np.inf)
        fore[0, 0] = 0
        for j in range(1, n + 1):
            fore[j, 0] = np.logaddexp.reduce(fore[j - 1] + self.next[:, 0])
            for i, _, s in scores[j]:
                fore[j, 1:] = np.logaddexp(fore[j, 1:], np.logaddexp.reduce(fore[i][:, None] + self.next[:, 1:], axis=0) + s)
        rear = np.full((n + 1, size), -np.inf)
        rear[n] = 0
        total = np.logaddexp.reduce(fore[n])
        dw, dn = np.zeros_like(self.weights), np.zeros_like(self.next)
        by_start: list[list[tuple[int, list[int], np.ndarray]]] = [[] for _ in range(n + 1)]
        for j in range(n + 1):
            for i, f, s in scores[j]:
                by_start[i].append((j, f, s))
        for i in range(n - 1, -1, -1):
            rear[i] = self.next[:, 0] + rear[i + 1, 0]
            dn[:, 0] -= np.exp(fore[i] + self.next[:, 0] + rear[i + 1, 0] - total)
            for j, f, s in by_start[i]:
                path = self.next[:, 1:] + (s + rear[j, 1:])[None, :]
                rear[i] = np.logaddexp(rear[i], np.logaddexp.reduce(path, axis=1))
                share = np.exp(fore[i][:, None] + path - total)
                dn[:, 1:] -= share
                dw[:, f] -= share.sum(axis=0)[:, None]
        at, kind = 0, 0
        chosen = {i: (j, k) for i, j, k in gold}
        where = {(i, j): f for j in range(n + 1) for i, f, _ in scores[j]}
        while at < n:
            j, k = chosen.get(at, (at + 1, 0))
            dn[kind, k] += 1
            if k:
                dw[k - 1, where[at, j]] += 1
            at, kind = j, k
        return dw, dn

    def learn(self, samples: list[tuple[str, list[tuple[str, int, int]]]], *, rounds: int = 12, rate: float = 0.5, decay: float = 1e-3) -> SpanField:
        """Stochastic gradient ascent over ``(stretch, spans)``; spans that are no candidate are left out."""
        ready = []
        for text, spans in samples:
            stretch = Stretch(text, 0, len(text))
            index = {e: k for k, e in enumerate(stretch.ends)}
            known = {(i, j) for j, at in enumerate(stretch.spans) for i, _ in at}
            gold = {(index[s], index[e], KINDS.index(k) + 1) for k, s, e in spans if s in index and e in index}
            ready.append((stretch, {g for g in gold if g[:2] in known}))
        random = np.random.default_rng(7)
        for r in range(rounds):
            for k in random.permutation(len(ready)):
                dw, dn = self._gradient(*ready[k])
                step = rate / (1 + r)
                self.weights += step * (dw - decay * self.weights)
                self.next += step * (dn - decay * self.next)
        return self


def training_samples(n: int = 360, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled stretches made from rules: what the base patterns miss, and look-alikes without a label."""
    r = np.random.default_rng(seed)
    one = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    letters = lambda a, b: "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(a, b))))
    word = lambda: letters(2, 9)

    def card() -> str:
        d = str(r.integers(3, 7)) + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return one([" . ", ".", "/", "_"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = one([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), ("@", " dot "), (" [at] ", ".")])
        return word() + one(["", ".", "_"]) + word() + at + word() + dot + one(["com", "org", "net", "de", "fr", "es", "example"])

    def phone() -> str:
        a, b, c = str(r.integers(2, 10)) + num(2), str(r.integers(2, 10)) + num(2), num(4)
        return one([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(7)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0049 {num(3)} {num(7)}"])

    def ip() -> str:
        return one(["[.]", "(.)", " . ", " dot "]).join(str(int(x)) for x in r.integers(1, 256, 4))

    def other() -> str:
        return one([
            f"{r.integers(1900, 2030)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"v{num(1)}.{num(2)}.{num(1)}", num(int(r.integers(7, 24))),
            "".join("0123456789abcdef"[c] for c in r.integers(0, 16, 40)), f"{num(3)},{num(3)},{num(3)}", f"10.{num(4)}/{word()}.{num(4)}.{num(5)}", f"{word()} dot {word()}", f"{word()} at {word()}", f"{num(4)} {num(4)} {num(4)} {num(3)}",
            f"{num(1)}.{num(4)} {num(1)}.{num(4)}", f"{num(8)}-{num(4)}", f"{word()}@{word()}", f"{num(5)} {num(6)}",
        ])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    cues = {"email": ["email", "mail", "contact", "write to"], "ip": ["ip", "host", "server"], "card": ["card", "visa", "credit card"], "phone": ["phone", "tel", "call", "fax"]}
    out = []
    for i in range(n):
        text, spans = " ".join(word() for _ in range(int(r.integers(1, 4)))), []
        for _ in range(1 + int(r.integers(0, 2))):
            kind = one([*KINDS, None, None]) if i % 3 else None
            if kind:
                text += " " + (one(cues[kind]) + one([" ", ": "]) if r.random() < 0.6 else word() + " ")
                item = makers[kind]()
                spans.append((kind, len(text), len(text) + len(item)))
            else:
                text += " " + (one(["isbn", "order", "id", "ref", "token =", "version", word()])) + " "
                item = other()
            text += item + one([" ", ", ", ". "]) + " ".join(word() for _ in range(int(r.integers(1, 3))))
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained() -> SpanField:
    return SpanField().learn(training_samples())


def _stretches(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches around anchors that no base span covers; they never overlap one, nor each other."""
    taken = sorted((s, e) for _, s, e in base)
    open_at = k = 0
    last = None
    anchors = [m.start() for m in _ANCHOR.finditer(text)]
    for a in anchors:
        while k < len(taken) and taken[k][1] <= a:
            open_at = max(open_at, taken[k][1])
            k += 1
        if k < len(taken) and taken[k][0] <= a:
            continue
        start, end = max(open_at, a - AROUND), min(len(text), a + AROUND, taken[k][0] if k < len(taken) else len(text))
        while start > open_at and text[start].isalnum() and text[start - 1].isalnum() and a - start < 2 * AROUND:
            start -= 1
        while end < len(text) and (k == len(taken) or end < taken[k][0]) and text[end - 1].isalnum() and text[end].isalnum() and end - a < 2 * AROUND:
            end += 1
        if last and start <= last[1]:
            last = (last[0], max(last[1], end))
        else:
            if last:
                yield last
            last = (start, end) if start < end else None
    if last:
        yield last


def all_spans(text: str, field: SpanField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """``(base spans, base and added spans)``, each by kind and then start."""
    base = base_spans(text)
    more = []
    for start, end in _stretches(text, base):
        if _GATE.search(text, start, end):
            more += field.best(text, start, end)
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if more else base


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans``: arrays of ``(kind, start, end)`` in code points; ``spans`` holds the base spans and the added ones.

    Null and empty texts have none; each row is judged alone, so repeated rows give equal results; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    field = trained()
    kind = "array<struct<kind: string, start: int, end: int>>"

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in it:
            base, spans = all_spans(text or "", field)
            yield key, *([{"kind": k, "start": s, "end": e} for k, s, e in x] for x in (base, spans))

    return map_rows(columns(docs, id_col, text_col), rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, base {kind}, spans {kind}")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, hash of the base spans and all spans of each row of ``documents``; null and empty texts have none."""
    found = find_pii(read_table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
