"""Secret scans (operator 6): candidate strings, and a random forest that removes false positives.

Candidates are long unbroken strings of letters and digits, or the value after a word such as "password" and a sign. Features
are length, kinds of signs and the transitions between them, how likely the sequence of letters is in plain words, how much of
it a dictionary covers, path signs, and the words next to it. The forest is grown here from labelled findings: generated
ones, or a bounded sample of a table of findings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, map_rows, read_table

#: Trees and their depth, least score of a secret, labelled findings used at most, signs looked at on either side.
TREES, DEPTH, LEAST_SCORE, SAMPLE, NEAR = 25, 8, 0.5, 5_000, 48

_LONG = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])[A-Za-z0-9+/=_-]{16,}+")
_NAMED = re.compile(r"""(?i)(?:key|token|secret|passw(?:or)?d|pwd|credential)["']?\s{0,3}(?:[:=]|=>|:=)\s{0,3}["']?([^\s"'<>,;]{6,}+)""")
# Words of code, paths and plain text; longer runs of letters made of them are no secrets.
_DICTIONARY = (
    "access account action address admin alpha api app array asset auth author back base beta block body book branch build button cache call change check child "
    "class click client code color common config content control copy count create data date default delete demo design detail device dev dir doc document edit "
    "element email entry error event example export feature field file filter form from front function get global group handle hash head header help home host "
    "html http https icon image import index info init input instance item job json key label lang layout lib license line link list load local log login main "
    "manager master media menu message meta method mock mode model module name nav new node note null number object option order output page param parent part "
    "path pattern picture place plugin post prefix print process product profile project public query random read record release remove report request reset "
    "resource response result role root route row rule run sample save schema script search section select send server service session set setup show size source "
    "stage start state static status step store string style sub table tag target task temp template test text theme time title token tool track type update url "
    "user util value version view web widget window word work write the and for with that this are was have not you all can will one our out use"
).split()
_CUES = frozenset("key token secret password passwd pwd auth bearer credential credentials apikey private access".split())
_DOUBTS = frozenset("example sample test dummy fake placeholder changeme xxx hash sha sha1 sha256 md5 commit checksum digest etag uuid guid id revision blob integrity fingerprint".split())
_EXTENSIONS = re.compile(r"(?i)(?:/|\.(?:png|jpg|jpeg|gif|svg|js|css|html|php|py|java|json|xml|txt|md|pdf|zip|gz|woff2?)$)")
_HEX, _UUID = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)


@lru_cache(maxsize=1)
def _letter_pairs() -> dict[str, float]:
    """Log shares of pairs of letters in plain words."""
    pairs = Counter(w[i : i + 2] for w in _DICTIONARY for i in range(len(w) - 1))
    total = sum(pairs.values()) + 676
    return {a + b: math.log((pairs[a + b] + 1) / total * 676) for a in map(chr, range(97, 123)) for b in map(chr, range(97, 123))}


@lru_cache(maxsize=1)
def _words() -> re.Pattern:
    return re.compile("|".join(sorted((w for w in _DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str) -> list[float]:
    """Numbers for the forest: the candidate itself, then what stands next to it."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    low = value.lower()
    counts = Counter(value)
    pairs = [_letter_pairs()[p] for i in range(n - 1) if (p := low[i : i + 2]) in _letter_pairs()]
    near = re.findall(r"[a-z0-9]+", before.lower())[-4:] + re.findall(r"[a-z0-9]+", after.lower())[:2]
    parts = [p for w in near for p in (w, *re.split(r"_|-", w))]
    return [
        n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        *(kinds.count(k) / n for k in range(4)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        len(counts) / n,
        max((len(m[0]) for m in re.finditer(r"(.)\1*", value)), default=0),
        sum(pairs) / len(pairs) if pairs else 0.0,
        sum(len(m[0]) for m in _words().finditer(low)) / n,
        float(_HEX.fullmatch(value) is not None),
        float(_UUID.fullmatch(value) is not None),
        float(value.isdigit()),
        value.count("/") + value.count("\\"),
        float(_EXTENSIONS.search(value) is not None),
        float(before[-1:] in ("/", "\\", ".", "#") or after[:1] in ("/", "\\")),
        float(re.search(r"[=:]\s*[\"']?$", before) is not None),
        float(before[-1:] in ('"', "'") and after[:1] in ('"', "'")),
        float(sum(w in _CUES for w in parts)),
        float(sum(w in _DOUBTS for w in parts) + sum(d in low for d in ("example", "changeme", "xxxx", "dummy", "1234567", "abcdef"))),
    ]


class Forest:
    """Trees of axis-parallel splits; each grown on a bootstrap sample with a random choice of features at each split."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def grow(cls, x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
        random = np.random.default_rng(seed)
        return cls([cls._tree(x, y, random.integers(0, len(y), len(y)), depth, random) for _ in range(trees)])

    @staticmethod
    def _tree(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, random: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def add(rows: np.ndarray, left: int) -> int:
            at, mean = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, mean])
            if left and 0 < mean < 1 and len(rows) >= 4:
                best = (0.0, -1, 0.0)
                for f in random.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    values, ones = x[order, f], np.cumsum(y[order])
                    cut = np.flatnonzero(values[1:] > values[:-1]) + 1
                    if len(cut):
                        a, b = ones[cut - 1], ones[-1] - ones[cut - 1]
                        n, m = cut, len(order) - cut
                        impure = (2 * a * (1 - a / n) + 2 * b * (1 - b / m)) / len(order)
                        gain = 2 * mean * (1 - mean) - impure
                        k = int(np.argmax(gain))
                        if gain[k] > best[0] + 1e-12:
                            best = (float(gain[k]), int(f), float((values[cut[k]] + values[cut[k] - 1]) / 2))
                if best[1] >= 0:
                    low = x[rows, best[1]] <= best[2]
                    nodes[at][:2] = best[1], best[2]
                    nodes[at][2] = add(rows[low], left - 1)
                    nodes[at][3] = add(rows[~low], left - 1)
            return at

        add(rows, depth)
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees' leaves."""
        total = np.zeros(len(x))
        for feature, cut, low, high, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                to = np.where(x[np.arange(len(x)), f] <= cut[at], low[at], high[at])
                at = np.where(inner, to, at)
            total += share[at]
        return total / len(self.trees)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be secrets, in order; those that overlap are one."""
    spans = [m.span() for m in _LONG.finditer(text)]
    spans += [m.span(1) for m in _NAMED.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
        elif e > out[-1][1]:
            out[-1] = (out[-1][0], e)
    return out


def describe(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    return np.array([features(text[s:e], text[max(0, s - NEAR) : s], text[e : e + NEAR]) for s, e in spans])


def labelled_findings(n: int = 2400, seed: int = 3) -> list[tuple[str, str, str, int]]:
    """``(value, before, after, is secret)`` made from rules, in the manner of reviewed reports."""
    r = np.random.default_rng(seed)
    one = lambda xs: xs[int(r.integers(len(xs)))]
    signs = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))
    az, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    prose = lambda: " ".join(one(_DICTIONARY) if r.random() < 0.5 else signs(az, int(r.integers(2, 9))) for _ in range(4))

    def secret() -> tuple[str, str, str]:
        value = one([
            lambda: signs(num + "abcdef", one([32, 40, 64])), lambda: signs(az + up + num, int(r.integers(20, 65))), lambda: signs(az + up + num + "+/", 40), lambda: signs(up + num, 20),
            lambda: signs(az + num, int(r.integers(16, 40))), lambda: signs(az + up + num + "-_", 43), lambda: one(["pk_", "sk_", "tok-", "key_"]) + signs(az + up + num, 32), lambda: signs(az + up + num + "!$%&*", int(r.integers(8, 20))),
        ])()
        name = one(["token", "key", "api_key", "secret", "password", "auth_token", "access_key", "private key", "bearer", "credential"])
        before, after = one([(f'{name} = "', '"'), (f"{name}: ", " "), (f"{name}='", "'"), (f"{name} ", " "), (f'"{name}": "', '",')])
        return value, prose() + " " + before, after + " " + prose()

    def other() -> tuple[str, str, str]:
        words = lambda sep, k: sep.join(one(_DICTIONARY) for _ in range(k))
        value, names = one([
            lambda: (signs(num + "abcdef", one([32, 40, 64])), ["sha256", "md5", "commit", "checksum", "digest", "etag", "revision"]), lambda: (words("_", 4) + signs(num, 2), [""]), lambda: (words("/", 4) + "/" + signs(num, 3), ["path", "url", "see", ""]),
            lambda: ("-".join(signs(num + "abcdef", k) for k in (8, 4, 4, 4, 12)), ["id", "uuid", "guid"]), lambda: (signs(num, int(r.integers(16, 24))), ["", "number", "order", "id"]), lambda: (words("-", 5) + "-" + signs(num, 4), ["", "slug", "key", "token"]),
            lambda: (one(["example", "your-", "dummy", "test", "xxxx", "changeme"]) + one(["token", "key", "secret", "xxxxxxxx", "password"]) + signs(num, 3), ["key", "token", "secret", "password"]), lambda: ("".join(w.title() for w in words(" ", 4).split()) + signs(num, 1), ["", "key", "class"]),
            lambda: (one("=-_+") * int(r.integers(16, 60)) + signs(num, 1), [""]), lambda: (signs(az, int(r.integers(16, 30))) + signs(num, 1), [""]), lambda: (words("", 2), ["token", "key", "password"]), lambda: (signs(up, 17) + signs(num, 2), [""]),
        ])()
        name = one(names)
        before, after = one([(f"{name} = ", " "), (f"{name}: ", " "), (f'{name} "', '"'), (f"{name} ", " ")]) if name else ("", " ")
        return value, prose() + " " + before, after + prose()

    return [(*(secret() if i % 2 else other()), i % 2) for i in range(n)]


@lru_cache(maxsize=1)
def trained() -> Forest:
    found = labelled_findings()
    return Forest.grow(np.array([features(*f[:3]) for f in found]), np.array([f[3] for f in found]))


def learn(findings: DataFrame, *, most: int = SAMPLE) -> Forest:
    """A forest from columns ``value, before, after, is_secret``; of more than ``most`` rows, those of the smallest hashes."""
    rows = columns(findings, "value", "before", "after", "is_secret").where("value IS NOT NULL AND value != '' AND is_secret IS NOT NULL")
    picked = rows.orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after").limit(most).collect()
    if not picked:
        raise ValueError("no labelled findings")
    return Forest.grow(np.array([features(r[0], r[1] or "", r[2] or "") for r in picked]), np.array([int(r[3]) for r in picked]))


def scan(docs: DataFrame, forest: Forest | None = None, *, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, findings``: for each row the candidates as ``(start, end, score, is_secret)``, in code points.

    Null and empty texts have none; each row is judged alone; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    forest = forest or trained()

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in it:
            spans = candidates(text or "")
            scores = forest.scores(describe(text, spans)).tolist() if spans else []
            yield key, [{"start": s, "end": e, "score": p, "is_secret": p >= least} for (s, e), p in zip(spans, scores, strict=True)]

    kind = "array<struct<start: int, end: int, score: double, is_secret: boolean>>"
    return map_rows(columns(docs, id_col, text_col), rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, findings {kind}")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, secrets and their spans in each row of ``documents``; null and empty texts have none."""
    found = scan(read_table(spark, sf_dir, "documents"))
    secrets = F.filter("findings", lambda x: x["is_secret"])
    spans = F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), spans.alias("spans"))
