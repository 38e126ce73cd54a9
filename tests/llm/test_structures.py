"""Token alignment, Merkle manifest and fingerprints against plain programs, and on nulls, ties, repeated rows and odd tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from luxtrace.llm import fingerprints, merkle_manifest, token_alignment
from luxtrace.llm.queries import ORACLES, QUERIES

EDGES = [None, "", " ", "  ", "\n", "a ", "a\n\n b", "é日本\U0001f600", "x" * 3000, "<s>x</s> <|endoftext|>", "a▁b", "<0x41>", "\x00", "Same Words Here", "Same Words Here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d int, at string, `a.b` int"


def make(spark, texts, ids=None, sources=None):
    """A table of documents with columns whose names could clash."""
    ids, sources = list(range(len(texts))) if ids is None else ids, ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, None if t == "" else "en", s, None if t is None else len(t), 1, "x", 2) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# --- 11


def plain_groups(text):
    """Groups of a text as pairs of id lists, encoded whole and cut one token at a time."""
    both = token_alignment.load_tokenizers(*token_alignment.default_vocabularies())
    if not text:
        return []
    a, b = both.a_library.encode(" " + text, add_special_tokens=False).ids, both.b_library.encode(text)
    spelled = [[side.tokens[k] for k in ids] for side, ids in ((both.a, a), (both.b, b))]
    if any(b"".join(x) != (" " + text).encode() for x in spelled):
        return []
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in spelled]
    out = []
    at = [0, 0]
    for c in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for k, ids in enumerate((a, b)):
            to = ends[k].index(c) + 1
            group.append(ids[at[k] : to])
            at[k] = to
        out.append(tuple(group))
    return out


def plain_alignment(texts):
    groups = [plain_groups(t) for t in texts]
    links = [[(a, b) for x, y in g for a in x for b in y] for g in groups]
    count = Counter(p for of in links for p in set(of))
    best: dict = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    for g, of in zip(groups, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(of), sum(count[p] == best[p[0]] for p in of), sum(count[p] for p in of), hashlib.sha256(said.encode()).hexdigest() if said else ""


@pytest.fixture(scope="module")
def strange():
    r = random.Random(3)
    signs = ["a", "b", " ", "  ", "\n", "\t", "\r", "é", "日", "the", "'s", ";", "\x1c", "\x85", "　", "1", "<s>", ".", "▁", "q", "\U0001f600", "ation", " token"]
    return EDGES + ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(400)]


def aligned(spark, docs):
    blocks = token_alignment.align_blocks(docs)
    return [tuple(r)[1:] for r in token_alignment.link_scores(blocks, token_alignment.pair_counts(blocks)).orderBy("doc_id").collect()]


def test_alignment_as_plain(spark, strange, monkeypatch):
    want = list(plain_alignment(strange))
    assert aligned(spark, make(spark, strange)) == want
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", 7)  # also in slices
    both = token_alignment.load_tokenizers(*token_alignment.default_vocabularies())
    whole = both.aligned(strange)
    got = Counter((int(d), int(a), int(b)) for part in whole.links() for d, a, b in zip(*part, strict=True))
    assert got == Counter((d, a, b) for d, t in enumerate(strange) for x, y in plain_groups(t) for a in x for b in y)
    distinct, doc, place, times = whole.pairs()
    assert Counter({(int(d), *divmod(int(distinct[p]), 1 << token_alignment.ID_BITS)): int(n) for d, p, n in zip(doc, place, times, strict=True)}) == got


def test_alignment_of_few_repeated_rows(spark):
    texts = ["one two", "one two", None, ""]
    got = aligned(spark, make(spark, texts, ids=[5, 5, 6, 7]))
    assert got == list(plain_alignment(texts)) and got[0] == got[1]
    assert aligned(spark, make(spark, ["x"]).limit(0)) == []
    groups = {r["doc_id"]: r["groups"] for r in token_alignment.token_groups(make(spark, EDGES)).collect()}
    assert groups[0] == "" and len(groups) == len(EDGES)


def test_alignment_memory_is_that_of_pairs():
    """A group of 4,000 by 4,000 tokens has sixteen million links of one pair."""
    both = token_alignment.load_tokenizers(*token_alignment.default_vocabularies())
    n = 4000
    found = both.aligned(["a"])
    found.a, found.b = np.zeros(n, "i4"), np.zeros(n, "i4")
    found.doc_a = found.doc_b = found.group_a = found.group_b = np.zeros(n, "i8")
    found.in_a = found.in_b = np.array([n])
    distinct, _, _, times = found.pairs()
    assert len(distinct) == 1 and times.tolist() == [n * n]


# --- 12


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    first = lambda v: (v is not None, v)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (first(r[0]), plain_leaf(r))) for s in sources}
    trees = {s: plain_tree([plain_leaf(r) for r in own[s]]) for s in sources}
    top = plain_tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for place, r in enumerate(own[s]):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded, siblings = plain_leaf((*r[:4], text)), ""
            for levels, at in ((trees[s], place), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    siblings += "".join(run[: at % 16] + run[at % 16 + 1 :])
                    folded = h("".join([*run[: at % 16], folded, *run[at % 16 + 1 :]]))
                    at //= 16
            yield r[0], plain_leaf(r), trees[s][-1][0], top[-1][0], h(siblings), folded, folded == top[-1][0]


def sortable(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1), (300, 1, 16, 257), (2,) * 20])
def test_manifest_as_plain(spark, sizes):
    r = random.Random(len(sizes))
    sources = [None if k == 1 else f"s{k}é" for k, n in enumerate(sizes) for _ in range(n)]
    texts = [r.choice([*EDGES, f"Text {k}"]) for k in range(len(sources))]
    ids = [r.choice([k, None, 7]) if k % 11 == 0 else k for k in range(len(sources))]
    docs = make(spark, texts, ids, sources)
    rows = [tuple(x) for x in docs.select(*merkle_manifest.FIELDS).collect()]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle_manifest.verified(docs, F.when(merkle_manifest.tampered(F.col("doc_id")), lower)).collect()
    assert sortable(got) == sortable(plain_manifest(rows))


def test_manifest_and_proofs(spark):
    docs = make(spark, [f"Text {k}" for k in range(40)], sources=["a", None] * 20)
    by_source = merkle_manifest.manifest(docs).collect()
    assert [x["n_docs"] for x in by_source] == [20, 20] and len({x["root"] for x in by_source}) == 1 and len({x["subroot"] for x in by_source}) == 2
    for p in merkle_manifest.inclusion_proofs(docs).collect():
        at = p["leaf"]
        for before, after in p["way"]:
            at = h(before + at + after)
        assert at == p["root"]
    none = docs.limit(0)
    assert merkle_manifest.verified(none, F.lit(None).cast("string")).count() == 0 and merkle_manifest.manifest(none).count() == 0


def test_manifest_as_sql(spark, sf_dir, tmp_path):
    import duckdb

    QUERIES["op12_merkle_manifest"](spark, sf_dir).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    got, want = con.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'").fetchall(), con.sql(f"SELECT {columns} FROM ({ORACLES['op12_merkle_manifest']})").fetchall()
    assert sorted(got) == sorted(want) and {x[-1] for x in got} == {True, False}


# --- 13


def test_closed_syncmers_as_defined():
    """An anchor is a k-mer whose least s-mer is its first or last; counted one k-mer at a time."""
    r = random.Random(4)
    for text in ["".join(r.choice("abc dé日\U0001f600") for _ in range(n)) for n in (0, 1, 21, 22, 23, 40, 300)] + ["a" * 100, "ab" * 60]:
        s, k = fingerprints.S, fingerprints.K

        def order(x):
            v = 0
            for c in x:
                v = (v * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            return mixed(v)

        def mixed(v):
            v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            return v ^ v >> 29

        want = []
        for i in range(len(text) - k + 1):
            inner = [order(text[j : j + s]) for j in range(i, i + k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                want.append((mixed((inner[0] * 0x9E3779B97F4A7C15 + inner[-1]) % 2**64) >> 16, i))
        hashes, places = fingerprints.anchors(text)
        got = list(zip(hashes.tolist(), places.tolist(), strict=True))
        assert got == want if want else len(got) == min(1, len(text))


def words(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_fingerprints_tell_edits_from_others():
    r = random.Random(5)
    of = fingerprints.Fingerprint.of
    halves, others, inserted, swapped = [], [], [], []
    for _ in range(60):
        a, b = words(r, r.randint(60, 400)), words(r, r.randint(60, 400))
        halves.append(of(a).likeness(of(fingerprints.edited(a, b))))
        others.append(of(a).likeness(of(b)))
        inserted.append(of(a).likeness(of(words(r, 30) + " " + a)))
        parts = [a[k : k + 100] for k in range(0, len(a), 100)]
        swapped.append(of(a).likeness(of("".join(reversed(parts)))))
        assert str(fingerprints.Fingerprint.read(str(of(a)))) == str(of(a)) and of(a).likeness(of(a)) == 1
    assert 0.4 < np.mean(halves) < 0.6 and min(halves) > 0.15 and max(others) < 0.05 and np.mean(inserted) > 0.8 and np.mean(swapped) < 0.35


def test_all_anchors_count():
    """Long texts too: the fingerprint has each anchor, and the likeness is that of all of them, counted pair by pair."""
    r = random.Random(9)
    of = fingerprints.Fingerprint.of
    a = words(r, 300)
    for b in (fingerprints.edited(a, words(r, 300)), a[900:] + a[:900], words(r, 80) + a[:700] + words(r, 90), words(r, 40), ""):
        first = [dict(reversed([*zip(*(x.tolist() for x in fingerprints.anchors(t)), strict=True)])) for t in (a, b)]
        assert [len(base64.b64decode(str(of(t)))) for t in (a, b)] == [10 * len(x) for x in first] and len(first[0]) > 200
        shared = sorted((first[0][h], first[1][h]) for h in first[0].keys() & first[1].keys())
        best = []
        for k, (_, p) in enumerate(shared):
            best.append(1 + max((best[j] for j in range(k) if shared[j][1] < p), default=0))
        assert of(a).likeness(of(b)) == of(b).likeness(of(a)) == 2 * max(best, default=0) / (len(first[0]) + len(first[1]))


def plain_next(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    for k, (d, t, _) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        own, changed = fingerprints.Fingerprint.of(t), fingerprints.Fingerprint.of(new)
        yield d, len(t), hashlib.sha256(new.encode()).hexdigest(), str(own), str(changed), own.likeness(changed), own.likeness(fingerprints.Fingerprint.of(following))


@pytest.mark.parametrize("kind", ["edges", "one", "two", "hot id", "nulls", "many"])
def test_next_document_as_plain(spark, kind, monkeypatch):
    r = random.Random(6)
    many = [words(r, r.randint(0, 60)) for _ in range(600)]
    texts, ids = {
        "edges": (EDGES, None), "one": (["only " * 20], [3]), "two": (["first " * 20, None], [9, 4]), "hot id": (many, [7 if k % 3 else k for k in range(600)]), "nulls": (many, [None if k % 2 else -k for k in range(600)]),
        "many": (many, random.Random(1).sample(range(10**9), 600)),
    }[kind]
    monkeypatch.setattr(fingerprints, "LEAST_RANGES", 20)
    docs = make(spark, texts, ids)
    rows = [tuple(x) for x in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = fingerprints.compare_with_next(docs).collect()
    assert sortable(got) == sortable(plain_next(rows))
    if kind == "hot id":
        assert len({x["at"] for x in fingerprints.in_order(docs).where("NOT ahead AND d = 7").select("at").collect()}) > 3


def test_fingerprints_of_rows(spark):
    got = {x["doc_id"]: x for x in fingerprints.fingerprints(make(spark, EDGES)).collect()}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == "" and got[13]["fingerprint"] == got[14]["fingerprint"] != ""
    none = make(spark, ["x"]).limit(0)
    assert fingerprints.fingerprints(none).count() == 0 and fingerprints.compare_with_next(none).count() == 0
