"""The ten operators on small tables: against plain programs, and with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns of any name."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from luxtrace.llm import bpe, decontaminate, language, line_dedup, media, mph, near_dedup, passages, pii, secrets, token_files
from luxtrace.llm.common import shared_dir

WORDS = "the and of to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def make(spark, texts, ids=None, extra=True):
    """A table of documents with columns whose names could clash."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows if extra else [r[:5] for r in rows], schema + (", d int, h1 string, `a.b` int" if extra else "")).repartition(3)


EDGES = [None, "", " ", "\n\n\n", "a", "é日本\U0001f600", "x" * 50_000, "same line here\n" * 3, "The quick brown fox", "The quick brown fox"]


def empty(spark):
    return make(spark, ["x"]).limit(0)


# --- 1


def test_bpe_as_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = EDGES + ["".join(r.choice("aabcdethe  \n\t'sÉß0123 日本—_-=<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["a" * 3000, "ÃÂ" * 500]
    got = {x["doc_id"]: x for x in bpe.digest(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert tuple(got[i])[1:] == want, t
    assert bpe.digest(empty(spark)).count() == 0


# --- 2

_REF = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def reference_spans(t):
    keep = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(d := re.sub("[ -]", "", s)) <= 19 and pii.luhn(d), "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15}
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(_REF[k], t) if keep[k](m[0])]


def test_pii_base_and_added(spark):
    r = random.Random(2)
    texts = EDGES + ["".join(r.choice("ab.@1234567890+- ()%25é\n") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["9" * 5000, "a@" * 2000, "+1 " * 1000, "card 4111 1111 1111 1111, mail x@y.org"]
    for x in pii.find_pii(make(spark, texts)).collect():
        t = texts[x["doc_id"]] or ""
        base = [tuple(s) for s in x["base"]]
        assert base == reference_spans(t)
        assert set(base) <= {tuple(s) for s in x["spans"]}
    said = ["please write to ann dot lee at mail dot example today", "phone: (415) 555-2671 or later", "host 10[.]20[.]30[.]40 is down"]
    added = [[s["kind"] for s in x["spans"]] for x in pii.find_pii(make(spark, said)).orderBy("doc_id").collect()]
    assert added[1] == ["phone"] and added[2] == ["ip"]
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_spans_need_no_seven_digits():
    field = pii.trained()
    kinds = lambda t: [k for k, _, _ in pii.all_spans(t, field)[1]]
    assert kinds("host 8[.]8[.]8[.]8 is down") == ["ip"] and kinds("server 10[.]0[.]0[.]1 or so") == ["ip"]
    assert kinds("write to john [at] example.com soon") == ["email"]
    assert kinds("they looked at the sky and at that time") == []


def test_pii_spans_wherever_they_stand_in_digits():
    """A number among very many others is found at any offset."""
    field, lost = pii.trained(), 0
    for k in range(60):
        text = "v1 " * (330 + k) + "please call (415) 555-2671 now " + "v2 " * 400
        at = text.index("(415)")
        lost += ("phone", at, at + 14) not in pii.all_spans(text, field)[1]
    assert not lost


def test_pii_recall_through_the_whole_operator(spark):
    samples = pii.training_samples(300, seed=5)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(samples)], "doc_id long, text string")
    got = {r["doc_id"]: {tuple(s) for s in r["spans"]} for r in pii.find_pii(docs).collect()}
    want = [(i, *s) for i, (_, spans) in enumerate(samples) for s in spans]
    assert sum(tuple(w[1:]) in got[w[0]] for w in want) / len(want) > 0.95


def test_pii_field_is_accurate_on_new_samples():
    field, good, want, got = pii.trained(), 0, 0, 0
    for text, spans in pii.training_samples(200, seed=77):
        found = set(field.best(text, 0, len(text)))
        good, want, got = good + len(found & set(spans)), want + len(spans), got + len(found)
    assert good / want > 0.95 and good / got > 0.95


def test_pii_segmentation_is_the_best_of_all():
    """Dynamic programming against all segmentations of a short stretch."""
    field = pii.trained()
    text = "call (415) 555-2671 x"
    stretch = pii.Stretch(text, 0, len(text))
    n = len(stretch.ends) - 1

    def walk(at, kind):
        if at == n:
            return 0.0
        best = field.next[kind, 0] + walk(at + 1, 0)
        for j in range(at + 1, n + 1):
            for i, f in stretch.spans[j]:
                if i == at:
                    best = max(best, *(field.next[kind, k] + field.weights[k - 1, f].sum() + walk(j, k) for k in range(1, 5)))
        return best

    spans = field.best(text, 0, len(text))
    index = {e: k for k, e in enumerate(stretch.ends)}
    total, kind, at = 0.0, 0, 0
    for k, s, e in [*spans, (None, len(text), None)]:
        while at < index[s]:
            total, kind, at = total + field.next[kind, 0], 0, at + 1
        if k:
            f = next(f for i, f in stretch.spans[index[e]] if i == at)
            c = pii.KINDS.index(k) + 1
            total, kind, at = total + field.next[kind, c] + field.weights[c - 1, f].sum(), c, index[e]
    assert total == pytest.approx(walk(0, 0))


# --- 3


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language.op3_language_id(spark, sf_dir).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97
    profiles = language.learned_on_documents(docs)
    got = {r["doc_id"]: r for r in language.identify(make(spark, EDGES), profiles).collect()}
    assert {got[k]["lang_pred"] for k in (0, 1, 2, 3)} == {"und"} and got[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    marks = ["\u0301\u0301", "12 \u0301 34", "a\u0301"]
    assert [r["lang_pred"] == "und" for r in language.identify(make(spark, marks), profiles).orderBy("doc_id").collect()] == [True, True, False]
    kept = language.keep_identified(make(spark, EDGES + ["this and that of the in with for on are from ing", "12345 67 !!"]), profiles)
    ids = {r["doc_id"] for r in kept.collect()}
    assert 10 in ids and not ids & {0, 1, 2, 3, 11}
    assert language.learn(empty(spark)).languages == [] and language.identify(make(spark, ["abc"]), language.learn(empty(spark))).first()["lang_pred"] == "und"


def test_rank_distance_by_hand():
    grams, counts = language.gram_counts("Ab, ab c")
    name = lambda g: "".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0) if g >> s)
    got = {name(int(g)): int(n) for g, n in zip(grams, counts, strict=True)}
    assert got == {"a": 2, "b": 2, "c": 1, " a": 2, "ab": 2, "b ": 2, " c": 1, "c ": 1, " ab": 2, "ab ": 2, "b a": 1, "b c": 1, " c ": 1}
    long = "Ab c. " * 500
    whole = language.gram_counts(long)
    old, language.BLOCK = language.BLOCK, 97
    try:
        parts = language.gram_counts(long)
    finally:
        language.BLOCK = old
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    own = language.ranked(*whole).tolist()
    assert language.Profiles({"x": own, "y": own[::-1]}).predict(long)[0] == "x" and language.Profiles({"x": own}).predict(long)[1] == 1.0


# --- 4


def test_decontamination(spark):
    item = "A farmer named Tom has 12 apples and gives 5 kg of pears to his friend Anna before Tom walks 3 miles home to the old house near the river"
    other = item.replace("Tom", "Bob").replace("12", "31").replace("5", "9").replace("Anna", "Mary").replace("3 miles", "7 miles")
    mixed = "A farmer named Bob has 31 apples and gives 9 kg of pears to his friend Mary before Joe walks 7 miles home and sleeps in a big new house by some lake"
    texts = [*EDGES, f"Start here. {item}. End.", f"Start here. {other}. End.", " ".join(item.split()[:12]), mixed, other]
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(make(spark, texts), items).collect()}
    assert set(got) == {(10, 1), (11, 1), (14, 1)}
    assert not got[10, 1]["changed"] and got[11, 1]["changed"]
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(make(spark, texts), items).collect()}
    assert kept == set(range(len(texts))) - {10, 11, 14}
    assert decontaminate.find_leaks(empty(spark), items).count() == 0 and decontaminate.find_leaks(make(spark, texts), items.limit(0)).count() == 0


def test_slots_must_agree(spark):
    item = "Ann gives Tom apples, then Ann gives Tom pears, then Ann gives Tom plums, then Ann gives Tom figs."
    texts = ["Then " + item.replace("Ann", "Eve").replace("Tom", "Joe"), "Then Ann gives Tom apples, then Eve gives Joe pears, then Kim gives Lee plums, then Max gives Ian figs.", "Then " + item.replace("Ann", "Joe").replace("Tom", "Joe")]
    items = spark.createDataFrame([(1, "Then " + item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(make(spark, texts), items).collect()] == [0]


def test_items_without_windows(spark):
    texts = ["What is 7 + 8?", "what is 3 + 9?", "Say: what is 7 + 8?", "12 13", "14 15", "who is 7 + 8?", None, ""]
    items = spark.createDataFrame([(1, "What is 7 + 8?"), (2, "12 13"), (3, "?"), (4, ""), (None, "who is 1 + 2?")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["changed"]) for r in decontaminate.find_leaks(make(spark, texts), items).collect()), key=str)
    assert got == [(0, 1, False), (1, 1, True), (2, 1, False), (3, 2, False), (5, None, True)]


def test_names_at_the_start_of_a_sentence(spark):
    item = "Tom has 12 apples. Tom gives 5 of them to Anna. Tom walks 3 miles home. How many apples does Tom have left?"
    texts = [item, item.replace("Tom", "Bob"), "Well then: " + item.replace("Tom", "Zoe").replace("12", "40"), item.replace("Tom gives", "Max gives").replace("Tom walks", "Kim walks").replace("does Tom", "does Lea")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["coverage"], r["changed"]) for r in decontaminate.find_leaks(make(spark, texts), items).collect()}
    assert got == {0: (1.0, False), 1: (1.0, True), 2: (1.0, True)}


def test_leaks_against_plain_search(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join(t.lower().split())
    want = {(d["doc_id"], b["item_id"]) for b in items.collect() for d in docs.collect() if flat(b["text"]) in flat(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontaminate(spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 2


def plain_leaks(texts, items, least=0.8):
    """Each text against each item, window by window, without hashes, bit maps or joins."""
    templates = decontaminate.Templates()

    def read(text):
        words = (text or "").split()
        tokens, may_name = (x.tolist() for x in templates.read(words))
        out = []
        for j in range(len(words) - decontaminate.WINDOW + 1):
            place = range(j, j + decontaminate.WINDOW)
            if sum(tokens[k] >= 4 or may_name[k] for k in place) < decontaminate.WORDS:
                continue
            for named in range(1 << decontaminate.WINDOW):
                if all(may_name[k] for b, k in enumerate(place) if named >> b & 1):
                    out.append((j, named, tuple(decontaminate.NAME if named >> b & 1 else tokens[k] for b, k in enumerate(place))))
        return words, tokens, out

    found = set()
    asked = [(key, text, *read(text)) for key, text in items if text]
    for d, text in texts:
        words, tokens, windows = read(text)
        places = {}
        for j, _, w in windows:
            places.setdefault(w, set()).add(j)
        for key, item, _, item_tokens, item_windows in asked:
            n = len({i for i, _, _ in item_windows})
            pairs = [(j, i, m, " ".join(words[j : j + decontaminate.WINDOW])) for i, m, w in item_windows for j in places.get(w, ())]
            if not n and item_tokens and tokens == item_tokens:
                n, pairs = 1, [(-1, -1, 0, " ".join(words))]
            if n and len({p[1] for p in pairs}) >= least * n - 1e-9 and (got := decontaminate.judged(pairs, item, n, least, templates)):
                found.add((d, key, round(got[0], 9), got[1], got[2]))
    return found


def test_leaks_against_each_pair(spark, sf_dir):
    r = random.Random(33)
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs += [(10**6 + k, " ".join(w if r.random() > 0.03 else str(r.randint(1, 99)) for w in f"So. {t} And {items[k - 1][1]}".split())) for k, (_, t) in enumerate(items[:60])] + [(5, None), (6, "")]
    items += [(None, None), (900, "Ann has 3 pears."), (901, "1 2 3")]
    docs += [(10**7, "Ann has 3 pears."), (10**7 + 1, "ann has 4 pears"), (10**7 + 2, "1 2 3"), (10**7 + 3, "1 2 4")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"], round(x["coverage"], 9), x["n_windows"], x["changed"]) for x in got} == plain_leaks(docs, items)
    assert len(got) >= 60


# --- 5


def test_media_round_trip(spark):
    got = {r["doc_id"]: r for r in media.describe_stored(media.store_texts(make(spark, EDGES))).collect()}
    for i, t in enumerate(EDGES):
        raw = (t or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tuple(got[8])[1:] == tuple(got[9])[1:]
    assert media.store_texts(empty(spark)).count() == 0


def test_media_formats(spark):
    r = np.random.default_rng(0)
    grey, rgb = r.integers(0, 256, (5, 7)).astype(np.uint8), r.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    text = lambda a: b" ".join(b"%d" % x for x in a.ravel())
    assert np.array_equal(media.decode_media(b"P2 # c\n7 5\n255\n" + text(grey)), grey)
    assert np.array_equal(media.decode_media(b"P3 7 5 255\n" + text(rgb)), rgb)
    assert np.array_equal(media.decode_media(b"P5 7 5 255\n" + grey.tobytes()), grey)
    assert np.array_equal(media.decode_media(b"P6 7 5 255\n" + rgb.tobytes()), rgb)
    bits = grey > 128
    assert np.array_equal(media.decode_media(b"P4 7 5\n" + np.packbits(bits, axis=1).tobytes()) == 0, bits)
    assert np.array_equal(media.decode_media(b"P1 7 5\n" + b"".join(b"1" if x else b"0" for x in bits.ravel())) == 0, bits)
    assert np.array_equal(media.decode_media(b"P5 2 1 65535\n\xff\xff\x80\x00"), [[255, 128]])
    assert np.array_equal(media.decode_media(media.encode_bmp(grey)), grey) and np.array_equal(media.decode_media(media.encode_bmp(rgb)), rgb)
    big = r.integers(0, 256, (40, 60)).astype(float)
    assert np.allclose(media.area_resize(big, 8, 12), big.reshape(8, 5, 12, 5).mean(axis=(1, 3)))
    assert media.area_resize(big, 7, 9).mean() == pytest.approx(big.mean())
    df = spark.createDataFrame([(1, b"P5 2 2 255\nabcd"), (2, b"P5 9 9 255\nshort"), (3, None), (4, b"GIF89a"), (5, b"BM")], "doc_id long, media binary")
    tiles = {x["doc_id"]: x for x in media.media_tiles(df).collect()}
    assert tiles[1]["error"] is None and bytes(tiles[1]["tile"])[:6] == b"\x93NUMPY" and all(tiles[k]["error"] for k in (2, 3, 4, 5))


# --- 6


def test_long_secrets_are_whole():
    r = random.Random(4)
    part = lambda n: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH0123456789_-") for _ in range(n))
    token = ".".join((part(40), part(500), part(60)))
    assert secrets.candidates(f"token: {token} end") == [(7, 7 + len(token))]
    assert secrets.candidates(f"1{part(30)}key={part(20)}!{part(30)}1 end") == [(0, 87)]


def test_secrets(spark):
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = [*EDGES, f'my token = "{key}" end', f"commit {key} sha1", "see docs/path/to/file_name_2024.html now", "password: hunter2!x9Q", "card 4111111111111111"]
    got = {r["doc_id"]: [(f["start"], f["end"]) for f in r["findings"] if f["is_secret"]] for r in secrets.scan(make(spark, texts)).collect()}
    start = texts[10].index(key)
    assert got[10] == [(start, start + 40)] and not got[11] and not got[12] and not got[14] and all(not got[i] for i in range(10))
    held = secrets.labelled_findings(600, seed=99)
    p = secrets.trained().scores(np.array([secrets.features(*f[:3]) for f in held])) >= 0.5
    assert np.mean(p == np.array([f[3] for f in held], bool)) > 0.97
    table = spark.createDataFrame([tuple(map(str, f[:3])) + (f[3],) for f in secrets.labelled_findings(200)], "value string, before string, after string, is_secret int")
    assert len(secrets.learn(table, most=150).trees) == secrets.TREES
    assert secrets.scan(empty(spark)).count() == 0


# --- 7


def test_token_files(spark):
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = EDGES + ["".join(r.choice("aabCDEthe  \n\t'sÉéßİΣσ0123 日本́—_-=.,*!<|endoftext|>\x85\xa0") for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["hello <|endoftext|> world", "<|ENDOFTEXT|>a<|startoftext|>\u0301b<|endoftext|><|endoftext|>", "x <|endoftext|", *("".join(r.choice(["<|endoftext|>", "<|startoftext|>", " ", "Ab.", "'s", "é", "<|", "\n"]) for _ in range(8)) for _ in range(60))]
    folder = shared_dir(spark, "files")
    manifest = token_files.write_token_files(make(spark, texts), folder)
    library = Tokenizer.from_file(token_files.tokenizer_path("word_bpe_49k.json"))
    rows = {x["doc_id"]: x for x in token_files.read_token_files(manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (rows[i]["start"], rows[i]["n_tokens"], np.frombuffer(rows[i]["ids"], "<u4").tolist()) == (start, len(ids), ids), t
        start += len(ids)
    file = manifest.orderBy("part").first()["file"]
    some = token_files.read_documents(file, {0, 2})
    assert some[0] == [1] and some[2] == [1]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(file.removeprefix("file://"), "rb"), read_across_frames=True).read()
    assert len(whole) == sum(token_files.SeekableReader(file).raw)
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), folder)).count() == 0
    odd = spark.createDataFrame([(None, "b"), (5, "a"), (5, "a"), (5, None)], "doc_id long, text string")
    assert [x["doc_id"] for x in token_files.read_token_files(token_files.write_token_files(odd, folder)).orderBy("start").collect()] == [None, 5, 5, 5]


def test_other_vocabularies_are_encoded_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    path = token_files.tokenizer_path("word_bpe_49k.json")
    assert token_files.WordEncoder(path).by_chunks
    rules = json.load(open(path, encoding="utf-8"))
    rules["normalizer"] = {"type": "Replace", "pattern": {"String": " "}, "content": ""}
    (tmp_path / "other.json").write_text(json.dumps(rules), encoding="utf-8")
    own = token_files.WordEncoder(str(tmp_path / "other.json"))
    texts = ["ab cd <|endoftext|> ef", "", None]
    want = [Tokenizer.from_file(str(tmp_path / "other.json")).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not own.by_chunks and [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == want


def test_damaged_token_file(tmp_path):
    out = open(tmp_path / "f", "wb")
    w = token_files.SeekableWriter(out, "<u2")
    w.add(7, np.arange(500, dtype="<u2").tobytes())
    w.add(None, b"")
    w.close()
    r = token_files.SeekableReader(f"file://{tmp_path}/f")
    assert [(k, len(i)) for k, i in r] == [(7, 500), (None, 0)]
    raw = bytearray((tmp_path / "f").read_bytes())
    raw[int(r.packed[0]) - 3] ^= 255
    (tmp_path / "g").write_bytes(raw)
    with pytest.raises(Exception):
        list(token_files.SeekableReader(f"file://{tmp_path}/g"))


# --- 8


def plain_classes(texts, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = {i: near_dedup.word_hashes(t) for i, t in zip(ids, texts, strict=True)}
    for a in ids:
        for b in ids:
            if a < b and near_dedup.similarity(words[a], words[b]) is not None:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS) + str(r.randint(0, 99))
    return " ".join(w)


def test_near_duplicates(spark, monkeypatch):
    r = random.Random(5)
    base = [" ".join(r.choice(WORDS) + r.choice(["", "s", "ly"]) for _ in range(120)) for _ in range(12)]
    passage = " ".join(r.choice(WORDS) for _ in range(60))
    texts = [*base, *(edited(r, b, 4) for b in base[:6]), *(edited(r, base[0], 3) for _ in range(20)), base[1], base[1].upper(), *(passage + " " + " ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(60)) for _ in range(25)), None, "", "  ", "one two", "one two", "x " * 3000]
    ids = [7 * i + 3 for i in range(len(texts))]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(make(spark, texts, ids)).collect()}
    assert got == plain_classes(texts, ids)
    kept = near_dedup.keep_one(make(spark, texts, ids))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(got.values())) and kept.columns[-1] == "a.b"
    monkeypatch.setattr(near_dedup, "SALT", 3)
    monkeypatch.setattr(near_dedup, "LARGE", 2)  # nearly all by rare words
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(make(spark, texts, ids)).collect()} == got
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, near_dedup.near_duplicates(twice).collect())) == sorted(["Row(doc_id=1, class_id=None)"] * 2 + ["Row(doc_id=None, class_id=None)"] * 2)


def test_banded_alignment():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    for block in (3, 1024):
        near_dedup.BLOCK = block
        for _ in range(800):
            a = [r.randint(0, 4) for _ in range(r.randint(0, 22))]
            b = [x for x in a if r.random() > 0.1]
            for _ in range(r.randint(0, 3)):
                b.insert(r.randint(0, len(b)), r.randint(0, 4))
            most, want = r.randint(0, 7), distance(a, b)
            assert near_dedup.edits(np.array(a, np.uint32), np.array(b, np.uint32), most) == (want if want <= most else None)
    near_dedup.BLOCK = 1024


def test_word_hashes_are_of_words():
    a, b = near_dedup.word_hashes("The  cat\nsat\ton"), near_dedup.word_hashes("x the cat sat on y")
    assert a.tolist() == b[1:5].tolist() and len(set(b.tolist())) == 6
    found = near_dedup.shingles(near_dedup.word_hashes("a b c d e a b c d e"))
    assert found[0] == found[5] and len(set(near_dedup.labelled(found).tolist())) == 6


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200), (150, 200)], "x long, y long")
    got = {r["v"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert got == dict.fromkeys(range(31), 0) | dict.fromkeys((100, 150, 200), 100)


# --- 9


@pytest.mark.parametrize("most", [512, 5, 1])
def test_passages(spark, monkeypatch, most):
    r = random.Random(6)
    monkeypatch.setattr(passages, "GROUP", most)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    a, b, c = text(150), text(90), text(200)
    texts = [None, "", "short", a + b, text(40) + b + text(30), a[100:700] + "é" + c, c[:399], c[:400], c[3:500] + text(20) + c[3:500], "ab" * 900, "x" * 401, "x" * 1500, "y" * 399, a + b, text(300), *(text(12) + b + text(12) for _ in range(12))]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in passages.remove_repeats(make(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == passages.brute_force(texts)
    assert passages.remove_repeats(empty(spark)).count() == 0


def test_repeated_rows_of_passages(spark):
    t = " ".join(WORDS)[:600]
    rows = spark.createDataFrame([(1, t), (1, t), (None, None), (None, t[:200])], "doc_id long, text string")
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"]) for x in passages.remove_repeats(rows).collect()]
    assert sorted(got, key=str) == [(1, 600, 600), (1, 600, 600), (None, 0, 0), (None, 200, 0)]


def test_texts_of_one_id_are_documents_of_their_own(spark):
    r = random.Random(61)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = text(130)[:500]
    texts = [text(200)[:700] + shared, shared + text(80), text(150), text(150), shared[:450]]
    rows = spark.createDataFrame([(1, texts[0]), (1, texts[2]), (2, texts[1]), (None, texts[3]), (None, texts[4])], "doc_id long, text string")
    got = {(x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in passages.remove_repeats(rows).collect()}
    assert got == set(passages.brute_force(texts))


def test_hot_cores_with_many_neighbourhoods(spark, monkeypatch):
    """Many near copies, each with an edit of its own: no step makes a row for each window."""
    r = random.Random(62)
    monkeypatch.setattr(passages, "GROUP", 20)
    base = " ".join(r.choice(WORDS) for _ in range(260)).split()
    texts = []
    for _ in range(150):
        w = list(base)
        w[r.randrange(len(w))] = str(r.randint(0, 99999))
        texts.append(" ".join(w))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in passages.remove_repeats(make(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == passages.brute_force(texts)


# --- 10


def plain_line_dedup(texts):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    docs = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := key(x)) >= 10 and len(docs[k]) > 1 and min(docs[k]) < i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    r = random.Random(7)
    pool = ["Nine char", "ten chars.", "  Ten Chars.\t", "ÄÖÜ line of Umlauts", "äöü line of umlauts", "another repeated line", "\x0bvertical tab line\x0c", "İstanbul is long enough", "\xa0not stripped at all\xa0"]
    texts = EDGES + ["\n".join(r.choice(pool + [f"unique line {r.random()}"]) for _ in range(r.randint(0, 8))) for _ in range(60)] + ["\n".join(pool)] * 2
    out = line_dedup.drop_repeated_lines(make(spark, texts))
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"]) for x in out.collect()}
    assert [got[i] for i in range(len(texts))] == plain_line_dedup(texts)
    assert out.columns[:8] == make(spark, [""]).columns
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0
    rows = spark.createDataFrame([(1, "the same line"), (1, "the same line"), (None, "the same line"), (None, None)], "doc_id long, text string")
    assert sorted((str(x["doc_id"]), x["n_dropped"]) for x in line_dedup.drop_repeated_lines(rows).collect()) == [("1", 1), ("1", 1), ("None", 0), ("None", 0)]


def test_minimal_perfect_hash():
    r = np.random.default_rng(8)
    for n in (1, 2, 3, 10, 1000, 20_000):
        h1, h2 = (r.integers(-(1 << 63), 1 << 63, n) for _ in range(2))
        displacements, slot = mph.build(h1, h2)
        assert sorted(slot.tolist()) == list(range(n))
        assert np.array_equal(mph.look_up(displacements, n, h1, h2), slot)
        assert len(displacements) <= n // 4 + 2


def test_registered_queries_have_no_limits():
    from luxtrace.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["op10_line_dedup"])
def test_equal_to_sql(spark, sf_dir, tmp_path, name):
    import duckdb

    from luxtrace.llm import queries

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    queries.QUERIES[name](spark, sf_dir).write.parquet(str(tmp_path / "o"))
    got, want = (sorted(map(tuple, c.sql(q).df().sort_index(axis=1).astype(str).to_numpy().tolist())) for q in (f"SELECT * FROM '{tmp_path}/o/*.parquet'", queries.ORACLES[name]))
    assert got == want


def test_pipeline(spark, tmp_path, sf_dir):
    """Each stage against a plain program on what it was given."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "language_id":
            assert after == before
        elif name == "line_dedup":
            order = sorted(before)
            assert [after[i]["text"] for i in order] == [t for _, _, t in plain_line_dedup([before[i]["text"] for i in order])]
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_dedup":
            ids = sorted(before)
            assert set(after) == set(plain_classes([before[i]["text"] for i in ids], ids).values())
        elif name == "decontamination":
            gone = set(before) - set(after)
            items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            flat = lambda t: " ".join(t.lower().split())
            assert {i for i, r in before.items() if any(flat(t) in flat(r["text"]) for t in items)} <= gone and len(gone) < 20
        else:
            assert all(after[i]["decoded_sha256"] == hashlib.sha256(before[i]["text"].encode()).hexdigest() for i in before) and set(after) == set(before)
            break
        assert docs.columns == columns and all(after[i] == before[i] for i in after if name not in ("line_dedup",))
    assert len(cp.STAGES) == 5


@pytest.mark.parametrize("large", [64, 20])
def test_links_among_texts_that_differ_from_the_first_of_a_large_bucket(spark, monkeypatch, large):
    """All that two near texts share stands in many longer texts of smaller ids too; by pairs of the bucket and by rare words."""
    monkeypatch.setattr(near_dedup, "LARGE", large)
    r = random.Random(9)
    fresh = lambda n: [r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(n)]
    texts = []
    for _ in range(6):
        shared = fresh(80)
        texts += [shared + fresh(60) for _ in range(40)] + [shared + fresh(20) for _ in range(2)]
    texts = [" ".join(t) for t in texts]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(make(spark, texts)).collect()}
    assert got == plain_classes(texts, list(range(len(texts)))) and sum(k != v for k, v in got.items()) == 6


def test_rarest_words_of_similar_texts_meet():
    """Whatever the counters say, texts of similarity 0.8 or more share one of their rarest words."""
    r = random.Random(4)
    for _ in range(400):
        a = [r.randint(0, r.choice([5, 40, 10**6])) for _ in range(r.randint(1, 120))]
        b, n = list(a), r.randint(0, 30)
        for _ in range(n):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = [r.randint(0, 40)] * r.randint(0, 1)
        if b and near_dedup.similarity(*(np.array(t, np.uint32) for t in (a, b))) is not None:
            counts = np.random.default_rng(n).integers(0, 9, near_dedup.CELLS)
            first = [set(near_dedup._rarest(near_dedup._marks(np.array(t, np.uint32).tobytes()), counts, 0.8).tolist()) for t in (a, b)]
            assert first[0] & first[1]
            # whatever else is in the tables, what both have is found from either side, unless they are of one part
            cells = np.zeros(2 * near_dedup.PART_CELLS, np.uint32)
            length = [near_dedup._length_class(len(t), 0.8) for t in (a, b)]
            for part, k in ((5, 0), (6, 1)):
                for at in near_dedup._cells(np.array(sorted(first[k]), np.uint64), length[k]):
                    held, mine = cells[at], near_dedup._part_hash(part)
                    cells[at] = np.where((held == 0) | (held == mine), mine, 1)
            for part, k in ((5, 0), (6, 1)):
                assert first[0] & first[1] <= set(near_dedup._elsewhere(np.array(sorted(first[k]), np.uint64), length[k], part, cells).tolist())


@pytest.mark.parametrize("words", [30, 41, 45, 55, 65, 80, 81, 100])
@pytest.mark.parametrize("kind", ["deleted", "inserted", "replaced"])
def test_share_of_least_similar_pairs_by_kind_of_edit(words, kind):
    """Pairs of similarity 0.80, of which one has words deleted, inserted or replaced."""
    r, met, n = np.random.default_rng(words), 0, 200
    for _ in range(n):
        a = r.integers(0, 2**63, words).astype(np.uint64)
        most = int(0.2 * words + 1e-9)
        at = np.sort(r.choice(words, most, replace=False))
        if kind == "replaced":
            b = a.copy()
            b[at] = r.integers(0, 2**63, most).astype(np.uint64)
        elif kind == "deleted":
            b = np.delete(a, at)
        else:
            b, a = a, np.delete(a, at)
        met += bool(set(near_dedup.sketches(a).tolist()) & set(near_dedup.sketches(b).tolist()))
    assert met >= 0.95 * n, met


@pytest.mark.parametrize(("words", "apart"), [(5, False), (9, False), (12, False), (20, False), (100, False), (300, False), (20, True), (100, True)])
def test_share_of_least_similar_pairs_that_meet(words, apart):
    """Pairs of similarity 0.80 share a sketch wherever the edits stand, also if no run of five words is left."""
    r, met, n = np.random.default_rng(words), 0, 200
    for _ in range(n):
        a = r.integers(0, 2**63, words).astype(np.uint64)
        b, most = a.copy(), int(0.2 * words + 1e-9)
        b[np.arange(most) * 5 + 4 if apart else r.choice(words, most, replace=False)] = r.integers(0, 2**63, most).astype(np.uint64)
        met += bool(set(near_dedup.sketches(a).tolist()) & set(near_dedup.sketches(b).tolist()))
    assert met >= 0.98 * n, met


def test_parity_never_rules_out_a_link():
    r = random.Random(2)
    for _ in range(500):
        a = [r.randint(0, 10**9) for _ in range(r.randint(1, 200))]
        b, n = list(a), r.randint(0, 30)
        for _ in range(n):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = [r.randint(0, 10**9)] * r.randint(0, 1)
        bits = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) % 2**64).bit_count() for x, y in zip(*(near_dedup.parity(np.array(t, np.uint64)) for t in (a, b)), strict=True))
        assert bits <= 2 * n


def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns with names that operators use themselves."""
    r = random.Random(12)
    long = " ".join(r.choice(WORDS) + str(r.randint(0, 9999)) for _ in range(90_000))
    lines = "a line that comes again\nthe and of to in that is was for it with as his on be"
    texts = [None, "", "  \n ", lines, lines, lines + "\nmore of it here", long, "12 34", "the same text of the and is in", "the same text of the and is in"]
    ids = [0, 1, None, 3, 4, 4, 6, 7, 8, 8]
    names = "n_lines int, n_dropped int, __kept string, d0 int, f1 long, f2 long, a long, b long, v int, t string, item int, h int, c0 int, `x.y` string"
    rows = [(i, t, "en" if k % 3 else None, None if k % 4 == 1 else "s", None if k == 2 else len(t or ""), *([k] * 2), None if k % 2 else "q", *([k] * 6), "t", *([k] * 3), "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows[9] = (8, texts[9], *rows[8][2:])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + names).repartition(3)


def test_stages_on_odd_tables(spark, sf_dir):
    import corpus_pipeline as cp

    docs = odd_documents(spark)
    before = docs.collect()
    left = {
        "language_id": None, "line_dedup": len(before), "near_dedup": None, "decontamination": len(before), "byte_bpe": len(before),
    }
    for name, stage in cp.STAGES:
        got = stage(spark, docs, sf_dir)
        rows = got.collect()
        if name != "byte_bpe":
            assert got.columns == docs.columns, name
        assert left[name] in (None, len(rows)), name
        if name == "near_dedup":
            # texts without words are one class, of the null id; those of 3 and 4 are alike; equal rows stay once
            assert sorted(str(r["doc_id"]) for r in rows) == ["3", "6", "7", "8", "None"]
            assert all(any(tuple(r) == tuple(b) for b in before) for r in rows)
        if name == "language_id":
            assert all(r["text"] and any(map(str.isalpha, r["text"])) for r in rows)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_operators_on_odd_tables(spark):
    docs = odd_documents(spark)
    n = docs.count()
    items = spark.createDataFrame([(1, "the same text of the and is in"), (None, None)], "item_id long, text string")
    assert bpe.digest(docs).count() == pii.find_pii(docs).count() == media.describe_stored(media.store_texts(docs)).count() == secrets.scan(docs).count() == n
    assert near_dedup.near_duplicates(docs).count() == passages.remove_repeats(docs).count() == line_dedup.drop_repeated_lines(docs).count() == n
    assert language.identify(docs, language.learn(docs)).count() == n
    assert sorted(r["doc_id"] for r in decontaminate.find_leaks(docs, items).collect()) == [8, 8]
    assert token_files.read_token_files(token_files.write_token_files(docs, shared_dir(spark, "odd"))).count() == n
    texts = {r["text"] for r in docs.collect()}
    kept = {hashlib.sha256(r["kept"]).hexdigest() for r in passages.remove_repeats(docs).collect()}
    assert kept == {want[3] for want in passages.brute_force([t for t in texts if t is None or len(t) < 1000])} | {hashlib.sha256(max((t or "" for t in texts), key=len).encode()).hexdigest()}


def test_pairs_of_texts_that_share_many_keys_are_made_once(spark, monkeypatch):
    """Once for all sketches, or rarest words, that two texts share; with fewer keys taken along again, but none is lost."""
    r = random.Random(21)
    fresh = lambda n: [r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(n)]
    shared = fresh(90)
    texts = [" ".join(shared + fresh(20 + k % 3)) for k in range(30)]
    docs = make(spark, texts)
    rows = near_dedup.sketch_documents(docs)
    rows = near_dedup.cut(rows.join(near_dedup.distinct_texts(rows), ["f1", "f2", "d"]), "texts")
    ids = near_dedup.cut(rows.select("v", F.col("v").alias("part")), "ids")
    rare = near_dedup._by_rare_words(docs, rows, ids, 0.8, "doc_id", "text")
    everything = {(a, b) for a in range(30) for b in range(30) if a < b}
    links = {(a, b) for a, b in everything if near_dedup.similarity(near_dedup.word_hashes(texts[a]), near_dedup.word_hashes(texts[b])) is not None}
    for members in (near_dedup._members(rows), rare):
        parts = near_dedup._mixed_buckets(near_dedup._with_parts(members, None))
        made = {}
        for taken in (200, 2):
            monkeypatch.setattr(near_dedup, "BEFORE", taken)
            got = [tuple(x) for x in near_dedup._pairs(parts, rows, 0.8).collect()]
            made[taken] = set(got)
            assert links <= made[taken] and len(links) > 100
            assert taken == 2 or len(got) == len(made[taken])
        assert made[200] == made[2]


def test_a_word_of_which_two_texts_share_too_few_more_makes_no_pair(spark):
    """Texts of 800 and of 950 words share 700, of 760 that a link needs; the place of their first common word shows it."""
    r = random.Random(22)
    fresh = lambda n: [r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(n)]
    shared = fresh(700)
    often = fresh(100)  # comes after the shared words in the order by rarity
    texts = [" ".join(shared + (fresh(100) if k < 10 else fresh(150) + often)) for k in range(20)] + [" ".join(fresh(900) + often) for _ in range(30)]
    docs = make(spark, texts)
    rows = near_dedup.sketch_documents(docs)
    rows = near_dedup.cut(rows.join(near_dedup.distinct_texts(rows), ["f1", "f2", "d"]), "texts")
    ids = near_dedup.cut(rows.select("v", F.col("v").alias("part")), "ids")
    rare = near_dedup._with_parts(near_dedup._by_rare_words(docs, rows, ids, 0.8, "doc_id", "text"), None)
    got = {tuple(x) for x in near_dedup._pairs(rare, rows, 0.8).collect()}
    assert {(a, b) for a in range(10) for b in range(a + 1, 10)} <= got and all((a < 10) == (b < 10) for a, b in got)


def test_first_texts_of_other_lengths_make_no_star(spark):
    """A text meets the first one of a bucket only if their lengths fit; all that may be links are there."""
    r = random.Random(23)
    fresh = lambda n: [r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(n)]
    shared = fresh(90)
    texts = [" ".join(shared + fresh(10 if k < 8 else 100)) for k in range(16)]
    rows = near_dedup.sketch_documents(make(spark, texts))
    rows = near_dedup.cut(rows.join(near_dedup.distinct_texts(rows), ["f1", "f2", "d"]), "texts")
    got = {tuple(x) for x in near_dedup._stars(near_dedup._members(rows), 0.8).collect()}
    assert {(0, k) for k in range(1, 8)} <= got and all((a < 8) == (b < 8) for a, b in got)
