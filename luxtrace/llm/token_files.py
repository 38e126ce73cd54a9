"""Token-ID files (operator 7): one independent zstandard frame for each document and a trailing seek table.

A file holds, in order: the frames; a skippable frame with the documents' ids; a skippable frame with the seek table
(compressed size, raw size and checksum of each frame, the low half of XXH64 of the raw bytes) whose last nine bytes give
the number of frames, a flag byte and a magic number. This is the seekable layout of the zstandard project, so plain
zstandard readers get the whole stream, and a reader of single documents decompresses their frames alone.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, cut, map_rows, read_table, shared_dir, tokenizer_path

# Fixed values of the seekable zstandard layout.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

LEVEL = 3
#: Chunks of text kept with their ids in each Python worker, and documents encoded at a time.
CHUNKS_KEPT = 400_000
CHUNK_CHARS = 64
#: ASCII signs that are one piece of their own after a word; the apostrophe has rules of its own.
STOPS = '.,;:!?"*#$%&()[]{}<>/|@^~_=+-\\`'
AT_A_TIME = 256
#: The rules under which a text's ids are those of its chunks.
FOLDS = [(("type", "NFC"),), (("content", " "), ("pattern", "{'Regex': '\\\\s+'}"), ("type", "Replace")), (("type", "Lowercase"),)]
SPLITS = [
    (("behavior", "Removed"), ("invert", "True"), ("pattern", str({"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})), ("type", "Split")),
    (("add_prefix_space", "False"), ("trim_offsets", "True"), ("type", "ByteLevel"), ("use_regex", "False")),
]
#: The most bytes that a reader takes from a file at once, if no frame is larger.
READ_BYTES = 4 << 20
NULL_ID = -(1 << 63)


class WordEncoder:
    """Encodes as the tokenizers library does; chunks between blanks are encoded once and kept while there is room.

    The vocabulary's rules fold case, drop white space, never look across it and part letters from other signs, so a
    text's ids are those of its chunks, and those of a word with stops after it are the word's and the stops'. A file of
    other rules (``SPLITS``, ``FOLDS``) has its texts encoded whole. Special tokens that stand in a text are found first, as the
    library does; what is between them is encoded for itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        added = rules["added_tokens"]
        plain = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
        self.by_chunks = plain and _kinds(rules["normalizer"]) == FOLDS and _kinds(rules["pre_tokenizer"]) == SPLITS
        self.special = {t["content"]: t["id"] for t in added}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self.tokenizer.encode_special_tokens = self.by_chunks
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # of words
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = self._first()
        self.older: dict[str, bytes] = {}

    def _first(self) -> dict[str, bytes]:
        """The empty chunk, and special tokens after a blank, which no other chunk has."""
        return {"": b""} | {f" {t}": np.array([i], self.dtype).tobytes() for t, i in self.special.items()}

    def _chunks(self, text: str) -> list[str]:
        if self.specials is None or not (found := self.specials.search(text)):
            return _folded(text.replace("\n", " ")).split(" ")
        out, at = [], 0
        while found:
            out += _folded(text[at : found.start()].replace("\n", " ")).split(" ")
            out.append(f" {found[0]}")
            at = found.end()
            found = self.specials.search(text, at)
        return out + _folded(text[at:].replace("\n", " ")).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_chunks:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        chunked = [self._chunks(t or "") for t in texts]
        if len(self.kept) > CHUNKS_KEPT:
            self.kept, self.older = self._first(), self.kept  # what is met again moves on, the rest goes
        known = self.kept
        new = set().union(*chunked).difference(known)
        older = self.older
        again = [c for c in new if c in older]
        known.update((c, older[c]) for c in again)
        new.difference_update(again)
        if new:
            self._learn(new)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in chunked]
        for c in new:
            if len(c) > CHUNK_CHARS:
                del known[c]
        return out

    def _learn(self, chunks: set[str]) -> None:
        known = self.kept
        stopped = [(c, w) for c in chunks if c[-1] in STOPS and (w := c.rstrip(STOPS)).isalpha() and max(w) < "\u0100"]
        words = {w for _, w in stopped}.difference(known)
        words.update(c for c in chunks if c.isalpha() and max(c) < "\u0100")
        others = chunks.difference(words, (c for c, _ in stopped))
        others |= {c[len(w) :] for c, w in stopped}.difference(known)
        self._learn_words(list(words))
        if others:
            some = list(others)
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[c] = np.array(e.ids, self.dtype).tobytes()
        for c, w in stopped:
            known[c] = known[w] + known[c[len(w) :]]

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone have one end each, so many are encoded as one text."""
        known, step = self.kept, self.width
        lines = [words[i : i + 256] for i in range(0, len(words), 256)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * step).tolist()
            if len(ends) != len(line):
                for w, one in zip(line, self.tokenizer.encode_batch_fast(line, add_special_tokens=False), strict=True):
                    known[w] = np.array(one.ids, self.dtype).tobytes()
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(line, ends, strict=True):
                known[w] = raw[at:end]
                at = end


def _kinds(rule: dict | None) -> list[tuple]:
    """The parts of a normaliser or splitter with all that they are told, as plain values."""
    parts = (rule or {}).get("normalizers") or (rule or {}).get("pretokenizers") or ([rule] if rule else [])
    return [tuple(sorted((k, str(v)) for k, v in p.items())) for p in parts]


def _folded(text: str) -> str:
    """Lower case if that is the same sign by sign; else the text itself, and the tokenizer folds it."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=2)
def load_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SeekableWriter:
    """Writes frames to a binary stream as they come; memory holds the table of frames alone."""

    def __init__(self, out, dtype: str):
        self.out, self.dtype = out, np.dtype(dtype)
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.entries = bytearray()
        self.keys = bytearray()

    def add(self, key: int | None, raw: bytes) -> None:
        frame = self.compress(raw)
        self.out.write(frame)
        self.entries += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.keys += struct.pack("<q", NULL_ID if key is None else key)

    def close(self) -> None:
        n = len(self.keys) // 8
        index = struct.pack("<B", self.dtype.itemsize) + bytes(self.keys)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = bytes(self.entries) + struct.pack("<IBI", n, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)
        self.out.close()


class SeekableReader:
    """Reads the table at a file's end, then any frames."""

    def __init__(self, uri: str):
        system, path = arrow_fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.packed, self.raw, self.checks = (table[:, k].astype(np.int64) for k in range(3))
        index_end = size - 9 - 12 * n - 8
        index = self.file.read_at(8 * n + 1, index_end - 8 * n - 1)
        self.dtype = {2: "<u2", 4: "<u4"}[index[0]]
        self.keys = np.frombuffer(index, "<i8", n, 1)
        self.offsets = np.concatenate([[0], np.cumsum(self.packed)])
        self.decompress = zstandard.ZstdDecompressor().decompress

    def _ids(self, k: int, frame: bytes) -> np.ndarray:
        raw = self.decompress(frame, max_output_size=int(self.raw[k])) if self.raw[k] else b""
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.dtype)

    def frame(self, k: int) -> np.ndarray:
        """The ids of one document; no other frame is read."""
        return self._ids(k, self.file.read_at(int(self.packed[k]), int(self.offsets[k])))

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        k, n = 0, len(self.keys)
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + READ_BYTES, "right")) - 1)
            start = int(self.offsets[k])
            block = self.file.read_at(int(self.offsets[to]) - start, start)
            for i in range(k, to):
                at = int(self.offsets[i]) - start
                yield (None if self.keys[i] == NULL_ID else int(self.keys[i])), self._ids(i, block[at : at + int(self.packed[i])])
            k = to


def write_token_files(docs: DataFrame, folder: str, *, path: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` in ascending order of ``id_col`` and return the manifest, one row for each file.

    Null ids come first; rows of equal id follow each other in order of a hash of the text; null texts count as empty;
    an empty table makes no file. Files have names of their own for each attempt of a task and count only if they are in
    the manifest, so a repeated task does no harm. ``folder`` is a URI that pyarrow's file systems can open.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or tokenizer_path("word_bpe_49k.json")
    tie = F.xxhash64(F.col(f"`{text_col}`"))
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("k"), tie.alias("tie"), F.col(f"`{text_col}`").alias("t"))
    order = [F.asc_nulls_first("k"), F.asc("tie")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")
    return cut(map_rows(sorted_rows, _file_writer(folder, path, end_id), "part int, file string, n_docs long, n_ids long, n_bytes long"), "manifest")


def _file_writer(folder: str, path: str, end_id: int | None) -> Callable[[Iterable[tuple]], Iterator[tuple]]:
    def write(it: Iterable[tuple]) -> Iterator[tuple]:
        encoder = load_encoder(path)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        writer, uri, n_docs, n_ids = None, "", 0, 0
        part = TaskContext.get().partitionId()
        for group in _groups(it, AT_A_TIME):
            if writer is None:
                uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                system, place = arrow_fs.FileSystem.from_uri(uri)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                writer = SeekableWriter(system.open_output_stream(place, compression=None), encoder.dtype)
            for (key, _), ids in zip(group, encoder.encode([t for _, t in group]), strict=True):
                writer.add(key, ids + end)
                n_docs += 1
                n_ids += (len(ids) + len(end)) // np.dtype(encoder.dtype).itemsize
        if writer:
            writer.close()
            yield part, uri, n_docs, n_ids, sum(SeekableReader(uri).packed.tolist())

    return write


def _groups(it: Iterable[tuple], n: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    size = 0
    for r in it:
        held.append(r)
        size += len(r[1] or "")
        if len(held) >= n or size > 4 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_token_files(manifest: DataFrame, of: Callable[[bytes], object] = bytes, column: str = "ids binary") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32 bits) of each document in the files, read back.

    ``of`` and ``column`` give what is made of the ids, and its name and type, where the ids themselves aren't needed.
    The manifest has one row for each file, so the starts of the files are summed on the driver.
    """
    spark = manifest.sparkSession
    files, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["part"], r["file"], at))
        at += r["n_ids"]
    given = spark.createDataFrame(files, "part int, file string, start long").repartition(max(1, len(files)), "part")

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for _, file, start in it:
            for key, ids in SeekableReader(file):
                yield key, start, len(ids), of(ids.astype("<u4").tobytes())
                start += len(ids)

    return map_rows(given, rows, f"doc_id long, start long, n_tokens long, {column}")


def read_documents(file: str, wanted: set[int]) -> dict[int, list[int]]:
    """The ids of some documents of one file; only their frames are decompressed."""
    reader = SeekableReader(file)
    return {int(k): reader.frame(i).tolist() for i, k in enumerate(reader.keys) if int(k) in wanted}


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each row of ``documents``, from the files; nulls, ties and repeats as in :func:`write_token_files`."""
    folder = shared_dir(spark, "token-files")
    files = write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return read_token_files(files, zlib.crc32, "ids_crc32 long")
