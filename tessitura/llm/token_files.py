"""Token ids in seekable binary files (operator 6).

A file is a run of independent zstandard frames, each with the ids of some documents,
and two skippable frames that any zstandard decoder passes over: an index of the
documents, and at last a seek table with the compressed size, the size and the checksum
of every frame.  A reader takes the tail of a file, looks a document up and decompresses
the one frame that holds it.

Fixed values of the public seekable format: skippable magic 0x184D2A5E, footer magic
0x8F92EAB1, the checksum flag 0x80, and as checksum the low 32 bits of XXH64.  The
index has a skippable magic of its own, 0x184D2A50.

Texts are tokenised by the public library.  A tokenizer that lower-cases, splits at white
space and drops it is asked a piece at a time, so that a piece is encoded once and looked
up again; any other one gets whole texts.  Ids go into the file in ascending doc_id order; files hold ranges of
doc_id and their names sort as these.  A file is written under another name and moved
into place, so a task that runs again replaces what it had written.

Defined results: a null text gives the end id alone; rows with a null doc_id come first;
rows that share a doc_id, or have none, stand in the order of the crc32 of their texts, and the ties of
that in the order of the texts, and may be dealt to several files; a text of any length is encoded as
a whole and is in one frame; an empty table gives no rows.  Of docs only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.blocks import Words, buckets_for, chunks, shared_folder, tokenise

SKIPPABLE_SEEK, SKIPPABLE_INDEX = 0x184D2A5E, 0x184D2A50
FOOTER, CHECKSUM_FLAG = 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 20
LEVEL = 3
CACHE = 1_500_000  # pieces whose ids a worker keeps, 20 bytes each or so
END_ID = 2


class SeekableWriter:
    """Frames of documents into a binary file object."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.frames: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.size = 0
        self.index: list[tuple[int, int, int, int]] = []  # doc_id, has id, frame, number of ids

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.size and self.size + 4 * len(ids) > self.frame_bytes:
            self._frame()
        self.index.append((doc_id or 0, int(doc_id is not None), len(self.frames), len(ids)))
        self.pending.append(ids.astype("<u4").tobytes())
        self.size += 4 * len(ids)

    def _frame(self) -> None:
        if self.pending:
            data = b"".join(self.pending)
            packed = self.codec.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self._frame()
        index = np.array(self.index, "<i8").reshape(-1, 4)
        body = self.codec.compress(index.tobytes())
        self.out.write(struct.pack("<III", SKIPPABLE_INDEX, 8 + len(body), len(index)) + struct.pack("<I", xxhash.xxh64_intdigest(body) & 0xFFFFFFFF) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<III", 16 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)  # the index, empty to a decoder
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.frames) + 1, CHECKSUM_FLAG, FOOTER))


class SeekableReader:
    """Reads the documents of one file; only the frames asked for are decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER or flags & CHECKSUM_FLAG == 0:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.frames = table[:-1]
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        head = struct.unpack("<IIII", self._at(int(self.starts[-2]), 16))
        body = self._at(int(self.starts[-2]) + 16, head[1] - 8)
        if head[0] != SKIPPABLE_INDEX or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != head[3]:
            raise ValueError("the index of documents is damaged")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=32 * head[2]), "<i8").reshape(-1, 4) if head[2] else np.zeros((0, 4), np.int64)
        self.n_tokens = self.index[:, 3]
        before = np.concatenate([[0], np.cumsum(self.n_tokens)])
        firsts = np.searchsorted(self.index[:, 2], np.arange(len(self.frames)))
        self.within = before[:-1] - before[firsts][self.index[:, 2]] if len(self.index) else before[:0]
        self.start = before[:-1]
        self._cached = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self._cached[0] != k:
            packed, size, check = self.frames[k].tolist()
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size) if size else b""
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self._cached = (k, data)
        return self._cached[1]

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        return int(self.index[i, 0]) if self.index[i, 1] else None

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        at = int(self.within[i])
        return np.frombuffer(self.frame(int(self.index[i, 2])), "<u4")[at : at + int(self.n_tokens[i])]

    def find(self, doc_id: int) -> list[int]:
        """The places of a document, by bisection: doc_ids ascend in a file."""
        known = self.index[:, 1] == 1
        first = int(np.argmax(known)) if known.any() else len(known)
        a, b = np.searchsorted(self.index[first:, 0], [doc_id, doc_id + 1]) + first
        return list(range(int(a), int(b)))


#: What a tokenizer must do before its model for texts to be encoded by pieces: fixed values of the public file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Lower-case words of letters up to U+00FF: neither normalised nor split.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: The byte-level alphabet: a printable byte is its own character, the others follow from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def pieces(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words cut further where ASCII letters meet other ASCII characters, and a hash of each piece.

    A word with an apostrophe or ``<|`` is one piece, and its case counts: it may hold
    a contraction or a special token.
    """
    w = tokenise(texts)
    raw = w.raw
    n = len(raw)
    odd = np.zeros(n, bool)
    odd[raw == 39] = True
    odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
    sums = np.concatenate([[0], np.cumsum(odd)])
    special = sums[w.ends] > sums[w.starts]
    inside = np.zeros(n + 1, np.int8)  # 1 from the second byte of a word that may be cut
    inside[w.starts[~special] + 1] += 1
    inside[w.ends[~special]] -= 1
    letter = _LETTER[raw]
    cut = np.zeros(n, bool)
    cut[1:] = (letter[1:] != letter[:-1]) & (raw[1:] < 128) & (raw[:-1] < 128)
    cuts = np.flatnonzero(cut & (np.cumsum(inside[:-1]) > 0))
    starts, ends = np.sort(np.concatenate([w.starts, cuts])), np.sort(np.concatenate([w.ends, cuts]))
    first = np.searchsorted(starts, w.offsets)
    own = Words(raw, w.offsets, starts, ends, np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first)), first)
    h = own.hashes(fold=True)
    if special.any():
        k = np.searchsorted(starts, w.starts[special])
        h[k] = w.hashes(fold=False)[special] ^ np.uint64(0x5DEECE66D)
    return own, h


class IdCache:
    """Ids of pieces by their hashes, in flat arrays: about 20 bytes for each piece."""

    def __init__(self):
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)) for _ in range(2)]

    def missing(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for known, *_ in self.levels:
            if len(known):
                out &= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
        return out

    def add(self, h: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        """h ascends and holds nothing that is known."""
        if sum(len(x[0]) for x in self.levels) + len(h) > CACHE:
            self.__init__()
        self.levels[1] = self._merge(self.levels[1], (h, np.cumsum(lengths) - lengths, lengths, flat))
        if len(self.levels[1][0]) > 20_000 + len(self.levels[0][0]) // 4:
            self.levels = [self._merge(*self.levels), (h[:0], lengths[:0], lengths[:0], flat[:0])]

    @staticmethod
    def _merge(a, b):
        h = np.concatenate([a[0], b[0]])
        order = np.argsort(h, kind="stable")
        return h[order], np.concatenate([a[1], b[1] + len(a[3])])[order], np.concatenate([a[2], b[2]])[order], np.concatenate([a[3], b[3]])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, lengths, flat): where the ids of each known hash are in flat."""
        flat = np.concatenate([x[3] for x in self.levels])
        begins, lengths, base = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), 0
        for known, own_begins, own_lengths, own_flat in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                begins[hit], lengths[hit] = own_begins[at[hit]] + base, own_lengths[at[hit]]
            base += len(own_flat)
        return begins, lengths, flat


class Encoder:
    """Ids of texts.  A tokenizer that splits at white space and drops it is asked for each piece of a text once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        pre = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.by_piece = (
            said.get("normalizer") == _NORMALIZER and pre[0] == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
            and len(pre) == 2 and level.items() <= pre[1].items() and all(re.fullmatch(r"<\|.*\|>", t["content"]) for t in said["added_tokens"])
        )
        self.cache = IdCache()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 1024) for e in self.tokenizer.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)]

    def _encode_pieces(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids)."""
        model, out, rest = self.tokenizer.model, [], []
        for piece in found:
            text = piece.decode()
            if b"<|" not in piece:
                text = text.lower() if text.isascii() or _PLAIN.fullmatch(text.lower()) and len(text.lower()) == len(text) else text
            if _PLAIN.fullmatch(text):
                out.append([t.id for t in model.tokenize(text.encode().decode("latin-1").translate(_ALPHABET))])
            else:
                rest.append((len(out), text))
                out.append([])
        for (i, _), ids in zip(rest, self._encode([t for _, t in rest]), strict=True):
            out[i] = ids
        lengths = np.array([len(x) for x in out], np.int64)
        return lengths, np.fromiter((i for x in out for i in x), np.uint32, int(lengths.sum()))

    def __call__(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        tail = np.array([end_id], np.uint32)
        if not self.by_piece:
            return [np.array([*ids, end_id], np.uint32) for ids in self._encode([t or "" for t in texts.to_pylist()])]
        words, h = pieces(texts)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.cache.missing(unique))
        if len(new) and len(new) + sum(len(x[0]) for x in self.cache.levels) > CACHE:
            self.cache = IdCache()
            new = np.arange(len(unique))
        if len(new):
            raw = words.raw
            found = [raw[a:b].tobytes() for a, b in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)]
            self.cache.add(unique[new], *self._encode_pieces(found))
        begins, lengths, flat = self.cache.find(unique)
        each = lengths[inverse]
        bounds = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(begins[inverse] - bounds[:-1], each) + np.arange(bounds[-1])]
        cut = bounds[words.first]
        return [np.concatenate([ids[a:b], tail]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python process, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open_fs(uri: str):
    uri = re.sub("^s3[an]://", "s3://", uri)  # as Spark names it
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Writes docs(doc_id, text) to files in folder; one row for each: file, n_docs, n_tokens.

    The rows are the manifest.  Write or collect them once: this runs the job.
    """
    n = files or buckets_for(docs, 16 << 20, least=8)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, writer = None, None, None
        fs, root = _open_fs(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.zst"
        temporary = f"{root}/_{uuid.uuid4().hex}"
        for batch in chunks(batches):
            if writer is None:
                encoder = encoder_of(tokenizer)
                out = fs.open_output_stream(temporary, compression=None)
                writer = SeekableWriter(out)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1), end_id), strict=True):
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"file": [Path(name).name], "n_docs": [len(writer.index)], "n_tokens": [sum(x[3] for x in writer.index)]})

    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc).repartitionByRange(n, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "text")
    fs, root = _open_fs(folder)
    fs.create_dir(root, recursive=True)
    return ordered.mapInArrow(write, "file string, n_docs long, n_tokens long")


def read_token_files(manifest: DataFrame, folder: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (binary, little-endian) of all documents of the manifest, or of those named."""
    wanted = None if doc_ids is None else sorted(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader = SeekableReader(source)
                    places = range(len(reader)) if wanted is None else [i for d in wanted for i in reader.find(d)]
                    for at in range(0, len(places), 512):
                        own = places[at : at + 512]
                        data = [reader.ids(i).tobytes() for i in own]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([reader.doc_id(i) for i in own], pa.int64()), pa.array([base + int(reader.start[i]) for i in own], pa.int64()),
                                pa.array([int(reader.n_tokens[i]) for i in own], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(data, pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    # one row for each file: the running sum sees no documents
    placed = manifest.select("file", (F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens")).alias("base"))
    return placed.repartition(max(8, manifest.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tessitura-tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    path = f"{folder}-manifest"
    manifest.write.parquet(path)
    return read_token_files(spark.read.parquet(path), folder).drop("ids")
