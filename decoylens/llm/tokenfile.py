"""Token-id files: one zstandard frame per document, a trailing seek table and a checksum per frame.

A shard file is

* for each document, an independent zstandard frame of its ids as little-endian unsigned 32-bit numbers, end id included;
* a skippable frame (magic 0x184D2A50) with the document ids: a byte (1: has an id) and a signed 64-bit number each;
* a seek table in the layout of zstandard's seekable format: a skippable frame (magic 0x184D2A5E) with compressed size,
  size and checksum (low 32 bits of XXH64) per frame, the frame of the ids as the last entry with size 0, then the
  number of frames, the descriptor 0x80 and the magic 0x8F92EAB1.

Any zstandard reader that knows seek tables can read it. A reader gets the table from the end of the file, and
decompresses the frames of the documents it wants and no other.

Documents are dealt to shards by ranges of the order, so shard numbers follow it. Each task streams one shard, writes
it under a name of its own attempt and renames it at the end: a repeated or lost task leaves whole files only. The
folder is reached by ``pyarrow.fs`` from its address, which must be one that all executors share.

Texts are cut into pieces at single blanks between other characters and at single line breaks, where byte-level
pre-tokenising always cuts, and the tokenizers library encodes each distinct piece (without the signs it may end in,
another place of certain cuts); a bounded cache keeps them.

Defined cases: a null or empty text is the end id alone; rows with a null id come first and keep their null; rows
that repeat an id follow one another in the order of their texts; an empty table gives no file and no rows; other
columns do not matter. A document may have 2^30 ids at most.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path
from .tables import stored

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Pieces in each of the two generations of a worker's cache, at about 200 bytes each.
CACHE_PIECES, CACHE_PIECE_CHARS = 300_000, 64
#: ASCII signs but the apostrophe, which may begin a token with letters behind it, and those of special tokens.
SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
IDS_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
BATCH_CHARS, BATCH_DOCS = 1 << 22, 4096
_RUN = re.compile(r"\s\s")
#: White space but the blank and the line break.
OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters in every version of Unicode.
_LATIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_level() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as they are, the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LEVEL = _byte_level()
BLANK = BYTE_LEVEL[32]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def has_run(text: str) -> bool:
    """Whether one white space follows another; texts with none but blanks and line breaks need no pattern."""
    if any(pair in text for pair in ("  ", "\n\n", " \n", "\n ")):
        return True
    return any(space in text for space in OTHER_SPACE) and _RUN.search(text) is not None


def pieces(text: str) -> list[str]:
    """A text in parts that pre-tokenise alone as they do together."""
    if not text:
        return []
    if "\0" in text or has_run(text):
        return _CUT.split(text)
    parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return parts[not parts[0] : len(parts) - (not parts[-1])]


def cut(texts: Sequence[str | None]) -> pa.ListArray:
    """The ``pieces`` of every text, and perhaps empty ones."""
    texts = [t or "" for t in texts]
    if any("\0" in t for t in texts):
        return pa.array(map(pieces, texts), pa.list_(pa.large_string()))
    marked = ["\0".join(_CUT.split(t)) if has_run(t) else t.replace(" ", "\0 ").replace("\n", "\0\n\0") for t in texts]
    return pc.split_pattern(pa.array(marked, pa.large_string()), "\0")


class Generations(dict):
    """A bounded cache in two generations: what is asked for moves to the young one, so common pieces outlive rare ones."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, piece: str) -> bytes:
        self[piece] = code = self.old[piece]
        return code

    def turn(self) -> None:
        """The young generation becomes the old one if it is full."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as bytes; built once per worker and path."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed = [struct.pack("<I", i) for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.known = Generations(CACHE_PIECES)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Encode pieces that are not known. Signs after a final letter are always a token or tokens of their own."""
        stems = [p.rstrip(SIGNS) for p in new]
        signed = {p: s for p, s in zip(new, stems) if len(s) < len(p) and s[-1:].isalpha()}
        more = {*signed.values(), *(p[len(s) :] for p, s in signed.items())}.difference(new)
        stems = [p for p in new if p not in signed] + [p for p in more if p not in self.known and p not in self.known.old]
        # A blank and letters are one pre-token, which the library's model encodes without the steps around it.
        tokenize, packed, latin = self.model.tokenize, self.packed, _LATIN.fullmatch
        shown = lambda p: p.replace(" ", BLANK) if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LEVEL)
        codes = {p: b"".join([packed[t.id] for t in tokenize(shown(p))]) for p in stems if latin(p)}
        other = [p for p in stems if p not in codes]
        codes.update((p, b"".join([packed[i] for i in e.ids])) for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)))
        of = lambda p: codes[p] if p in codes else self.known[p]
        codes.update([(p, of(stem) + of(p[len(stem) :])) for p, stem in signed.items()])
        self.known.update((p, c) for p, c in codes.items() if len(p) <= CACHE_PIECE_CHARS)
        return codes

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each distinct piece of the texts is looked up once; its ids then go to all its places at once."""
        end = struct.pack("<I", END_ID)
        self.known.turn()
        lists = cut(texts)
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        missing = [i for i, code in enumerate(found) if code is None]
        codes = self._learn([names[i] for i in missing if names[i] not in self.known.old])
        for i in missing:
            found[i] = codes[names[i]] if names[i] in codes else self.known[names[i]]
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        place = coded.indices.to_numpy()
        ends = np.cumsum(sizes[place])
        rows = np.repeat((np.cumsum(sizes) - sizes)[place] - (ends - sizes[place]), sizes[place])
        placed = ids[rows + np.arange(len(rows))].tobytes()
        bounds = (4 * np.concatenate([[0], ends])[lists.offsets.to_numpy()]).tolist()
        return [placed[a:b] + end for a, b in zip(bounds, bounds[1:])]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class ShardWriter:
    """Writes frames one after another, then the tables."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.entries, self.ids, self.n_tokens, self.size = bytearray(), bytearray(), 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.packer.compress(ids)
        self.stream.write(frame)
        self.entries += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.ids += struct.pack("<bq", doc_id is not None, doc_id or 0)
        self.n_tokens += len(ids) // 4
        self.size += len(frame)

    def close(self) -> None:
        self.stream.write(struct.pack("<II", IDS_MAGIC, len(self.ids)) + self.ids)
        self.entries += struct.pack("<III", len(self.ids) + 8, 0, 0)
        footer = struct.pack("<IBI", len(self.entries) // 12, 0x80, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(self.entries) + 9) + self.entries + footer)
        self.stream.close()


class ShardReader:
    """Random access to one shard. ``documents`` lists (id or None, number of ids) without decompressing anything."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("not a token shard: no seek table at its end")
        source.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        source.seek(int(self.offsets[frames - 1]) + 8)
        kinds = np.dtype([("has", "i1"), ("id", "<i8")])
        own = np.frombuffer(source.read(int(self.table[-1, 0]) - 8), kinds)
        self.documents = [(int(i) if has else None, int(n)) for (has, i), n in zip(own, self.table[:-1, 1] // 4)]

    def read(self, number: int) -> np.ndarray:
        """The ids of the document at a place of ``documents``; its checksum is verified."""
        import xxhash

        packed, size, checksum = map(int, self.table[number])
        if self.source.tell() != self.offsets[number]:
            self.source.seek(int(self.offsets[number]))
        data = self.unpacker.decompress(self.source.read(packed))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return np.frombuffer(data, "<u4")


MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def write(docs: DataFrame, order: Sequence[Column] | None = None, shards: int | None = None, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents; one row per shard file. Order: by ``doc_id`` unless other columns are given."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, tokenizer = folder or scratch_path(spark, "token-shards"), tokenizer or tokenizer_path()

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task, writer = TaskContext.get(), None
        own = f"{root}/.attempt-{task.taskAttemptId()}"
        for batch in batches:
            if writer is None and len(batch):
                store.create_dir(root)
                writer = ShardWriter(store.open_output_stream(own))
            ids, part, chars, first = batch.column("doc_id").to_pylist(), [], 0, 0
            for i, text in enumerate(batch.column("text")):
                part.append(text.as_py())
                chars += len(part[-1] or "")
                if chars >= BATCH_CHARS or i == len(ids) - 1:
                    for doc_id, code in zip(ids[first : i + 1], encoder(tokenizer).encode(part)):
                        writer.add(doc_id, code)
                    part, chars, first = [], 0, i + 1
        if writer is None:
            return
        writer.close()
        path = f"shard-{task.partitionId():06d}.tokens.zst"
        store.move(own, f"{root}/{path}")
        row = [task.partitionId(), f"{folder}/{path}", len(writer.ids) // 9, writer.n_tokens, writer.size]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    order = list(order or [F.col("doc_id").asc_nulls_first()])
    rows = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return stored(rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(write_shard, MANIFEST), "token-manifest")


def read(files: DataFrame, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    With ``doc_ids`` only those are decompressed and returned.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as source:
                    shard, start, out = ShardReader(source), row["base"], []
                    for number, (doc_id, n) in enumerate(shard.documents):
                        if wanted is None or doc_id in wanted:
                            ids = shard.read(number)
                            out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), row["shard"]))
                        start += n
                        if len(out) == BATCH_DOCS or number == len(shard.documents) - 1:
                            columns = zip(*out) if out else [[]] * 5
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
                            out = []

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = files.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    shards = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(shards).mapInArrow(read_shard, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
