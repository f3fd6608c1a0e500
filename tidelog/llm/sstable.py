"""Token-ID output: sorted-string tables of documents' ids, written by shard and looked up by binary search.

File, little-endian where not said otherwise:
  data blocks      entries in key order: u16 bytes shared with the key before, u16 further key bytes, u32 value bytes, those key bytes, value;
                   a block's first key is whole
  index block      for each data block: u16 key bytes, its first key, u64 offset, u32 bytes, u32 entries
  Bloom block      bits as bytes; a key's bits are (a + i * b) mod bits, where a and b are the halves of its blake2b-128
  footer           u64 index offset, u64 index bytes, u64 Bloom offset, u64 Bloom bytes, u64 Bloom bits, u32 hashes, u64 entries, u64 ids, magic
Key of a long id: one byte 1, then the id big-endian with its sign bit flipped, so bytes sort as ids do. A null id is the one byte 0 and comes first.
Value: the document's ids as u16, the end id among them.

The tokenizer's vocabulary must have fewer than 65,536 ids.
A file has a name of its attempt and counts once its row is in the list of files, so a repeated or lost attempt leaves at most a file that nobody lists;
token_ids() deletes those. Folders are resolved as Spark does, by its default file system; the workers write through pyarrow (file, hdfs, s3, gs, abfs).
Rows are dealt by ranges of id, then of a hash of the text and of a number of the row, so one id that very many rows have is split over files.

Results: null text is empty and has the end id alone. Repeated ids stay next to each other, in order of a hash of their texts. Empty tables give no file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import parts, saved, scratch_root, tuned

END_ID = 0
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
MAGIC = b"TLSSTBL1"
FOOTER = struct.Struct("<QQQQQIQQ8s")
ENTRY, INDEX = struct.Struct("<HHI"), struct.Struct("<QII")
#: Words in each of the two generations whose ids a worker remembers, the longest of them, and how many are tokenized in one call.
CACHE_WORDS, CACHE_LENGTH, CALL_WORDS = 600_000, 40, 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models have for each byte: printable Latin-1 as it is, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """The tokenizer, with the ids of words remembered: where white space stands alone, its pieces never reach over the start of a word.

    Words are known by themselves when a space comes before, after LINE when a line end does, after TEXT at the start of a text. Texts with empty lines,
    or with white space beside a space or after a line's end, are tokenized whole.
    """

    LINE, TEXT = "\n", "\0"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # words of letters are one piece each: the model gets them with no search for pieces, in its letters for bytes
        self.table = _byte_letters()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(self.table[10], "isolated")
        self.line_end, *marks = self.ids(["\n", ".", ","])
        self.marks = dict(zip(".,", marks, strict=True))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lines(self, words: list[str], letters: bool = False) -> list[bytes]:
        """Many words in one call, on a line each; the ids come apart at the line ends. letters: words of a space and letters only."""
        if len(self.line_end) != 2:
            return self.ids(words)
        text = "\n".join(words)
        if letters:
            ids = np.array(self.model.encode_batch_fast([text.encode().decode("latin-1").translate(self.table)], add_special_tokens=False)[0].ids, "<u2")
        else:
            ids = np.frombuffer(self.ids([text])[0], "<u2")
        cut = np.flatnonzero(ids == np.frombuffer(self.line_end, "<u2")[0])
        if len(cut) != len(words) - 1:
            return self.ids(words)
        raw, begin, end = ids.tobytes(), [0, *(2 * cut + 2).tolist()], [*(2 * cut).tolist(), 2 * len(ids)]
        return [raw[i:j] for i, j in zip(begin, end, strict=True)]

    def _plain(self, word: str) -> str:
        return word[1:] if word[0] in (self.LINE, self.TEXT) else " " + word

    def learn(self, words: set[str]) -> None:
        """Adds words that aren't known; those of the older generation come back from there."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh, ended = set(), []
        for w in words:
            if (ids := older.get(w)) is not None:
                known[w] = ids
            elif w[-1] in ".," and w[-2:-1].isalpha():
                ended.append(w)  # the mark is a piece of its own
                stem = w[:-1]
                if stem in older:
                    known[stem] = older[stem]
                elif stem not in known:
                    fresh.add(stem)
            else:
                fresh.add(w)
        todo = [w for w in fresh if w.isalpha()]
        for i in range(0, len(todo), CALL_WORDS):
            some = todo[i : i + CALL_WORDS]
            known.update(zip(some, self.lines([" " + w for w in some], letters=True), strict=True))
        todo = [w for w in fresh if not w.isalpha()]
        for i in range(0, len(todo), CALL_WORDS):
            some = todo[i : i + CALL_WORDS]
            ids = self.lines([self._plain(w) for w in some])
            known.update((w, self.line_end + x if w[0] == self.LINE else x) for w, x in zip(some, ids, strict=True))
        for w in ended:
            known[w] = known[w[:-1]] + self.marks[w[-1]]

    def _keys(self, text: str) -> list[str] | None:
        keys: list[str] = []
        for line in text.split("\n"):
            words = line.split(" ")
            if "" in words or words[0][0].isspace() or self.TEXT in line:
                return None
            words[0] = self.LINE + words[0]
            keys += words
        keys[0] = self.TEXT + keys[0][1:]
        return keys

    def encode(self, texts: list[str]) -> list[bytes]:
        """u16 ids of each text."""
        split = [self._keys(t) for t in texts]
        whole = iter(self.ids([t for t, keys in zip(texts, split, strict=True) if keys is None]))
        found = [next(whole) if keys is None else list(map(self.known.get, keys)) for keys in split]
        gaps: list[tuple[list, list, list[int]]] = []
        new: set[str] = set()
        for keys, ids in zip(split, found, strict=True):
            if keys is not None and None in ids:
                at, i = [], -1
                for _ in range(ids.count(None)):
                    i = ids.index(None, i + 1)
                    at.append(i)
                    new.add(keys[i])
                gaps.append((keys, ids, at))
        self.learn(new)
        for keys, ids, at in gaps:
            for i in at:
                ids[i] = self.known[keys[i]]
        for w in new:
            if len(w) > CACHE_LENGTH:
                self.known.pop(w, None)
                self.known.pop(w[:-1], None)
        return [x if isinstance(x, bytes) else b"".join(x) for x in found]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process: it and what it remembers serve all of the worker's tasks."""
    return Encoder(path)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(hashes)]


class Writer:
    """Writes entries given in key order to a binary stream; holds one block, the sparse index and the keys' hashes."""

    def __init__(self, out):
        self.out, self.at, self.block, self.last = out, 0, bytearray(), b""
        self.first, self.in_block, self.entries, self.ids = b"", 0, 0, 0
        self.index, self.hashes = bytearray(), bytearray()

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        if self.block and len(self.block) + len(value) > BLOCK_BYTES:
            self._close_block()
        shared = 0
        if self.in_block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.hashes += hashlib.blake2b(key, digest_size=16).digest()
        self.last, self.in_block, self.entries, self.ids = key, self.in_block + 1, self.entries + 1, self.ids + len(value) // 2

    def _close_block(self) -> None:
        self.index += struct.pack("<H", len(self.first)) + self.first + INDEX.pack(self.at, len(self.block), self.in_block)
        self._put(bytes(self.block))
        self.block, self.in_block = bytearray(), 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.block:
            self._close_block()
        index_at = self.at
        self._put(bytes(self.index))
        bits = max(64, -(-self.entries * BLOOM_BITS_PER_KEY // 8) * 8)
        a, b = np.frombuffer(self.hashes, "<u8").reshape(-1, 2).T
        filled = np.zeros(bits, np.uint8)
        for i in range(BLOOM_HASHES):
            filled[[(x + i * (y | 1)) % bits for x, y in zip(a.tolist(), b.tolist(), strict=True)]] = 1
        bloom_at = self.at
        self._put(np.packbits(filled).tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits // 8, bits, BLOOM_HASHES, self.entries, self.ids, MAGIC))


class Reader:
    """Reads a table from a file that can seek."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        if end < FOOTER.size:
            raise ValueError("not a table: too short")
        self.index_at, index_bytes, self.bloom_at, self.bloom_bytes, self.bits, self.hashes, self.entries, self.ids, magic = FOOTER.unpack(self._get(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table: wrong magic")
        index, i = self._get(self.index_at, index_bytes), 0
        self.firsts, self.blocks = [], []
        while i < len(index):
            (n,) = struct.unpack_from("<H", index, i)
            self.firsts.append(index[i + 2 : i + 2 + n])
            self.blocks.append(INDEX.unpack_from(index, i + 2 + n))
            i += 2 + n + INDEX.size
        self._bloom: bytes | None = None

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, _ = self.blocks[i]
        data, x, key = self._get(at, size), 0, b""
        while x < len(data):
            shared, more, n = ENTRY.unpack_from(data, x)
            x += ENTRY.size
            key = key[:shared] + data[x : x + more]
            yield key, data[x + more : x + more + n]
            x += more + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)

    def may_have(self, key: bytes) -> bool:
        if self._bloom is None:
            self._bloom = self._get(self.bloom_at, self.bloom_bytes)
        return bool(self.bits) and all(self._bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits, self.hashes))

    def get(self, key: bytes) -> list[bytes]:
        """Values of the key, several where the id was repeated: Bloom filter, then binary search in the index, then its blocks."""
        if not self.may_have(key):
            return []
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key:  # a repeated key may have begun in the block before
            i -= 1
        out = []
        for j in range(i, len(self.blocks)):
            if self.firsts[j] > key:
                break
            out.extend(v for k, v in self._block(j) if k == key)
        return out


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme and host that Spark would use for it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


def _open(path: str):
    scheme, rest = path.split(":", 1)
    fs, where = pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}")
    return fs, where


def write_table(path: str, entries: Iterable[tuple[bytes, bytes]]) -> tuple[int, int]:
    """Writes a table of entries in key order; gives the numbers of entries and ids."""
    fs, where = _open(path)
    with fs.open_output_stream(where) as out:
        w = Writer(out)
        for key, value in entries:
            w.add(key, value)
        w.close()
    return w.entries, w.ids


def open_table(path: str) -> Reader:
    fs, where = _open(path)
    return Reader(fs.open_input_file(where))


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenizes all texts and writes one table for each range of ids. Gives shard, path, entries and ids of each file."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    tuned(spark)
    folder = qualified(spark, folder)
    fs, where = _open(folder)
    fs.create_dir(where, recursive=True)
    end = np.array([end_id], "<u2").tobytes()
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()

        def entries():
            for b in batches:
                ids, texts = b.column("id").to_pylist(), b.column("text")
                for i in range(0, len(ids), 64):
                    values = encoder.encode(["" if t is None else t for t in texts.slice(i, 64).to_pylist()])
                    yield from ((key_of(d), v + end) for d, v in zip(ids[i : i + 64], values, strict=True))

        rows = entries()
        first = next(rows, None)
        if first is not None:
            path = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.sst"

            def all_rows():
                yield first
                yield from rows

            n, m = write_table(path, all_rows())
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path]), pa.array([n]), pa.array([m])], names=["shard", "path", "entries", "ids"])

    keys = [F.col("id").asc_nulls_first(), "h"]
    narrow = narrow.withColumn("h", F.xxhash64("text"))
    ordered = narrow.withColumn("r", F.monotonically_increasing_id()).repartitionByRange(parts(narrow), *keys, "r").select("id", "text", "h").sortWithinPartitions(*keys).select("id", "text")
    return ordered.mapInArrow(write, "shard long, path string, entries long, ids long")


def read_ids(files: DataFrame, tokens: bool = False) -> DataFrame:
    """Documents from the files of write_ids, in its rows: doc_id, start, n_tokens and ids_crc32; with tokens also the ids.

    start: ids of all documents before. It needs one number a file, which the driver sums.
    """
    spark = files.sparkSession
    known = sorted(tuple(r) for r in files.select("shard", "path", "ids").collect())
    at, rows = 0, []
    for _, path, n in known:
        rows.append((path, at))
        at += n
    table = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out):
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if tokens:
                cols.append(pa.array([r[4] for r in out], pa.list_(pa.int32())))
                names.append("token_ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                out, start = [], base
                for key, value in open_table(path):
                    ids = np.frombuffer(value, "<u2").astype("<u4")
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if tokens else None))
                    start += len(ids)
                    if len(out) == 1000:
                        yield batch(out)
                        out = []
                yield batch(out)

    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * tokens)


def token_ids(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the files and reads them back; folder: where they go, else a new one in the shared folder."""
    folder = folder or f"{scratch_root(docs.sparkSession)}/sst-{uuid.uuid4().hex}"
    files = saved(write_ids(docs, folder, **options), "files")
    fs, where = _open(qualified(docs.sparkSession, folder))
    listed = {r["path"].rsplit("/", 1)[1] for r in files.select("path").collect()}
    for f in fs.get_file_info(pafs.FileSelector(where)):
        if f.base_name.endswith(".sst") and f.base_name not in listed:
            fs.delete_file(f.path)
    return read_ids(files)
