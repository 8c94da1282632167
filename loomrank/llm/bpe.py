"""BPE encoding and decoding over a distinct-word table.

Texts are split into the pre-tokens of the byte-level tokenizer, every distinct pre-token of the corpus is
encoded once, and its ids are joined back to the places where it stands. Decoding joins ids to the pieces
of the vocabulary (a table of fixed size, which is broadcast). One row for each position would shuffle the
corpus many times over, so a document travels as the packed word numbers of its chunk (one to two bytes a
word), and a chunk's words travel once, packed by hash bucket; all packs of a bucket meet where its distinct
words are encoded. Each pack's distinct ids are joined to their pieces on the way back to the chunk, and a
document's text is put together from the joined pieces by the order of its ids.

Results for odd input: a null text counts as empty, has no ids and decodes to the empty text; strings of
added tokens in a text become their ids, as the tokenizers library does; repeated rows are encoded each;
an empty table gives an empty result; other columns are ignored. A text longer than a chunk is a chunk of
its own.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import give_back, written_by

#: UTF-8 bytes of text that one chunk gathers; bounds the memory of every task
CHUNK_BYTES = 16 << 20
#: Buckets of distinct words at least, and UTF-8 bytes of text a bucket more is for.
BUCKETS, BUCKET_BYTES = 256, 4 << 30

#: The pre-token pattern of the byte-level tokenizer family that ``byte_bpe_50k.json`` belongs to.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Pre-tokens of a text: added tokens first (leftmost, longest), the pattern between them.

    Characters that this Python's Unicode tables don't know may be letters to one library and not to the
    other; a text with such a character is split by the tokenizers library itself.
    """

    def __init__(self, tokenizer_path: str):
        self.path = tokenizer_path
        self.known: dict[str, bool] = {}
        self.own = None
        with open(tokenizer_path, encoding="utf-8") as f:
            added = sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.find = regex.compile(PRE_TOKEN).findall

    def _settled(self, text: str) -> bool:
        if text.isascii():
            return True
        for c in set(text):
            if c not in self.known:
                self.known[c] = unicodedata.category(c) != "Cn"
            if not self.known[c]:
                return False
        return True

    def _plain(self, text: str) -> list[str]:
        if self._settled(text):
            return self.find(text)
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if self.added is None or self.added.search(text) is None:
            return self._plain(text)
        out, upto = [], 0
        for m in self.added.finditer(text):
            out += self._plain(text[upto : m.start()])
            out.append(m.group())
            upto = m.end()
        return out + self._plain(text[upto:])


def piece_rows(tokenizer_path: str) -> list[tuple[int, bytearray]]:
    """(id, bytes of its piece) for each entry of the vocabulary."""
    with open(tokenizer_path, encoding="utf-8") as f:
        data = json.load(f)
    alphabet = _byte_alphabet()
    added = {t["id"]: t["content"] for t in data["added_tokens"]}
    rows = [(i, bytearray(alphabet[c] for c in token)) for token, i in data["model"]["vocab"].items() if i not in added]
    return rows + [(i, bytearray(content.encode())) for i, content in added.items()]


def pieces(spark, tokenizer_path: str) -> DataFrame:
    """(id, piece binary); its number of rows is fixed by the tokenizer file."""
    ids, spelled = zip(*piece_rows(tokenizer_path))
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array(map(bytes, spelled), pa.binary())}))


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed; small numbers cost about a byte."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def _unpack_words(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    stops = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 * (n + 1)).tolist()
    return [raw[i:j] for i, j in zip([4 * (n + 1), *stops], stops)]


def _split(tokenizer_path: str, chunk_bytes: int, buckets: int, key_type: pa.DataType):
    """Rows of two kinds a chunk: a document with its word numbers, and the words of a hash bucket.

    Words are numbered by falling frequency within the chunk. A bucket row holds the numbers of its words
    (as differences, rising) and the words in that order.
    """
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("slots", pa.binary()), ("words", pa.binary()), ("doc_id", key_type), ("payload", pa.binary())])

    def chunk_rows(chunk: int, ids: list, docs: list[np.ndarray], vocab: dict[str, int]):
        words = [w.encode("utf-8", "replace") for w in vocab]
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        rank = np.empty(len(words), dtype=np.int64)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank[order] = np.arange(len(words))
        payload = [_pack(rank[d]) for d in docs]
        home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))[order]
        by_bucket = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[by_bucket], prepend=-1, append=buckets))
        parts = [by_bucket[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        slots = [_pack(np.diff(p, prepend=0)) for p in parts]
        blobs = [_pack_words([words[order[i]] for i in p]) for p in parts]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array([int(home[p[0]]) for p in parts], pa.int32()), pa.array(slots, pa.binary()), pa.array(blobs, pa.binary()), pa.nulls(n, key_type), pa.nulls(n, pa.binary())], schema=schema)
        n = len(docs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(ids, key_type), pa.array(payload, pa.binary())], schema=schema)

    def split(batches):
        splitter = Splitter(tokenizer_path)
        chunk = TaskContext.get().partitionId() << 32
        ids, docs, size, vocab = [], [], 0, defaultdict()
        vocab.default_factory = vocab.__len__
        for batch in batches:
            for key, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.binary_length(batch.column(1)).to_pylist()):
                ids.append(key)
                docs.append(np.array(list(map(vocab.__getitem__, splitter.words(text or ""))), dtype=np.int32))
                size += n or 0
                if size >= chunk_bytes:
                    yield from chunk_rows(chunk, ids, docs, vocab)
                    chunk += 1
                    ids, docs, size, vocab = [], [], 0, defaultdict()
                    vocab.default_factory = vocab.__len__
                    give_back()
        if ids:
            yield from chunk_rows(chunk, ids, docs, vocab)
        ids, docs, vocab = [], [], None
        give_back()

    return split


class WordTable:
    """The distinct words of one bucket, each encoded once."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bucket = None
        self.ids: dict[bytes, tuple[int, ...]] = {}

    def encode(self, bucket: int, words: list[bytes]) -> list[tuple[int, ...]]:
        if bucket != self.bucket:
            self.bucket, self.ids = bucket, {}
        fresh = [w for w in words if w not in self.ids]
        for w, e in zip(fresh, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in fresh], add_special_tokens=False)):
            self.ids[w] = tuple(e.ids)
        return [self.ids[w] for w in words]


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of (chunk, id) rows, in order."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[fresh, 0], rows[fresh, 1]


def _encode_words(tokenizer_path: str):
    """Rows of a bucket, one bucket behind the other, to packs (home chunk, slots, counts, ids) and the ids that a chunk uses (home chunk, id).

    All rows of a bucket meet in one task, so a word is encoded once.
    """
    names = ["home", "slots", "counts", "ids", "id"]

    def encode(batches):
        table = WordTable(tokenizer_path)
        for batch in batches:
            counts, ids, used = [], [], []
            for bucket, home, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                found = table.encode(bucket, _unpack_words(blob))
                flat = np.fromiter((i for f in found for i in f), np.int64)
                counts.append(_pack(np.array(list(map(len, found)))))
                ids.append(_pack(flat))
                distinct = np.unique(flat)
                used.append(np.column_stack([np.full(len(distinct), home), distinct]))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(counts, pa.binary()), pa.array(ids, pa.binary()), pa.nulls(n, pa.int32())], names)
            home, every = _distinct_rows(np.concatenate(used or [np.zeros((0, 2), np.int64)]))
            none = pa.nulls(len(every), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(home), none, none, none, pa.array(every, pa.int32())], names)
        table = None
        give_back()

    return encode


def decode_ids(rows: DataFrame, table: DataFrame, key: str = "word_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary): the pieces of each row's ids in their order, found by a join on the id.

    The vocabulary is the one side that is broadcast: its number of rows is fixed by the tokenizer file.
    Rows without ids are missing from the result; keys must be unique.
    """
    places = rows.select(key, F.posexplode(ids).alias("at", "id"))
    joined = places.join(F.broadcast(table), "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("p"))
    return joined.select(key, F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("decoded"))


def _assemble(key_type: pa.DataType):
    """Join ids back by position: a chunk's documents with the ids of its words; decode by the joined piece of each id."""

    def assemble(docs: pa.Table, found: pa.Table) -> pa.Table:
        named = found.filter(pc.is_valid(found.column("id")))
        spelling = dict(zip(named.column("id").to_pylist(), named.column("piece").to_pylist()))
        words = found.filter(pc.is_null(found.column("id")))
        cols = [[_unpack(x) for x in words.column(c).to_pylist()] for c in ("slots", "counts", "ids")]
        slots = np.concatenate([np.cumsum(x, dtype=np.int64) for x in cols[0]] or [np.zeros(0, np.int64)])
        counts = np.concatenate(cols[1] or [np.zeros(0, np.uint32)]).astype(np.int64)
        table = np.concatenate(cols[2] or [np.zeros(0, np.uint32)]).astype(np.int32)
        width, start = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        width[slots] = counts
        ends = np.cumsum(counts)
        start[slots] = ends - counts
        written_as = list(map(spelling.__getitem__, table.tolist()))
        spelled = [b"".join(written_as[a : a + n]) for a, n in zip(start.tolist(), width.tolist())]
        ids, stops, decoded = [], [0], []
        for payload in docs.column("payload").to_pylist():
            numbers = _unpack(payload)
            each = width[numbers]
            upto = np.cumsum(each)
            total = int(upto[-1]) if len(upto) else 0
            ids.append(table[np.arange(total) + np.repeat(start[numbers] - (upto - each), each)])
            stops.append(stops[-1] + total)
            decoded.append(b"".join(map(spelled.__getitem__, numbers.tolist())).decode("utf-8", "replace"))
        lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
        return pa.table([docs.column("doc_id").cast(key_type), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return assemble


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row; decoded is what the ids decode to."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer()
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    rows = rows.coalesce(max(2 * spark.sparkContext.defaultParallelism, size // chunk_bytes))  # chunks follow the size, not the number of files
    schema = f"chunk long, bucket int, slots binary, words binary, doc_id {kind.simpleString()}, payload binary"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = written_by(rows.mapInArrow(_split(path, chunk_bytes, buckets, arrow), schema), "split", "chunk", parts)
    table = split.where("bucket is not null").select("bucket", "chunk", "slots", "words").repartition("bucket").sortWithinPartitions("bucket")
    found = table.mapInArrow(_encode_words(path), "home long, slots binary, counts binary, ids binary, id int").repartition(parts, "home")
    found = found.join(F.broadcast(pieces(spark, path)), "id", "left")  # behind the shuffle, which so carries ids alone
    texts = split.where("bucket is null").select("chunk", "doc_id", "payload")
    return texts.groupBy("chunk").cogroup(found.groupBy("home")).applyInArrow(_assemble(arrow), f"doc_id {kind.simpleString()}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
