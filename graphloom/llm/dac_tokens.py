"""Token ids in a binary file format with random access: directly addressable codes (Brisaboa et al.).

An id is split into chunks of LEVEL_BITS bits. Level 0 holds every id's lowest chunk; an id with more non-zero bits has
its continuation bit set and its next chunk stands in level 1, at the place given by the rank of that bit, and so on.
With the rank directory, token i is found by one lookup a level; nothing before it is decoded.

A shard (one blob, little-endian):
    8 bytes magic, then uint32: bits a chunk, levels, documents, and uint64: tokens
    uint64 x (documents + 1): first token of each document
    for each level: uint64 entries, entries bytes or uint16, then (but for the last level)
    ceil(entries / 64) uint64 of continuation bits and as many uint32 of ranks (set bits before each word)

Shards stand in a Parquet file as they are, uncompressed, one to a row group: the codes are the compression, and nothing has
to be unpacked between the file and a token.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import HELD, batched, bounded, free, lean, written

MAGIC = b"GLDAC\0\0\1"
LEVEL_BITS, LEVELS = 8, 4
#: Tokens of a shard at most, unless one document has more.
SHARD_TOKENS = 1 << 20
#: How shards are written: a row group each, uncompressed.
FILES = {"compression": "none", "parquet.block.row.count.limit": "1"}
#: Distinct pieces that one Python worker remembers.
REMEMBERED = 1_000_000

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, first: np.ndarray) -> bytes:
    """ids: uint32; first: where each document starts, and the end."""
    out = [MAGIC, struct.pack("<IIIQ", LEVEL_BITS, LEVELS, len(first) - 1, len(ids)), first.astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    for level in range(LEVELS):
        out += [struct.pack("<Q", len(rest)), (rest & np.uint32(255)).astype(np.uint8).tobytes()]
        if level == LEVELS - 1:
            break
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_POP[bits].reshape(-1, 8).sum(1))[:-1]]) if len(bits) else np.zeros(0)
        out += [bits.tobytes(), ranks.astype("<u4").tobytes()]
        rest = rest[more] >> np.uint32(8)
    return b"".join(out)


class Shard:
    """Reads a blob without copying it."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.bits, levels, self.documents, self.tokens = struct.unpack_from("<IIIQ", blob, 8)
        at = 28
        take = lambda kind, n: np.frombuffer(blob, kind, n, at)
        self.first = take("<u8", self.documents + 1).astype(np.int64)
        at += 8 * (self.documents + 1)
        self.levels = []
        for level in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunk = take(np.uint8, n)
            at += n
            words = -(-n // 64)
            if level == levels - 1:
                self.levels.append((chunk, None, None))
                break
            bits = take(np.uint8, 8 * words)
            at += 8 * words
            ranks = take("<u4", words)
            at += 4 * words
            self.levels.append((chunk, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Set continuation bits before entry i."""
        _, bits, ranks = self.levels[level]
        word, part = divmod(i, 64)
        if word == len(ranks):
            word, part = word - 1, 64
        if word < 0:
            return 0
        inside = int.from_bytes(bits[8 * word : 8 * word + 8].tobytes(), "little") & ((1 << part) - 1)
        return int(ranks[word]) + inside.bit_count()

    def token(self, i: int) -> int:
        """The id at place i, by one lookup a level."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << (self.bits * level)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b - 1: one rank a level, then neighbours only."""
        out = self.levels[0][0][a:b].astype(np.uint32)
        where = None
        for level in range(len(self.levels) - 1):
            _, bits, _ = self.levels[level]
            on = np.unpackbits(bits[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 :][: b - a].view(bool)
            here = np.flatnonzero(on)
            if not len(here):
                break
            where = here if where is None else where[here]
            a = self._rank(level, a)
            b = a + len(here)
            out[where] |= self.levels[level + 1][0][a:b].astype(np.uint32) << np.uint32(self.bits * (level + 1))
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.first[k]), int(self.first[k + 1]))


class Encoder:
    """The tokenizers library's ids, each distinct piece encoded once.

    Byte-level BPE works on each piece of its pre-tokenizer alone. Those pieces never reach over the places where white
    space meets other text (but that one blank goes with the text that follows it), nor over the end of a run of letters
    or of signs before another ASCII character; an apostrophe may begin a piece of its own, so no run of signs is cut
    next to one. A text is cut there, and a piece's ids are looked up or, together with all other new pieces of the
    batch, encoded by the library. Texts with the separators U+001C to U+001F (white space for Python, not for the
    library) or with a special token's string are encoded whole.
    """

    LETTERS = r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+"
    CUT = r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]++(?=[\x00-\x7F]|\Z)| ?[!-&(-/:-@\[-`{-~]++(?=[\x00-&(-\x7F]|\Z)| ?\S+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # the same model over words that stand between line breaks, without looking for words in them
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cut, self.plain = re.compile(self.CUT).findall, re.compile(self.LETTERS).fullmatch
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *special]
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.recent: list[str] = []
        self._begin()

    def _begin(self) -> None:
        """known: the number of each piece; its ids are size[number] ids of the pool from first[number] on."""
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.size = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)

    def _forget(self) -> None:
        """Drops all pieces but those of the last batch, which holds the common ones."""
        number = np.fromiter(map(self.known.__getitem__, self.recent), np.int64, len(self.recent))
        ids, sizes = self._ids(number), self.size[number]
        self._begin()
        self._add(self.recent, ids, sizes)

    def _ids(self, number: np.ndarray) -> np.ndarray:
        """The ids of pieces by number, one after the other."""
        size = self.size[number]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.first[number] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), self.used
        while m + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + len(pieces) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.size))
        self.pool[m : m + len(ids)] = ids
        self.first[n : n + len(pieces)] = m + np.cumsum(sizes) - sizes
        self.size[n : n + len(pieces)] = sizes
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.used = m + len(ids)

    def _learn(self, new: list[str]) -> np.ndarray:
        """The numbers of new pieces. Runs of letters are words of their own, which only need to be cut at line breaks."""
        number = np.empty(len(new), np.int64)
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, x in enumerate(new):
            kinds[0 if self.plain(x) else 2 if x.isspace() else 1].append(i)
        for kind, library in zip(kinds, (self.words, self.library, None), strict=True):
            some = [new[i] for i in kind]
            if not some:
                continue
            ids, at = None, np.zeros(0, np.int64)
            if library is not None:
                # a line break is a piece of its own before any other text, so it separates the pieces of one long text
                ids = np.array(library.encode_batch_fast(["\n" + "\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                at = np.flatnonzero(ids == self.line[0])
            number[kind] = np.arange(len(self.known), len(self.known) + len(some))
            if len(self.line) == 1 and len(at) == len(some):
                self._add(some, np.delete(ids, at), np.diff(at, append=len(ids)) - 1)
            else:
                each = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                self._add(some, np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64))
        return number

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids. A batch's pieces are numbered by Arrow, so that only its distinct ones are looked up."""
        if len(self.known) > REMEMBERED:
            self._forget()
        whole = [t or "" for t in texts]
        odd = [any(x in t for x in self.odd) for t in whole]
        cut = [[] if o else self.cut(t) for t, o in zip(whole, odd, strict=True)]
        pieces = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = self._learn([distinct[i] for i in fresh.tolist()])
        self.recent = distinct
        number = number[pieces.indices.to_numpy()]
        ids = self._ids(number)
        last = np.append(0, np.cumsum(self.size[number]))[np.cumsum([len(c) for c in cut])] if cut else np.zeros(0, np.int64)
        out = np.split(ids, last[:-1]) if cut else []
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if o else x for t, o, x in zip(whole, odd, out, strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        if _encoders.clear not in HELD:
            HELD.append(_encoders.clear)
        free()
    return _encoders[path]


def _rows(batches, size: int = 1 << 22):
    """(doc_ids, texts) of a few MB each, whatever the size of Arrow's batches."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        at, n = 0, 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, b in enumerate(sizes):
            n += b
            if n >= size or i == len(sizes) - 1:
                yield ids[at : i + 1], texts.slice(at, i + 1 - at).to_pylist()
                at, n = i + 1, 0


def write_shards(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes docs in ascending doc_id order (null ids first, ties by text) into shards (part, shard, doc_ids, blob).

    Range partitioning keeps the order over partitions; each partition is cut into shards of bounded size, so memory
    follows the shard, not the partition. The table is written to the shared folder.
    """

    def encode(batches):
        part, shard, ids, parts, n = None, 0, [], [], 0
        end = np.array([end_id], np.uint32)
        encoder = _encoder(path)

        def blob():
            every = [y for x in parts for y in (x, end)]
            first = np.cumsum([0, *(len(x) + 1 for x in parts)])
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "doc_ids": [ids], "tokens": [int(first[-1])], "blob": [pack(np.concatenate(every), first)]}, schema)

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for some, texts in _rows(batches):
            for i, x in zip(some, encoder.encode(texts), strict=True):
                if parts and n + len(x) + 1 > shard_tokens:
                    yield blob()
                    shard, ids, parts, n = shard + 1, [], [], 0
                ids.append(i)
                parts.append(x)
                n += len(x) + 1
        if parts:
            yield blob()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("tokens", pa.int64()), ("blob", pa.binary())])
    # rows of one id, or without any, are dealt by the beginning of their text, whose order agrees with the text's
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = batched(docs).select(F.col("doc_id").cast("long"), "text").repartitionByRange(by_id, F.substring("text", 1, 32)).sortWithinPartitions(by_id, "text")
    return written(ordered.mapInArrow(lean(encode, keep=True), "part int, shard int, doc_ids array<bigint>, tokens bigint, blob binary"), "shards", **FILES)


def based(shards: DataFrame) -> DataFrame:
    """shards with base, the number of ids in all shards before.

    Only (part, shard, tokens), one short row a shard, meets in one place.
    """
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    return shards.join(bounded(starts, 32), ["part", "shard"])


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, middle_id) of every document, read from the blobs.

    middle_id, the id at n_tokens div 2, is fetched by itself, by one lookup a level; that it is the one that the
    document's neighbours give too is checked, and a shard whose directory disagrees with its codes fails the task.
    """

    def read(batches):
        for batch in batches:
            for base, ids, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = Shard(blob.as_buffer().to_pybytes())
                # documents follow one another, so a level's neighbours are read for all of them at once
                every = s.slice(0, s.tokens).astype("<u4")
                middle = (s.first[:-1] + s.first[1:]) // 2
                fetched = [s.token(i) for i in middle.tolist()]
                if every[middle].tolist() != fetched:
                    raise ValueError("a shard's rank directory does not fit its codes")
                raw = memoryview(every.tobytes())
                at = (s.first * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(base + s.first[:-1]), "n_tokens": pa.array(np.diff(s.first)), "ids_crc32": pa.array(crc, pa.int64()), "middle_id": pa.array(fetched, pa.int64())})

    return based(shards).select("base", "doc_ids", "blob").mapInArrow(lean(read, keep=True), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, middle_id bigint")


#: Places of one group of tokens_at, as ids of the corpus.
STRETCH = SHARD_TOKENS


def tokens_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """(place, id) of the ids at places (place), counted from the first id of all shards; places outside give no row.

    A shard meets the places that fall in it by the stretches of STRETCH ids that both touch, so only shards that hold one
    are opened, once each for every stretch, and of those only the asked ids are looked up. Null places give no row;
    repeated ones are answered once.
    """
    held = based(shards).select("base", "tokens", "part", "shard")
    first, last = F.floor(F.col("base") / STRETCH), F.floor((F.col("base") + F.col("tokens") - 1) / STRETCH)
    held = held.where("tokens > 0").withColumn("stretch", F.explode(F.sequence(first, last)))
    asked = places.select(F.col("place").cast("long")).where("place IS NOT NULL").distinct().withColumn("stretch", F.floor(F.col("place") / STRETCH))
    inside = held.join(asked, "stretch").where("place >= base AND place < base + tokens")
    lists = inside.groupBy("part", "shard", "stretch").agg(F.first("base").alias("base"), F.array_sort(F.collect_list("place")).alias("places"))

    def fetch(batches):
        for batch in batches:
            for base, wanted, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = Shard(blob.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_pydict({"place": pa.array(wanted, pa.int64()), "id": pa.array([s.token(i - base) for i in wanted], pa.int64())})

    return shards.select("part", "shard", "blob").join(lists, ["part", "shard"]).select("base", "places", "blob").mapInArrow(lean(fetch, keep=True), "place bigint, id bigint")


def encode_documents(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes docs as token shards and returns what reading them back gives, one row a document.

    Null and empty texts are one end id. Repeated rows are encoded each. Columns but doc_id and text are ignored. An
    empty table gives no rows. Texts are encoded whole, whatever their length.
    """
    return read_shards(write_shards(docs, path, end_id))
