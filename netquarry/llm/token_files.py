"""Token ids in framed binary records, with an index of offsets beside each file."""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import CACHES, blocks, claim_worker, scratch, small_batches, staged, utf8

#: A frame is: length of the data (8 bytes), checksum of these 8, the data, checksum of the data; little-endian.
LENGTH, CHECK = struct.Struct("<Q"), struct.Struct("<I")
FRAME = LENGTH.size + 2 * CHECK.size
#: The data begins with the kind of its document's id, the size of that and the bytes of one token id.
HEAD = struct.Struct("<BIB")
NO_ID, WHOLE_NUMBER, TEXT = range(3)
#: Bytes that are read at once from a file, unless one record is longer.
READ_BYTES = 4 << 20
#: Fixed value: what is added to a rotated checksum, so that data that hold checksums of their own aren't taken for them.
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    """The CRC-32 of data, rotated right by 15 bits, plus a constant."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    size = LENGTH.pack(len(data))
    return b"".join((size, CHECK.pack(masked(size)), data, CHECK.pack(masked(data))))


def unframed(frame: bytes) -> bytes:
    """The data of one whole frame; a wrong length or checksum is an error."""
    size = frame[: LENGTH.size]
    if len(frame) < FRAME or CHECK.unpack_from(frame, LENGTH.size)[0] != masked(size) or LENGTH.unpack(size)[0] != len(frame) - FRAME:
        raise ValueError("the length of a record is damaged")
    data = frame[LENGTH.size + CHECK.size : -CHECK.size]
    if CHECK.unpack(frame[-CHECK.size :])[0] != masked(data):
        raise ValueError("the data of a record are damaged")
    return data


def index_entry(offset: int, length: int, before: int) -> bytes:
    """An entry of the index: offset of the frame, its whole length, ids before it in the file."""
    return struct.pack("<QQQ", offset, length, before)


def serialized(doc_id: int | str | None, ids: bytes, width: int) -> bytes:
    """One document's data: its id, then its token ids of ``width`` bytes each."""
    if doc_id is None:
        kind, own = NO_ID, b""
    elif isinstance(doc_id, str):
        kind, own = TEXT, doc_id.encode()
    else:
        kind, own = WHOLE_NUMBER, struct.pack("<q", doc_id)
    return HEAD.pack(kind, len(own), width) + own + ids


def parsed(data: bytes) -> tuple[int | str | None, np.ndarray]:
    """The document's id, and its token ids as unsigned 32-bit integers."""
    kind, size, width = HEAD.unpack_from(data)
    own = data[HEAD.size : HEAD.size + size]
    doc_id = None if kind == NO_ID else own.decode() if kind == TEXT else struct.unpack("<q", own)[0]
    return doc_id, np.frombuffer(data, f"<u{width}", offset=HEAD.size + size).astype("<u4")


class LibraryEncoder(dict):
    """Ids of whole texts by the tokenizers library, a word at a time; keeps the ids of the words it has met.

    The vocabulary lower-cases, cuts at white space and joins no token across
    it, nor across an ASCII sign after an ASCII letter or digit (three signs that
    special tokens hold are left out), nor before a digit after one. So the
    ids of a text are those of its parts between these places, and a long text
    needs no more memory than its ids. Of more than ``most`` words half are
    forgotten: those not met since the half before was.
    """

    def __init__(self, vocabulary: str, most: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads here
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = self.library.model.tokenize
        self.width = 2 if self.library.get_vocab_size() < 1 << 16 else 4
        self.most, self.earlier = most // 2, {}
        self.symbols = dict(enumerate(byte_symbols()))
        self.sign = re.compile(rb"[!-/:;=?@\[-`{}~](?<=[a-z0-9].)")
        self.before_digit = re.compile(rb"(?<=[a-z0-9])(?=[0-9])")

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.earlier.get(word)
        if found is None:
            found = self.packed(self._ids(word))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.earlier = dict(self)
                self.clear()
            self[word] = found
        return found

    def _ids(self, word: bytes) -> list[int]:
        # One piece in its normal form: what is left to the library is the merging of its symbols.
        if word.isalpha() and word.islower():  # ASCII letters alone
            return [t.id for t in self.tokens(word.decode())]
        own = word.decode()
        if own.isalpha() and own == own.lower() and unicodedata.is_normalized("NFC", own):
            return [t.id for t in self.tokens(word.decode("latin-1").translate(self.symbols))]
        return self.library.encode(own, add_special_tokens=False).ids

    def encode(self, text: bytes) -> bytes:
        """The ids of UTF-8 text, ``width`` bytes each."""
        if b"<|" not in text:  # else capitals tell special tokens from others
            text = text.lower()
        words = self.sign.sub(rb" \g<0>", text).split()
        if len(text) > 4096 * (len(words) + 1):
            words = [part for word in words for part in (self.before_digit.sub(b" ", word).split() if len(word) > 4096 else [word])]
        return b"".join(map(self.__getitem__, words))


_ENCODERS: dict[str, LibraryEncoder] = {}
CACHES["token_files"] = _ENCODERS.clear


def _encoder(vocabulary: str) -> LibraryEncoder:
    """One encoder a Python worker, kept from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = LibraryEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def in_order(documents: DataFrame) -> DataFrame:
    """(doc_id, text as UTF-8) dealt and sorted by doc_id, nulls first; rows of one id by their text's hash.

    A third key, different for each row, lets rows of a very frequent id spread over many tasks.
    """
    rows = documents.select("doc_id", utf8().alias("text"))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("doc_id").asc_nulls_first(), "text_hash", "row"]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_token_files(documents: DataFrame, tokenizer_path: str, end_id: int | None = 1, file_bytes: int = 64 << 20, folder: str | None = None) -> DataFrame:
    """Encode whole texts and write their ids, in ascending doc_id order, into record files: one row a file.

    Returns uri, part, number, records, tokens and start (ids in all files
    before it), and writes the same as ``manifest.json`` beside the files. Texts
    are dealt by ranges of doc_id, once, and each task writes its rows into files
    of about ``file_bytes``, each with an index of offsets (``.idx``). The driver
    gets one row a file. A task that runs again writes new files; only those of
    the attempt that counted are listed.

    Each sequence ends with ``end_id``, if it isn't None. A null or empty text is
    that id alone. Null ids come first; repeated rows are written one by one,
    rows of one id in the order of a hash of their text. Other columns are
    ignored. An empty table writes no file.
    """
    spark = documents.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("token_files")
        encoder, part = _encoder(shared.value), TaskContext.get().partitionId()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        end = encoder.packed([] if end_id is None else [end_id])
        sequences = (
            (doc_id, encoder.encode(text) + end)
            for batch in blocks(batches, 256)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        )
        row = next(sequences, None)
        for number in itertools.count():
            if row is None:
                return
            name, at, tokens, entries = f"{uuid.uuid4().hex}.tok", 0, 0, []
            with system.open_output_stream(f"{path}/{name}") as out:
                while row is not None and at < file_bytes:
                    frame = framed(serialized(*row, encoder.width))
                    out.write(frame)
                    entries.append(index_entry(at, len(frame), tokens))
                    at += len(frame)
                    tokens += len(row[1]) // encoder.width
                    row = next(sequences, None)
            with system.open_output_stream(f"{path}/{name}.idx") as out:
                out.write(framed(b"".join(entries)))
            yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"], "part": [part], "number": [number], "records": [len(entries)], "tokens": [tokens]})

    written = staged(in_order(documents).mapInArrow(write, "uri string, part bigint, number bigint, records bigint, tokens bigint"), "token-list")
    files, start = [], 0
    for row in sorted(written.collect(), key=lambda r: (r["part"], r["number"])):  # one row a file
        files.append({**row.asDict(), "start": start})
        start += row["tokens"]
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"files": files, "tokens": start}).encode())
    return _listed(spark, files)


def _listed(spark, files: list[dict]) -> DataFrame:
    schema = "uri string, part bigint, number bigint, records bigint, tokens bigint, start bigint"
    return spark.createDataFrame([tuple(f[n.split()[0]] for n in schema.split(", ")) for f in files], schema)


def token_files(spark, folder: str) -> DataFrame:
    """The files of a folder that ``write_token_files`` wrote, by its manifest."""
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/manifest.json") as file:
        return _listed(spark, json.loads(file.read())["files"])


def record_places(files: DataFrame) -> DataFrame:
    """The records of files by their indexes alone: uri, record (number in the file), offset, length, start."""
    schema = "uri string, record bigint, offset bigint, length bigint, start bigint"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(path + ".idx") as file:
                    entries = np.frombuffer(unframed(file.read()), "<i8").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uri] * len(entries), pa.string()),
                        pa.array(np.arange(len(entries))),
                        *(pa.array(entries[:, k].copy()) for k in range(2)),
                        pa.array(entries[:, 2] + start),
                    ],
                    ["uri", "record", "offset", "length", "start"],
                )

    return files.select("uri", "start").mapInArrow(locate, schema)


def read_places(places: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records at places (uri, offset, length, start), in whatever order these come: doc_id, start, n_tokens, ids.

    ``ids`` holds unsigned 32-bit integers, little-endian. Places that follow each
    other in a file are read together, up to ``READ_BYTES``; both checksums of
    each record are verified. ``places.orderBy(F.rand(seed))`` gives a shuffled
    read, as each record is reached by its offset alone.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for uri, own in itertools.groupby(places, lambda p: p[0]):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as file:
                    for run in _runs(own):
                        yield _sequences(file, run, id_type)

    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids binary"
    return places.select("uri", "offset", "length", "start").mapInArrow(read, schema)


def _runs(places: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Places that follow each other, of ``READ_BYTES`` together at most unless one is longer."""
    run: list[tuple] = []
    for place in places:
        if run and (place[1] != run[-1][1] + run[-1][2] or place[1] + place[2] - run[0][1] > READ_BYTES):
            yield run
            run = []
        run.append(place)
    yield run


def _sequences(file, run: list[tuple], id_type: str) -> pa.RecordBatch:
    first = run[0][1]
    data = file.read_at(run[-1][1] + run[-1][2] - first, first)
    found = [parsed(unframed(data[offset - first : offset - first + length])) for _, offset, length, _ in run]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([doc_id for doc_id, _ in found], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]),
            pa.array([start for *_, start in run], pa.int64()),
            pa.array([len(ids) for _, ids in found], pa.int64()),
            pa.array([ids.tobytes() for _, ids in found], pa.binary()),
        ],
        ["doc_id", "start", "n_tokens", "ids"],
    )


def ids_crc32(ids: str = "ids") -> Column:
    """The unsigned CRC-32 of a sequence's ids."""
    return F.crc32(ids)
