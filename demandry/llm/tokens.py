"""Token ids of documents in Arrow files of equal-length sequences, written in id order and read back at random.

A file is in the Arrow IPC file format: record batches of SEQUENCES rows with two fixed-size lists each, `ids` and `mask`.
Documents follow one another without gaps; only the end of a file is padded (id 0, mask false). A sequence or any run of
ids is found by division, without reading what lies before it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from .common import materialise, ranges, shared_dir

#: Ids of a sequence, sequences of a record batch, and ids after which a task begins another file.
LENGTH, SEQUENCES, FILE_IDS = 2048, 64, 1 << 26
#: Bytes of text encoded at once; pieces remembered by a worker, and the longest of them; characters learned at once.
BLOCK, KNOWN, LONGEST, LEARN = 1 << 23, 1 << 20, 64, 1 << 19

OTHER, SPACE, LETTER, DIGIT, PUNCT, QUOTE, CONTROL = range(7)


def _kinds() -> np.ndarray:
    """The kind of each byte; those of characters beyond ASCII are OTHER until they are known to be no white space."""
    kind = np.full(256, OTHER, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = SPACE if c in "\t\n\v\f\r " else LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else PUNCT if c.isprintable() else CONTROL
    return kind


KINDS = _kinds()
#: Where a text may be cut between bytes of two kinds so that its parts encode to the same ids: a piece of the byte-level
#: pattern holds white space at its beginning only, letters, digits and others apart; a quotation mark may begin "'s".
CUTS = np.zeros((7, 7), dtype=bool)
CUTS[[LETTER, DIGIT, PUNCT, QUOTE, CONTROL], SPACE] = True
CUTS[LETTER, [DIGIT, PUNCT, QUOTE, CONTROL]] = True
CUTS[DIGIT, [LETTER, PUNCT, QUOTE, CONTROL]] = True
CUTS[PUNCT, [LETTER, DIGIT]] = True
#: White space beyond ASCII, which may join the white space around it to one piece.
WIDE_SPACE = [np.frombuffer(chr(c).encode(), dtype=np.uint8) for c in range(0x80, 0x3001) if chr(c).isspace()]


def pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of the texts in data begin; they encode apart as they do together. Texts begin at starts."""
    kind = KINDS[data]
    cut = CUTS[kind[:-1], kind[1:]]
    high = np.flatnonzero((data[:-1] >= 128) & (kind[1:] == SPACE))
    if len(high):
        # A character beyond ASCII before white space: a cut, unless it is white space too.
        wide = np.zeros(len(high), dtype=bool)
        for space in WIDE_SPACE:
            same = high >= len(space) - 1
            for back, byte in enumerate(space[::-1]):
                same &= data[np.maximum(high - back, 0)] == byte
            wide |= same
        cut[high[~wide]] = True
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[1:-1] = cut
    begin[starts] = True
    return np.flatnonzero(begin[:-1])


class Encoder:
    """Texts to ids with the tokenizers library. Special tokens' strings in a text are ordinary text.

    With a byte-level BPE, texts are cut where no piece of its pattern crosses, distinct pieces are encoded once and
    remembered. Other tokenizers encode whole texts.
    """

    def __init__(self, spec: str):
        said = json.loads(spec)
        before, model = said.get("pre_tokenizer") or {}, said["model"]
        self.by_piece = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
            and model.get("type") == "BPE" and not model.get("dropout") and all(t["special"] for t in said.get("added_tokens", ()))
        )
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if self.by_piece:
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, group, size = {}, [], 0
        alone = []
        for w in words:
            text = w.decode("utf-8", "replace")
            if text[0] == " " and not text[-1].isspace():
                group.append((w, text))
                size += len(text)
                if size > LEARN:
                    found |= self._together(group)
                    group, size = [], 0
            else:
                alone.append((w, text))
        found |= self._together(group)
        for k in range(0, len(alone), 1000):
            part = alone[k : k + 1000]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                found[w] = np.array(e.ids, dtype=self.kind).tobytes()
        return found

    def _together(self, group: list[tuple[bytes, str]]) -> dict[bytes, bytes]:
        """Pieces that begin with a space and end otherwise, encoded as one text and told apart by offsets."""
        if not group:
            return {}
        e = self.tokenizer.encode("".join(t for _, t in group), add_special_tokens=False)
        ids, at = np.array(e.ids, dtype=self.kind), np.fromiter((o[0] for o in e.offsets), dtype=np.int64, count=len(e.ids))
        ends = np.cumsum(np.fromiter((len(t) for _, t in group), dtype=np.int64, count=len(group)))
        raw, width, begin, found = ids.tobytes(), self.kind.itemsize, 0, {}
        for (w, _), end in zip(group, (np.searchsorted(at, ends) * width).tolist(), strict=True):
            found[w], begin = raw[begin:end], end
        return found

    def __call__(self, column: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of blocks of the texts in turn: each text's ids and then the end id; a null text has the end only."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
        at = 0
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
            yield self._block(column.slice(at, upto - at), offsets[at : upto + 1], end)
            at = upto

    def _block(self, column: pa.Array, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in column.to_pylist()], add_special_tokens=False)
            lists = [np.array([*e.ids, end], dtype=self.kind) for e in got]
            return np.concatenate(lists), np.array([len(x) for x in lists], dtype=np.int64)
        first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        if not size:
            return np.full(len(column), end, dtype=self.kind), np.ones(len(column), dtype=np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8, count=size, offset=first)
        starts = offsets - first
        begin = pieces(data, starts)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.r_[begin, size].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        unique, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        if len(self.known) > KNOWN:
            self.known.clear()
        coded = list(map(self.known.get, unique))
        fresh = self._learn([w for w, c in zip(unique, coded, strict=True) if c is None])
        if fresh:
            coded = [fresh[w] if c is None else c for w, c in zip(unique, coded, strict=True)]
            self.known.update((w, c) for w, c in fresh.items() if len(w) <= LONGEST)
        flat = np.frombuffer(b"".join(coded), dtype=self.kind)
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // self.kind.itemsize
        own = lengths[which]
        ids = flat[ranges((np.cumsum(lengths) - lengths)[which], own)]
        ends = np.r_[0, np.cumsum(own)][np.searchsorted(begin, starts)]
        return np.insert(ids, ends[1:], end), np.diff(ends) + 1


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder for each worker, with what it remembers."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = Encoder(spec)
    return _encoders[spec]


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder's URI; a local one is mapped into memory."""
    system, path = pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return (pa.fs.LocalFileSystem(use_mmap=True) if isinstance(system, pa.fs.LocalFileSystem) else system), path


class SequenceWriter:
    """Files of sequences in a folder: add() appends ids and says where they begin; a file ends between two additions."""

    def __init__(self, folder: str, stem: str, kind: np.dtype, length: int = LENGTH, file_ids: int = FILE_IDS):
        self.system, self.path = open_folder(folder)
        self.stem, self.kind, self.length, self.file_ids = stem, kind, length, file_ids
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.files, self.sink, self.writer = 0, None, None

    def add(self, ids: np.ndarray) -> tuple[str, int]:
        if self.writer is None or self.count >= self.file_ids:
            self.close()
            self.name = f"{self.stem}-{self.files:04d}.arrow"
            self.sink = self.system.open_output_stream(f"{self.path}/{self.name}")
            self.writer, self.held, self.waiting, self.count, self.files = pa.ipc.new_file(self.sink, self.schema), [], 0, 0, self.files + 1
        at = self.count
        self.held.append(ids)
        self.waiting += len(ids)
        self.count += len(ids)
        if self.waiting >= self.length * SEQUENCES:
            self._flush()
        return self.name, at

    def _flush(self, last: bool = False) -> None:
        ids, step = np.concatenate(self.held) if self.held else np.zeros(0, dtype=self.kind), self.length * SEQUENCES
        whole = len(ids) if last else len(ids) // step * step
        for k in range(0, whole, step):
            part = ids[k : min(k + step, whole)]
            pad = -len(part) % self.length
            real = np.r_[np.ones(len(part), dtype=bool), np.zeros(pad, dtype=bool)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.r_[part, np.zeros(pad, dtype=self.kind)], real)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        if self.writer is not None:
            self._flush(last=True)
            self.writer.close()
            self.sink.close()
            self.writer = None


class SequenceFile:
    """Random access to a file of sequences; what it returns are views of the file where it is mapped into memory."""

    def __init__(self, system: pa.fs.FileSystem, path: str):
        self.source = system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.file.get_batch(k)
        return self._batch

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of a sequence."""
        batch, row = self.batch(k // SEQUENCES), k % SEQUENCES
        ids, mask = (batch.column(i).flatten().slice(row * self.length, self.length) for i in (0, 1))
        return ids.to_numpy(), mask

    def run(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the file; it is an error if some of them are padding."""
        step, parts, end = self.length * SEQUENCES, [], start + n
        while start < end:
            batch, at = self.batch(start // step), start % step
            some = min(end - start, step - at)
            ids, mask = (batch.column(i).flatten().slice(at, some) for i in (0, 1))
            if len(ids) < some or mask.true_count < some:
                raise ValueError(f"ids {start} to {start + some} are not in the file")
            parts.append(ids.to_numpy())
            start += some
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def close(self) -> None:
        self.source.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, length: int = LENGTH, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of docs into files in folder, in ascending order of the ids of documents, and returns their index:
    (id, part, at, n_tokens, file, place). part numbers the ranges of ids, at counts ids from the range's beginning,
    place those from the file's.

    tokenizer is the path of a tokenizer's JSON file. Texts are dealt by ranges of (id, row number), so that repeated ids
    (or nulls, which come first) may be many; a range's task encodes and writes its texts in turn, in files of bounded
    size. Files of a task that ran again are named anew, and only those that the index names count.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")).repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, total = encoder(spec.value), TaskContext.get().partitionId(), 0
        writer = SequenceWriter(folder, f"part-{part:06d}-{uuid.uuid4().hex}", encode.kind, length, file_ids)
        for batch in batches:
            counted, placed = [], []
            for ids, counts in encode(batch.column(1), end):
                ends = np.cumsum(counts)
                counted.append(counts)
                placed += [writer.add(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            counts = np.concatenate(counted) if counted else np.zeros(0, dtype=np.int64)
            at = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            files, places = (list(x) for x in zip(*placed, strict=True)) if placed else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(at), pa.array(counts), pa.array(files, type=pa.string()), pa.array(places, type=pa.int64())], ["id", "part", "at", "n_tokens", "file", "place"])
        writer.close()

    return materialise(dealt.mapInArrow(run, f"id {kind}, part int, at long, n_tokens long, file string, place long"), "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document of the index, its ids read from the files; start counts the ids
    of all documents before it. The sizes of ranges (one number for each partition) reach the driver; the ids don't."""
    sizes = {r[0]: r[1] for r in index.groupBy("part").agg(F.sum("n_tokens")).collect()}
    base, total = {}, 0
    for part in sorted(sizes):
        base[part], total = total, total + sizes[part]
    known = index.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, path), name, file = open_folder(folder), None, None
        for batch in batches:
            part, at, n, files, places = (batch.column(k).to_pylist() for k in range(1, 6))
            codes = []
            for own, place, count in zip(files, places, n, strict=True):
                if own != name:
                    if file is not None:
                        file.close()
                    name, file = own, SequenceFile(system, f"{path}/{own}")
                codes.append(zlib.crc32(file.run(place, count).astype("<u4").tobytes()))
            starts = [known.value[p] + a for p, a in zip(part, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, type=pa.int64()), batch.column(3), pa.array(codes, type=pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    kind = index.schema["id"].dataType.simpleString()
    return index.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def sequences(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """(file, sequence, ids, mask): every sequence of the files that the index names, for training."""
    names = index.select("file").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                file = SequenceFile(system, f"{path}/{name}")
                for k in range(file.file.num_record_batches):
                    got = file.batch(k)
                    rows = got.num_rows
                    lists = [got.column(0).cast(pa.list_(pa.int32())), got.column(1).cast(pa.list_(pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(np.arange(k * SEQUENCES, k * SEQUENCES + rows, dtype=np.int64)), *lists], ["file", "sequence", "ids", "mask"])
                file.close()

    return names.mapInArrow(run, "file string, sequence long, ids array<int>, mask array<boolean>")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, length: int = LENGTH) -> DataFrame:
    """One row per document: its id, start, n_tokens and ids_crc32, of ids that were written to files in the shared folder
    and read back.

    A null or empty text has the end id alone; whole texts are encoded; repeated rows and null ids stay (nulls first); an
    empty table gives no rows and no file; other columns of docs are not read. Ids of documents may be of any type that
    can be ordered. The folder must be one that pyarrow's file systems reach (local or mounted, s3, gs, abfs, hdfs).
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    index = write_tokens(docs, folder, tokenizer, id_col, text_col, end, length)
    return read_tokens(index, folder).withColumnRenamed("id", id_col)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
