"""Media columns: content-defined chunks, deduplicated by their digests, from which ordered lists rebuild verified media.

A payload is kept as a WAV file of 8-bit mono samples. Rolling gear hashes cut it into chunks. Digests that occur once
need no join: their bytes stay in the row of their document (its pack). Digests that occur more often are stored once,
in a table of their own, and documents refer to them. So only shared chunks are ever shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, texts

UNIT, HEADER, RATE = 64, 44, 8000
#: Chunk sizes: least, most, and the bits of the hash that a cut needs to be zero (a mean of 2**BITS bytes and LEAST).
LEAST, MOST, BITS = 512, 8192, 10
#: The filter of shared digests has 2**FILTER bits; where it fills up, more chunks take the shuffled way, none is lost.
FILTER, BLOCK = 26, 13
GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), dtype="<u4")
MANIFEST = "n_bytes long, media_bytes long, media binary, sizes array<int>, digests array<binary>, pack binary, refs int"


def to_media(text: bytes | None) -> tuple[int, bytes]:
    """(bytes of the text, WAV file of its payload): zero bytes fill the payload up to a positive multiple of 64."""
    text = text or b""
    payload = text + bytes(-len(text) % UNIT if text else UNIT)
    size = min(len(payload), 0xFFFFFFFF - HEADER)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", size + HEADER - 8, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)
    return len(text), head + payload


def samples(media: bytes) -> np.ndarray:
    """The 8-bit samples of a WAV file."""
    kind, channels, bits = struct.unpack("<H", media[20:22])[0], struct.unpack("<H", media[22:24])[0], struct.unpack("<H", media[34:36])[0]
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or (kind, channels, bits) != (1, 1, 8):
        raise ValueError("not a WAV file of 8-bit mono samples")
    return np.frombuffer(media, dtype=np.uint8, offset=HEADER)


def features(wave: np.ndarray) -> str:
    """Mean, root mean square and crossings of the middle, and the shares of eight loudness bands."""
    centred = wave.astype(np.int64) - 128
    bands = np.bincount(wave >> 5, minlength=8)
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return f"mean={centred.mean():.4f};rms={np.sqrt((centred * centred).mean()):.4f};crossings={crossings};bands=" + ",".join(f"{b / len(wave):.4f}" for b in bands)


def cuts(media: bytes) -> list[int]:
    """The ends of the chunks. A cut depends on the 32 bytes before it, so equal passages are cut alike wherever they stand."""
    h = GEAR[np.frombuffer(media, dtype=np.uint8)].copy()
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s].copy() << np.uint32(s)
    ends, last = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while len(media) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(media):
        ends.append(len(media))
    return ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def _bit(name: bytes) -> int:
    return int.from_bytes(name[:4], "big") >> (32 - FILTER)


def _digest_rows(docs: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = [digest(c) for t in texts(part.column(0)) for c in chunks(to_media(t)[1])]
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.binary())], ["digest"])

    return docs.select("text").mapInArrow(run, "digest binary")


def shared_filter(docs: DataFrame) -> np.ndarray:
    """A bit for each digest (by its leading bits) that more than one chunk of the table has; of a fixed size."""
    shared = _digest_rows(docs).groupBy("digest").count().where("count > 1")
    bit = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - FILTER)
    grouped = shared.select(F.shiftright(bit, BLOCK).cast("int").alias("block"), bit.bitwiseAND((1 << BLOCK) - 1).cast("int").alias("bit")).groupBy("block").agg(F.collect_set("bit").alias("bits"))

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for bits in part.column(1).to_pylist():
                own = np.zeros(1 << BLOCK, dtype=np.uint8)
                own[bits] = 1
                rows.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, type=pa.binary())], ["block", "bits"])

    out = np.zeros(1 << (FILTER - BLOCK) << (BLOCK - 3), dtype=np.uint8).reshape(-1, 1 << (BLOCK - 3))
    for block, bits in grouped.mapInArrow(pack, "block int, bits binary").toLocalIterator():
        out[block] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, shared) of docs (doc_id, text), both written to the shared folder.

    manifest has a row for each document: the ordered chunk list, and in pack the bytes of the chunks that it alone has.
    shared has each other chunk once.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(shared_filter(docs))

    def is_shared(name: bytes, bits: np.ndarray) -> bool:
        b = _bit(name)
        return bool(bits[b >> 3] & (128 >> (b & 7)))

    def manifest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, press = known.value, zstandard.ZstdCompressor(level=3)
        for whole in parts:
            for k in range(0, whole.num_rows, 1000):
                part = whole.slice(k, 1000)
                rows: list[tuple] = []
                for text in texts(part.column(1)):
                    n, media = to_media(text)
                    pieces = chunks(media)
                    names = [digest(c) for c in pieces]
                    refs = [is_shared(x, bits) for x in names]
                    own = b"".join(c for c, r in zip(pieces, refs, strict=True) if not r)
                    rows.append((n, len(media), digest(media), [-len(c) if r else len(c) for c, r in zip(pieces, refs, strict=True)], names, press.compress(own) if own else None, sum(refs)))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "media_bytes", "media", "sizes", "digests", "pack", "refs"])

    def shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, press = known.value, zstandard.ZstdCompressor(level=3)
        for part in parts:
            own: dict[bytes, bytes] = {}
            for text in texts(part.column(0)):
                for c in chunks(to_media(text)[1]):
                    name = digest(c)
                    if name not in own and is_shared(name, bits):
                        own[name] = press.compress(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), type=pa.binary()), pa.array(list(own.values()), type=pa.binary())], ["digest", "bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialise(docs.select("doc_id", "text").mapInArrow(manifest, f"doc_id {kind}, {MANIFEST}"), "manifest")
    once = materialise(docs.select("text").mapInArrow(shared, "digest binary, bytes binary").dropDuplicates(["digest"]), "chunks")
    return rows, once


VALUES = T.StructType([T.StructField("media", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def read_back(rows: DataFrame) -> DataFrame:
    """What the stored media give, of rows (media, sizes, digests, pack, got): got has (pos, bytes) of the shared chunks.

    Every chunk is checked against its digest and the whole against the manifest; a mismatch fails the job.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for part in parts:
            out: list[tuple] = []
            for name, sizes, digests, pack, got in zip(*[part.column(i).to_pylist() for i in range(5)], strict=True):
                own, at, pieces = press.decompress(pack) if pack else b"", 0, []
                far = {g["pos"]: g["bytes"] for g in got or ()}
                for pos, (size, expected) in enumerate(zip(sizes, digests, strict=True)):
                    if size < 0:
                        piece = press.decompress(far[pos])
                    else:
                        piece, at = own[at : at + size], at + size
                    if digest(piece) != expected:
                        raise ValueError(f"chunk {pos} of {name.hex()} is not what was stored")
                    pieces.append(piece)
                media = b"".join(pieces)
                if digest(media) != name:
                    raise ValueError(f"media {name.hex()} is not what was stored")
                wave = samples(media)
                payload = wave.tobytes()
                out.append((name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), name.hex(), features(wave)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], VALUES.names)

    return rows.select("media", "sizes", "digests", "pack", "got").mapInArrow(run, VALUES)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload of each whole text is stored as media and read back from the store. Media with shared chunks are rebuilt
    once for all documents that have them: their references join the chunk table by digest and come together by
    medium, of whose own length the group is. A null text is an empty payload of one unit of zeros; repeated rows stay;
    an empty table gives no rows; other columns of docs are not read. Ids of documents may be of any type.
    """
    rows, once = store(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    none = F.lit(None).cast("array<struct<pos:int,bytes:binary>>").alias("got")
    alone = rows.where("refs = 0")
    single = read_back(alone.select("media", "sizes", "digests", "pack", none))
    # A medium of which every chunk is shared may have many documents; one row stands for them.
    mixed = rows.where("refs > 0").select("media", "sizes", "digests", "pack").dropDuplicates(["media"])
    refs = mixed.select("media", F.posexplode(F.arrays_zip("sizes", "digests")).alias("pos", "c")).where("c.sizes < 0").select("media", "pos", F.col("c.digests").alias("digest"))
    got = refs.join(once, "digest").groupBy("media").agg(F.collect_list(F.struct("pos", "bytes")).alias("got"))
    joined = read_back(mixed.join(got, "media").select("media", "sizes", "digests", "pack", "got"))
    values = single.unionByName(joined)
    # A medium without shared chunks has one document, so media are unique on this side.
    return rows.select("doc_id", "n_bytes", "media_bytes", "media").join(values, "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_media(spark, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
