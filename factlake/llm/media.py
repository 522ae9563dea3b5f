"""Media columns: content-addressed payloads in tar shards; rows carry digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bit_filter, bits_of, discard, materialize, shared_dir, slices

#: Samples in a row of the stored image; a payload is filled up to whole rows.
WIDTH, FILL = 576, b"\xff"
#: A shard is closed at this size.
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a stored image that hold its metadata: signature and header chunk.
HEADER = 33
#: Open shards that a reading task keeps, and hashes that a writing task remembers.
KEPT_SHARDS, KEPT_KEYS = 16, 1 << 16
#: Bits of the filter that tells texts that repeat; its size doesn't grow.
FILTER_BITS = 1 << 26


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: bytes) -> bytes:
    return text + FILL * (max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def to_png(payload: bytes) -> bytes:
    """Whole rows of WIDTH 8-bit samples as a grey PNG image: the same bytes for the same payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if len(head) < HEADER or head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    width, height, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", head[16:29])
    if colour or interlace:
        raise ValueError("only grey images without interlace are stored here")
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """Samples of a stored image; every chunk's checksum is tested."""
    width, height, _ = png_header(data[:HEADER])
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are stored here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Average hash of 64 equal parts (16 hex digits), then mean and deviation of the samples."""
    x = np.frombuffer(payload, np.uint8).reshape(64, -1)
    means = x.mean(axis=1)
    bits = np.packbits(means > means.mean()).tobytes().hex()
    return f"{bits}:{x.mean():.3f}:{x.std():.3f}"


class Shards:
    """Writes tar shards in a folder of any file system that pyarrow reaches by a URI. A name is never used twice, so
    a task that runs again leaves the rows of the other attempt alone."""

    def __init__(self, folder: str, limit: int = SHARD_BYTES):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.out = limit, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        """Stores data as a member; its shard and where in it the data begins."""
        if self.out is None:
            self.shard, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.shard}")
        member = tarfile.TarInfo(name)
        member.size = len(data)
        head = member.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        where = self.shard, self.at + len(head)
        self.at += len(head) + len(data) + -len(data) % 512
        if self.at >= self.limit:
            self.close()
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def _stored(folder: str):
    """For mapInArrow over (id, key, text): stores each text's payload and gives id, key and its place."""

    def run(batches: Iterable[pa.RecordBatch]):
        shards = Shards(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for text in as_bytes(batch.column(2)):
                data = to_png(payload_of(text))
                digest = hashlib.sha256(data).hexdigest()
                rows.append((len(text), digest, *shards.add(f"{digest}.png", data), len(data)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "key", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return run


_PLACES = "doc_id long, key binary, n_bytes long, digest string, shard string, offset long, length long"


#: Rows of one repeated text that meet its place in one task; those of a text with more are dealt to so many cuts.
HOT_ROWS, CUTS = 100_000, 64


def _places(docs: DataFrame, folder: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stores each text's payload: places of the texts that don't repeat, with their ids; of each other text its key and place; and
    (doc_id, key) of the rows of those. Texts are read three times: to hash them, to store those alone, and to send one of each other."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def hashed(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(x).digest() for x in as_bytes(batch.column(1))], pa.binary())], names=["doc_id", "key"])

    def short(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(x[:8], "little", signed=True) for x in batch.column(0).to_pylist()], pa.int64())], names=["hash"])

    keys = materialize(rows.mapInArrow(hashed, "doc_id long, key binary"), "media-keys")
    repeated = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "media-repeated")
    held = rows.sparkSession.sparkContext.broadcast(bit_filter(repeated.select("key").mapInArrow(short, "hash long"), FILTER_BITS))

    def keyed(again: bool):
        def run(batches: Iterable[pa.RecordBatch]):
            seen: set[bytes] = set()
            for batch in batches:
                for ids, texts in slices(batch.column(0), batch.column(1)):
                    key = [hashlib.sha256(x).digest() for x in as_bytes(texts)]
                    own = bits_of(held.value, np.array([int.from_bytes(x[:8], "little", signed=True) for x in key], np.int64))
                    own = own if again else ~own
                    if again:  # a task sends a text once while it remembers it
                        seen = set() if len(seen) > KEPT_KEYS else seen
                        own &= np.array([x not in seen and not seen.add(x) for x in key], bool)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(key, pa.binary()), pc.fill_null(texts, "")], names=["id", "key", "text"]).filter(pa.array(own))

        return run

    kept = "id long, key binary, text string"
    alone = materialize(rows.mapInArrow(keyed(False), kept).mapInArrow(_stored(folder), _PLACES), "media-alone")
    one = rows.mapInArrow(keyed(True), kept).groupBy("key").agg(F.first("text").alias("text"))
    shared = materialize(one.select(F.lit(None).cast("long").alias("id"), "key", "text").mapInArrow(_stored(folder), _PLACES), "media-shared")
    hot = rows.sparkSession.sparkContext.broadcast(bit_filter(repeated.where(F.col("n") > HOT_ROWS).select("key").mapInArrow(short, "hash long"), FILTER_BITS))

    def hashes(keys_: pa.Array) -> np.ndarray:
        return np.array([int.from_bytes(x[:8], "little", signed=True) for x in keys_.to_pylist()], np.int64)

    def crowded(batches: Iterable[pa.RecordBatch]):
        """The rows of repeated texts; those of a hot one go in turn to its cuts."""
        for batch in batches:
            h = hashes(batch.column(1))
            cut = np.where(bits_of(hot.value, h), np.arange(len(h)) % CUTS, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.int32())], names=["doc_id", "key", "cut"]).filter(pa.array(bits_of(held.value, h)))

    def spread(batches: Iterable[pa.RecordBatch]):
        """A place for each cut of a hot text, one for each other."""
        for batch in batches:
            n = np.where(bits_of(hot.value, hashes(batch.column(batch.schema.names.index("key")))), CUTS, 1)
            at = np.repeat(np.arange(len(n)), n)
            cut = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(cut, pa.int32())], names=[*batch.schema.names, "cut"])

    places = materialize(shared.drop("doc_id").mapInArrow(spread, _PLACES.replace("doc_id long, ", "") + ", cut int"), "media-places")
    crowd = materialize(keys.mapInArrow(crowded, "doc_id long, key binary, cut int"), "media-crowd")
    discard(keys, repeated, shared)
    return alone, places, crowd


def store_texts(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's payload in tar shards in folder (a URI that all executors share): doc_id, n_bytes, digest
    (sha256 of the stored form), shard, offset, length.

    Payloads are content-addressed: members are named by digest, and equal payloads are stored once in all shards. Which texts
    repeat is found by their hashes alone and told to the tasks as a bitmap of fixed size; texts that don't are stored where they
    are read, one row of each other text is shuffled by its hash. Null counts as empty, repeated rows share a place. The rows are
    written before they are returned, so they name shards that are whole."""
    alone, shared, crowd = _places(docs, folder, id_col, text_col)
    return materialize(alone.drop("key").unionByName(crowd.join(shared, ["key", "cut"]).drop("key", "cut")), "media-rows")


class Reader:
    """Range reads of shards, with the last ones kept open."""

    def __init__(self, folder: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.open: OrderedDict[str, object] = OrderedDict()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            self.open[shard] = self.fs.open_input_file(f"{self.folder}/{shard}")
            if len(self.open) > KEPT_SHARDS:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(shard)
        return self.open[shard].read_at(length, offset)


def _with_columns(places: DataFrame, folder: str, fn, schema: str) -> DataFrame:
    """Adds columns that fn(reader, shard, offset, length) gives for each row's stored payload. Rows are small but what they point at
    isn't: they are dealt out by shard and part of a shard, to tasks of as many bytes as Spark's own scans have. A place whose rows
    stand one after another is read once."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]):
        reader, last, value = Reader(folder), None, None
        for batch in batches:
            got = []
            for place in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("shard", "offset", "length"))):
                if place != last:
                    last, value = place, fn(reader, *place)
                got.append(value)
            columns = [pa.array(c, t) for c, t in zip(zip(*got), types)] if got else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    part = places.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = places.repartition(total // part + 1, "shard", F.floor(F.col("offset") / F.lit(max(part // 4, 1)))).sortWithinPartitions("shard", "offset")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema)
    return dealt.mapInArrow(run, f"{kept}, {schema}")


_METADATA = "width long, height long, sample_bits long"
_CONTENT = "payload_sha256 string, tail_crc32 long, feature string, stored_sha256 string"


def _metadata(reader: Reader, shard: str, offset: int, length: int) -> tuple:
    return png_header(reader.read(shard, offset, min(HEADER, length)))


def _content(reader: Reader, shard: str, offset: int, length: int) -> tuple:
    data = reader.read(shard, offset, length)
    payload = from_png(data)
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature(payload), hashlib.sha256(data).hexdigest()


def fill_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and sample_bits, reading the header of each stored payload and nothing else."""
    return _with_columns(rows, folder, _metadata, _METADATA)


def read_payloads(rows: DataFrame, folder: str) -> DataFrame:
    """Adds what whole payloads show, read back from the shards: payload_sha256, tail_crc32 (last 32 samples), feature and
    stored_sha256."""
    return _with_columns(rows, folder, _content, _CONTENT)


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text and reads it back, a row for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, then shard, offset, width and height. folder defaults to a new one
    in the shared folder. Null and empty texts are one row of fill bytes; a very long text is one payload. Null ids stay
    null; repeated rows give repeated rows that share a payload; an empty table gives none; other columns aren't read."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path)
    alone, shared, crowd = _places(docs, folder, id_col, text_col)

    def both(places: DataFrame) -> DataFrame:  # the header first, by itself, then the payload: both of a place in one task
        return _with_columns(places, folder, lambda *place: (*_metadata(*place), *_content(*place)), f"{_METADATA}, {_CONTENT}")

    # each payload is read once, before the rows that share it meet it
    rows = both(alone.drop("key")).unionByName(crowd.join(both(shared), ["key", "cut"]).drop("key", "cut"))
    return rows.select(
        "doc_id", "n_bytes", (F.col("width") * F.col("height")).alias("payload_bytes"), "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"),
        F.col("stored_sha256").alias("media_sha256"), "feature", "shard", "offset", "width", "height",
    )
