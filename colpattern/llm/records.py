"""Token ids as length-delimited binary records with a separate offset index.

A record frames one serialised sequence:

    uint64 length | uint32 masked CRC-32C of the length | data | uint32 masked CRC-32C of data

all little-endian, where masking rotates the checksum right by 15 bits and adds 0xa282ead8, so
that checksums of data that hold checksums stay sound. The data of a document are its integer
id (int64), the width of an id (uint8: 2 or 4 bytes) and its token ids with the end mark last.
Each task writes its records to one file `shard-<n>.rec` and, beside it, `shard-<n>.idx`: a
row of (doc_id int64, offset uint64, length uint64, tokens uint64) per record, so that a reader
can draw records in any order without scanning.

Files are written under a temporary name and then renamed; a task that runs twice (after the
loss of an executor, or speculatively) writes the same bytes under the same name. Memory is one
batch of records.

Defined results: a null or empty text is a record with the end mark alone; rows that share a
doc_id are a record each; a null doc_id is written as the least int64 and shown as null in the index rows;
a task without rows writes no file; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colpattern.llm.common import batch, cut, spread, text_of, tidy
from colpattern.llm.tokens import TOKENIZER, encoding

MASK_DELTA = 0xA282EAD8
#: What stands for a null doc_id in a file.
NO_ID = -(2**63)
#: Bytes of a block whose checksum is computed in lockstep with the others.
BLOCK = 256
INDEX = "shard string, record long, doc_id long, offset long, length long, n_tokens long, crc long"
_INDEX = pa.schema([("shard", pa.string()), ("record", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64())])
IDX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8")])


# ------------------------------------------------ CRC-32C
@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """tables[k][b]: the register after byte b and then k zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    out = [t]
    for _ in range(7):
        out.append(t[out[-1] & 0xFF] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


@lru_cache(maxsize=8)
def _shift(n: int) -> np.ndarray:
    """[4, 256]: what n zero bytes make of each byte of a register."""
    t = _tables()[0]
    reg = (np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
    for _ in range(n):
        reg = t[reg & 0xFF] ^ (reg >> np.uint32(8))
    return reg


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of each data[start:end]. All records are cut into blocks of BLOCK bytes (the first
    is filled up with leading zeros, which a zero register ignores), all blocks run in lockstep,
    eight bytes a step, and the blocks of a record are then joined with the shift operator."""
    n = np.asarray(ends) - np.asarray(starts)
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    room = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    pad = blocks * BLOCK - n
    at = first[:-1] * BLOCK + pad
    inside = spread(n)
    room[np.repeat(at, n) + inside] = data[np.repeat(np.asarray(starts), n) + inside]
    # the register begins as all ones: that is, the first four bytes are flipped
    crc = np.zeros(len(n), np.uint32)
    long_ = n >= 4
    for k in range(4):
        room[at[long_] + k] ^= 0xFF
    t = _tables()
    words = room.reshape(-1, BLOCK // 8, 8)
    reg = np.zeros(len(words), np.uint32)
    for s in range(BLOCK // 8):
        w = words[:, s]
        new = np.zeros(len(words), np.uint32)
        for k in range(8):
            b = w[:, k]
            if k < 4:
                b = b ^ ((reg >> np.uint32(8 * k)) & np.uint32(0xFF)).astype(np.uint8)
            new ^= t[7 - k][b]
        reg = new
    sh = _shift(BLOCK)
    order = np.argsort(-blocks, kind="stable")
    live = order
    for k in range(int(blocks.max(initial=0))):
        live = live[: np.searchsorted(-blocks[live], -k, "left")]
        c = crc[live]
        crc[live] = sh[0][c & 0xFF] ^ sh[1][(c >> np.uint32(8)) & 0xFF] ^ sh[2][(c >> np.uint32(16)) & 0xFF] ^ sh[3][c >> np.uint32(24)] ^ reg[first[live] + k]
    crc = ~crc
    for i in np.flatnonzero(~long_):
        c = 0xFFFFFFFF
        for b in data[starts[i] : ends[i]].tolist():
            c = int(t[0][(c ^ b) & 0xFF]) ^ (c >> 8)
        crc[i] = c ^ 0xFFFFFFFF
    return crc


def masked(crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.uint32)
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK_DELTA)


# ------------------------------------------------ writing
def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(the framed records, offsets, lengths with frame, CRC-32C of the data)."""
    n = np.array([len(p) for p in payloads], np.int64)
    total = n + 16
    at = np.concatenate([[0], np.cumsum(total)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    out = np.zeros(int(total.sum()), np.uint8)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    src = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64)
    shift = np.repeat(at + 12 - src, n)
    out[np.arange(len(data)) + shift] = data

    def put(where: np.ndarray, values: np.ndarray) -> None:
        b = values.view(np.uint8).reshape(len(values), -1)
        for k in range(b.shape[1]):
            out[where + k] = b[:, k]

    put(at, n.astype("<u8"))
    put(at + 8, masked(crc32c(out, at, at + 8)).astype("<u4"))
    crc = crc32c(out, at + 12, at + 12 + n)
    put(at + 12 + n, masked(crc).astype("<u4"))
    return out.tobytes(), at, total, crc


def serialise(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return np.int64(NO_ID if doc_id is None else doc_id).astype("<i8").tobytes() + bytes([width]) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def deserialise(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id = int(np.frombuffer(data, "<i8", 1)[0])
    return (None if doc_id == NO_ID else doc_id), np.frombuffer(data, "<u2" if data[8] == 2 else "<u4", offset=9).astype(np.uint32)


#: What a complete set of shards has beside them.
MANIFEST = "_manifest.json"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + os.path.abspath(path))


def _writer(path: str, tokenizer: str, rows: int):
    def run(batches):
        from pyspark import TaskContext

        enc = encoding(tokenizer)
        mark, width = enc.n_vocab, 2 if enc.n_vocab < 1 << 16 else 4
        fs, root = filesystem(path)
        shard = f"shard-{TaskContext.get().partitionId():06d}"
        temporary = f"{root}/_{shard}-{uuid.uuid4().hex}"
        rec = idx = None
        offset = record = 0
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for lo in range(0, b.num_rows, rows):
                own, text = ids[lo : lo + rows].to_pylist(), texts[lo : lo + rows].to_pylist()
                tokens = [np.array([*(enc.encode_ordinary(t) if t else ()), mark], np.uint32) for t in text]
                data, at, length, crc = frame([serialise(i, t, width) for i, t in zip(own, tokens, strict=True)])
                if rec is None:
                    fs.create_dir(root, recursive=True)
                    rec, idx = fs.open_output_stream(temporary + ".rec"), fs.open_output_stream(temporary + ".idx")
                rec.write(data)
                n = np.array([len(t) for t in tokens], np.int64)
                row = np.zeros(len(own), IDX)
                row["doc_id"], row["offset"], row["length"], row["n_tokens"] = [NO_ID if i is None else i for i in own], at + offset, length, n
                idx.write(row.tobytes())
                yield batch(_INDEX, [shard] * len(own), np.arange(record, record + len(own)), ids[lo : lo + rows], at + offset, length, n, crc.astype(np.int64))
                offset, record = offset + len(data), record + len(own)
        if rec is not None:
            rec.close()
            idx.close()
            for end in (".idx", ".rec"):
                fs.move(temporary + end, f"{root}/{shard}{end}")

    return run


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, rows: int = 512) -> DataFrame:
    """Tokenise docs and write shards to the folder `path` (a URI all executors reach), then a manifest of the
    shards, so that a set without one is incomplete. Returns the index rows (shard, record, doc_id,
    offset, length, n_tokens, crc), which are kept: reading them, or a part of them, writes
    nothing again. `length` is the whole frame, `crc` the unmasked CRC-32C of the data."""
    got = cut(text_of(docs).mapInArrow(tidy(_writer(path, tokenizer, rows)), INDEX))
    shards = got.groupBy("shard").agg(F.count("*").alias("records"), F.sum("length").alias("bytes")).collect()  # a row for each task
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps({r["shard"]: [r["records"], r["bytes"]] for r in shards}, sort_keys=True).encode())
    return got


def check(path: str) -> None:
    """ValueError unless the folder holds the shards of its manifest, with the bytes these have there."""
    fs, root = filesystem(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        raise ValueError(f"{path} has no manifest: writing did not end")
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        want = json.loads(f.read())
    there = {f.base_name: f.size for f in fs.get_file_info(pafs.FileSelector(root)) if f.extension in ("rec", "idx") and not f.base_name.startswith("_")}
    if {f"{s}.rec": size for s, (_, size) in want.items()} | {f"{s}.idx": n * IDX.itemsize for s, (n, _) in want.items()} != there:
        raise ValueError(f"the shards in {path} are not those of its manifest")


# ------------------------------------------------ reading
def unframe(buf: bytes) -> bytes:
    """The data of one framed record; ValueError where a length or checksum is wrong."""
    a = np.frombuffer(buf, np.uint8)
    n = int(np.frombuffer(buf, "<u8", 1)[0])
    if len(buf) != n + 16:
        raise ValueError(f"record of {len(buf)} bytes has data of {n}")
    for lo, hi in ((0, 8), (12, 12 + n)):
        want = np.frombuffer(buf, "<u4", 1, hi)[0]
        if masked(crc32c(a, np.array([lo]), np.array([hi])))[0] != want:
            raise ValueError("checksum mismatch")
    return buf[12 : 12 + n]


_READ = pa.schema([("shard", pa.string()), ("record", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _reader(path: str):
    def run(batches):
        fs, root = filesystem(path)
        for b in batches:
            out = []
            files = {}
            for shard, record, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "record", "offset", "length")), strict=True):
                if shard not in files:
                    files[shard] = fs.open_input_file(f"{root}/{shard}.rec")
                doc_id, ids = deserialise(unframe(files[shard].read_at(length, offset)))
                out.append((shard, record, doc_id, ids.astype(np.int32)))
            for f in files.values():
                f.close()
            yield batch(_READ, *([r[c] for r in out] for c in range(4)))

    return run


def _index_rows(batches):
    for b in batches:
        for at in b.column("at").to_pylist():
            fs, file = filesystem(at)
            with fs.open_input_file(file) as f:
                row = np.frombuffer(f.read(), IDX)
            shard = file.rsplit("/", 1)[1].removesuffix(".idx")
            ids = pa.array(row["doc_id"].astype(np.int64), mask=row["doc_id"] == NO_ID)
            yield batch(_INDEX, [shard] * len(row), np.arange(len(row)), ids, row["offset"].astype(np.int64), row["length"].astype(np.int64), row["n_tokens"].astype(np.int64), pa.nulls(len(row), pa.int64()))


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of all shards in `path`, read from the .idx files alone (crc is null)."""
    check(path)
    fs, root = filesystem(path)
    at = [(f.path if isinstance(fs, pafs.LocalFileSystem) else f"{path.rstrip('/')}/{f.base_name}",) for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.extension == "idx" and not f.base_name.startswith("_")]
    return spark.createDataFrame(at, "at string").repartition(max(1, min(len(at), 4096))).mapInArrow(_index_rows, INDEX)


def read(spark: SparkSession, path: str, seed: int | None = None, partitions: int | None = None) -> DataFrame:
    """(shard, record, doc_id, ids) of the records in `path`, checksums verified. With a seed, in
    a shuffled order that depends on the seed alone: the index is sorted, not the data."""
    rows = index(spark, path).select("shard", "record", "offset", "length")
    if seed is not None:
        order = [F.xxhash64(F.lit(seed), "shard", "record"), F.col("shard"), F.col("record")]
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(_reader(path), "shard string, record long, doc_id long, ids array<int>")
