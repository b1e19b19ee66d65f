"""Training-order materialisation: packed token sequences, a keyed permutation of them, fixed-stride shards."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.files import new_file, open_file
from riskloom.llm.ordering import part_offsets
from riskloom.session import materialise, work_path

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# the public split pattern of this vocabulary, and one without look-ahead for texts without white-space runs,
# where both cut alike
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
QUICK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
# the free id behind the vocabulary: ends every document, and fills a partition's last sequence
END_OF_TEXT = 50256
TOKEN = np.dtype("<u2")


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0..size-1: a balanced Feistel network over the next even power of two, walked along
    its cycle until the value falls below ``size`` (fewer than four steps expected)."""

    size: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, math.ceil(max(1, (self.size - 1).bit_length()) / 2))

    def mixed(self, value: np.ndarray, number: int) -> np.ndarray:
        """Round function: a 64-bit finaliser over value, round and key, cut to half the width."""
        state = (self.key * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1B54A32D192ED03) % 2**64
        x = value + np.uint64(state)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def once(self, value: np.ndarray, backward: bool) -> np.ndarray:
        width, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = value >> width, value & mask
        for number in reversed(range(self.rounds)) if backward else range(self.rounds):
            if backward:
                left, right = right ^ self.mixed(left, number), left
            else:
                left, right = right, left ^ self.mixed(right, number)
        return (left << width) | right

    def walk(self, values, backward: bool = False) -> np.ndarray:
        out = self.once(np.asarray(values, dtype=np.uint64), backward)
        while (outside := out >= self.size).any():
            out[outside] = self.once(out[outside], backward)
        return out.astype(np.int64)

    def slot(self, index) -> np.ndarray:
        return self.walk(index)

    def index(self, slot) -> np.ndarray:
        return self.walk(slot, backward=True)


def load_tokenizer(path: str):
    """text -> numpy token ids, by a rank file of a byte-level vocabulary."""
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    quick = tiktoken.Encoding("quick", pat_str=QUICK_PATTERN, mergeable_ranks=ranks, special_tokens={})
    runs = regex.compile(r"\s\s")
    return lambda text: (whole if runs.search(text) else quick).encode_to_numpy(text).astype(TOKEN)


def packed_sequences(docs: DataFrame, key: str, text: str, length: int, tokenizer: str) -> DataFrame:
    """Stored rows (_part, _local, n_tokens, keys, _tokens): every partition packs its documents, each closed by
    the end token, into sequences of ``length`` tokens; only its last sequence is filled up. ``keys`` are the
    documents that have tokens in the sequence, in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), load_tokenizer(tokenizer)
        pieces, keys, held, made = [], [], 0, 0
        end = np.array([END_OF_TEXT], TOKEN)

        def sequence(tokens: np.ndarray, count: int) -> dict:
            nonlocal made
            made += 1
            return {"_part": part, "_local": made - 1, "n_tokens": count, "keys": keys, "_tokens": tokens.tobytes()}

        def table(rows: list[dict]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(key_type), pa.binary()]
            names = ["_part", "_local", "n_tokens", "keys", "_tokens"]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

        key_type = pa.null()
        for batch in batches:
            key_type, rows = batch.schema.field(0).type, []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.append(encode(value), end) if value else end
                while len(tokens):
                    piece, tokens = tokens[: length - held], tokens[length - held :]
                    pieces.append(piece)
                    keys.append(name)
                    held += len(piece)
                    if held == length:
                        rows.append(sequence(np.concatenate(pieces), length))
                        pieces, keys, held = [], [], 0
                        if len(rows) == 1000:
                            yield table(rows)
                            rows = []
            if rows:
                yield table(rows)
        if held:
            filled = np.concatenate([*pieces, np.full(length - held, END_OF_TEXT, TOKEN)])
            yield table([sequence(filled, held)])

    kind = dict(docs.dtypes)[key]
    schema = f"_part int, _local bigint, n_tokens int, keys array<{kind}>, _tokens binary"
    path = work_path(docs.sparkSession, "sequences")
    packed = docs.select(key, F.col(text).cast("string")).mapInArrow(pack, schema)
    packed.write.option("compression", "zstd").parquet(path)  # many sequences together compress best
    return docs.sparkSession.read.schema(schema).parquet(path)


def write_training_order(
    alerts: DataFrame,
    folder: str,
    *,
    key: str = "alert_id",
    text: str = "alert_type",
    tokenizer: str = TOKENIZER,
    length: int = 2048,
    seed: int = 42,
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """Tokenises every text, packs the tokens into sequences, permutes them and writes shards under ``folder``.

    Returns the stored slot table, one row per sequence: ``slot`` (its place in training order), ``shard``,
    ``shard_slot`` (its place in the file), ``file``, ``n_tokens`` (without filling), ``keys``. A shard is nothing
    but little-endian 16-bit token ids, 2 * ``length`` bytes a slot, so slot s stands at byte
    2 * length * shard_slot of its file and training resumes anywhere with one seek.

    NULL and empty texts give the end token alone. A NULL key is kept as a NULL in ``keys``; repeated rows are
    repeated. Texts of any length run on over sequences. Other columns are ignored. An empty table writes nothing.
    Sequences are packed along the input's partitions, and stored once before they are numbered, so retried tasks
    cannot renumber them; a shard is named after its task attempt and found through the slot table only.
    """
    stride = length * TOKEN.itemsize
    per_shard = max(1, shard_bytes // stride)
    sequences = packed_sequences(alerts, key, text, length, tokenizer)
    counts = sequences.select("_part", F.lit(1).alias("_one")).groupBy("_part").agg(F.sum("_one").alias("_one"))
    total = counts.agg(F.sum("_one")).first()[0] or 0
    order = Permutation(total, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            slots = pa.array(order.slot(batch.column(0).to_numpy()))
            small = pa.array([squeeze.compress(t) for t in batch.column("_tokens").to_pylist()], pa.binary())
            columns = [slots, batch.column("n_tokens"), batch.column("keys"), small]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "n_tokens", "keys", "_tokens"])

    # one row per packing task
    numbered = sequences.join(F.broadcast(part_offsets(counts, ["_one"])), "_part")
    numbered = numbered.select((F.col("_local") + F.col("_o__one")).alias("_index"), "n_tokens", "keys", "_tokens")
    kind = dict(numbered.dtypes)["keys"]
    placed = numbered.mapInArrow(place, f"slot bigint, n_tokens int, keys {kind}, _tokens binary")
    placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard))
    shards = -(-total // per_shard)
    tasks = max(1, min(shards, 2000))
    # contiguous shard ranges, shard_bytes each: no sampling pass over the tokens
    ranged = placed.repartitionById(tasks, F.floor(F.col("shard") * tasks / F.lit(max(1, shards))).cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = stream = None
        current = expected = None
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            slots, blobs = batch.column("slot").to_pylist(), batch.column("_tokens")
            files = []
            for number, slot in enumerate(slots):
                shard = slot // per_shard
                if shard != current:
                    if stream is not None:
                        stream.close()
                    path, stream = new_file(folder, f"shard-{shard:06d}", ".bin")
                    current, expected = shard, shard * per_shard
                if slot != expected:
                    raise ValueError(f"slot {slot} where {expected} was due")
                stream.write(expand.decompress(blobs[number].as_py()))
                expected += 1
                files.append(path)
            kept = batch.select(["slot", "shard", "n_tokens", "keys"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(files, pa.string())], [*kept.schema.names, "file"])
        if stream is not None:
            stream.close()

    schema = f"slot bigint, shard bigint, n_tokens int, keys {kind}, file string"
    written = ranged.sortWithinPartitions("slot").mapInArrow(write, schema)
    written = written.withColumn("shard_slot", F.col("slot") - F.col("shard") * per_shard)
    return materialise(written, "slots")


def read_training_order(slots: DataFrame, *, length: int = 2048, first_slot: int = 0) -> DataFrame:
    """(slot, tokens array<int>) from ``first_slot`` on, every shard read sequentially from its first wanted slot."""
    wanted = slots.where(F.col("slot") >= first_slot)
    runs = wanted.groupBy("shard", "file").agg(F.min("slot").alias("first"), F.min("shard_slot").alias("skip"))
    stride = length * TOKEN.itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["file"]) as stream:
                    stream.seek(row["skip"] * stride)
                    slot = row["first"]
                    while data := stream.read(1000 * stride):
                        rows = np.frombuffer(data, TOKEN).reshape(-1, length).astype(np.int32)
                        numbers = pa.array(range(slot, slot + len(rows)), pa.int64())
                        yield pa.RecordBatch.from_arrays([numbers, pa.array(list(rows), pa.list_(pa.int32()))], ["slot", "tokens"])
                        slot += len(rows)

    return runs.mapInArrow(read, "slot bigint, tokens array<int>")
