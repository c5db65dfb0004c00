"""Token ids as Arrow files of fixed-size lists.

Documents are dealt by ranges of their key, each range is tokenised in order
and written as one Arrow IPC file.  A file's rows are sequences of equal length
(``ids``: fixed_size_list<uint16 or uint32>) with a mask of the same length that
is false on the padding after the last document.  Nothing is compressed, so a
memory-mapped reader finds sequence ``i`` without touching the others.  An index
table holds for each document its file, its place in the file's token stream
and its length; the position over all files follows from the files' totals.

Files go below the shared folder through the file system that its path names.
A task writes under a name of its own and renames at the end; the same rows
give the same bytes, so that a repeated task only writes again what was there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import shared_path, stored

#: Distinct chunks of text whose ids a worker remembers (some 150 MB).
REMEMBERED = 1_000_000
#: Tokens that a task gathers before it writes a record batch.
BATCH_TOKENS = 1 << 20


class Encoder:
    """A tokenizer that drops white space, ends every word with an id of its
    own kind and never joins across white space, with the ids of known chunks
    remembered.

    A text falls apart at spaces and line ends; chunks that a worker has seen
    cost one look-up.  New words of letters are encoded in one call and parted
    at their last ids; a full stop or comma behind one is encoded by itself, as
    the tokenizer does; other new chunks have a call each.  Chunks are
    lower-cased first as the tokenizer does, but for texts with letters whose
    lower case depends on their place.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype(kind)
        self.known: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _learn(self, parts: list[str]) -> None:
        known = self.known
        new = {p for p in parts if p not in known}
        if len(known) + 2 * len(new) > REMEMBERED:
            known.clear()
            new = set(parts)
        # a lower case of more signs than letters may end in a mark, which the tokenizer keeps with what follows
        plain = lambda p: p.isalpha() and p.lower().isalpha()
        stops = {p for p in new if p[-1:] in (".", ",") and plain(p[:-1])}
        words = [p for p in {p[:-1] for p in stops} | {p for p in new if plain(p)} if p not in known]
        if words:
            ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                known.update((w, x.tobytes()) for w, x in zip(words, np.split(ids, ends[:-1]), strict=True))
            else:
                known.update((w, self._bytes(e.ids)) for w, e in zip(words, self.model.encode_batch_fast(words, add_special_tokens=False), strict=True))
        rest = [p for p in new if p not in stops and p not in known] + [c for c in (".", ",") if c not in known]
        known.update((p, self._bytes(e.ids)) for p, e in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        known.update((p, known[p[:-1]] + known[p[-1]]) for p in stops)

    def __call__(self, text: str) -> np.ndarray:
        if "Σ" not in text and "İ" not in text:
            text = text.lower()
        parts = text.replace("\n", " ").split(" ")
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), dtype=self.kind)
        except KeyError:
            self._learn(parts)
            return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), dtype=self.kind)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary file; tasks share it."""
    if (path, kind) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Packs a stream of ids into sequences and writes whole batches."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.schema = sequence_schema(length, kind)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.length, self.kind = length, kind
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= BATCH_TOKENS:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind.to_pandas_dtype())
        full = len(ids) // self.length * self.length
        rest = ids[full:]
        mask = np.ones(full, dtype=bool)
        if last and len(rest):
            pad = self.length - len(rest)
            ids, mask = np.concatenate([ids, np.zeros(pad, ids.dtype)]), np.concatenate([mask, np.ones(len(rest), bool), np.zeros(pad, bool)])
            full, rest = len(ids), rest[:0]
        if full:
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids[:full], mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.count = [rest], len(rest)

    def close(self) -> None:
        self._write(True)
        self.file.close()


def write_sequences(
    docs: DataFrame, vocabulary: str, folder: str, text: str = "text", key: str = "doc_id", end: int = 1, length: int = 2048, wide: bool = False,
    encode: Callable[[str], list[int]] | None = None,
) -> DataFrame:
    """Writes the files and returns their index: key, file, at, n_tokens, nth
    (the document's place in its file).

    ``vocabulary`` is the path of the tokenizer's file, which every executor
    has; ``wide`` takes 32-bit ids (for vocabularies over 65,536).
    """
    kind = pa.uint32() if wide else pa.uint16()
    name = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        file = f"part-{task.partitionId():06d}.arrow"
        draft = f"{base}/.{file}.{uuid.uuid4().hex}"
        ids_of = encode or encoder(vocabulary, str(kind))
        with system.open_output_stream(draft) as sink:
            writer, at, nth = _Writer(sink, length, kind), 0, 0
            while batch is not None:
                counts = []
                for body in batch.column(1):
                    ids = np.append(np.asarray(ids_of(body.as_py() or ""), dtype=kind.to_pandas_dtype()), kind.to_pandas_dtype()(end))
                    writer.add(ids)
                    counts.append(len(ids))
                sizes = np.array(counts, dtype=np.int64)
                starts = at + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([file] * len(sizes)), pa.array(starts), pa.array(sizes), pa.array(np.arange(nth, nth + len(sizes), dtype=np.int64))],
                    names=["id", "file", "at", "n_tokens", "nth"],
                )
                at, nth = at + int(sizes.sum()), nth + len(sizes)
                batch = next(batches, None)
            writer.close()
        system.move(draft, f"{base}/{file}")

    order = F.col("id").asc_nulls_first()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order, "text")
    return stored(dealt.mapInArrow(run, f"id {name}, file string, at bigint, n_tokens bigint, nth bigint"), "token-index")


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: key, start over all files, n_tokens,
    ids_crc32, masked (the tokens that its file's mask marks as real)."""
    from pyspark.sql import Window as W

    # one row per file
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    wanted = index.join(F.broadcast(totals), "file").repartition("file").sortWithinPartitions("file", "at")
    name = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        opened, source, reader, first = "", None, None, []
        for batch in batches:
            rows = batch.to_pydict()
            crcs, marked = [], []
            for file, at, n in zip(rows["file"], rows["at"], rows["n_tokens"], strict=True):
                if file != opened:
                    path = f"{base}/{file}"
                    source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
                    reader, opened = pa.ipc.open_file(source), file
                    length = reader.schema.field("ids").type.list_size
                    counts = [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)]
                    first = np.concatenate([[0], np.cumsum(counts)]) * length
                crc, real, here = 0, 0, at
                while here < at + n:
                    i = int(np.searchsorted(first, here, side="right")) - 1
                    block, a = reader.get_batch(i), here - int(first[i])
                    b = min(a + at + n - here, int(first[i + 1] - first[i]))
                    ids = block.column(0).flatten().slice(a, b - a).to_numpy(zero_copy_only=True)
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    real += block.column(1).flatten().slice(a, b - a).true_count
                    here += b - a
                crcs.append(crc)
                marked.append(real)
            start = np.array(rows["before"], dtype=np.int64) + np.array(rows["at"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), pa.array(start), batch.column(batch.schema.get_field_index("n_tokens")), pa.array(crcs, pa.int64()), pa.array(marked, pa.int64())],
                names=["id", "start", "n_tokens", "ids_crc32", "masked"],
            )

    return wanted.mapInArrow(run, f"id {name}, start bigint, n_tokens bigint, ids_crc32 bigint, masked bigint")


def token_files(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Writes ``docs`` and reads them back: one row per input row with key,
    start, n_tokens, ids_crc32.

    A null or empty text is its end id alone; a null key stands first; rows
    that repeat a key stand in the order of their texts; an empty table writes
    no file and gives no rows; other columns are not read.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    index = write_sequences(docs, vocabulary, folder, text, key, **options)
    read = read_documents(index, folder)
    broken = F.raise_error(F.concat(F.lit("the mask of a sequence is wrong from token "), F.col("start").cast("string"))).cast("bigint")
    return read.select(F.col("id").alias(key), "start", F.when(F.col("masked") == F.col("n_tokens"), F.col("n_tokens")).otherwise(broken).alias("n_tokens"), "ids_crc32")
