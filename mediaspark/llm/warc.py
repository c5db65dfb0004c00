"""WARC archives written by Spark and read back block by block.

Writing.  A record is one string column, and Spark's text sink writes it with
the records' trailer as line separator, so that archives are committed as any
other table.  Of rows with equal payloads the one with the smallest key is a
``response``, the others are ``revisit`` records without a payload.  Digests
find the groups.  What is known about them comes back to the rows in two steps,
so that payloads without a copy are never shuffled: a bitmap of hashed digests
of fixed size tells rows that surely have none, and only the others are joined.

Reading.  Files are cut into blocks that tasks scan for the version line of a
record, which may also stand inside a payload.  Every such place is a candidate
that, by its length field, points to its successor.  Within a block a task
follows these pointers to where each candidate's chain leaves the block; over
the blocks the chains are followed by pointer jumping, the pointers' reach
doubling per round, from the start of each file.  Only candidates that are
reached are records, and a file whose chain does not arrive at its end is an
error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.llm.common import file_system, let, shared_path, stored, told_apart

#: Bytes of a file that a task scans at a time.
BLOCK = 4 << 20

# fixed values of the format
VERSION, END, TRAILER = "WARC/1.1", "\r\n", "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE16_32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", re.IGNORECASE)


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column."""
    digits = lambda h: F.concat(*[F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(let(F.sha1(payload.cast("binary")), digits), _BASE16_32, _BASE32)


def record_id(key: Column, digest: Column) -> Column:
    """A record's name, the same whenever it is written."""
    name = F.sha2(F.concat_ws("|", key.cast("string"), digest).cast("binary"), 256)
    parts = lambda h: F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), let(name, parts), F.lit(">"))


def _copies(rows: DataFrame, minimum: int) -> DataFrame:
    """(digest, first) of the payloads that occur more than once."""
    groups = rows.where(F.octet_length("payload") >= minimum).groupBy(F.unhex(F.sha1("payload")).alias("digest"))
    return stored(groups.agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "copies")


def _typed(rows: DataFrame, minimum: int) -> DataFrame:
    """Adds copied (a payload that occurs again) and first (the smallest key
    that has it)."""
    copies = _copies(rows, minimum)
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    single, perhaps = told_apart(keyed, F.xxhash64("digest"), copies, F.xxhash64("digest"))
    single = single.withColumns({"first": F.lit(None).cast(rows.schema["id"].dataType), "copied": F.lit(False)})
    joined = perhaps.join(copies.hint("merge").withColumn("copied", F.lit(True)), "digest", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    return single.unionByName(joined).drop("digest")


def _record(rows: DataFrame, date: str) -> Column:
    """The record of (id, uri, payload, first, copied), without its trailer."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    # signs that would end a header line, and those that an address can't have
    clean = F.regexp_replace("uri", r"[\x00-\x20\x7F]+", "%20")
    digest = payload_digest(F.col("payload"))
    head = lambda n: F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), n.cast("string"), F.lit(TRAILER))
    size = F.octet_length("payload")
    again = F.col("copied") & ~F.col("id").eqNullSafe(F.col("first"))

    def full(d: Column) -> Column:
        block = F.concat(head(size), F.when(again, F.lit("")).otherwise(F.col("payload").cast("string")))
        length = F.octet_length(head(size)) + F.when(again, F.lit(0)).otherwise(size)
        refers = F.when(again, F.concat(line("WARC-Refers-To", record_id(F.col("first"), d)), F.lit(f"WARC-Profile: {SAME_PAYLOAD}{END}"))).otherwise(F.lit(""))
        return F.concat(
            F.lit(f"{VERSION}{END}"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", record_id(F.col("id"), d)), F.lit(f"WARC-Date: {date}{END}"), optional("WARC-Target-URI", clean),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), d)), refers, optional("X-Row-Key", F.col("id").cast("string")),
            F.lit(f"Content-Type: application/http; msgtype=response{END}"), line("Content-Length", length.cast("string")), F.lit(END), block,
        )

    return let(digest, full)


def write_archives(rows: DataFrame, folder: str, payload: str, key: str, uri: str | None = None, minimum: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record per row into files of ``folder``, one per task.

    Payloads below ``minimum`` bytes are responses even if they are equal.
    """
    address = F.col(uri).cast("string") if uri else F.lit(None).cast("string")
    plain = rows.select(F.col(key).alias("id"), address.alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    _typed(plain, minimum).select(_record(plain, date).alias("value")).write.option("lineSep", TRAILER).text(folder)


def blocks(spark: SparkSession, folder: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """((file, size, start), most blocks of a file) of the files of a folder."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select(F.col("path").alias("file"), F.col("length").alias("size"))
    total = files.agg(F.sum(F.ceil(F.col("size") / block)).alias("n"), F.max(F.ceil(F.col("size") / block)).alias("most")).first()
    cut = files.select("file", "size", F.explode(F.expr(f"sequence(0L, size - 1, {block}L)")).alias("start"))
    return cut.repartition(max(1, min(20_000, (total["n"] or 0) // 4)), "file", "start"), total["most"] or 0


class _Source:
    """Reads stretches of files and keeps the last file open."""

    def __init__(self):
        self.name, self.file = None, None

    def __call__(self, name: str, start: int, size: int) -> bytes:
        if name != self.name:
            system, path = file_system(name)
            self.name, self.file = name, system.open_input_file(path)
        return self.file.read_at(size, start)


def candidates(cut: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, size, start, at, next, exit): per block the places that look like
    a record, their successors, and where the chain of each leaves the block.

    A place without a header, a length or room for it has no successor and is
    left out; an exit is null where a chain ends inside a block.
    """
    margin = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Source()
        for batch in batches:
            ats, nexts, exits = [], [], []
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stop = min(start + block, size)
                data = read(file, start, block + margin)
                at, after = [], []
                for found in _MAGIC.finditer(data):
                    if start + found.start() >= stop:
                        break
                    # headers may end behind the block
                    while (end := data.find(b"\r\n\r\n", found.start())) < 0 and start + len(data) < size:
                        data += read(file, start + len(data), max(block, len(data)))
                    length = _LENGTH.search(data, found.start(), end + 2) if end >= 0 else None
                    if length and (to := start + end + 4 + int(length[1]) + 4) <= size:
                        at.append(start + found.start())
                        after.append(to)
                leaves: dict[int, int | None] = {}
                for a, b in zip(reversed(at), reversed(after), strict=True):
                    leaves[a] = b if b >= stop else leaves.get(b)
                ats.append(at)
                nexts.append(after)
                exits.append([leaves[a] for a in at])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ats, longs), pa.array(nexts, longs), pa.array(exits, longs)], names=["file", "size", "start", "at", "next", "exit"])

    return cut.select("file", "size", "start").mapInArrow(run, "file string, size bigint, start bigint, at array<bigint>, next array<bigint>, exit array<bigint>")


def reached(links: DataFrame, most: int) -> DataFrame:
    """(file, at): where the chain from each file's start enters blocks, and its
    end if it arrives there, by pointer jumping."""
    flat = links.select("file", F.explode(F.arrays_zip("at", "exit")).alias("l")).select("file", "l.at", "l.exit").where("exit is not null")
    # only places that some chain enters a block by, and starts of files
    doors = flat.select("file", F.col("exit").alias("at")).unionByName(links.where("start = 0").select("file", F.lit(0).cast("long").alias("at"))).distinct()
    jump = stored(flat.join(doors, ["file", "at"], "left_semi"), "jumps")
    there = stored(links.where("start = 0").select("file", F.lit(0).cast("long").alias("at")), "reached")
    rounds = max(1, most).bit_length()
    for i in range(rounds):
        ahead = there.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
        there = stored(there.unionByName(ahead).distinct(), "reached")
        if i < rounds - 1:
            onward = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("further"))
            jump = stored(jump.join(onward, ["file", "exit"]).select("file", "at", F.col("further").alias("exit")), "jumps")
    return there


def record_places(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(file, entry, at, exit, rejected): per block that a record starts in, the
    places of its records, the end of the last one, and the number of
    candidates that are none.

    An empty folder gives no rows.  A file whose records do not fill it from
    its first to its last byte is an error.
    """
    cut, most = blocks(spark, folder, block)
    links = stored(candidates(cut, block), "links")
    there = reached(links, most)
    files = links.where("start = 0").select("file", "size")
    broken = files.join(there.withColumnRenamed("at", "size"), ["file", "size"], "left_anti").agg(F.count("*").alias("n"), F.min("file").alias("file")).first()
    if broken["n"]:
        raise ValueError(f"{broken['n']} archives are not whole, as {broken['file']}")
    entries = there.select("file", F.col("at").alias("entry"), (F.col("at") - F.col("at") % block).alias("start"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ends, left = [], [], []
            for entry, ats, nexts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                want, mine = entry, []
                for a, b in zip(ats, nexts, strict=True):
                    if a == want:
                        mine.append(a)
                        want = b
                kept.append(mine)
                ends.append(want)
                left.append(len(ats) - len(mine))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.int64())), pa.array(ends, pa.int64()), pa.array(left, pa.int64())], names=["file", "entry", "at", "exit", "rejected"])

    # the end of a file is no entry
    met = entries.join(links.hint("merge"), ["file", "start"]).where("entry < size").select("file", "entry", "at", "next")
    return stored(met.mapInArrow(walk, "file string, entry bigint, at array<bigint>, exit bigint, rejected bigint"), "places")


_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "x-row-key")
_COLUMNS = ("type", "record_id", "uri", "digest", "refers", "key")


def read_archives(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """One row per record: file, at, type, record_id, uri, digest, refers, key,
    payload (what follows the HTTP head; null in revisit records)."""
    places = record_places(spark, folder, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Source()
        for batch in batches:
            for file, entry, ats, end in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                data = read(file, entry, end - entry)
                rows: dict[str, list] = {c: [] for c in _COLUMNS}
                payloads = []
                for a, b in zip(ats, [*ats[1:], end], strict=True):
                    record = memoryview(data)[a - entry : b - entry - 4]
                    stop = data.find(b"\r\n\r\n", a - entry) - (a - entry)
                    head = bytes(record[:stop]).decode("utf-8", "replace").split("\r\n")[1:]
                    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head)}
                    for c, f in zip(_COLUMNS, _FIELDS, strict=True):
                        rows[c].append(fields.get(f))
                    body = bytes(record[stop + 4 :])
                    if "msgtype=response" in fields.get("content-type", ""):
                        body = body.partition(b"\r\n\r\n")[2]
                    payloads.append(None if fields.get("warc-type") == "revisit" else body)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(ats)), pa.array(ats, pa.int64()), *[pa.array(rows[c], pa.string()) for c in _COLUMNS], pa.array(payloads, pa.binary())],
                    names=["file", "at", *_COLUMNS, "payload"],
                )

    return places.mapInArrow(run, "file string, at bigint, " + ", ".join(f"{c} string" for c in _COLUMNS) + ", payload binary")


def archived(rows: DataFrame, payload: str = "html", key: str = "page_id", uri: str | None = "url", minimum: int = 0, block: int = BLOCK) -> DataFrame:
    """Writes ``rows`` and reads them back: one row per input row with key,
    payload_bytes, payload_digest, record_type, refers_to.

    A null payload is empty; a null key counts as the largest; rows that repeat
    the smallest key of a payload are responses all; a null address is left
    out; an empty table writes and gives nothing; other columns are not read.
    Digests are computed anew from what was read, and a record whose own
    digest differs is an error.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    folder = shared_path(spark, "archives")
    write_archives(rows, folder, payload, key, uri, minimum)
    said = F.substring_index("digest", ":", -1)
    read = read_archives(spark, folder, block).withColumn("computed", F.when(F.col("payload").isNotNull(), payload_digest(F.col("payload"))))
    wrong = F.raise_error(F.concat(F.lit("wrong payload digest of "), F.col("record_id")))
    read = read.select("type", "record_id", "refers", "key", F.octet_length("payload").cast("long").alias("bytes"), F.when(F.coalesce("computed", said) == said, said).otherwise(wrong.cast("string")).alias("digest"))
    read = stored(read, "records")
    named = F.col("key").cast(kind)
    own = read.where("type = 'response'")
    out = own.select(named.alias(key), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    # repeated rows share a record's name
    known = own.groupBy(F.col("record_id").alias("refers")).agg(F.max("key").alias("_to"), F.max("bytes").alias("_bytes"), F.max("digest").alias("_digest"))
    again = read.where("type = 'revisit'").drop("bytes").join(known.hint("merge"), "refers", "left")
    lost = F.raise_error(F.concat(F.lit("no response for "), F.col("record_id")))
    again = again.select(
        named.alias(key), F.when(F.col("digest") == F.col("_digest"), F.col("_bytes")).otherwise(lost.cast("long")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("_to").cast(kind).alias("refers_to"),
    )
    return out.unionByName(again)
