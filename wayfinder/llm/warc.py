"""WARC archives of pages, and capture histories by an external merge of index runs.

Pages are written as WARC 1.1 records, one gzip member each, by the tasks that read them; of pages with one payload, that
with the largest id is a response and the others revisit it. Archives are then read back record by record, payload digests
are verified, and the captures of a task are sorted in bounded runs by URL key, time and page. Runs are merged k at a time by
loser trees, in passes, until one ordered history is left. A merge is split into key ranges, so that a task has a bounded
number of captures whatever the size of the corpus or of one URL's history.

Archives, runs and merged runs are files in the shared folder, named by the attempt that wrote them; a table lists the files
that count, so that what a lost attempt left is never read. Python must reach the folder (file, HDFS, S3).

Defined results: null html is an empty payload; a null url has an empty URL key, and so has one without a host; control
characters, blanks and letters beyond ASCII of a url are percent-encoded; pages without an id come first in their history and are revisits
where another page of their payload has an id, else responses; rows that repeat the largest id of a payload are all responses;
an empty table gives no row. Where several pages share URL key and time, the smaller id comes first.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfinder.llm.common import bound_batches, slices_of
from wayfinder.shared import BROADCAST_ROWS, fresh_path, materialize

#: Uncompressed bytes after which an archive is closed; captures in a sorted run; in one block of a run; runs merged at once;
#: captures in a key range; ranges of a merge at most.
ARCHIVE_BYTES, RUN_ROWS, BLOCK_ROWS, FAN_IN, RANGE_ROWS, MAX_RANGES = 256 << 20, 65_536, 1024, 32, 32_768, 10_000
#: Pages carry no time of capture; by default one is captured each second.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a URL key by which ranges are bounded.
BOUND_CHARS = 1000

CAPTURE = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("seq", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
CAPTURE_DDL = "url_key string, captured long, seq long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long, size long"
#: A block of a run: its place, its rows and its first and last (URL key cut, captured, seq).
BLOCK_DDL = "run long, range int, block int, file string, at long, size long, n long, first_key string, first_captured long, first_seq long, last_key string, last_captured long, last_seq long"
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
NO_ID = -(1 << 63)
#: What stays as it is in an address.
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query: com,example)/a?b. Scheme, user, fragment and letter case of the host don't count."""
    _, mark, rest = url.partition("://")
    if not mark:
        return ""
    rest = rest.partition("#")[0]
    end = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host = rest[:end].rpartition("@")[2].lower()
    return f"{','.join(reversed(host.split('.')))}){rest[end:] or '/'}" if host else ""


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{page}>" if page is not None else f"<urn:x-page:none-{uuid.uuid4().hex}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:x-page:").removesuffix(">")
    return None if name.startswith("none-") else int(name)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, captured: datetime) -> bytes:
    """One record; refers_to makes it a revisit, which keeps the HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    heads = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {captured.strftime('%Y-%m-%dT%H:%M:%SZ')}"]
    if url is not None:
        heads.append("WARC-Target-URI: " + quote(url, safe=PRINTABLE))
    heads.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        heads += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    heads += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page, url, captured, type, payload_bytes, digest, refers_to; an error where a payload isn't what its digest says."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"))
    digest = fields["warc-payload-digest"].partition(":")[2]
    if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its digest says")
    captured = datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    refers = fields.get("warc-refers-to")
    return {"page": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "captured": int(captured.timestamp()), "type": fields["warc-type"], "payload_bytes": size, "digest": digest, "refers_to": page_of(refers) if refers else None}


def first_captures(pages: DataFrame, digest: Column, id_col: str) -> DataFrame:
    """digest, keeper: the largest id of each payload that several pages share; written and its rows counted."""
    met = pages.select(digest.alias("digest"), F.col(id_col).cast("long").alias("id")).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    kept = materialize(met.where("n > 1 and keeper is not null").select("digest", "keeper"), "keepers")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page to an archive in folder; returns archive, n_records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, n, at, raw = None, "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], names=["archive", "n_records", "bytes"])

        for part in slices_of(batches, "html"):
            html = part.column(3).cast(pa.large_binary() if pa.types.is_large_string(part.column(3).type) else pa.binary())
            for i, (page, url, digest, keeper) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                if out is None:
                    name, n, at, raw = f"captures-{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page, url, html[i].as_py(), base64.b32encode(bytes.fromhex(digest)).decode(), keeper, EPOCH + timedelta(seconds=(page or 0) % (1 << 31)))
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out.write(member)
                n, at, raw = n + 1, at + len(member), raw + len(data)
                if raw >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    html = F.coalesce(F.col(html_col), F.lit(""))
    digest = F.sha1(html.cast("binary"))
    kept = first_captures(pages, digest, id_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), digest.alias("digest"), html.alias("html")).join(kept, "digest", "left")
    # the page that the others refer to refers to none
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("keeper")
    rows = bound_batches(rows).select("page_id", "url", "digest", "html", refers)
    return materialize(rows.mapInArrow(write, "archive string, n_records long, bytes long"), "archives")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Place, size and content of each gzip member of a stream; one member is held at a time."""
    at, held = 0, b""
    while held or (held := stream.read(1 << 20)):
        packed, size, parts = zlib.decompressobj(31), 0, []
        while not packed.eof:
            if not held and not (held := stream.read(1 << 20)):
                raise ValueError("an archive ends within a record")
            parts.append(packed.decompress(held))
            size += len(held) - len(packed.unused_data)
            held = packed.unused_data
        yield at, size, b"".join(parts)
        at += size


class RunWriter:
    """Writes the captures of a sorted run in blocks; each block can be read by itself."""

    def __init__(self, folder: str, run: int, range_: int = 0, block_rows: int = BLOCK_ROWS):
        from pyarrow import fs

        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.file, self.run, self.range, self.block_rows = f"run-{uuid.uuid4().hex}", run, range_, block_rows
        self.out, self.at, self.rows, self.blocks = self.store.open_output_stream(f"{path}/{self.file}", compression=None), 0, [], []

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.block_rows:
            self.flush()

    def flush(self) -> None:
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), CAPTURE.types, strict=True)], schema=CAPTURE)
        with pa.ipc.new_stream(sink, CAPTURE, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_batch(batch)
        data = sink.getvalue()
        self.out.write(data)
        first, last = self.rows[0], self.rows[-1]
        self.blocks.append((self.run, self.range, len(self.blocks), self.file, self.at, data.size, len(self.rows), first[0][:BOUND_CHARS], *first[1:3], last[0], *last[1:3]))
        self.at, self.rows = self.at + data.size, []

    def close(self) -> pa.RecordBatch:
        """The run's blocks."""
        if self.rows:
            self.flush()
        self.out.close()
        names = [x.split()[0] for x in BLOCK_DDL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.blocks, strict=True), BLOCK_TYPES, strict=True)], names=names)


def index_archives(archives: DataFrame, folder: str, runs: str, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Reads every record of the archives and writes the captures of each task as runs sorted by key; returns the runs' blocks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda r: r[:3])
            out = RunWriter(runs, uuid.uuid4().int >> 65, block_rows=block_rows)
            for row in held:
                out.add(row)
            held.clear()
            return out.close()

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{archive}", compression=None) as stream:
                    for at, size, raw in members(stream):
                        r = parse(raw)
                        seq = NO_ID if r["page"] is None else r["page"]
                        held.append((url_key(r["url"]), r["captured"], seq, r["page"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"], archive, at, size))
                        if len(held) >= run_rows:
                            yield flush()
        if held:
            yield flush()

    # an archive is read by one task; there are as many as tasks wrote, or more
    dealt = archives.select("archive").repartition(max(1, archives.count()))
    return materialize(dealt.mapInArrow(scan, BLOCK_DDL), "runs")


def read_block(source, at: int, size: int) -> list[tuple]:
    source.seek(at)
    with pa.ipc.open_stream(pa.py_buffer(source.read(size))) as r:
        return list(zip(*(c.to_pylist() for c in r.read_all().columns), strict=True))


class LoserTree:
    """Merges sorted iterators of rows by their first three fields; a row costs one comparison on each level of the tree."""

    def __init__(self, inputs: list[Iterator[tuple]]):
        self.inputs, self.n = inputs, len(inputs)
        self.rows = [next(x, None) for x in inputs]
        self.losers = [-1] * self.n
        self.winner = -1
        for leaf in range(self.n):
            self.play(leaf, filling=True)

    def before(self, a: int, b: int) -> bool:
        """Whether input a's row comes before b's; an input that has ended comes last, equal keys go by input."""
        x, y = self.rows[a], self.rows[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[:3], a) < (y[:3], b)

    def play(self, leaf: int, filling: bool = False) -> None:
        """Takes a leaf's row up to the root: the loser of each match stays at its node. While filling, the first to come waits."""
        node, best = (leaf + self.n) >> 1, leaf
        while node:
            other = self.losers[node]
            if other < 0 and filling:
                self.losers[node] = best
                return
            if other >= 0 and self.before(other, best):
                self.losers[node], best = best, other
            node >>= 1
        self.winner = best

    def __iter__(self) -> Iterator[tuple]:
        while self.n and self.rows[self.winner] is not None:
            at = self.winner
            yield self.rows[at]
            self.rows[at] = next(self.inputs[at], None)
            self.play(at)


def slice_of(store, path: str, blocks: list[dict], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a run's blocks, in order, whose key is at least low and below high."""
    for b in blocks:
        with store.open_input_file(f"{path}/{b['file']}") as source:
            rows = read_block(source, b["at"], b["size"])
        for row in rows:
            if low is not None and row[:3] < low:
                continue
            if high is not None and row[:3] >= high:
                return
            yield row


def bounds_of(blocks: DataFrame, ranges: int) -> list[tuple]:
    """Keys that part the blocks into about as many equal ranges as asked for, at most MAX_RANGES."""
    if ranges <= 1:
        return []
    first = ["first_key", "first_captured", "first_seq"]
    dealt = blocks.select(*first).repartitionByRange(min(ranges, MAX_RANGES), *first)
    least = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*first)).alias("k"))
    return sorted(tuple(r["k"]) for r in least.collect())[1:]


def merge_pass(blocks: DataFrame, folder: str, fan_in: int, range_rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merges groups of runs, each in key ranges; returns the blocks of the merged runs, one for each group."""
    spark = blocks.sparkSession
    sizes = blocks.groupBy("run").agg(F.sum("n").alias("n"))
    total, runs = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    groups = -(-runs // fan_in)
    bounds = spark.sparkContext.broadcast(bounds_of(blocks, -(-total // max(1, groups) // range_rows)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            first = [bisect_right(bounds.value, (r["first_key"], r["first_captured"], r["first_seq"])) for r in rows]
            last = [bisect_right(bounds.value, (r["last_key"], r["last_captured"], r["last_seq"])) for r in rows]
            met = [(i, t) for i, (a, b) in enumerate(zip(first, last, strict=True)) for t in range(a, b + 1)]
            yield batch.take(pa.array([i for i, _ in met], pa.int64())).append_column("to", pa.array([t for _, t in met], pa.int32()))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        group, to = (k.as_py() for k in key)
        by_run: dict[int, list[dict]] = {}
        for b in sorted(table.to_pylist(), key=lambda b: (b["run"], b["range"], b["block"])):
            by_run.setdefault(b["run"], []).append(b)
        low, high = bounds.value[to - 1] if to else None, bounds.value[to] if to < len(bounds.value) else None
        tree = LoserTree([slice_of(store, path, x, low, high) for x in by_run.values()])
        out = RunWriter(folder, group, to, block_rows)
        for row in tree:
            out.add(row)
        done = out.close() if out.rows or out.blocks else None
        if done is None:
            out.out.close()
            return pa.table([pa.array([], t) for t in BLOCK_TYPES], names=[x.split()[0] for x in BLOCK_DDL.split(", ")])
        return pa.Table.from_batches([done])

    # a run's group by a hash would be uneven; ids of runs are random, so that their order is
    if groups <= 1:
        numbered = blocks.withColumn("group", F.lit(0).cast("long"))
    else:
        ids = sizes.select("run").repartitionByRange("run").withColumn("p", F.spark_partition_id())
        ids = materialize(ids, "run-ids")
        before = ids.groupBy("p").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).select("p", F.coalesce("before", F.lit(0)).alias("before"))
        ids = ids.join(before, "p").withColumn("group", F.floor((F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("run")) - 1) / fan_in)).select("run", "group")
        numbered = blocks.join(ids, "run")
    dealt = numbered.select(*blocks.columns, "group").mapInArrow(deal, BLOCK_DDL + ", group long, to int")
    return materialize(dealt.groupBy("group", "to").applyInArrow(merge, BLOCK_DDL), "merged")


def merged(blocks: DataFrame, folder: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the one run that all runs are merged to."""
    while True:
        runs = blocks.select("run").distinct().count()
        blocks = merge_pass(blocks, folder, fan_in, range_rows, block_rows) if runs else blocks
        if runs <= fan_in:
            return blocks


def histories(blocks: DataFrame, folder: str) -> DataFrame:
    """All captures in order: by range, block and place (columns range, block, place before those of a capture)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for b in batch.to_pylist():
                with store.open_input_file(f"{path}/{b['file']}") as source:
                    source.seek(b["at"])
                    with pa.ipc.open_stream(pa.py_buffer(source.read(b["size"]))) as r:
                        rows = r.read_all().combine_chunks()
                n = rows.num_rows
                head = [pa.repeat(pa.scalar(b["range"], pa.int32()), n), pa.repeat(pa.scalar(b["block"], pa.int32()), n), pa.array(range(n), pa.int32())]
                yield from pa.table([*head, *rows.columns], names=["range", "block", "place", *CAPTURE.names]).to_batches()

    return blocks.select("file", "at", "size", "range", "block").mapInArrow(read, "range int, block int, place int, " + CAPTURE_DDL)


def capture_histories(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, run_rows: int = RUN_ROWS, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Archives the pages, indexes the archives and merges the index; one row for each capture, with its place in its archive."""
    spark: SparkSession = pages.sparkSession
    archive, index = fresh_path(spark, "warc"), fresh_path(spark, "cdx")
    archives = write_archives(pages, archive, id_col, url_col, html_col, archive_bytes)
    runs = index_archives(archives, archive, index, run_rows, block_rows)
    return histories(merged(runs, index, fan_in, range_rows, block_rows), index)


def read_capture(folder: str, archive: str, at: int, size: int) -> dict:
    """One record by its place in its archive."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{archive}") as source:
        source.seek(at)
        return parse(zlib.decompress(source.read(size), 31))
