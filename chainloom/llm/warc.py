"""A deterministic sharded WARC writer, and its reader.

Records are sorted by page_id and digest and the order is cut into runs of equally
many rows, at places that depend on the rows alone.  Each run goes to one task, which
writes it as gzip members, rolls to a new file when the compressed size passes a
limit, writes under temporary names, renames, and reports the file for the manifest,
which is written beside the files.  Headers and digests are made anew, dates are a
parameter, and gzip headers hold no time, so a rerun gives the same bytes.

Of records with equal payloads the one with the largest page_id is a response and
the others revisit it.  Which page that is comes from an aggregate over digests
(rows of a few bytes, combined before the shuffle); the decision then travels as
a small row beside its page through the one shuffle of payloads.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import cut_keys, rows_a_run, run_of, sortable
from .workspace import filesystem, fresh_dir, map_texts, materialise, publish

ROLL_BYTES, LEVEL, DATE = 64 << 20, 1, "2020-01-01T00:00:00Z"
RUN_BYTES, TASK_BYTES = 32 << 20, 16 << 20  # payload bytes in a run; bytes of archives in a reading task
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, roll int, path string, records long, bytes long, first_page long, last_page long, sha1 string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _header_text(value: str) -> str:
    """A header value on one line: controls and spaces are percent-encoded."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _header_text(url) if url else _name(page_id)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, roll, out = None, 0, None
        rows: list[tuple] = []
        size = records = 0
        seal = hashlib.sha1()
        span: list[int | None] = [None, None]

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            seal.update(data)
            size += len(data)

        def close() -> None:
            nonlocal out, roll, size, records, seal, span
            if out is None:
                return
            out.close()
            name = f"part-{shard:06d}-{roll:05d}.warc.gz"
            where.move(f"{root}/{name}.{attempt}.tmp", f"{root}/{name}")
            rows.append((shard, roll, f"{folder}/{name}", records, size, *span, seal.hexdigest()))
            out, roll, size, records, seal, span = None, roll + 1, 0, 0, hashlib.sha1(), [None, None]

        page, decisions, done = object(), {}, set()
        for batch in batches:
            for run_, page_id, kind, sha, url, html, response in zip(*(batch.column(c).to_pylist() for c in ("run", "page_id", "kind", "sha", "url", "html", "response"))):
                if run_ != shard:
                    close()
                    shard, roll, page = run_, 0, object()
                if page_id != page:
                    page, decisions, done = page_id, {}, set()
                if kind == 0:
                    decisions[sha] = response
                    continue
                target = decisions.get(sha, page_id)
                revisit = sha in decisions and (target != page_id or sha in done)
                done.add(sha)
                if out is None:
                    out = where.open_output_stream(f"{root}/part-{shard:06d}-{roll:05d}.warc.gz.{attempt}.tmp")
                    name = f"part-{shard:06d}-{roll:05d}.warc.gz"
                    put(record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                put(page_record(page_id, url, html, target, revisit, date))
                records += 1
                if page_id is not None:
                    span = [page_id if span[0] is None else span[0], page_id]
                if size >= roll_bytes:
                    close()
        close()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, date: str = DATE, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` and return the manifest.

    A null html is an empty payload, a null url becomes a name made of the page_id.
    Payloads under ``min_bytes`` are all responses.  Rows that repeat a page_id with
    the same payload revisit the first of them; rows without page_id come first and
    are responses only if no row of their payload has a page_id, one of each.
    """
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    where, root = filesystem(folder)
    where.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("sha"), F.col("url").cast("string").alias("url"), html.alias("html"))
    small = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "sha")
    best = small.groupBy("sha").agg(F.max("page_id").alias("response"))
    decisions = materialise(small.distinct().join(best, "sha"), "responses")
    nothing = F.lit(None)
    key = F.concat(sortable(F.col("page_id")), "sha")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html") + 1), F.lit(1))).first()
    cuts = cut_keys(rows.select(key.alias("key")), rows_a_run(n, size, run_bytes))
    both = rows.select("page_id", F.lit(1).alias("kind"), "sha", "url", "html", nothing.cast("long").alias("response")).unionByName(
        decisions.select("page_id", F.lit(0).alias("kind"), "sha", nothing.cast("string").alias("url"), nothing.cast("binary").alias("html"), "response")
    )
    ordered = both.withColumn("run", run_of(key, cuts)).repartition("run").sortWithinPartitions("run", "page_id", "sha", "kind", "url")
    return publish(map_texts(ordered, _writer(folder, roll_bytes, date), MANIFEST), folder, "manifest")


def members(source, chunk: int = 1 << 14) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked one by one."""
    left, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        data = left or source.read(chunk)
        if not data:
            return
        parts.append(unpack.decompress(data))
        left = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a block that contradicts its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def _page_of(name: str | None) -> int | None:
    tail = (name or "none>")[:-1].rpartition(":")[2]
    return None if tail in ("none", "") else int(tail)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url, from the files in the manifest."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, at = filesystem(path)
                rows: list[tuple] = []
                with where.open_input_stream(at, compression=None) as source:
                    for raw in members(source):
                        headers, block = parse(raw)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.decode().partition("Content-Length: ")[2].split("\r\n")[0])
                        sum_ = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != sum_):
                            raise ValueError(f"damaged payload in {path}")
                        rows.append((_page_of(headers["WARC-Record-ID"]), length, sum_, headers["WARC-Type"], _page_of(headers.get("WARC-Refers-To")), headers["WARC-Target-URI"]))
                        if len(rows) >= 20_000:
                            yield out(rows)
                            rows = []
                yield out(rows)

    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return manifest.select("path").repartition(max(1, -(-size // TASK_BYTES)), "path").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives and return what they say of each page."""
    return read_archives(write_archives(pages, min_bytes=min_bytes, roll_bytes=roll_bytes)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
