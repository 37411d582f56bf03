"""WARC archives and capture histories.

``write`` stores one record per page in ``.warc.gz`` files (a gzip member per record) in the shared
folder: a response with the payload, or a revisit of the response with an equal payload and the
least page_id. ``read`` opens the archives, checks digests, and sorts what it finds into local runs
by URL key, time and page. Runs are cut at global range bounds into blocks of bounded size; each
range then takes its blocks by first key and merges them with a loser tree, a block being opened
when the merge reaches it. Ranges and places in them give the global order of captures.

A file is written under a temporary name and then moved, and its content depends on its rows only,
so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import shared_dir, stored

MIN_REVISIT_BYTES = 0
FILE_BYTES = 64 << 20
BROADCAST_DIGESTS = 200_000
RUN_ROWS, BLOCK_ROWS = 1 << 16, 512
# Range bounds come from at most so many keys; they only balance ranges.
SAMPLE_KEYS, KEYS_PER_FILE = 20_000, 64
EPOCH = dt.datetime(2024, 1, 1)
ENTRY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, file string, offset long, length long"
FIELDS = [x.split()[0] for x in ENTRY.split(", ")]


def base32(hex_digest) -> F.Column:
    """Upper-case base32 of a 40-digit hexadecimal column: twenty bits are five of its digits and four of base32's."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: scheme, ``www.``, port and fragment don't count."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "", re.S)
    if not m:
        return (url or "").split("#")[0].lower()
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def captured_at(page_id: int | None) -> str:
    """Pages carry no time of capture; one second per page_id stands in, within 100 years."""
    return (EPOCH + dt.timedelta(seconds=(page_id or 0) % 3_155_760_000)).strftime("%Y%m%d%H%M%S")


def order_key(key: str, captured: str, page_id: int | None) -> str:
    return f"{key}\0{captured}\0{(page_id if page_id is not None else -1) + (1 << 63):020d}"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, name: str) -> bytes:
    """A WARC/1.1 record. Control characters and spaces of the URL are escaped; a null URL is about:blank."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    when = dt.datetime.strptime(captured_at(page_id), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archives of (page_id, url, html) in ``folder``; returns (file, records, keys): each file and a bounded sample of its keys.

    Null html: an empty payload. Rows alike in page_id and payload are all responses if that
    page_id is the least. Empty table: no files.
    """
    body = F.coalesce("html", F.lit(""))
    digest = F.sha1(body)
    size = F.octet_length(body).cast("long")
    seen = pages.select("page_id", digest.alias("digest"), size.alias("size")).where(F.col("size") >= min_bytes)
    again = stored(seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    # Few repeated payloads are broadcast, so no page is shuffled; of more, adaptive execution splits a common one.
    few = again.count() <= BROADCAST_DIGESTS
    rows = pages.select("page_id", "url", "html", digest.alias("digest"), size.alias("size")).join(F.broadcast(again) if few else again, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = rows.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "size", base32(F.col("digest")).alias("digest"), refers.alias("refers_to"))
    rows = rows.sortWithinPartitions("page_id", "digest", "url")

    def run(batches):
        filesystem, path = _fs(folder)
        filesystem.create_dir(path, recursive=True)
        ctx = TaskContext.get()
        part, attempt, files, k = ctx.partitionId(), ctx.taskAttemptId(), 0, 0
        out, written, keys = None, 0, []

        def close():
            nonlocal files
            out.close()
            name = f"part-{part:06d}-{files:05d}.warc.gz"
            filesystem.move(f"{path}/.{attempt}.tmp", f"{path}/{name}")
            files += 1
            step = max(1, -(-len(keys) // KEYS_PER_FILE))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([sorted(keys)[::step]], pa.list_(pa.string()))], ["file", "records", "keys"])

        for b in batches:
            for page_id, url, html, n, sha, ref in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out, written, keys = filesystem.open_output_stream(f"{path}/.{attempt}.tmp", compression=None), 0, []
                raw = record(page_id, url, (html or "").encode(), n, sha, ref, str(page_id) if page_id is not None else f"none-{part}-{k}")
                k += 1
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(raw) + z.flush()
                out.write(member)
                written += len(member)
                keys.append(order_key(url_key(url), captured_at(page_id), page_id))
                if written >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stored(rows.mapInArrow(run, "file string, records long, keys array<string>"))


def members(stream, chunk: int = 1 << 20):
    """(offset, length, content) of each gzip member."""
    at, data = 0, stream.read(chunk)
    while data:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not data:
                raise ValueError("an archive ends within a record")
            parts.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data if z.eof else stream.read(chunk)
        yield at, used, b"".join(parts)
        at += used
        if not data:
            data = stream.read(chunk)


def parse(content: bytes) -> dict:
    """What a record says; a response's payload must have the digest in its head."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not that of its digest")
        size = len(payload)
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and re.fullmatch(r"<urn:page:-?\d+>", x) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")),
        "url_key": url_key(fields["WARC-Target-URI"]), "captured": re.sub(r"[^0-9]", "", fields["WARC-Date"]), "payload": payload if kind == "response" else None,
    }


class LoserTree:
    """k-way merge: each inner node holds the loser of its match, the root's winner is the least head."""

    def __init__(self, runs: list[list]):
        self.runs, self.pos, self.k = [r for r in runs if r], [], 0
        self.pos = [0] * len(self.runs)
        self.build()

    def build(self) -> None:
        self.k = len(self.runs)
        self.node = [-1] * max(self.k, 1)
        if self.k:
            winner = [0] * self.k + list(range(self.k))
            for i in range(self.k - 1, 0, -1):
                a, b = winner[2 * i], winner[2 * i + 1]
                if self.less(b, a):
                    a, b = b, a
                winner[i], self.node[i] = a, b
            self.node[0] = winner[1] if self.k > 1 else 0

    def head(self, r: int):
        return self.runs[r][self.pos[r]] if self.pos[r] < len(self.runs[r]) else None

    def less(self, a: int, b: int) -> bool:
        x, y = self.head(a), self.head(b)
        return y is None and x is not None or (x is not None and y is not None and (x[0], a) < (y[0], b))

    def add(self, run: list) -> None:
        """One more run; runs at their end leave."""
        live = [r for r in range(self.k) if self.head(r) is not None]
        self.runs, self.pos = [self.runs[r] for r in live] + [run], [self.pos[r] for r in live] + [0]
        self.build()

    def peek(self):
        return self.head(self.node[0]) if self.k else None

    def pop(self):
        r = self.node[0]
        out = self.head(r)
        self.pos[r] += 1
        i = (r + self.k) // 2
        while i > 0:
            if self.less(self.node[i], r):
                self.node[i], r = r, self.node[i]
            i //= 2
        self.node[0] = r
        return out


def bounds(files: DataFrame, ranges: int) -> list[str]:
    """Keys at which ranges begin, from a bounded sample."""
    share = min(1.0, 4 * SAMPLE_KEYS / max(files.agg(F.sum(F.size("keys"))).head()[0] or 0, 1))
    keys = files.select(F.explode("keys").alias("key")).where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sorted(r["key"] for r in keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_KEYS).collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def read(files: DataFrame, folder: str, ranges: int | None = None) -> DataFrame:
    """Capture histories of the archives in ``files``: the entries, with (range_id, seq) as their global order by URL key, time and page."""
    spark = files.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(files, ranges)

    def runs(batches):
        filesystem, path = _fs(folder)
        held = []

        def blocks():
            held.sort(key=lambda x: x[0])
            out, lo = [], 0
            while lo < len(held):
                r = bisect_right(cuts, held[lo][0])
                hi = lo + 1
                while hi < len(held) and hi - lo < BLOCK_ROWS and (r == len(cuts) or held[hi][0] < cuts[r]):
                    hi += 1
                out.append((r, held[lo][0], [x[0] for x in held[lo:hi]], [x[1] for x in held[lo:hi]]))
                lo = hi
            held.clear()
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.list_(ENTRY_TYPE))], ["range_id", "first", "keys", "rows"])

        for b in batches:
            for name in b.column("file").to_pylist():
                with filesystem.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for offset, length, content in members(stream):
                        x = parse(content)
                        x |= {"file": name, "offset": offset, "length": length}
                        held.append((order_key(x["url_key"], x["captured"], x["page_id"]), {f: x[f] for f in FIELDS}))
                        if len(held) >= RUN_ROWS:
                            yield blocks()
        if held:
            yield blocks()

    ENTRY_TYPE = pa.struct([(f, pa.int64() if f in ("page_id", "payload_bytes", "refers_to", "offset", "length") else pa.string()) for f in FIELDS])  # noqa: N806

    def merge(batches):
        at, seq, tree, out = None, 0, LoserTree([]), []

        def drain(until=None):
            nonlocal seq
            while (x := tree.peek()) is not None and (until is None or x[0] < until):
                out.append(tree.pop()[1] | {"range_id": at, "seq": seq})
                seq += 1
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, OUT)
                    out.clear()

        for b in batches:
            for r, first, keys, rows in zip(*(c.to_pylist() for c in b.columns)):
                yield from drain(first if r == at else None)
                if r != at:
                    at, seq, tree = r, 0, LoserTree([])
                tree.add(list(zip(keys, rows)))
        yield from drain()
        if out:
            yield pa.RecordBatch.from_pylist(out, OUT)

    OUT = pa.schema([*ENTRY_TYPE, pa.field("range_id", pa.int64()), pa.field("seq", pa.int64())])  # noqa: N806
    found = files.select("file").repartition(max(ranges, 1), "file").mapInArrow(runs, f"range_id long, first string, keys array<string>, rows array<struct<{', '.join(x.replace(' ', ': ') for x in ENTRY.split(', '))}>>")
    return found.repartition(max(ranges, 1), "range_id").sortWithinPartitions("range_id", "first").mapInArrow(merge, f"{ENTRY}, range_id long, seq long")


def archive(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes all ``pages`` and reads the archives back: one row per page in its capture history.

    Other columns of ``pages`` are ignored. A null page_id comes back null. Empty table: no rows.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc"
    return read(write(pages, folder, min_bytes), folder)


def histories(captures: DataFrame) -> DataFrame:
    """``captures`` with ``place``, the number of each in the global order from 0 on: rows of the ranges before, and the place in its own."""
    rows = stored(captures)
    before, base = 0, []
    for r in sorted(rows.groupBy("range_id").count().collect()):  # as many rows as ranges
        base.append((r["range_id"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(base, "range_id long, base long")
    return rows.join(F.broadcast(starts), "range_id").withColumn("place", F.col("base") + F.col("seq")).drop("base")
