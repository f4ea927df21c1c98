"""WARC archives, written with revisit records and read back in parallel by boundary chains.

Reading does not trust the marker ``WARC/1.1``, since a payload may hold it. Tasks look at separate
stretches of a file and emit, for each place that could be a record, the place where its successor
would start. Only records that a chain from the start of the file reaches are real. Inside a stretch
a task follows the chains itself; between stretches, pointer jumping in Spark doubles the distance
in every round, so a file of n stretches takes about log2(n) rounds of equi-joins.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm._blobs import attempt_name, open_folder
from catalens.llm._common import drop_scratch, materialize, scratch_path

MARKER = b"WARC/1.1\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes read for a header block at first; a longer one is read on to its end.
HEADER_READ = 1 << 16
#: As many repeated payloads' digests may be broadcast (about 60 bytes each).
MAX_BROADCAST_PAYLOADS = 200_000
#: Fixed value of the format: the profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: One line of a header block (a field, or the blank line that ends the block), and such a line whose end is not read yet.
_LINE = re.compile(rb"(?:([!#$%&'*+\-.^_`|~0-9A-Za-z]+):([^\r\n]*))?\r\n")
_CUT_LINE = re.compile(rb"(?:[!#$%&'*+\-.^_`|~0-9A-Za-z]+(?::[^\r\n]*)?)?\r?\Z")
_DIGITS = re.compile(rb" *(\d{1,18}) *")
_FIELD = re.compile(rb"\r\n([A-Za-z-]+): *([^\r\n]*)")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that has the payload's length and digest only."""
    block = HTTP_HEAD + payload if refers_to is None else HTTP_HEAD
    identity = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f"page-{page_id}")
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    head = [
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:uuid:{identity}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    return MARKER + "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; the manifest (path, n_records, n_bytes).

    Payloads of one SHA-1 and length count as equal. Of equal payloads of at least ``min_payload`` bytes the smallest page_id is the response and the
    others revisit it; repeated rows of that page are responses too, and so are all rows of a payload
    that no row with a page_id has. A null html is the empty payload. Each attempt of a task writes a
    file of its own; the manifest (materialize it) names those that count. The repeated payloads'
    digests are broadcast after a count of them; above MAX_BROADCAST_PAYLOADS the join shuffles, and
    adaptive execution splits a hot payload's rows.
    """
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), raw.alias("payload"), F.sha1(raw).alias("sha1"))
    named = named.withColumn("n", F.octet_length("payload"))
    first = named.filter(F.col("n") >= min_payload).groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    first = materialize(first, "warc-repeated")
    if first.limit(MAX_BROADCAST_PAYLOADS + 1).count() <= MAX_BROADCAST_PAYLOADS:  # then no payload is shuffled
        first = F.broadcast(first)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, n, size, path = None, 0, 0, None
        for b in batches:
            for row in zip(*[b.column(c) for c in ("page_id", "url", "payload", "sha1", "first")]):
                if stream is None:
                    store, root = open_folder(folder)
                    store.create_dir(root, recursive=True)
                    path = attempt_name(root, "pages", ".warc")
                    stream = store.open_output_stream(path, compression=None)
                page_id, url, payload, sha1, target = [x.as_py() for x in row]
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), None if target == page_id else target)
                stream.write(data)
                n, size = n + 1, size + len(data)
        if stream is not None:
            stream.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

    return named.join(first, ["sha1", "n"], "left").mapInArrow(write, "path string, n_records long, n_bytes long")


class Headers:
    """Header blocks in a part of a file that begins at ``start``; a block that goes on beyond ``data`` is read to its end.

    The blocks of markers that lie in one another's headers end together, so every line is looked at
    once for all of them: the time is linear in the bytes, whatever a payload repeats.
    """

    def __init__(self, stream, start: int, data: bytes):
        self.stream, self.start, self.data, self.more = stream, start, data, HEADER_READ
        self.known: dict[int, tuple[int, int | None] | None] = {}  # by the first line's place: end and length

    def _read_on(self) -> bool:
        self.stream.seek(self.start + len(self.data))
        rest = self.stream.read(self.more)
        self.data, self.more = self.data + rest, 2 * self.more
        return bool(rest)

    def at(self, at: int) -> tuple[int, int] | None:
        """Where the block of a possible record at ``at`` starts and how long it is; None if that is no record."""
        first = line = at + len(MARKER)
        walked: list[tuple[int, int | None]] = []
        while line not in self.known:
            found = _LINE.match(self.data, line)
            if found is None:
                if _CUT_LINE.match(self.data, line) and self._read_on():
                    continue
                self.known[line] = None
            elif found.group(1) is None:
                self.known[line] = (found.end(), None)
            else:
                digits = found.group(1).lower() == b"content-length" and _DIGITS.fullmatch(found.group(2))
                walked.append((line, int(digits.group(1)) if digits else None))
                line = found.end()
        end = self.known[line]
        for place, length in reversed(walked):  # of several lengths the first counts
            if end is not None and length is not None:
                end = (end[0], length)
            if place == first or self.data.startswith(MARKER, place - len(MARKER)):
                self.known[place] = end
        return None if end is None or end[1] is None else end


def boundary_candidates(manifest: DataFrame, folder: str, stretch: int) -> DataFrame:
    """All possible records: path, at, successor, out (where the chain from here leaves its stretch), n_bytes.

    A task reads its stretch and the header that may reach beyond it.
    """
    parts = manifest.select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(stretch))).alias("begin"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        for b in batches:
            for path, n_bytes, begin in zip(*[b.column(c).to_pylist() for c in ("path", "n_bytes", "begin")]):
                with store.open_input_file(path) as stream:
                    stream.seek(begin)
                    data = stream.read(stretch + HEADER_READ)
                    found: list[tuple[int, int]] = []
                    headers, at = Headers(stream, begin, data), data.find(MARKER)
                    while 0 <= at < stretch:
                        head = headers.at(at)
                        if head:
                            found.append((begin + at, begin + head[0] + head[1] + 4))
                        at = data.find(MARKER, at + 1)
                leaves: dict[int, int] = {}
                for place, after in reversed(found):  # a chain that meets no candidate in its stretch ends as a dead place
                    leaves[place] = leaves.get(after, after) if after < begin + stretch else after
                if not found:
                    continue
                yield pa.record_batch(
                    [pa.array([path] * len(found)), pa.array([n_bytes] * len(found), pa.int64()), pa.array([begin] * len(found), pa.int64()), *[pa.array(c, pa.int64()) for c in ([p for p, _ in found], [a for _, a in found], [leaves[p] for p, _ in found])]],
                    names=["path", "n_bytes", "begin", "at", "successor", "out"],
                )

    tasks = manifest.sparkSession.sparkContext.defaultParallelism * 3
    return parts.repartition(tasks, "path", "begin").mapInArrow(scan, "path string, n_bytes long, begin long, at long, successor long, out long")


def reachable_entries(candidates: DataFrame) -> DataFrame:
    """The places (path, at) where the chain from each file's start enters a stretch, by pointer jumping."""
    hops = materialize(candidates.select("path", "at", F.col("out").alias("to")), "warc-hops")
    reached = materialize(candidates.filter("at = 0").select("path", "at"), "warc-reached")
    known = reached.count()
    while True:
        step = reached.join(hops.hint("merge"), ["path", "at"]).select("path", F.col("to").alias("at"))
        before, reached = reached, materialize(reached.union(step).distinct(), "warc-reached")
        drop_scratch(before)
        now = reached.count()
        if now == known:  # the chain has no place further on
            drop_scratch(hops)
            return reached
        known = now
        after = hops.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        # a pointer that leaves the chain's last record stays where it is
        longer = materialize(hops.join(after.hint("merge"), ["path", "to"], "left").select("path", "at", F.coalesce("beyond", "to").alias("to")), "warc-hops")
        drop_scratch(hops)
        hops = longer


def read_warc(manifest: DataFrame, folder: str, stretch: int = 4 << 20) -> DataFrame:
    """The records of the manifest's files that a chain from the file's start reaches.

    Returns path, at, page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload
    (null for revisits). A response's digest is computed from the payload read and its length is
    that of the payload; a revisit has the archive's. Raises if a file's chain does not end at its
    end, or if a payload differs from the digest in its header.
    """
    candidates = materialize(boundary_candidates(manifest, folder, stretch), "warc-candidates")
    entries = reachable_entries(candidates)
    ended = entries.join(manifest.select("path", F.col("n_bytes").alias("at")), ["path", "at"], "left_semi").select("path").distinct()
    broken = manifest.filter("n_bytes > 0").join(ended, "path", "left_anti").select("path").take(1)
    if broken:
        raise ValueError(f"the chain of records in {broken[0][0]} does not reach its end")
    starts = materialize(entries.join(candidates.select("path", "begin", "at").hint("merge"), ["path", "at"]).select("path", "begin", "at"), "warc-starts")
    drop_scratch(entries)
    drop_scratch(candidates)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        names = ["path", "at", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        pack = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for b in batches:
            for path, begin, at in zip(*[b.column(c).to_pylist() for c in ("path", "begin", "at")]):
                rows: list[tuple] = []
                size = store.get_file_info(path).size
                with store.open_input_file(path) as stream:
                    while at < min(begin + stretch, size):  # from the entry on, successor by successor
                        stream.seek(at)
                        headers = Headers(stream, at, stream.read(HEADER_READ))
                        block_at, length = headers.at(0)
                        head = headers.data
                        fields = {k.lower(): v.decode() for k, v in _FIELD.findall(head[: block_at - 2])}
                        block = head[block_at : block_at + length]
                        if len(block) < length:
                            stream.seek(at + block_at)
                            block = stream.read(length)
                        digest = fields[b"warc-payload-digest"].removeprefix("sha1:")
                        body, n = None, int(fields[b"x-payload-length"])
                        if fields[b"warc-type"] == "response":
                            body = block[block.index(b"\r\n\r\n") + 4 :]
                            if payload_digest(body) != digest:
                                raise ValueError(f"the payload at {at} of {path} does not match its digest")
                            n = len(body)
                        page_id, refers_to = fields.get(b"x-page-id"), fields.get(b"x-refers-to-page")
                        rows.append((path, at, int(page_id) if page_id else None, fields[b"warc-target-uri"], fields[b"warc-type"], int(refers_to) if refers_to else None, n, digest, body))
                        at += block_at + length + 4
                        if len(rows) >= 128:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    tasks = manifest.sparkSession.sparkContext.defaultParallelism * 3
    return starts.repartition(tasks, "path", "at").mapInArrow(read, "path string, at long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def warc_round_trip(spark: SparkSession, pages: DataFrame, min_payload: int = 0, stretch: int = 4 << 20) -> DataFrame:
    """Write all ``pages`` as archives in the shared folder and read them back (see write_warc, read_warc).

    An empty table gives no rows; columns of other names are ignored. The archives stay as long as the
    rows are to be read; inside a scratch_scope they go at its end.
    """
    folder = scratch_path(spark, "warc")
    manifest = materialize(write_warc(pages, folder, min_payload), "warc-manifest")
    return read_warc(manifest, folder, stretch)
