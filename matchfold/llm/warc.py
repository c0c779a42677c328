"""Operator 13: WARC archives, and one index over them by external merge.

Writing: each page becomes one record of an archive file.  Of pages with equal payloads of at
least ``MIN_REVISIT`` bytes the one with the smallest id is a response and carries the payload;
the others are revisits, which keep the HTTP head, the payload's digest and the page they
refer to.  Records are text (headers, payload in UTF-8), so Spark's own writer makes the
files: gzip, a bounded number of records each, in the shared folder.

Reading: files are read as they lie; a worker unpacks one as a stream, finds records by their
Content-Length and hashes payloads as they pass.  The captures of a file, sorted by URL key and
timestamp, are one run.  Runs are dealt over ranges of (URL key, timestamp, page, run), which
splits a URL captured very often as well; a task merges the pieces of all runs that lie in its
range by a loser tree.  The stored index is in global order: ``place`` gives a capture's
position, so the history of a URL is a contiguous stretch of it.  Revisits are resolved by
joining them to the response of their digest.

Rows: a null html is an empty payload; a null id is larger than all others; rows that share the
smallest id and the payload are all responses.  A null URL has the key "" and no target header;
line breaks in a URL are escaped.  Payloads may hold anything that looks like a record.  Only
page_id, url and html are read.  Empty tables give empty archives and an empty index.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.llm.common import keys_join, materialise, release, shuffle_partitions
from matchfold.session import scratch_path

#: Payloads of fewer bytes are stored each time.
MIN_REVISIT = 100
#: Payload bytes that a file holds, about.
ARCHIVE_BYTES = 32_000_000
#: Captures that one merging task gets, about.
RANGE_ROWS = 100_000
_EOL, _GAP = "\r\n", "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host reversed by its dots, then path and query: captures of a site lie together."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*\z", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substr(bare, F.char_length(host) + 1))
    return F.when(bare == "", "").otherwise(key)


def uuid(*parts: Column) -> Column:
    """A record id from what identifies the record."""
    h = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """One header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_EOL)), F.lit(""))


def write_archives(pages: DataFrame, path: str, captured: Column, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archive files of ``pages`` below ``path``; ``captured`` is the time of capture in seconds."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest, size = F.sha2(payload.cast("binary"), 256), F.octet_length(payload).cast("long")
    narrow = materialise(pages.select(digest.alias("digest"), size.alias("bytes"), "page_id"), "warc-digests")
    copies = narrow.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = materialise(copies.where("n > 1").select("digest", "first"), "warc-copies")
    total = narrow.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    per_file = max(1, int(archive_bytes * (total.n or 0) / max(total.b or 0, archive_bytes / 20_000)))

    rows = pages.select("page_id", "url", payload.alias("payload"), captured.cast("long").alias("captured"))
    rows = rows.select("*", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").alias("bytes"))
    rows = keys_join(rows, copies, ["digest"], "left", limit=200_000)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    body = F.when(again, "").otherwise(F.col("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(_GAP))
    record = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        header("WARC-Record-ID", uuid(F.col("page_id"), F.col("url"), F.col("digest"))),
        header("WARC-Date", F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("WARC-Profile", F.when(again, _PROFILE)),
        header("X-Page-Id", F.col("page_id")),
        header("X-Refers-To-Page", F.when(again, F.col("first"))),
        header("X-Url-Key", F.replace(F.replace(url_key(F.col("url")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        header("X-Captured", F.col("captured")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(http) + F.octet_length(body)),
        F.lit(_EOL),
        http,
        body,
    )
    out = rows.select(record.alias("value")).write.option("maxRecordsPerFile", per_file)
    out.option("lineSep", _GAP).option("compression", "gzip").text(path)


class _Unpacked:
    """A gzip file's bytes as a stream of which a bounded part is held."""

    def __init__(self, packed: bytes, step: int = 1 << 18):
        self.packed, self.step, self.next = memoryview(packed), step, 0
        self.inflate = zlib.decompressobj(31)
        self.held, self.offset = bytearray(), 0

    def more(self) -> bool:
        while self.next < len(self.packed):
            piece = self.inflate.unconsumed_tail or self.packed[self.next : self.next + self.step]
            if not self.inflate.unconsumed_tail:
                self.next += len(piece)
            got = self.inflate.decompress(piece, 8 * self.step)
            rest = self.inflate.unused_data
            if self.inflate.eof and rest:  # the next member of the file
                self.next -= len(rest)
                self.inflate = zlib.decompressobj(31)
            if got:
                self.held += got
                return True
        while self.inflate.unconsumed_tail:
            got = self.inflate.decompress(self.inflate.unconsumed_tail, 8 * self.step)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += len(out)
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n > 0:
            out = self.take(min(n, 1 << 20))
            if not out:
                raise ValueError("archive ends inside a record")
            n -= len(out)
            yield out


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(_EOL)
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def records(packed: bytes) -> Iterator[tuple[int, dict, dict, Iterator[bytes]]]:
    """(offset in the unpacked file, WARC headers, HTTP headers, payload in pieces) of each record.

    The payload is to be read before the next record is asked for.
    """
    stream = _Unpacked(packed)
    while True:
        offset = stream.offset
        head = stream.until(_GAP.encode())
        if head is None:
            if stream.held:
                raise ValueError("archive ends inside a header")
            return
        if not head.startswith(b"WARC/1.1\r\n"):
            raise ValueError(f"no record at {offset}")
        names = headers_of(head)
        http = stream.until(_GAP.encode())
        if http is None:
            raise ValueError("archive ends inside a header")
        rest = stream.pieces(int(names["Content-Length"]) - len(http))
        yield offset, names, headers_of(http), rest
        for _ in rest:
            pass
        if stream.take(4) != _GAP.encode():
            raise ValueError(f"the record at {offset} does not end where it should")


CAPTURE = "run string, seq long, url_key string, captured long, page string, record_type string, refers_to string, payload_digest string, payload_bytes long, url string, at long"
_CAPTURE = pa.schema([(x.split()[0], pa.int64() if x.endswith(" long") else pa.string()) for x in CAPTURE.split(", ")])
_ORDER = ("url_key", "captured", "page", "run", "seq")


def capture_order(c: dict) -> tuple:
    return (c["url_key"], c["captured"] or 0, c["page"] or "", c["run"], c["seq"])


def captures_of(run: str, packed: bytes) -> list[dict]:
    """The captures of one archive file as a sorted run."""
    out = []
    for offset, names, http, pieces in records(packed):
        h, size = hashlib.sha256(), 0
        for piece in pieces:
            h.update(piece)
            size += len(piece)
        revisit = names["WARC-Type"] == "revisit"
        written = names["WARC-Payload-Digest"].removeprefix("sha256:")
        if not revisit and h.hexdigest() != written:
            raise ValueError(f"{run} at {offset}: payload and digest differ")
        out.append(
            {
                "run": run,
                "seq": 0,
                "url_key": names.get("X-Url-Key", ""),
                "captured": int(names["X-Captured"]) if "X-Captured" in names else None,
                "page": names.get("X-Page-Id"),
                "record_type": names["WARC-Type"],
                "refers_to": names.get("X-Refers-To-Page"),
                "payload_digest": written,
                # a revisit's payload lies elsewhere
                "payload_bytes": None if revisit else size,
                "url": names.get("WARC-Target-URI"),
                "at": offset,
            }
        )
    out.sort(key=capture_order)
    for i, c in enumerate(out):
        c["seq"] = i
    return out


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the next item costs one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = [r for r in runs if r], key
        self.at = [0] * len(self.runs)
        self.heads = [key(r[0]) for r in self.runs]
        k = len(self.runs)
        self.losers = [0] * k  # node 0 holds the winner
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        if k:
            self.losers[0] = winners[1] if k > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k:
            w = self.losers[0]
            if self.heads[w] is None:
                return
            run, i = self.runs[w], self.at[w]
            yield run[i]
            self.at[w] = i + 1
            self.heads[w] = self.key(run[i + 1]) if i + 1 < len(run) else None
            node = (w + k) // 2
            while node:
                if self.beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.losers[0] = w


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archive files below ``path``, each file a sorted run."""
    # a partition of files is no larger than spark.sql.files.maxPartitionBytes, or it is one file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py().rsplit("/", 1)[-1]
                found = captures_of(name, batch.column("content")[i].as_buffer())
                if found:
                    yield pa.RecordBatch.from_pylist(found, _CAPTURE)
        release()

    return files.mapInArrow(run, CAPTURE)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order of URL key and timestamp, with their ``place`` in it.

    ``runs`` must be stored.  Ranges come from Spark's sample of the keys, which is bounded.
    """
    n = max(shuffle_partitions(runs.sparkSession), -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(n, *_ORDER)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[dict]] = {}
        for batch in batches:
            for c in batch.to_pylist():
                pieces.setdefault(c["run"], []).append(c)
        for piece in pieces.values():  # fetched in any order of blocks: sorted already if a run was read by one task
            piece.sort(key=lambda c: c["seq"])
        out = []
        for c in LoserTree(list(pieces.values()), capture_order):
            out.append(c)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, _CAPTURE)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _CAPTURE)

    # places are stored with the rows, so that they hold whatever is run again
    return materialise(dealt.mapInArrow(merge, CAPTURE).withColumn("place", F.monotonically_increasing_id()), "warc-index")


def resolved(index: DataFrame) -> DataFrame:
    """The index with the payload size of revisits, from the response of their digest."""
    wanted = index.where("record_type = 'revisit'").select("payload_digest").distinct()
    known = index.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_found"))
    known = materialise(known.join(wanted, "payload_digest", "left_semi"), "warc-responses")
    out = keys_join(index, known, ["payload_digest"], "left", limit=200_000)
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "_found")).drop("_found")


def archive_index(pages: DataFrame, captured: Column, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Writes ``pages`` to archives, reads them back and returns the merged, resolved index."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "warc-archives")
    write_archives(pages, path, captured, archive_bytes)
    index = resolved(merge_runs(materialise(read_runs(spark, path), "warc-runs"), range_rows))
    kind = pages.schema["page_id"].dataType.simpleString()
    return index.withColumn("page_id", F.col("page").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)).drop("page", "seq")
