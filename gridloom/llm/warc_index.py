"""WARC archives of page captures, and their global index by a k-way loser-tree merge.

Writing: each page is one gzip member holding a WARC record, written by Spark's own writer (so retries and lost
executors are its matter).  Of the captures with equal payloads that with the largest id is the response; the others
are revisits that refer to it and hold no payload.  A second, constant gzip member (the two line ends after a record)
separates the records.

Reading: each archive file yields its captures as one locally sorted run.  Runs meet in ranges of the index key
(URL key, time, id), which a sample of the keys bounds; a URL that holds a third of all captures is cut by time and id.
Inside a range the runs are merged by a loser tree.  Range and position give every capture its place in the global
order, and a running count per URL its place in the history.

A null payload is the empty one; a null URL gives the empty URL key; line ends and spaces in a URL are written as
percent signs with their code.  A null id is never a response of others (it is one if all ids are null).  Rows repeated
with the same id get the same record type.  Empty tables give no rows.
"""

from __future__ import annotations

import base64
import calendar
import hashlib
import re
import time
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from gridloom.llm.common import in_tasks, saved, table
from gridloom.storage import work_folder

DATE = "%Y-%m-%dT%H:%M:%SZ"
EPOCH = 1_600_000_000  # the capture time of page 0; pages carry no time of their own
FILE_BYTES = 32 << 20
ENTRIES_PER_RANGE = 200_000
HOT_SHARE = 1000  # a payload with more than 1/1000 of the captures; there are fewer than 1000 of them
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = zlib.compressobj(9, zlib.DEFLATED, 31)
SEPARATOR = SEPARATOR.compress(b"\r\n\r\n") + SEPARATOR.flush()
GZIP_LEVEL, CHUNK = 4, 1 << 15


def with_roles(pages: DataFrame) -> DataFrame:
    """(id, url, payload, digest, first): ``first`` is the largest id of the captures with that payload.

    Payloads with very many captures (fewer than 1000, by their share) are looked up by broadcast, so that they do not
    meet in one task; the others are joined.
    """
    ids = saved(pages.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = pages.count()
    hot = ids.where(F.col("n") * HOT_SHARE > total).select(F.col("digest").alias("__hot"), F.col("first").alias("__hot_first"))
    cold = ids.where(F.col("n") * HOT_SHARE <= total).select("digest", "first")
    looked = pages.join(F.broadcast(hot), F.col("digest") == F.col("__hot"), "left")
    is_hot = F.col("__hot").isNotNull()
    one = looked.where(is_hot).select(*pages.columns, F.col("__hot_first").alias("first"))
    two = looked.where(~is_hot).select(*pages.columns).join(cold, "digest", "left").select(
        *pages.columns, F.coalesce("first", "id").alias("first"))
    return one.union(two)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(id_, url, payload: bytes, digest: str, first, seconds: int) -> bytes:
    """One WARC record without its closing line ends."""
    revisit = first is not None and id_ != first
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    date = time.strftime(DATE, time.gmtime(seconds))
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:capture:{'' if id_ is None else id_}>",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:capture:{first}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def _write(batches):
    for batch in batches:
        ids = [None if pd.isna(x) else int(x) for x in batch["id"]]
        firsts = [None if pd.isna(x) else int(x) for x in batch["first"]]
        rows = zip(ids, batch["url"], batch["payload"], batch["digest"], firsts, batch["seconds"], strict=True)
        yield pd.DataFrame({"member": [
            _gzip(record(i, u if isinstance(u, str) else None, p.encode("utf-8", "surrogatepass"), d, f, int(s)))
            for i, u, p, d, f, s in rows]})


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write all rows as ``.warc.gz`` members under ``path``."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(1 << 31))
    average = rows.agg(F.avg(F.octet_length("payload"))).first()[0] or 1
    members = in_tasks(with_roles(rows).withColumn("seconds", seconds), _write, "member binary")
    # Text files hold the bytes as they are; the separator between two rows is a gzip member too.
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("latin-1")).option(
        "encoding", "ISO-8859-1").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (average + 500)))).text(path)


def url_key(url: str) -> str:
    """Host parts in reverse order, then the path in lower case: captures of a site sort together."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url)
    if not m:
        return url.lower()
    host = re.sub(r":(?:80|443)?$", "", m[1].lower())
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def _header(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, rest


def records(data: bytes):
    """(offset, length, header, block) of every record of an archive; offsets are of the gzip members."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, content, end = zlib.decompressobj(31), [], at
        while not unpack.eof:  # in chunks: what follows the member is copied back each time
            if end >= len(data):
                raise ValueError(f"archive ends inside a record at {at}")
            content.append(unpack.decompress(view[end : end + CHUNK]))
            end += CHUNK
        content = b"".join(content)
        length = min(end, len(data)) - len(unpack.unused_data) - at
        if content.strip(b"\r\n"):
            header, block = _header(content)
            if len(block) != int(header["content-length"]):
                raise ValueError(f"record at {at}: {len(block)} bytes instead of {header['content-length']}")
            yield at, length, header, block
        at += length


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:capture:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


CAPTURE = ("url_key string, captured long, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, file string, offset long, length long, run long, seq long")


def _read(batches):
    """One sorted run per archive file."""
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            run = []
            for offset, length, header, block in records(data):
                http, payload = _header(block)
                kind = header["warc-type"]
                stated = header["warc-payload-digest"].removeprefix("sha1:")
                size = len(payload) if kind == "response" else int(http["content-length"])
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
                    raise ValueError(f"{path}: payload at {offset} does not match its digest")
                url = header.get("warc-target-uri")
                when = calendar.timegm(time.strptime(header["warc-date"], DATE))
                run.append((url_key(url) if url is not None else "", when, _number(header["warc-record-id"]), url, kind,
                            _number(header.get("warc-refers-to")), size, stated, path, offset, length))
            run.sort(key=index_order)
            frame = pd.DataFrame(run, columns=[c.split()[0] for c in CAPTURE.split(", ")][:-2])
            for c in ("page_id", "refers_to"):
                frame[c] = frame[c].astype("Int64")
            # A number for the run that any later try of this task gives again.
            yield frame.assign(run=int.from_bytes(hashlib.sha256(path.encode()).digest()[:7], "big"), seq=range(len(run)))


def index_order(entry: tuple) -> tuple:
    """URL key, time, id (null first), then the archive place as the last word on ties."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


class LoserTree:
    """Merges sorted lists: inner nodes hold the loser of their match, so each step replays one path to the root."""

    def __init__(self, runs: list[list], key) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(len(runs))] + [None] * (self.k - len(runs))
        self.tree = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _head(self, i: int):
        return self.key(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self):
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            node = (i + self.k) // 2
            while node:
                if not self._first(i, self.tree[node]):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.winner = i


def _merge(batches):
    """Merge the runs of one range."""
    runs: dict[int, list[tuple]] = {}
    names = None
    for batch in batches:
        names = list(batch.columns)
        clean = batch.astype(object).where(batch.notna(), None)
        for row in clean.itertuples(index=False, name=None):
            runs.setdefault(row[11], []).append(row)
    if not runs:
        return
    lists = [sorted(r, key=lambda e: e[12]) for _, r in sorted(runs.items())]  # shuffles keep runs in order: a linear pass
    merged = list(LoserTree(lists, index_order))
    for at in range(0, len(merged), 10_000):
        part = merged[at : at + 10_000]
        frame = pd.DataFrame(part, columns=names)
        for c in ("page_id", "refers_to", "captured", "payload_bytes", "offset", "length"):
            frame[c] = frame[c].astype("Int64")
        yield frame.drop(columns=["run", "seq"]).assign(place=range(at, at + len(part)))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures under ``path`` in global order: the columns of a capture, ``part`` and ``place``, and ``capture_no``.

    Sorted by (part, place) the rows are in index order; ``capture_no`` counts the captures of a URL key from 1.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    captures = saved(in_tasks(files, _read, CAPTURE))
    n = captures.count()
    order = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_first(), F.col("file"), F.col("offset")]
    ranged = captures.repartitionByRange(max(1, -(-n // ENTRIES_PER_RANGE), min(n // 1000, spark.sparkContext.defaultParallelism)), *order)
    kept = ", ".join(CAPTURE.split(", ")[:-2])
    merged = in_tasks(ranged, _merge, f"{kept}, place long").withColumn("part", F.spark_partition_id())
    merged = saved(merged)
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = merged.groupBy("url_key", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
    starts = counts.select("url_key", "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    out = merged.join(saved(starts), ["url_key", "part"])
    return out.withColumn("capture_no", F.col("earlier") + F.col("place") - F.col("start") + 1).drop("earlier", "start")


def op1_warc_index(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = work_folder(spark, "warc")
    write_archives(pages, path)
    index = read_index(spark, path)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no")
