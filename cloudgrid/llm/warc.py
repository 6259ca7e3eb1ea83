"""WARC archives with revisit records, and their capture index in global order.

Each task writes compressed archives and, for each of them, a run of index
entries sorted by URL key, time and row id. Runs are merged externally: entries
are dealt by ranges of that order, and in each range a loser tree merges what
the runs hold of it. Archives are read back through the merged index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, open_file, partitions, rows_of, shared_dir, write_file

DATE = "2000-01-01T00:00:00Z"
#: Payload bytes after which an archive ends, and index entries that one range of the merge holds at most on average.
ARCHIVE_BYTES, RANGE_ROWS = 128 << 20, 200_000
LEVEL = 3
INDEX = "url_key string, captured string, id bigint, run string, seq bigint, path string, offset bigint, length bigint, record_type string, digest string"


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, and one path is replayed for each item."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        ka, kb = self.key(a), self.key(b)
        return ka < kb or ka == kb and i < j

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def url_key(url: str | None) -> str:
    """Host labels from last to first, then ')' and the rest, all of ASCII in lower case; a URL without '://' is its own key."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1]
    cut = min([at for c in "/?#" if (at := rest.find(c)) >= 0] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:].split("#", 1)[0].lower()


def _line(name: str, value) -> bytes:
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {text}\r\n".encode()


def record(kind: str, row_id, url: str | None, date: str, digest: str, payload: bytes, size: int, refers_to=None) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload
    head = b"WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", f"<urn:page:{'' if row_id is None else row_id}>") + _line("WARC-Date", date)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    if kind == "revisit":
        head += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + _line("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")
    head += _line("Content-Type", "application/http;msgtype=response") + _line("WARC-Payload-Digest", f"sha1:{digest}") + _line("Content-Length", len(block))
    return gzip.compress(head + b"\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(raw: bytes) -> dict:
    """The fields of a record, its payload, and payload_bytes of the full payload, which a revisit has elsewhere."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda text: int(text) if (text := text.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "id": number(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": size,
    }


def measured(r: dict) -> dict:
    """The record with a response's digest and length as its payload has them; ValueError if the headers say otherwise."""
    if r["record_type"] != "response":
        return r
    found = {"digest": base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode(), "payload_bytes": len(r["payload"])}
    for k, v in found.items():
        if r[k] != v:
            raise ValueError(f"record {r['id']}: {k} is {v}, its headers say {r[k]}")
    return r | found


def write(df: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, date: str = DATE) -> DataFrame:
    """Write a record for each row and return the runs of the index, themselves written to the shared folder.

    The payload is html in UTF-8, a null one empty. Of rows with equal payloads of
    min_bytes or more, that with the smallest id is the response and the others
    are revisits of it; rows that repeat its id are responses too, and rows with a
    null id are revisits unless no equal row has an id. Null URLs have no target
    field. time_col: when a row was captured; without it, or where it is null, at
    date. Other columns are ignored. An empty table gives no runs. The digests of
    payloads that repeat are joined back; while they are few enough for Spark to
    broadcast, only digests are shuffled, beyond that payloads are too, and the
    partitions of a digest with very many rows are split by adaptive execution.
    """
    folder = folder or shared_dir(df.sparkSession)
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    captured = F.lit(date)
    if time_col:
        utc = F.to_utc_timestamp(F.col(time_col).cast("timestamp"), F.current_timezone())
        captured = F.coalesce(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"), captured)
    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), captured.alias("captured"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    counted = own.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(counted.select("sha", "first"))
    tagged = own.join(copies, "sha", "left").select("id", "url", "captured", "payload", "sha", "first")

    def run(batches):
        task = TaskContext.get()
        parts, entries, size = [], [], 0

        def flush():
            path = f"{folder}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
            info = b"software: cloudgrid\r\n"
            lead = b"WARC/1.1\r\n" + _line("WARC-Type", "warcinfo") + _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + _line("WARC-Date", date) + _line("Content-Type", "application/warc-fields") + _line("Content-Length", len(info))
            first = gzip.compress(lead + b"\r\n" + info + b"\r\n\r\n", LEVEL, mtime=0)
            write_file(path, [first, *parts])
            at, placed = len(first), []
            for seq, (entry, part) in enumerate(zip(entries, parts, strict=True)):
                placed.append((*entry[:3], path, seq, path, at, len(part), *entry[3:]))
                at += len(part)
            return sorted(placed, key=entry_key)

        for doc, url, when, body, sha, first in rows_of(batches):
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            revisit = first is not None and first != doc
            parts.append(record("revisit" if revisit else "response", doc, url, when, digest, b"" if revisit else body, len(body), first))
            entries.append((url_key(url), when, doc, "revisit" if revisit else "response", digest))
            size += len(body)
            if size >= ARCHIVE_BYTES:
                yield from flush()
                parts, entries, size = [], [], 0
        if entries:
            yield from flush()

    return materialise(map_rows(tagged, run, INDEX))


def entry_key(e) -> tuple:
    """URL key, time, then row id with null before any other, then place."""
    return e[0], e[1], e[2] is not None, e[2] or 0, e[3], e[4]


def sorted_runs(rows: Iterable[tuple]) -> list[list[tuple]]:
    """The runs' stretches of a range; one that came out of order is cut where it falls."""
    open_runs: dict[str, list[tuple]] = {}
    done: list[list[tuple]] = []
    for row in rows:
        held = open_runs.setdefault(row[3], [])
        if held and entry_key(row) < entry_key(held[-1]):
            done.append(held)
            held = open_runs[row[3]] = []
        held.append(row)
    return done + list(open_runs.values())


def merge(runs: DataFrame) -> DataFrame:
    """The index in global order: range_no and range_pos give each entry's place.

    Ranges are cut in the whole order, so the captures of one URL may span
    several, and null ids come first among equal URLs and times. A range's entries,
    of which there are RANGE_ROWS on average at most, are in memory while its tree
    merges one stretch of each run. Repeated rows differ in run or place, so all
    stay. No runs give an empty index.
    """
    n = max(partitions(runs.sparkSession), runs.count() // RANGE_ROWS + 1)
    order = ["url_key", "captured", F.asc_nulls_first("id")]
    dealt = runs.repartitionByRange(n, *order, "run", "seq").sortWithinPartitions("run", *order, "seq")

    def run(batches):
        part = TaskContext.get().partitionId()
        for pos, row in enumerate(LoserTree([iter(r) for r in sorted_runs(rows_of(batches))], entry_key)):
            yield part, pos, *row

    return map_rows(dealt, run, f"range_no bigint, range_pos bigint, {INDEX}")


def read(index: DataFrame, digest_only: bool = False) -> DataFrame:
    """(range_no, range_pos, id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]) from the archives.

    Entries of one archive are read in its order, 500 a task at a time. Digest and
    length of a response are measured; ValueError if they aren't as its headers say.
    A null id or URL comes back as null, and each entry gives one row, so repeated
    rows stay. An empty index gives no rows.
    """

    def run(batches):
        path = file = None
        for b in batches:
            for part, pos, name, offset, length in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if name != path:
                    if file:
                        file.close()
                    path, file = name, open_file(name)
                file.seek(offset)
                r = measured(parse(zlib.decompress(file.read(length), 31)))
                yield part, pos, r["id"], r["url"], r["record_type"], r["refers_to"], r["digest"], r["payload_bytes"], *(() if digest_only else (r["payload"],))
        if file:
            file.close()

    asked = index.select("range_no", "range_pos", "path", "offset", "length", (F.col("seq") / 500).cast("bigint").alias("stretch"))
    dealt = asked.repartition(partitions(index.sparkSession), "path", "stretch").sortWithinPartitions("path", "offset").drop("stretch")
    return map_rows(dealt, run, "range_no bigint, range_pos bigint, id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint" + ("" if digest_only else ", payload binary"))


#: What op2_warc returns, for DuckDB: base 32 is taken from the digest's bits.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda c:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits,
    min(page_id) OVER (PARTITION BY sha) AS first
  FROM p
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
