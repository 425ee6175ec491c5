"""WARC archives of web pages and an external merge of their capture index.

Writing: one record per page; a payload that equals that of another capture
becomes a revisit record.  Records are UTF-8 text, so Spark's own text
writer lays them down (gzip, on any store Spark can reach).

Reading: each archive file is parsed by its Content-Length fields; its
captures, sorted by URL key and time, form one run of the index.  Runs are
written, dealt out by range of (URL key, time), and every range is merged
with a tree of losers over the runs' segments, so the result is globally
ordered.  The range includes time and page, so a hot URL or host is split
like any other.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.storage import Scratch

#: Payloads shorter than this are always stored.
MIN_REVISIT = 1000
#: Captures in one archive file, and so in one run of the index, at most.
FILE_RECORDS = 1000
#: Bytes of one archive file, uncompressed, at most (unless one record is longer):
#: a file is parsed in memory.
FILE_BYTES = 1 << 28
#: Longer pages are written to files of their own.  Bytes of a record besides its payload, at most.
LONG_PAGE, HEAD_BYTES = 1 << 20, 4096
#: Index entries that one merge task receives, about.
MERGE_ROWS = 200_000
#: Capture times where the pages have none: this second plus the page id.
FIRST_SECOND = 1_704_067_200
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: First half of the record ids made here; the second half is the page id.
_SPACE = "7369746570756c73"
_CRLF = "\r\n"


def _record_id(page_id: Column) -> Column:
    """urn:uuid whose last 64 bits are the page id."""
    digits = F.concat(F.lit(_SPACE), F.lpad(F.lower(F.hex(page_id)), 16, "0"))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(page_id.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")))


def _page_of(record_id: str | None) -> int | None:
    if not record_id:
        return None
    n = int(record_id.strip("<>").removeprefix("urn:uuid:").replace("-", "")[16:], 16)
    return n - 2**64 if n >= 2**63 else n


def page_time(page_id: Column) -> Column:
    """A capture time for pages that have none."""
    seconds = F.lit(FIRST_SECOND) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time: Column | None = None
) -> DataFrame:
    """(value) one WARC record per page, without its last line feed.

    Of pages with equal payloads of at least MIN_REVISIT bytes the one with
    the largest id is the response, the others are revisits of it.  A null
    html is an empty payload; pages without an id are always responses; a
    null url leaves out the target; rows repeated with the same id and
    payload are equal records.
    """
    page = F.col(id_col).cast("long")
    caps = pages.select(
        page.alias("page_id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7F]", "").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
        (time if time is not None else page_time(page)).alias("time"),
    ).select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha1("html").alias("digest"))
    first = (
        caps.filter((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    joined = caps.join(first, ["digest", "bytes"], "left")
    revisit = F.col("page_id") < F.col("original")

    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(_CRLF * 2),
    )
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    return joined.select(
        F.concat(
            F.lit(f"WARC/1.1{_CRLF}"),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            F.coalesce(line("WARC-Record-ID", _record_id(F.col("page_id"))), F.lit("")),
            line("WARC-Date", F.col("time")),
            F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.coalesce(F.when(revisit, line("WARC-Refers-To", _record_id(F.col("original")))), F.lit("")),
            F.when(revisit, line("WARC-Profile", F.lit(_PROFILE))).otherwise(F.lit("")),
            F.lit(f"Content-Type: application/http;msgtype=response{_CRLF}"),
            line("Content-Length", length.cast("string")),
            F.lit(_CRLF),
            http,
            F.when(revisit, F.lit("")).otherwise(F.col("html")),
            F.lit(_CRLF + "\r"),
        ).alias("value")
    )


def write_archives(recs: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Writes the records as gzip-compressed WARC files of at most ``file_records`` records."""
    recs.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", file_records).text(path)


def file_records(longest: int) -> int:
    """Records of a file whose longest page has so many bytes."""
    return max(1, min(FILE_RECORDS, FILE_BYTES // (longest + HEAD_BYTES)))


_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")


def url_key(url: str) -> str:
    """Sort key of a URL: reversed host labels, then path and query, lower-cased; no scheme, www, port 80/443, fragment."""
    rest = _SCHEME.sub("", url).split("#", 1)[0]
    cut = min([i for i in (rest.find("/"), rest.find("?")) if i >= 0], default=len(rest))
    host, tail = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    labels = [x for x in name.split(".") if x]
    if len(labels) > 2 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "")
    return f"{key}){tail.lower() or '/'}"


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of each record; raises ValueError where the file is damaged."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for one in raw[at:end].split(b"\r\n")[1:]:
            name, _, value = one.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        start = end + 4
        stop = start + int(fields["content-length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, stop + 4 - at, fields, raw[start:stop]
        at = stop + 4


CAPTURE = (
    "run string, urlkey string, time string, page_id long, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, offset long, length long"
)
_ARROW = pa.schema(
    [
        (n, pa.int64() if t == "long" else pa.string())
        for n, t in (x.strip().split(" ") for x in CAPTURE.split(","))
    ]
)


def capture(run: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record; checks the payload of a response against its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    said = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)[1])
    if fields["warc-type"] == "response" and (len(payload) != said or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{run}: the payload at byte {offset} does not match its digest")
    time = re.sub(r"\D", "", fields["warc-date"])
    return (
        run,
        url_key(fields.get("warc-target-uri", "")),
        time,
        _page_of(fields.get("warc-record-id")),
        fields["warc-type"],
        said,
        digest,
        _page_of(fields.get("warc-refers-to")),
        offset,
        length,
    )


def order(entry: tuple) -> tuple:
    """URL key, time, page (none first), run and offset."""
    return entry[1], entry[2], entry[3] is not None, entry[3] or 0, entry[0], entry[8]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            raw, left = b"", content.as_py()
            while left:  # a gzip file may have several members
                one = zlib.decompressobj(31)
                raw += one.decompress(left)
                left = one.unused_data
            name = path.as_py().rpartition("/")[2]
            run = sorted((capture(name, *rec) for rec in parse(raw)), key=order)
            cols = list(zip(*run)) or [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)


def index_runs(spark, path: str) -> DataFrame:
    """Index entries of all archives under ``path``; those of one file are sorted."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
    files = reader.load(path)
    return files.select("path", "content").mapInArrow(_runs, CAPTURE)


class LoserTree:
    """Merges sorted lists: an inner node keeps the loser of its match, the winner plays on.

    Taking the smallest entry replays one path of about log2(k) matches.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _head(self, run: int):
        at = self.at[run]
        return self.runs[run][at] if at < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return x is not None and (y is None or x < y)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            rival = self.loser[node]
            if rival < 0:  # while the tree is filled, the first to arrive waits
                self.loser[node] = run
                return
            if self._beats(rival, run):
                self.loser[node], run = run, rival
            node //= 2
        self.loser[0] = run

    def __iter__(self):
        while self.k:
            run = self.loser[0]
            head = self._head(run)
            if head is None:
                return
            yield head
            self.at[run] += 1
            self._play(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: entries arrive run by run, each run in order."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    runs: dict[str, list] = {}
    for i, entry in enumerate(zip(*(table[c].to_pylist() for c in table.column_names))):
        runs.setdefault(entry[0], []).append((order(entry), i))
    merged = table.take(pa.array([i for _, i in LoserTree(list(runs.values()))], pa.int64()))
    yield from merged.combine_chunks().to_batches(max_chunksize=10_000)


def merged_index(runs: DataFrame, rows: int, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The runs' entries in global order of URL key, time and page."""
    ranges = max(1, -(-rows // merge_rows), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["urlkey", "time", "page_id"]  # run and offset split rows that are equal in all of them
    dealt = runs.repartitionByRange(ranges, *keys, "run", "offset").sortWithinPartitions("run", *keys, "offset")
    return dealt.mapInArrow(_merge, CAPTURE)


def capture_histories(pages: DataFrame, **kw) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and returns their merged index.

    One row per page: run (archive file), urlkey, time, page_id,
    record_type, payload_bytes, payload_digest, refers_to, offset and length
    in the archive's uncompressed bytes.  ``kw`` as for ``records``.  An
    empty input gives an empty result; further columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = f"{scratch.path}/archives"
    recs = records(pages, **kw)
    size = F.octet_length(F.col(kw.get("html_col", "html")).cast("string"))
    longest, common = pages.agg(
        F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.max(F.when(size <= LONG_PAGE, size)), F.lit(0))
    ).first()
    if longest <= LONG_PAGE:
        write_archives(recs, path, file_records(longest))
    else:  # a few very long pages must not leave the others one to a file
        big = F.octet_length("value") > LONG_PAGE + HEAD_BYTES
        write_archives(recs.where(~big), f"{path}/common", file_records(common))
        write_archives(recs.where(big), f"{path}/long", file_records(longest))
    runs = scratch.table(index_runs(spark, path), "runs")
    return merged_index(runs, runs.count())
