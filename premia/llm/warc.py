"""WARC archives of pages: written with revisit records, read back, and indexed by merged capture runs.

Writing. Pages with equal payloads are grouped by SHA-1 and length; the one with the largest id is the response and
the others revisit it. Only (digest, id) is shuffled for that. Archives are sorted by URL key within a file and written by
Spark's text writer with the record end as line end, so any store Spark writes to will do.
Reading. Whole archives (bounded by ``records`` each) come back as binary files and are cut record by record along
Content-Length, decompressing as they go.
Index. Each archive's captures, in file order, are one locally sorted run of (URL key, time). Runs are split by key
ranges; within a range a loser tree merges the k runs, which gives globally ordered capture histories.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.frames import pick, shared_folder, stored, width
from premia.llm.urls import _labels, host_of, path_of

END = "\r\n\r\n"
START = "WARC/1.0"
READ = 1 << 20


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then ')' and the path: a site's captures are neighbours."""

    return F.concat(F.array_join(_labels(host_of(url)), ","), F.lit(")"), path_of(url))


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hex string of 40 digits: each five digits are four letters."""

    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = []
    for i in range(8):
        five = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(five, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(alphabet, place, F.lit(1)))
    return F.concat(*letters)


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of every page.

    Equal payloads of at least ``least`` bytes form a group: rows with its largest id are responses, the others revisits of
    it. Rows tied for the largest id are all responses. NULL ids are never the largest; a group with no other id is all responses.
    """

    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    sized = rows.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    digested = sized.withColumn("payload_digest", base32_of_hex(F.sha1("html")))
    groups = (
        digested.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("chief"), F.min("page_id").alias("low"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n", "low")
    )
    # A payload may belong to most pages; its rows are spread over salts, the group repeated for each.
    salts = width(pages.sparkSession)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = digested.withColumn("salt", salt).join(spread, ["payload_digest", "payload_bytes", "salt"], "left")
    revisit = F.col("chief").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chief"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("chief")).alias("refers_to"),
    )


def _record() -> Column:
    """A WARC record without its final line ends."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    response = F.col("record_type") == "response"
    named = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    # Control characters in a url would end its header line.
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(START),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), named, F.lit(">"))),
        line("WARC-Target-URI", target),
        line("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, F.lit("")).otherwise(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Url-Key", F.regexp_replace("url_key", r"[\x00-\x20\x7F]", "%20")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("payload_bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(END),
        F.when(response, F.col("html")).otherwise(F.lit("")),
    )


def write_archives(pages: DataFrame, folder: str, records: int = 2_000, least: int = 0) -> None:
    """Write gzip archives of at most ``records`` records each, every file sorted by URL key, time and id.

    Pages carry no capture time, so a page's time is its id in seconds after 1970 (the start for NULL).
    """

    captured = F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)))
    rows = marked(pages, least).withColumns({"url_key": url_key(F.coalesce("url", F.lit(""))), "captured": captured})
    ordered = rows.sortWithinPartitions("url_key", "captured", "page_id")
    ordered.select(_record().alias("value")).write.options(
        lineSep=END, compression="gzip", maxRecordsPerFile=records
    ).text(folder)


def _stream(content: bytes) -> Iterator[bytes]:
    """Decompressed bytes of an archive of one or more gzip members."""

    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        view = memoryview(content)
        while not member.eof and at < len(content):
            part = view[at : at + READ]
            at += len(part)
            yield member.decompress(part)
        at -= len(member.unused_data)
        yield member.flush()


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the decompressed archive, headers, payload) of each record."""

    held, base, end = b"", 0, END.encode()
    source = _stream(content)

    def more() -> bool:
        nonlocal held
        part = next(source, None)
        if part is None:
            return False
        held += part
        return True

    while True:
        while (cut := held.find(end)) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return
        lines = held[:cut].decode().split("\r\n")
        if lines[0] != START:
            raise ValueError("a record does not start with its version")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        stop = cut + len(end) + length
        while len(held) < stop + len(end):
            if not more():
                raise ValueError("an archive ends inside a record")
        yield base, headers, held[cut + len(end) : stop]
        held = held[stop + len(end) :]
        base += stop + len(end)


CAPTURE = pa.schema(
    [
        ("archive", pa.string()), ("place", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()),
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)
CAPTURE_SQL = (
    "archive string, place long, url_key string, captured string, page_id long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long"
)


def _number(urn: str | None) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "-"
    return None if text == "-" else int(text)


def _captures(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            path = batch.column("path")[i].as_py()
            rows = []
            for offset, headers, payload in parse(batch.column("content")[i].as_buffer()):
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                if headers["WARC-Type"] == "response":
                    if size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload at {offset} of {path} is damaged")
                rows.append(
                    {
                        "archive": path, "place": offset, "url_key": headers["X-Url-Key"], "captured": headers["WARC-Date"],
                        "page_id": _number(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
                        "record_type": headers["WARC-Type"], "refers_to": _number(headers.get("WARC-Refers-To")),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=CAPTURE)


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record: archive, place, url_key, captured, page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payloads of responses are digested anew and must agree with their headers; a revisit has those of the record it
    refers to, as its headers repeat them.
    """

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(_captures, CAPTURE_SQL)


class LoserTree:
    """Merges sorted runs: each inner node holds the run that lost there, so a step replays one path to the root."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        self.winner = -1
        for run in range(len(runs)):
            self._enter(run)

    def _beats(self, a: int, b: int) -> bool:
        if self.at[b] >= len(self.runs[b]):
            return True
        if self.at[a] >= len(self.runs[a]):
            return False
        return (self.runs[a][self.at[a]], a) <= (self.runs[b][self.at[b]], b)

    def _enter(self, run: int) -> None:
        """First match-up: wait at the first empty node, or play on upwards."""

        node = (run + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = run
                return
            if self._beats(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            node //= 2
        self.winner = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in the run) in merged order."""

        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], run):
                    self.tree[node], run = run, self.tree[node]
                node //= 2
            self.winner = run


def _merger(batches):
    """Merge the runs of one key range."""

    table = pa.Table.from_batches(list(batches), schema=CAPTURE)
    if not table.num_rows:
        return
    columns = [table.column(name).to_pylist() for name in ("archive", "place", "url_key", "captured", "page_id")]
    runs: list[list[tuple]] = []
    rows: list[list[int]] = []
    before = None
    for i, (archive, place, key, captured, page) in enumerate(zip(*columns)):
        if archive != before:
            runs.append([])
            rows.append([])
            before = archive
        runs[-1].append((key, captured, -1 if page is None else page, place))
        rows[-1].append(i)
    order = [rows[run][place] for run, place in LoserTree(runs)]
    merged = table.take(pa.array(order, pa.int64()))
    yield from merged.to_batches(max_chunksize=10_000)


def merge_runs(captures: DataFrame, per_range: int = 100_000) -> DataFrame:
    """Captures in global order of (url_key, captured, page_id) across the partitions of the result.

    Ranges of about ``per_range`` captures (a number of rows, so a hot URL splits by time) go to one task each.
    """

    # Sorting by run keeps each archive's captures together and in their order; the merge does the rest.
    n = max(width(captures.sparkSession), -(-captures.count() // per_range))
    ranged = captures.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "place")
    runs = ranged.sortWithinPartitions("archive", "url_key", "captured", "page_id", "place")
    return runs.mapInArrow(_merger, captures.schema)


def archive(pages: DataFrame, folder: str | None = None, records: int = 2_000, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below the shared folder, read them back and merge their index.

    A NULL html is an empty payload, a NULL url an empty target, a NULL id is written as '-' and read as NULL. Repeated rows
    are records of their own. An empty table gives no records. Other columns are dropped.
    """

    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "archives")
    write_archives(pages, folder, records, least)
    return merge_runs(stored(read_archives(spark, folder), "captures"))
