"""WARC archives and a merged capture index.

``write_archives`` turns pages into WARC 1.1 records: of equal payloads the
one with the smallest id is a response, the others revisit it. Records are
written by Spark's text writer, whose line separator is the empty line pair
that ends a record. ``read_index`` parses the archives by content length:
each file gives a run of index entries sorted by URL key, timestamp and id.
``merge_runs`` deals the runs over key ranges and merges the pieces of each
range with a loser tree, so the captures of all archives come out in order.

Defined results: a null payload is empty; a null URL has an empty key; rows
equal in id and payload are all responses; a null id is never the smallest
unless a payload has no others; ids are whole numbers; other columns are
ignored. A payload of any length is one record, which a task holds whole.
"""

from base64 import b32encode
from collections.abc import Iterable, Iterator
import gzip
import hashlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusvitals.llm.frames import text_of
from corpusvitals.session import stage, work_dir

END = "\r\n\r\n"
RECORDS_PER_FILE = 1000
#: Payload bytes of an archive, but for one that a single page fills: a task reads an archive whole.
ARCHIVE_BYTES = 64 << 20
ROWS_PER_RANGE = 100_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ID = "urn:x-page:"
INDEX = (
    "urlkey string, captured string, page_id {id}, record_type string, refers_to {id}, "
    "payload_digest string, payload_bytes long, url string, file string, offset long, length long"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: five hexadecimal digits are four characters."""
    digest = F.sha1(payload)
    characters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            characters.append(F.substring(F.lit(_BASE32), place, F.lit(1)))
    return F.concat(*characters)


def _header(name: str, value: Column) -> Column:
    """A header line; nothing when the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One WARC record per row of ``pages(page_id, url, captured, payload)``, without its end, and payload_bytes."""
    keyed = (
        pages.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("sha1", base32_sha1(F.col("payload").cast("binary")))
        .withColumn("mark", F.xxhash64("payload"))
    )
    keyed = keyed.withColumn("shared", F.col("payload_bytes") >= min_bytes)
    key = ["sha1", "mark", "payload_bytes"]
    firsts = keyed.filter("shared").groupBy(*key).agg(F.min("page_id").alias("first_id"))
    # written, so that the join exchanges both sides and a payload of very many rows can be split
    joined = keyed.join(stage(firsts, "firsts"), key, "left")
    revisit = F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Target-URI", line),
        _header("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), name, F.lit(">"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _header(
            "WARC-Refers-To",
            F.when(revisit, F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("first_id").cast("string"), F.lit("")), F.lit(">"))),
        ),
        F.when(
            revisit,
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
        F.col("block"),
    )
    return joined.withColumn("block", block).select(record.alias("value"), "payload_bytes")


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    time_col: str | None = None,
    min_bytes: int = 0,
    records_per_file: int = RECORDS_PER_FILE,
    compression: str = "gzip",
    archive_bytes: int = ARCHIVE_BYTES,
) -> str:
    """Write the archives below ``path``, each compressed as a whole (or "none").

    Without ``time_col`` a page's id stands for the second of its capture. An
    archive has ``records_per_file`` records at most. Pages whose number
    could make it larger than ``archive_bytes`` are written apart, in classes
    of twice the size each, with half as many records in a file each.
    """
    seconds = F.lit(1_577_836_800) + F.pmod(F.coalesce(F.hash(id_col), F.lit(0)), F.lit(31_536_000))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        (F.col(time_col) if time_col else F.timestamp_seconds(seconds)).alias("captured"),
        text_of(payload_col).alias("payload"),
    )
    small = max(1, archive_bytes // records_per_file)

    def size_class(size: Column) -> Column:
        return F.when(size <= small, 0).otherwise(F.ceil(F.log2(size / small))).cast("int")

    long = rows.select(F.octet_length("payload").alias("size")).filter(F.col("size") > small)
    classes = [r.c for r in long.select(size_class(F.col("size")).alias("c")).distinct().collect()]  # one for each power of two
    made = records(rows, min_bytes)
    for c in sorted({0, *classes}):
        (
            made.filter(size_class(F.col("payload_bytes")) == c)
            .select("value")
            .write.mode("append" if c else "errorifexists")  # class 0 comes first, and makes the folder
            .option("lineSep", END)
            .option("maxRecordsPerFile", max(1, records_per_file >> c))
            .option("compression", compression)
            .text(path)
        )
    return path


def url_key(url: str) -> str:
    """Host parts in reverse, then path and query, in lower case; a URL that cannot be parsed is its own key."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of each record."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = head_end + 4
        end = start + int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"not a WARC record at {at}")
        yield headers, data[start:end], at, end + 4 - at
        at = end + 4


def _entry(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        if len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    url = headers.get("WARC-Target-URI")
    page, refers = (
        int(x) if (x := headers.get(name, "").removeprefix(f"<{_ID}").removesuffix(">")) else None
        for name in ("WARC-Record-ID", "WARC-Refers-To")
    )
    return (url_key(url) if url else "", headers.get("WARC-Date", ""), page, headers["WARC-Type"], refers, digest, size, url)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; each file is a sorted run.

    Offsets count from the start of the uncompressed archive.
    """
    schema = INDEX.format(id="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                name = file.as_py().rpartition("/")[2]
                data = gzip.decompress(content.as_py()) if name.endswith(".gz") else content.as_py()
                entries = sorted(
                    ((*_entry(headers, block), name, offset, length) for headers, block, offset, length in parse(data)),
                    key=_order,
                )
                if entries:
                    yield _batch(entries)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


_ARROW = pa.schema(
    [
        ("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("url", pa.string()),
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def loser_tree(runs: list[Iterable], key) -> Iterator:
    """Merge sorted runs; each inner node of the tree keeps the loser of its match."""
    sources = [iter(r) for r in runs]
    k = len(sources)
    if not k:
        return
    heads: list = [next(s, None) for s in sources]
    keys = [None if h is None else key(h) for h in heads]

    def beats(x: int, y: int) -> bool:
        if keys[x] is None or keys[y] is None:
            return keys[y] is None and (keys[x] is not None or x < y)
        return (keys[x], x) < (keys[y], y)

    tree = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        x, y = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (x, y) if beats(x, y) else (y, x)
    best = winners[1] if k > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        heads[best] = next(sources[best], None)
        keys[best] = None if heads[best] is None else key(heads[best])
        node = (best + k) // 2
        while node:
            if beats(tree[node], best):
                tree[node], best = best, tree[node]
            node //= 2


def merge_runs(index: DataFrame, rows_per_range: int = ROWS_PER_RANGE, rows: int | None = None) -> DataFrame:
    """All captures in order of URL key, timestamp and id: within each partition and from one to the next.

    A range holds about ``rows_per_range`` entries. Ties are cut by id, so
    the captures of one URL may fill many ranges.
    """
    ranges = -(-(index.count() if rows is None else rows) // rows_per_range) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pieces.setdefault(row[8], []).append(row)
        for piece in pieces.values():
            piece.sort(key=_order)  # a pass over sorted rows: the exchange need not keep a run's order
        out = []
        for row in loser_tree(list(pieces.values()), _order):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return index.repartitionByRange(ranges, "urlkey", "captured", "page_id", "file").mapInArrow(run, index.schema)


def archive(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the archives, read them back and return the merged index."""
    spark = pages.sparkSession
    path = write_archives(pages, path or work_dir(spark, "warc"), **columns)
    # written: the runs are counted, sampled for ranges and dealt out, but the archives read once
    return merge_runs(stage(read_index(spark, path), "runs"))
