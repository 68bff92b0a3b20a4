"""WARC archives of pages, and a globally ordered index of their captures.

``write_archives`` writes one record for each page with Spark's text writer: a record is a
text, and the record separator is two line ends. Of pages with equal payloads the one with the
largest id is a response, the others are revisit records without the payload. Each task
writes a file of its own, so an archive is as large as a shuffle partition; it is one gzip
stream.

``read_archives`` parses the files by their record lengths (a payload may hold any text, record
marks included) and computes length and digest from the bytes it has read.

``capture_index`` merges the captures by URL key and time. Each reading task sorts what it
has read and writes it as a run; key ranges of all runs are dealt to tasks, and each merges the
slices of its range with a loser tree. A URL with very many captures spans several ranges;
its captures are numbered across them.

Nulls and blanks: a null html is an empty payload; a null url has no target header and the
empty key; a null page id is written as ``none`` and read as null, it is a response only where all
pages with that payload have none. Repeated rows are written each, and those that share
the largest id are all responses. Other columns are ignored. An empty table writes and
gives nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, scratch_path

END = "\r\n"
_NULL = -(1 << 63)
_ID = "urn:x-page:"
_CAPTURE = (
    "page_id long, url string, captured_at string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, archive string, position long"
)


def base32_sha1(text: Column) -> Column:
    """SHA-1 of a text's UTF-8 in upper-case base 32: 40 bits of the digest give 8 digits."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(text), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels from the right, then path and query; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    path = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path)))


def capture_time(page_id: Column) -> Column:
    """The given pages carry no time: one second after another, by id, over ten years."""
    second = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(315_360_000)) + F.lit(1_420_070_400)
    return F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record): the text of one record for each page, without the separator after it."""
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    read = read.withColumns({"digest": base32_sha1(F.col("html")), "size": F.octet_length("html").cast("long")})
    keeper = (
        read.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"))
        .select(F.col("digest").alias("of"), "keeper", F.lit(True).alias("known"))
    )
    # joined by a sort: the pages' shuffle deals out the archives, and Spark splits a hot digest
    # as both sides are plain shuffles
    keeper = cut(keeper)
    joined = read.join(keeper.hint("merge"), F.col("digest") == F.col("of"), "left")
    revisit = F.col("known") & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    revisit = F.coalesce(revisit, F.lit(False))
    named = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    return joined.withColumn("block", block).select(
        F.concat(
            F.lit(f"WARC/1.1{END}"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", named(F.col("page_id"))),
            F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
            line("WARC-Date", capture_time(F.col("page_id"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(
                revisit,
                F.concat(
                    line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                    line("WARC-Refers-To", named(F.col("keeper"))),
                ),
            ).otherwise(""),
            line("Content-Type", F.lit("application/http;msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit(END),
            "block",
        ).alias("record")
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    records(pages, min_bytes).write.option("lineSep", END + END).option("compression", "gzip").text(folder)


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, headers, block) of each record of a stream of bytes."""
    position = 0
    while line := stream.readline():
        start, headers = position, {}
        position += len(line)
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no record at byte {start}")
            continue
        while (line := stream.readline()).strip():
            position += len(line)
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        position += len(line)
        block = stream.read(int(headers["content-length"]))
        position += len(block)
        yield start, headers, block


def _page(name: str | None) -> int | None:
    value = (name or "").strip("<>").removeprefix(_ID)
    return int(value) if value not in ("", "none") else None


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row for each record: page_id, url, captured_at, record_type, refers_to, payload_bytes,
    payload_digest, archive, position, and the ``payload`` itself if asked for. Length and
    digest of a response come from its bytes, those of a revisit from its headers."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows, held = [], 0
                for position, head, block in _parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    http, _, body = block.partition(b"\r\n\r\n")
                    if head["warc-type"] == "response":
                        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    else:
                        size = int(http.lower().rpartition(b"content-length:")[2])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((
                        _page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-date"], head["warc-type"],
                        _page(head.get("warc-refers-to")), size, digest, path.rpartition("/")[2], position,
                        *([body if head["warc-type"] == "response" else None] if payload else []),
                    ))
                    held += len(body) if payload else 100
                    if held > 1 << 23:
                        yield _frame(rows)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows)

    names = [x.split()[0] for x in _CAPTURE.split(", ")] + (["payload"] if payload else [])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return files.mapInPandas(parse, _CAPTURE + (", payload binary" if payload else ""))


class LoserTree:
    """Merges sorted lists: each inner node holds the loser of its match, so that the next
    item costs one match for each level. Items are compared as (key, list number)."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(len(runs), 1)
        self.losers = [0] * self.size
        self.winner = self._play(1) if runs else 0

    def _head(self, run: int):
        """None, which loses to all, once a run has ended."""
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        while self.runs and (item := self._head(self.winner)) is not None:
            run = self.winner
            yield run, self.at[run], item
            self.at[run] += 1
            node = (run + self.size) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def capture_index(captures: DataFrame) -> DataFrame:
    """``captures`` with ``url_key`` and ``capture_no`` (from 1, by time then page id), its partitions
    in the order of the index."""
    keys = ["url_key", "captured_at", "page_id", "archive", "position"]
    # a pandas frame turns whole numbers with gaps into floats: nulls travel as the least long
    gaps = {c: F.coalesce(c, F.lit(_NULL)) for c in ("page_id", "refers_to")}
    runs = cut(captures.withColumns(gaps).withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions(*keys).withColumn("run", F.spark_partition_id()))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        frame = pd.concat(held, ignore_index=True)
        items = list(zip(*(frame[k] for k in keys)))
        bounds = frame.groupby("run", sort=True).indices
        places = [bounds[r] for r in sorted(bounds)]
        order = [int(places[run][i]) for run, i, _ in LoserTree([[items[p] for p in part] for part in places])]
        out = frame.iloc[order].drop(columns="run")
        out["local_no"] = out.groupby("url_key", sort=False).cumcount() + 1
        yield out

    kind = _CAPTURE + ", url_key string, local_no long"
    dealt = runs.repartitionByRange(*keys).sortWithinPartitions("run", *keys)
    merged = cut(dealt.mapInPandas(merge, kind).withColumn("part", F.spark_partition_id()))
    # captures of one URL in earlier ranges: one row for each URL and range
    before = W.partitionBy("url_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = merged.groupBy("url_key", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("before > 0")
    numbered = merged.join(counts.select("url_key", "part", "before"), ["url_key", "part"], "left")
    numbered = numbered.withColumn("capture_no", F.col("local_no") + F.coalesce("before", F.lit(0))).drop("local_no", "before", "part")
    return numbered.withColumns({c: F.nullif(F.col(c), F.lit(_NULL)) for c in gaps})


def archived(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` (a new one in the session's shared folder unless
    given), read them back, and index the captures."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, min_bytes)
    return capture_index(read_archives(pages.sparkSession, folder))
