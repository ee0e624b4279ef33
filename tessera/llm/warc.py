"""WARC archives: a deterministic sharded writer and a reader that checks every digest.

Writing
-------
1. Equal payloads are found on digests alone: a grouped maximum per (SHA-1, length), so a payload that a third of all
   pages share is one row after the partial aggregate.  Only the decisions *page p revisits page q* come out of it.
2. Pages and decisions are dealt together into ranges of page_id with about equal bytes of html and sorted, so a page
   meets its decision in the task that writes it.  The html is shuffled once.
3. Every range is one task and writes its own files, rolled by compressed size, through names that no other attempt uses.  Each task
   returns a manifest of its files.  Only the attempts in the final manifest are moved to their final names; the
   manifest is written last.  Ranges, headers, digests and file names depend on the pages only, never on how they were
   partitioned, on time or on host.

Defined results: a null html is an empty payload, and empty payloads revisit like any other; pages with equal payloads
and the same, largest page_id are all responses; a null page_id is a response and is read back as null; a null url has no
WARC-Target-URI.  An empty table gives an archive without files.  Pages are UTF-8.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.batches import longs, map_batches
from tessera.llm.common import bucket_of, byte_cuts, cut_lineage, join_hubs, shuffle_partitions

ROLL_BYTES = 64 << 20
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"  # of every record, unless the caller names another
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "bucket int, seq int, temporary string, file string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    own = (urn or "none").rsplit(":", 1)[-1].rstrip(">")
    return None if own == "none" else int(own)


def _headers(pairs: list[tuple[str, str | None]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in pairs if v is not None), "", ""]).encode()


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, date: str = DATE) -> bytes:
    """One whole record: regenerated WARC and HTTP headers, and the payload unless it revisits another page's."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + payload
    head = _headers(
        [
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", _urn(page_id)),
            ("WARC-Date", date),
            ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")),
            ("WARC-Refers-To", None if refers_to is None else _urn(refers_to)),
            ("WARC-Profile", None if refers_to is None else PROFILE),
            ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
            ("WARC-Block-Digest", f"sha1:{digest(block)}"),
            ("X-Payload-Length", str(len(payload))),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))),
        ],
        "WARC/1.1",
    )
    return head + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = _headers([("format", "WARC File Format 1.1")], "software: tessera").rstrip() + b"\r\n"
    head = _headers(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name),
         ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))],
        "WARC/1.1",
    )
    return head + block + b"\r\n\r\n"


def _store(uri: str):
    """The file system and path of a URI that every executor reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digests(pages: DataFrame) -> DataFrame:
    """``page_id, sha1, size`` of every payload, written to the shared folder: what all decisions are made from."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return cut_lineage(pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.octet_length(html).cast("long").alias("size")))


def revisits(thin: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, refers_to`` of the pages whose payload a page with a larger id has too, from their digests."""
    thin = thin.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).withColumn("payload", F.concat("sha1", F.col("size").cast("string").cast("binary")))
    shared = thin.groupBy("payload").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    return join_hubs(thin, shared, "payload", thin.count()).filter("page_id < refers_to").select("page_id", "refers_to").distinct()


def write(pages: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES, least: int = MIN_REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """Writes ``(page_id, url, html)`` below the URI and returns the manifest."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    thin = digests(own)
    cuts = byte_cuts(thin.select(F.col("page_id").alias("id"), "size"))
    # Pages without an id have no place in the order: they are dealt over all ranges.
    bucket = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url", "html"), F.lit(len(cuts) + 1))).otherwise(bucket_of(F.col("page_id"), cuts)).cast("int")
    decisions = revisits(thin, least).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    rows = own.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(decisions)
    rows = rows.withColumn("bucket", bucket).repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "page_id", "kind", "url", "html")

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _store(uri)
        attempt = TaskContext.get().taskAttemptId()
        files: list[tuple] = []
        sink = None
        at, seq, done, size, sha = None, 0, 0, 0, hashlib.sha1()
        name = temporary = ""
        decided: tuple[int, int] | None = None

        def put(data: bytes) -> None:
            nonlocal size
            data = gzip.compress(data, 6, mtime=0)
            sink.write(data)
            sha.update(data)
            size += len(data)

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                files.append((at, seq, temporary, name, done, size, sha.hexdigest()))
                sink = None

        for batch in batches:
            for b, page, kind, url, html, refers in zip(*(batch[c] for c in ("bucket", "page_id", "kind", "url", "html", "refers_to")), strict=True):
                page = None if pd.isna(page) else int(page)
                if kind == 0:
                    decided = (page, int(refers))
                    continue
                if sink is not None and (b != at or size >= roll_bytes):
                    close()
                    seq = seq + 1 if b == at else 0
                elif b != at:
                    seq = 0
                if sink is None:
                    at, done, size, sha = b, 0, 0, hashlib.sha1()
                    name = f"part-{b:06d}-{seq:05d}.warc.gz"
                    temporary = f"_temporary/{name}.{attempt}"
                    sink = store.open_output_stream(posixpath.join(top, temporary), compression=None)
                    put(_info(name, date))
                put(record(page, url, html, decided[1] if decided and decided[0] == page else None, date))
                done += 1
        close()
        yield pd.DataFrame(files, columns=["bucket", "seq", "temporary", "file", "records", "bytes", "sha1"])

    store, top = _store(uri)
    store.create_dir(posixpath.join(top, "_temporary"), recursive=True)
    manifest = cut_lineage(map_batches(rows, work, MANIFEST))

    def publish(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        store, top = _store(uri)
        for batch in batches:
            for temporary, name in zip(batch["temporary"], batch["file"], strict=True):
                # Again after a lost executor: what has been moved before is not there any more.
                if store.get_file_info(posixpath.join(top, temporary)).type == FileType.File:
                    store.move(posixpath.join(top, temporary), posixpath.join(top, name))
            yield batch

    manifest.mapInPandas(publish, MANIFEST).drop("temporary").write.mode("overwrite").parquet(posixpath.join(uri, "manifest"))
    store.delete_dir(posixpath.join(top, "_temporary"))
    return spark.read.parquet(posixpath.join(uri, "manifest"))


def parse(data: bytes) -> dict:
    """A record's headers in lower case, and its block as ``block``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    out["block"] = rest[: int(out["content-length"])]
    if len(out["block"]) != int(out["content-length"]):
        raise ValueError("a record is cut short")
    if "warc-block-digest" in out and out["warc-block-digest"] != f"sha1:{digest(out['block'])}":
        raise ValueError("a block digest does not match")
    return out


def records(stream, chunk: int = 1 << 20) -> Iterator[dict]:
    """The records of a stream of gzip members, one at a time."""
    member, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(member.decompress(data))
            data = member.unused_data
            if member.eof:
                yield parse(b"".join(parts))
                member, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("a file is cut short")


def read(spark: SparkSession, uri: str, html: bool = False) -> DataFrame:
    """The page records of the archives that the manifest names, their digests checked; with html also the payload."""
    files = spark.read.parquet(posixpath.join(uri, "manifest")).select("file", "records")
    n = files.count()

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _store(uri)
        for batch in batches:
            for name, expected in zip(batch["file"], batch["records"], strict=True):
                out, seen = [], 0
                with store.open_input_stream(posixpath.join(top, name), compression=None) as stream:
                    for r in records(stream):
                        if r["warc-type"] == "warcinfo":
                            continue
                        seen += 1
                        payload = r["block"].partition(b"\r\n\r\n")[2] if r["warc-type"] == "response" else None
                        if payload is not None and r["warc-payload-digest"] != f"sha1:{digest(payload)}":
                            raise ValueError("a payload digest does not match")
                        row = (_page_of(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], _page_of(r.get("warc-refers-to")), int(r["x-payload-length"]), r["warc-payload-digest"].removeprefix("sha1:"))
                        out.append((*row, payload) if html else row)
                        if len(out) >= 1000:
                            yield frame(out)
                            out = []
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records, its manifest {expected}")
                yield frame(out)

    columns = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * html

    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=columns, dtype=object)
        return made.assign(page_id=longs(made["page_id"]), refers_to=longs(made["refers_to"]))

    return map_batches(files.repartition(max(1, min(n, 4 * shuffle_partitions(spark)))), work, RECORD + ", payload binary" * html)


def round_trip(pages: DataFrame, top: str) -> DataFrame:
    """Writes the pages below a new name in the folder, reads the archives back, and removes them."""
    uri = posixpath.join(top, f"warc-{uuid.uuid4().hex}")
    write(pages, uri)
    found = cut_lineage(read(pages.sparkSession, uri))
    store, path = _store(uri)
    store.delete_dir(path)
    return found
