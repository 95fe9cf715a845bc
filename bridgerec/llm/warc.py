"""WARC files of pages and a Merkle audit of their replicas.

Writing: pages are range-partitioned by id; a task writes one file of gzip members,
one WARC record each, under a name of its own that becomes final when it is whole.  The
index has the byte range of every record.

Audit: a replica's bytes are hashed range by range in the order of the index, with one
more range from the last record to the end of the file, so bytes that are missing,
changed or added all show.  Every ``FAN`` neighbouring hashes are hashed into one, up to
one root a file; the levels are DataFrame aggregates.  Two replicas are compared root by
root; where roots differ, the children of the differing nodes alone are compared, level
by level, down to the ranges that differ.  What is read of the trees below the roots
follows from the damage, not from the archive.

Defined cases: null urls are written as ``about:blank`` and null html as an empty
payload; repeated and null ids keep a record each; an empty table gives an empty index
and an audit without findings; a file that one replica lacks differs in all its ranges;
only the named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bridgerec.llm.staging import Stage, shuffle_partitions

#: Children of a node of the tree.
FAN = 16
#: Bytes of a file that are held at once where it is read or copied as a whole.
CHUNK = 1 << 20
#: The date of all records, unless the caller gives another; a fixed one makes files repeat.
DATE = "2024-01-01T00:00:00Z"

INDEX = "file string, place long, page_id long, start long, end long"


def record(page_id: int | None, url: str | None, payload: bytes, date: str = DATE) -> bytes:
    """One WARC 1.1 record as a gzip member."""
    digest = hashlib.sha256(payload).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    target = "about:blank" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", compresslevel=6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; raises if it is damaged."""
    plain = gzip.decompress(member)
    head, blank, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    payload = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or not blank or rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError("payload digest differs")
    return fields, payload


def _named(folder: str, name: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(folder)
    return fs, f"{root}/{name}"


def write_warc(
    pages: DataFrame, folder: str, stage: Stage, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write the pages as WARC files into ``folder``; returns the index
    ``(file, place, page_id, start, end)``, one row a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        out, rows, place, at = None, [], 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, path = _named(folder, name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{path}.part", compression=None)
                member = record(page_id, url, (html or "").encode())
                out.write(member)
                rows.append((name, place, page_id, at, at + len(member)))
                place, at = place + 1, at + len(member)
        if out is not None:
            out.close()
            fs.move(f"{path}.part", path)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "place", "page_id", "start", "end"])

    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    parts = rows.repartitionByRange(shuffle_partitions(pages.sparkSession), "id").sortWithinPartitions("id", "url", "html")
    return stage.write(parts.mapInArrow(run, INDEX), "index")


def _by_file(index: DataFrame, *more: Column) -> DataFrame:
    """One row a file: its ranges in order.  A file was written by one task, so are its ranges."""
    return index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", *more))).alias("ranges"))


def _spread(files: DataFrame) -> DataFrame:
    """The files dealt in turn to all tasks.  A key would be that of the aggregate before it,
    so Spark would drop the step and merge the few small rows into one task."""
    return files.repartition(shuffle_partitions(files.sparkSession))


def copy_replica(index: DataFrame, source: str, target: str, flip: Column | None = None) -> int:
    """Copy the files of ``index`` to another folder; the number of files.  ``flip``
    marks records in whose middle byte the copy shall differ (to rehearse an audit)."""
    flip = F.lit(False) if flip is None else flip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _named(source, row["file"])
                to, final = _named(target, row["file"])
                to.create_dir(final.rpartition("/")[0], recursive=True)
                wrong = sorted((r["start"] + r["end"]) // 2 for r in row["ranges"] if r["flip"])
                part = f"{final}.{uuid.uuid4().hex}"
                with fs.open_input_stream(path, compression=None) as source_file, to.open_output_stream(part, compression=None) as copy:
                    at = 0
                    while data := source_file.read(CHUNK):
                        data = bytearray(data)
                        while wrong and wrong[0] < at + len(data):
                            data[wrong.pop(0) - at] ^= 0x55
                        copy.write(bytes(data))
                        at += len(data)
                to.move(part, final)
            yield batch.select([0])

    files = _by_file(index, F.coalesce(flip, F.lit(False)).alias("flip"))
    return _spread(files).mapInArrow(run, "file string").count()


def leaves(index: DataFrame, folder: str) -> DataFrame:
    """(file, node, start, end, hash): level 0 of a replica's tree."""
    names = ["file", "node", "start", "end", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _named(folder, row["file"])
                known = fs.get_file_info(path)
                if known.type != pafs.FileType.File:
                    continue
                out = []
                with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as f:
                    for k, r in enumerate(row["ranges"]):
                        out.append((row["file"], k, r["start"], r["end"], hashlib.sha256(f.read(r["end"] - r["start"])).digest()))
                    rest, end = hashlib.sha256(), row["ranges"][-1]["end"]
                    size = 0
                    while data := f.read(CHUNK):
                        rest.update(data)
                        size += len(data)
                    out.append((row["file"], len(out), end, None, rest.update(size.to_bytes(8, "big")) or rest.digest()))
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    files = _spread(_by_file(index))
    return files.mapInArrow(run, "file string, node long, start long, end long, hash binary")


def merkle_levels(index: DataFrame, folder: str, stage: Stage, name: str) -> list[DataFrame]:
    """The levels of the trees of a replica's files, ``(file, node, hash)``, leaves
    first, one root a file last.  How many follows from the longest file of the index."""
    bottom = stage.write(leaves(index, folder), f"{name}-0")
    most = (index.agg(F.max("place")).first()[0] or 0) + 2
    levels = [bottom]
    while most > 1:
        most = -(-most // FAN)
        up = levels[-1].groupBy("file", F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("below")
        )
        packed = F.transform("below", lambda x: F.concat(F.hex(x["node"]), F.lit(":"), F.hex(x["hash"])))
        up = up.select("file", "node", F.unhex(F.sha2(F.array_join(packed, ","), 256)).alias("hash"))
        levels.append(stage.write(up, f"{name}-{len(levels)}"))
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(file, node, start, end): the ranges in which two replicas differ; ``end`` is
    null for what follows the last record."""
    suspects = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if suspects is not None:
            parents = suspects.select("file", F.col("node").alias("parent"))
            a, b = (
                x.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).join(parents, ["file", "parent"], "left_semi")
                for x in (a, b)
            )
        where = a.select("file", "node", F.col("hash").alias("x"), *(F.col(c) for c in a.columns if c in ("start", "end")))
        other = b.select("file", "node", F.col("hash").alias("y"))
        suspects = where.join(other, ["file", "node"], "full").filter(~F.col("x").eqNullSafe(F.col("y"))).drop("x", "y")
    return suspects


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_sha256, n_bytes, readable) of each record of a replica; a record
    that does not parse, or whose digest differs, is not readable."""
    names = ["page_id", "payload_sha256", "n_bytes", "readable"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _named(folder, row["file"])
                out = []
                with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as f:
                    for r in row["ranges"]:
                        member = f.read(r["end"] - r["start"])
                        try:
                            _, payload = parse_record(member)
                            out.append((r["page_id"], hashlib.sha256(payload).hexdigest(), len(payload), True))
                        except (ValueError, KeyError, EOFError, OSError, zlib.error, UnicodeDecodeError):
                            out.append((r["page_id"], None, None, False))
                types = (pa.int64(), pa.string(), pa.int64(), pa.bool_())
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    files = _spread(_by_file(index, F.col("page_id")))
    return files.mapInArrow(run, "page_id long, payload_sha256 string, n_bytes long, readable boolean")
