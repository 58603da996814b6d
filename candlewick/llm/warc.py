"""WARC archives as a Python data source, and deduplicated archives of a table of pages.

``spark.read.format("warc").load(folder)`` gives one row per record. A partition is a
group of whole files; predicates on record type and other header fields are pushed
down, headers are parsed first, and the block of a record that no row needs is skipped:
by seeking in a plain file, by inflating without keeping in a gzipped one.
``df.write.format("warc").save(folder)`` writes numbered files per task; the driver
names the files of successful tasks in a list, and only listed files are read.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from candlewick.session import fresh_path

VERSION = b"WARC/1.1"
#: Columns of a record and the header fields they are; ``block`` and ``extra`` come beside them.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", extra map<string,string>, length long, block binary"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LIST = "_files.json"
#: Bytes after which a task begins a new file, bytes of files a partition reads, and bytes of a batch.
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 128 << 20, 64 << 20, 4 << 20
_CHUNK = 1 << 16
#: Header blocks longer than this are taken for damage.
HEADER_BYTES = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and its path there; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def line_safe(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value).strip()


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """One record: version, fields without nulls, length, block."""
    lines = [f"{name}: {line_safe(value)}".encode() for name, value in fields.items() if value is not None]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])


class Plain:
    """Sequential reading of a file whose bytes are the records."""

    def __init__(self, source):
        self.source, self.held, self.at = source, b"", 0

    def more(self) -> bytes:
        return self.source.read(_CHUNK)

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            more = self.more() if seen <= HEADER_BYTES else b""
            if not more:
                if self.held.strip():
                    raise ValueError(f"no header ends after byte {self.at}")
                return None
            self.held += more
        return self.take(at + len(mark))

    def take(self, size: int) -> bytes:
        parts, left = [self.held[:size]], size - len(self.held)
        self.held = self.held[size:]
        while left > 0:
            more = self.more()
            if not more:
                raise ValueError(f"the record at byte {self.at} is cut off")
            parts.append(more[:left])
            self.held, left = more[left:], left - len(more)
        self.at += size
        return b"".join(parts)

    def skip(self, size: int) -> None:
        beyond = size - len(self.held)
        if beyond <= 0:
            self.held = self.held[size:]
        else:
            self.held = b""
            self.source.seek(self.source.tell() + beyond)
        self.at += size


class Gzipped(Plain):
    """The same over gzip members, usually one per record."""

    def __init__(self, source):
        super().__init__(source)
        self.raw, self.inflate = b"", zlib.decompressobj(31)

    def more(self) -> bytes:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            raw = self.inflate.unconsumed_tail or self.raw or self.source.read(_CHUNK)
            self.raw = b""
            if not raw:
                return b""
            out = self.inflate.decompress(raw, _CHUNK)
            if out:
                return out

    def skip(self, size: int) -> None:
        left = size - len(self.held)
        self.held = self.held[size:]
        while left > 0:
            more = self.more()
            if not more:
                raise ValueError(f"the record at byte {self.at} is cut off")
            self.held, left = more[left:], left - len(more)
        self.at += size


def parsed(header: bytes) -> dict[str, str]:
    """Fields of a header block; a line that begins with white space goes on with the field before it."""
    found: dict[str, str] = {}
    name = None
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            found[name] = value.strip()
    return found


_KNOWN = {header.lower(): column for column, header in FIELDS.items()}


def read_records(reader: Plain, wanted, blocks: bool) -> Iterator[dict]:
    """Records whose fields ``wanted`` accepts; only their blocks are read, if any are."""
    while (header := reader.until(b"\r\n\r\n")) is not None:
        header = header.lstrip(b"\r\n")
        if not header.startswith(b"WARC/"):
            raise ValueError(f"no record begins before byte {reader.at}")
        fields = parsed(header)
        row = dict.fromkeys(FIELDS) | {_KNOWN[k.lower()]: v for k, v in fields.items() if k.lower() in _KNOWN}
        row["length"] = next((int(v) for k, v in fields.items() if k.lower() == "content-length"), 0)
        row["extra"] = {k: v for k, v in fields.items() if k.lower() not in _KNOWN and k.lower() != "content-length"}
        if wanted(row):
            row["block"] = reader.take(row["length"]) if blocks else None
            if not blocks:
                reader.skip(row["length"])
            yield row
        else:
            reader.skip(row["length"])
        reader.skip(4)


@dataclass
class Files(InputPartition):
    """Whole files that one task reads, in order."""

    paths: list[str]


class WarcReader(DataSourceReader):
    """Options: ``path``; ``blocks`` (false: block is null and never read); ``partitionBytes``."""

    def __init__(self, options):
        self.folder = options["path"]
        self.blocks = options.get("blocks", "true").lower() != "false"
        self.limit = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality, membership and presence of header columns are tested before a block is touched."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, EqualTo):
                self.tests.append((column, frozenset([f.value])))
            elif column in FIELDS and isinstance(f, In):
                self.tests.append((column, frozenset(f.value)))
            elif column in FIELDS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (allowed is None or row[c] in allowed) for c, allowed in self.tests)

    def partitions(self) -> list[Files]:
        """Files in order, grouped up to ``partitionBytes``; a larger file is a partition of its own."""
        store, folder = opened(self.folder)
        listed = posixpath.join(folder, LIST)
        if store.get_file_info(listed).type != fs.FileType.NotFound:
            with store.open_input_stream(listed) as source:
                files = [(posixpath.join(folder, f["name"]), f["bytes"]) for f in json.loads(source.read())]
        else:
            found = store.get_file_info(fs.FileSelector(folder))
            files = [(f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz"))]
        groups, total = [], self.limit
        for path, size in sorted(files):
            if total + size > self.limit:
                groups.append(Files([]))
                total = 0
            groups[-1].paths.append(path)
            total += size
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.folder)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as source:
                reader = Gzipped(source) if path.endswith(".gz") else Plain(source)
                try:
                    for row in read_records(reader, self.wanted, self.blocks):
                        rows.append(row)
                        held += len(row["block"] or b"") + 500
                        if held > BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    names = [*FIELDS, "extra", "length", "block"]
    types = [*[pa.string()] * len(FIELDS), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]
    columns = [pa.array([r[n] if n != "extra" else list(r[n].items()) for r in rows], t) for n, t in zip(names, types)]
    return pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    """Columns of SCHEMA, any of them; ``gzip`` writes a member per record, ``fileBytes`` begins a new file."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.gzip = options.get("gzip", "false").lower() == "true"
        self.limit = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Files have names of their own, so that a task that runs twice disturbs nothing."""
        store, folder = opened(self.folder)
        store.create_dir(folder, recursive=True)
        files, sink = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if sink is None or files[-1]["bytes"] >= self.limit:
                        if sink is not None:
                            sink.close()
                        name = f"{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else "")
                        files.append({"name": name, "bytes": 0, "records": 0})
                        sink = store.open_output_stream(posixpath.join(folder, name), compression=None)
                    fields = {header: row.get(column) for column, header in FIELDS.items()} | dict(row.get("extra") or [])
                    raw = record(fields, row.get("block") or b"")
                    if self.gzip:
                        packer = zlib.compressobj(wbits=31)
                        raw = packer.compress(raw) + packer.flush()
                    sink.write(raw)
                    files[-1]["bytes"] += len(raw)
                    files[-1]["records"] += 1
        finally:
            if sink is not None:
                sink.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.folder)
        store.create_dir(folder, recursive=True)
        listed, files = posixpath.join(folder, LIST), [f for m in messages if m is not None for f in m.files]
        if not self.overwrite and store.get_file_info(listed).type != fs.FileType.NotFound:
            with store.open_input_stream(listed) as source:
                files = json.loads(source.read()) + files
        with store.open_output_stream(listed, compression=None) as sink:
            sink.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.folder)
        for message in messages:
            for file in message.files if message is not None else []:
                store.delete_file(posixpath.join(folder, file["name"]))


class WarcSource(DataSource):
    """``warc``: see the module."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """The source by its name; pushing filters into Python sources is off in Spark unless asked for."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: eight groups of five, four symbols each."""
    groups = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(h, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    symbol = lambda n, shift: F.substr(F.lit(_BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    symbols = lambda h: F.array_join(F.transform(groups(h), lambda n: F.concat(*[symbol(n, s) for s in (15, 10, 5, 0)])), "")
    return F.transform(F.array(hexed), symbols)[0]  # what makes the digits runs once


#: A payload is hot if more than one in so many rows has it: there are at most so many hot payloads.
HOT_SHARE = 10_000


def with_roles(pages: DataFrame, least_bytes: int = 0, *, key: str = "page_id", digest: str = "payload_digest", length: str = "payload_bytes") -> DataFrame:
    """Adds ``keeper``: the largest key among rows with an equal payload of at least ``least_bytes``, null for shorter ones.

    Only payloads that come twice are joined. Those of more than one in HOT_SHARE of all rows number less
    than HOT_SHARE (and are not hot at all in a smaller table), so they are broadcast and their rows stay where they are; the others are equi-joined.
    """
    long = F.col(length) >= least_bytes
    groups = pages.filter(long).groupBy(F.col(digest).alias("__digest"), F.col(length).alias("__length")).agg(F.max(key).alias("keeper"), F.count("*").alias("__n"))
    shared = groups.filter("__n > 1")
    split = shared.withColumn("__hot", F.col("__n") > pages.count() / HOT_SHARE).drop("__n")
    same = (F.col(digest) == F.col("__digest")) & (F.col(length) == F.col("__length"))
    hot = F.broadcast(split.filter("__hot").select("__digest", "__length", F.col("keeper").alias("__keeper"), F.lit(True).alias("__found")))
    marked = pages.join(hot, same, "left").drop("__digest", "__length")
    rest = split.filter("not __hot").drop("__hot")
    cold = marked.filter("__found is null").join(rest, same, "left").select(*pages.columns, "keeper")
    done = marked.filter("__found").select(*pages.columns, F.col("__keeper").alias("keeper"))
    own = F.when(long, F.coalesce("keeper", key)).alias("keeper")
    return cold.unionByName(done).select(*pages.columns, own)


def archive(spark: SparkSession, pages: DataFrame, folder: str, *, least_bytes: int = 0, gzip: bool = True, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record per row: a response with the payload in UTF-8 (null: empty), or a revisit without it.

    Of equal payloads of at least ``least_bytes``, that with the largest key is the response and the
    others refer to it; rows that repeat its key are responses too. A row without a key
    has an identifier without a number; it is a revisit if an equal payload has a key. Control characters in a
    URI are percent-encoded, a null URI is left out. Records are gzip members unless ``gzip`` is false.
    """
    register(spark)
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(uri).cast("string").alias("uri"), F.encode(body, "UTF-8").alias("body"))
    sized = rows.withColumns({"n": F.octet_length("body").cast("long"), "digest": F.sha1("body")})
    roles = with_roles(sized, least_bytes, key="id", digest="digest", length="n")
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    records = roles.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"), F.col("uri").alias("target_uri"),
        F.lit(date).alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"), F.concat(F.lit("sha1:"), base32(F.col("digest"))).alias("payload_digest"),
        F.when(revisit, urn(F.col("keeper"))).alias("refers_to"), F.when(revisit, IDENTICAL).alias("profile"),
        F.create_map(F.lit("WARC-Payload-Length"), F.col("n").cast("string")).alias("extra"), F.when(~revisit, F.col("body")).alias("block"),
    )
    records.write.format("warc").option("gzip", str(gzip).lower()).mode("append").save(folder)


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of archives that ``archive`` wrote, read back from them.

    Responses are read with their payload, whose length and digest are taken anew; of
    revisits only headers are read, their blocks are skipped.
    """
    register(spark)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    read = lambda kind, blocks: spark.read.format("warc").option("blocks", blocks).load(folder).filter(F.col("record_type") == kind)
    shape = lambda df, n, digest: df.select(number(F.col("record_id")).alias("page_id"), "target_uri", n.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))
    whole = shape(read("response", "true"), F.octet_length("block").cast("long"), base32(F.sha1("block")))
    named = shape(read("revisit", "false"), F.col("extra")["WARC-Payload-Length"].cast("long"), F.regexp_extract("payload_digest", "^sha1:(.*)$", 1))
    return whole.unionByName(named)


def fresh_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
