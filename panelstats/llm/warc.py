"""Web archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends in a seek table (a skippable frame that lists the sizes of all
frames), and an index table maps each record to bundle, frame and offset inside the frame. Any Zstandard reader can
read a bundle from the start; with footer and index, one record costs one frame.

Tasks write bundles under the shared folder, under names of their own, so that a repeated task never meets another's file;
the index, written once, names those that count.
"""

from __future__ import annotations

import base64
import math
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import whole_text
from panelstats.session import materialise, new_folder

# fixed values of the seekable format: frame and footer marks, descriptor without checksums
SKIPPABLE, SEEKABLE, PLAIN = 0x184D2A5E, 0x8F92EAB1, 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STRETCH = 8  # frames that one task reads together
INDEX = "page_id long, digest string, bundle string, frame long, offset long, length long"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
          "payload string")


def record(page_id, url, payload: bytes, digest: str, revisits, date: str) -> bytes:
    """One record; a revisit keeps the headers of the answer and names the record that holds the payload."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = revisits is not None
    block = answer if again else answer + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Date: {date}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if again:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{revisits}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers (names in lower case), block and end of the record that starts at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    begin = stop + 4
    end = begin + int(head["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return head, data[begin:end], end + 4


class Bundle:
    """A bundle being written."""

    def __init__(self, folder: str, frame_bytes: int, level: int) -> None:
        import uuid

        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.uri, self.out = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.open and self.filled + len(data) > self.frame_bytes:
            self._close_frame()
        at = len(self.sizes), self.filled
        self.open.append(data)
        self.filled += len(data)
        return at

    def _close_frame(self) -> None:
        packed = self.pack.compress(b"".join(self.open))
        self.out.write(packed)
        self.sizes.append((len(packed), self.filled))
        self.written += len(packed)
        self.open, self.filled = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), PLAIN, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class Reader:
    """Random access to the frames of a bundle."""

    def __init__(self, uri: str) -> None:
        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, _, mark = struct.unpack("<IBI", self._read(size - 9, 9))
        if mark != SEEKABLE:
            raise ValueError(f"no seek table: {uri}")
        raw = self._read(size - 9 - 8 * count, 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", raw):
            self.frames.append((at, packed, plain))
            at += packed
        if at + 8 + len(raw) + 9 != size:
            raise ValueError(f"the seek table does not fit the bundle: {uri}")

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        data = self.unpack.decompress(self._read(at, packed), max_output_size=plain)
        if len(data) != plain:
            raise ValueError("a frame is not as long as the seek table says")
        return data

    def close(self) -> None:
        self.file.close()


def roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, html, digest (hex), refers_to: of equal payloads the largest id holds the payload."""
    data = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        whole_text(html_col).cast("binary").alias("html"))
    data = data.withColumn("digest", F.sha1("html"))
    holders = data.groupBy("digest").agg(F.max("page_id").alias("holder"))
    again = (F.length("html") >= least_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return data.join(holders, "digest").withColumn("refers_to", F.when(again, F.col("holder"))).drop("holder")


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3,
                  date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives; returns the index (page_id, digest, bundle, frame, offset, length), written once.

    A missing html is an empty payload, a missing url leaves its header out. A row without page_id can be a revisit but
    is never referred to; rows that repeat the largest id of their payload are all responses. Payloads under
    `least_bytes` are never revisits. An empty table gives an empty index and no bundle.
    """
    def write(frames):
        import pandas as pd

        bundle = None
        for frame in frames:
            rows = []
            for page, url, html, digest, holder in zip(frame["page_id"], frame["url"], frame["html"], frame["digest"],
                                                       frame["refers_to"]):
                if bundle is None:
                    bundle = Bundle(folder, frame_bytes, level)
                page = None if pd.isna(page) else int(page)
                holder = None if pd.isna(holder) else int(holder)
                short = base64.b32encode(bytes.fromhex(digest)).decode()
                data = record(page, url, bytes(html), short, holder, date)
                rows.append((page, short, bundle.uri, *bundle.add(data), len(data)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            out = pd.DataFrame(rows, columns=["page_id", "digest", "bundle", "frame", "offset", "length"])
            out["page_id"] = out["page_id"].astype("Int64")
            yield out
        if bundle is not None:
            bundle.close()

    chosen = roles(pages, id_col, url_col, html_col, least_bytes)
    return materialise(chosen.mapInPandas(write, INDEX), "warc-index")


def _row(head: dict, block: bytes, keep: bool) -> tuple:
    import hashlib

    answer, _, payload = block.partition(b"\r\n\r\n")
    size = int(answer.rsplit(b"Content-Length: ", 1)[1])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    again = head["warc-type"] == "revisit"
    if not again and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"a payload is not what its record says: {head['warc-record-id']}")
    number = lambda name: int(x) if (x := head[name][10:-1]) else None
    return (number("warc-record-id"), size, digest, head["warc-type"], number("warc-refers-to") if again else None,
            head.get("warc-target-uri"), None if again or not keep else payload.decode())


def _table(rows: list[tuple]):
    import pandas as pd

    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RECORD.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_bundles(index: DataFrame, keep_payload: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """All records of the bundles that the index names, read from the archives; payloads are checked by their digest.

    Stretches of STRETCH frames are dealt to one task for every `task_bytes` of records, so the frames of one bundle are
    read side by side, and tasks grow with the archives.
    """
    def read(frames) -> Iterator:
        for frame in frames:
            for uri, stretch in zip(frame["bundle"], frame["stretch"]):
                bundle = Reader(uri)
                for k in range(stretch * STRETCH, min((stretch + 1) * STRETCH, len(bundle.frames))):
                    data, at, rows = bundle.frame(k), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        rows.append(_row(head, block, keep_payload))
                    yield _table(rows)
                bundle.close()

    size = index.agg(F.sum("length")).first()[0] or 0
    stretches = index.select("bundle", F.floor(F.col("frame") / STRETCH).alias("stretch")).distinct()
    tasks = max(1, math.ceil(size / task_bytes))
    # a number that is named is kept; left to the rows' few bytes, all would end in one task
    return stretches.repartition(tasks, "bundle", "stretch").mapInPandas(read, RECORD)


def look_up(index: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the wanted ids; each frame needed is read once."""
    def read(key, frame):
        bundle = Reader(key[0])
        data = bundle.frame(int(key[1]))
        bundle.close()
        rows = []
        for offset, length in zip(frame["offset"], frame["length"]):
            head, block, end = parse(data, int(offset))
            if end - int(offset) != int(length):
                raise ValueError("the index does not fit the frame")
            rows.append(_row(head, block, True))
        return _table(rows)

    ids = wanted.select(F.col(f"`{id_col}`").cast("long").alias("page_id")).distinct()
    return index.join(ids, "page_id", "left_semi").groupBy("bundle", "frame").applyInPandas(read, RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least_bytes: int = 0) -> DataFrame:
    """Writes the pages under the shared folder and reads the archives back, without the payloads."""
    index = write_bundles(pages, new_folder(pages.sparkSession, "warc"), id_col, url_col, html_col, least_bytes)
    return read_bundles(index, keep_payload=False).drop("payload")
