"""Chat exports, mailboxes and Outlook archives: whole files by Spark's own reader, taken apart in Arrow batches.

An archive is one row, so it can be read from any store Spark reads; a task holds one archive at a time. Mailboxes are split
between tasks.
"""

from __future__ import annotations

import email
import email.policy
import functools
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano import schemas
from scrivano.constants import HTML_LIKE
from scrivano.functions import text as T
from scrivano.functions.mail import unescape_xml
from scrivano.sources.shared import small_batches

ENTRY = re.compile(r"(?:inbox|messages)/.+/message_[0-9]+\.json$")
LIKE_HTML = re.compile(HTML_LIKE)
CHAT_ROWS = "file string, entry string, thread long, place long, sender string, ts long, content string"


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and content of a folder's files of a name pattern; none where there are none."""
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, content binary")


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _thread(path: str, entry: str, number: int, raw: bytes) -> list[tuple]:
    try:
        found = json.loads(raw)
        said = found.get("messages") or []
        return [(path, entry, number, i, m.get("sender_name") or "", m.get("timestamp_ms"), m.get("content")) for i, m in enumerate(said) if isinstance(m, dict)]
    except (ValueError, AttributeError):
        return []


def chat_messages(spark: SparkSession, inbox: str) -> DataFrame:
    """Messages of the threads in *.zip exports (entries in the archive's order) and of bare message_*.json files.

    A broken archive is an error; a broken entry is left out. thread counts a file's entries.
    """

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if path.lower().endswith(".json"):
                    yield _table(_thread(path, "", 0, content), CHAT_ROWS)
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for number, name in enumerate(z.namelist()):
                        if ENTRY.search(name):
                            yield _table(_thread(path, name, number, z.read(name)), CHAT_ROWS)

    small_batches(spark)
    both = files(spark, inbox, "*.zip").unionByName(files(spark, inbox, "message_*.json"))
    named = F.when(F.col("file").endswith(".zip"), T.source_name(T.stem(F.col("file")))).otherwise("chat")
    return both.mapInArrow(unzip, CHAT_ROWS).withColumn("source", named)


MAILBOX = f"file string, {schemas.MAIL}"


def mailbox_messages(spark: SparkSession, folder: str) -> DataFrame:
    """file, place and raw bytes of the messages of a folder's *.mbox files, of any size: many tasks read one mailbox.

    Each begins after a line that starts with "From "; what comes before the first such line is left out.
    """
    try:
        rows = spark.read.option("lineSep", "\nFrom ").option("pathGlobFilter", "*.mbox").text(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file string, place long, raw binary")
    # A block has fewer messages than bytes, so its start and a message's number in the task give the order in the file.
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.col("value").cast("binary").alias("raw"))
    first = rows.groupBy("file").agg(F.min("place").alias("first"))
    opening = F.col("place") == F.col("first")
    rows = rows.join(first, "file").where(~opening | (F.substring("raw", 1, 5) == F.lit(b"From ")))
    return rows.select("file", "place", "raw")


def without_first_line(raw: bytes) -> bytes:
    first = raw.find(b"\n")
    return raw[first + 1 :] if first >= 0 else b""


def split_mbox(raw: bytes) -> list[bytes]:
    """The messages of a mailbox in memory, as mailbox_messages has them."""
    starts = [m.start() for m in re.finditer(rb"(?:^|(?<=\n))From ", raw)]
    return [without_first_line(raw[a:b]) for a, b in zip(starts, [*starts[1:], len(raw)])]


_header = functools.lru_cache(1024)(email.policy.default.header_fetch_parse)


class _Policy(email.policy.EmailPolicy):
    """The default policy, which parses a header anew each time that anything asks for it; mails share most of theirs."""

    def header_fetch_parse(self, name, value):
        return _header(name, value) if type(value) is str and len(value) <= 1000 else super().header_fetch_parse(name, value)


POLICY = _Policy()


def mail_fields(raw: bytes) -> tuple[str, str, str, str]:
    """From, Date, the kind of the body (plain or html) and its text, of a message in bytes."""
    raw = raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    message = email.message_from_bytes(raw, policy=POLICY)

    def header(name: str) -> str:
        try:
            return str(message.get(name) or "")
        except Exception:  # noqa: BLE001  malformed headers come as they are
            return next((v for k, v in message.raw_items() if k.lower() == name), "")

    kind = text = ""
    try:
        body = message.get_body(("plain", "html"))
        if body is not None:
            kind = body.get_content_subtype()
            try:
                text = body.get_content()
            except LookupError:  # an unknown character set
                text = (body.get_payload(decode=True) or b"").decode("ascii", "replace")
    except Exception:  # noqa: BLE001  a body that can't be decoded is empty
        text = ""
    return header("from"), next((v for k, v in message.raw_items() if k.lower() == "date"), ""), kind, text if isinstance(text, str) else ""


def _olm(xml: str, *names: str) -> str:
    """The text of the first element whose tag contains a name, else its first attribute's value."""
    for name in names:
        m = re.search(rf"<([\w:.-]*{name}[\w:.-]*)((?:\s[^>]*?)?)(/?)>", xml)
        if not m:
            continue
        end = xml.find(f"</{m[1]}", m.end()) if not m[3] else -1
        inner = re.sub(r"<[^>]*>", "", xml[m.end() : end]) if end >= 0 else ""
        attribute = re.search(r"=\s*\"([^\"]*)\"|=\s*'([^']*)'", m[2])
        found = inner if inner.strip() else (attribute[1] or attribute[2] or "") if attribute else ""
        if found:
            return unescape_xml(found)
    return ""


#: What a damaged or encrypted archive, or one packed by an unknown method, raises.
BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError)


def mail_messages(spark: SparkSession, inbox: str) -> DataFrame:
    """Messages of *.mbox files, of the sent mailboxes in *.zip archives, and of the sent items in *.olm archives.

    Columns of schemas.MAIL, and file, the path. Broken archives are left out. A mailbox is read by many tasks, an archive by one.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, place, raw in zip(*(c.to_pylist() for c in batch.columns)):
                name = path.rpartition("/")[2]
                sender, sent, kind, text = mail_fields(without_first_line(raw))
                rows.append((path, f"email:{unquote(name.rpartition('.')[0])}", "mbox", kind, place, sender, sent, text))
            if rows:
                yield _table(rows, MAILBOX)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                name = path.rpartition("/")[2]
                stem, low = name.rpartition(".")[0] or name, name.lower()
                boxes: list[tuple[str, bytes]] = []
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in z.namelist():
                            if "sent" not in entry.lower():
                                continue
                            if low.endswith(".zip") and entry.lower().endswith(".mbox"):
                                boxes.append((f"email:{stem}-{entry.rpartition('/')[2].rpartition('.')[0]}", z.read(entry)))
                            elif low.endswith(".olm") and entry.lower().endswith(".xml"):
                                xml = z.read(entry).decode("utf-8", "replace")
                                text = _olm(xml, "CopyBody", "CopyHTMLBody")
                                rows.append((f"email:{stem}", "olm", "html" if LIKE_HTML.search(text[:400]) else "plain", len(rows), _olm(xml, "SenderAddress", "EmailAddress"), _olm(xml, "SentTime"), text))
                except BROKEN:
                    continue
                for source, raw in boxes:
                    for i, m in enumerate(split_mbox(raw)):
                        sender, sent, kind, text = mail_fields(m)
                        rows.append((source, "mbox", kind, i, sender, sent, text))
                if rows:
                    yield _table([(path, *r) for r in rows], MAILBOX)

    small_batches(spark)
    zipped = files(spark, inbox, "*.zip").unionByName(files(spark, inbox, "*.olm")).mapInArrow(take, MAILBOX)
    return mailbox_messages(spark, inbox).mapInArrow(parse, MAILBOX).unionByName(zipped)
