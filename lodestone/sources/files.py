"""Mail, calendars, contacts, feeds, archives and attachments from files.

Spark deals the files; a small parser per file turns its bytes into records, so a
file that does not parse gives one record with `error` and stops nothing else.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RECORD = "path string, record string, kind string, title string, body string, at string, who string, error string"
#: A member of an archive may unpack to this many bytes, and to this many times its packed size.
MOST_MEMBER, MOST_RATIO = 64 << 20, 200


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(raw: str) -> str:
    parser = _Text()
    parser.feed(raw)
    return " ".join(" ".join(parser.parts).split())


def mail(raw: bytes) -> Iterator[dict]:
    """Messages of one EML file, or of an MBOX by its From lines."""
    parts = re.split(rb"(?m)^From [^\n]*\n", raw)[1:] if raw.startswith(b"From ") else [raw]
    for k, part in enumerate(parts):
        m = message_from_bytes(part, policy=policy.default)
        body = m.get_body(("plain", "html"))
        text = body.get_content() if body else ""
        if body and body.get_content_type() == "text/html":
            text = html_text(text)
        yield {"record": str(m["Message-ID"] or k), "kind": "mail", "title": str(m["Subject"] or ""), "body": text.strip(), "at": str(m["Date"] or ""), "who": str(m["From"] or "")}


def _components(raw: bytes, wanted: str) -> Iterator[dict[str, str]]:
    """Property maps of the components of a calendar or card file; folded lines are joined."""
    lines = re.sub(r"\r?\n[ \t]", "", raw.decode("utf-8", "replace")).splitlines()
    inside: dict[str, str] | None = None
    for line in lines:
        name, _, value = line.partition(":")
        name = name.split(";")[0].upper()
        if name == "BEGIN" and value.upper() == wanted:
            inside = {}
        elif name == "END" and value.upper() == wanted and inside is not None:
            yield inside
            inside = None
        elif inside is not None and name:
            inside.setdefault(name, value.replace("\\n", "\n").replace("\\,", ","))


def calendar(raw: bytes) -> Iterator[dict]:
    for c in _components(raw, "VEVENT"):
        yield {"record": c.get("UID", ""), "kind": "event", "title": c.get("SUMMARY", ""), "body": c.get("DESCRIPTION", ""), "at": c.get("DTSTART", ""), "who": c.get("ORGANIZER", "")}


def contacts(raw: bytes) -> Iterator[dict]:
    for c in _components(raw, "VCARD"):
        yield {"record": c.get("UID") or c.get("EMAIL", ""), "kind": "contact", "title": c.get("FN", ""), "body": c.get("NOTE", ""), "at": c.get("REV", ""), "who": c.get("EMAIL", "")}


def feed(raw: bytes) -> Iterator[dict]:
    """Entries of an RSS or Atom feed; declared entities are refused."""
    if b"<!ENTITY" in raw:
        raise ValueError("entities are not read")
    for e in ElementTree.fromstring(raw).iter():
        if e.tag.rpartition("}")[2] in ("item", "entry"):
            own = {c.tag.rpartition("}")[2]: (c.text or c.get("href") or "").strip() for c in e}
            yield {
                "record": own.get("guid") or own.get("id") or own.get("link", ""), "kind": "entry", "title": own.get("title", ""), "who": own.get("author", ""),
                "body": html_text(own.get("description") or own.get("summary") or own.get("content", "")), "at": own.get("pubDate") or own.get("updated", ""),
            }


def _members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            if info.file_size > MOST_MEMBER or info.file_size > MOST_RATIO * max(1, info.compress_size):
                raise ValueError(f"{info.filename} unpacks too far")
            yield info.filename, z.read(info)


def archive(raw: bytes) -> Iterator[dict]:
    """The text members of a ZIP archive."""
    for name, data in _members(raw):
        if name.rpartition(".")[2].lower() in ("json", "md", "txt", "csv", "js", "html"):
            yield {"record": name, "kind": "member", "title": name.rpartition("/")[2], "body": data.decode("utf-8", "replace"), "at": "", "who": ""}


def office(raw: bytes) -> Iterator[dict]:
    """The text of a DOCX or PPTX file, paragraph by paragraph."""
    parts = sorted((n, d) for n, d in _members(raw) if re.fullmatch(r"word/document\.xml|ppt/slides/slide\d+\.xml", n))
    for name, data in parts:
        paragraphs = ["".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == "t") for p in ElementTree.fromstring(data).iter() if p.tag.rpartition("}")[2] == "p"]
        yield {"record": name, "kind": "document", "title": "", "body": "\n".join(p for p in paragraphs if p), "at": "", "who": ""}


def page(raw: bytes) -> Iterator[dict]:
    yield {"record": "", "kind": "page", "title": "", "body": html_text(raw.decode("utf-8", "replace")), "at": "", "who": ""}


PARSERS: dict[str, Callable[[bytes], Iterator[dict]]] = {
    "eml": mail, "mbox": mail, "ics": calendar, "vcf": contacts, "xml": feed, "rss": feed, "atom": feed, "zip": archive, "docx": office, "pptx": office, "html": page,
}


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RECORD.split(", ")]
    for frame in frames:
        out = []
        for path, raw in zip(frame["path"], frame["content"], strict=True):
            try:
                out += [{"path": path, **r} for r in PARSERS[path.rpartition(".")[2].lower()](bytes(raw))]
            except Exception as e:  # a file that does not parse is a record of its own
                out.append({"path": path, "error": f"{type(e).__name__}: {e}"[:300]})
        yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)


def read_files(spark: SparkSession, root: str, *suffixes: str) -> DataFrame:
    """Records of the files below `root` with the given suffixes (all known ones by default)."""
    glob = "*.{" + ",".join(suffixes or PARSERS) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInPandas(_parse, RECORD)
