"""What was handed in: kinds of files told by their first bytes, broken and doubled items, and which reader takes which files."""

from __future__ import annotations

import re
import zipfile
import zlib
from dataclasses import dataclass
from io import BytesIO

#: Least score at which a reader claims files.
CLAIM = 0.5
UNFINISHED = re.compile(r"(?i)\.(crdownload|part|partial|download)$")
JUNK = re.compile(r"(?i)(^|/)(__MACOSX/|\.DS_Store$|Thumbs\.db$|\._|desktop\.ini$)")


def kind(head: bytes) -> str:
    """zip, gzip, rar, 7z, pdf, sqlite, html, json, empty or other."""
    if not head:
        return "empty"
    for name, mark in (("zip", b"PK\x03\x04"), ("zip", b"PK\x05\x06"), ("gzip", b"\x1f\x8b"), ("rar", b"Rar!"), ("7z", b"7z\xbc\xaf"), ("pdf", b"%PDF"), ("sqlite", b"SQLite format 3\x00")):
        if head.startswith(mark):
            return name
    text = head.removeprefix(b"\xef\xbb\xbf").lstrip()
    return "html" if text.startswith(b"<") else "json" if text[:1] in (b"{", b"[") else "other"


def problem(name: str, data: bytes) -> str | None:
    """Why an item can't be read: unfinished download, empty, no zip though named so, cut short, encrypted; None if it can."""
    if UNFINISHED.search(name):
        return "unfinished download"
    if not data:
        return "empty"
    is_zip = kind(data[:16]) == "zip"
    if name.lower().endswith(".zip") and not is_zip:
        return f"not a zip but {kind(data[:64])}"
    if is_zip:
        try:
            with zipfile.ZipFile(BytesIO(data)) as z:
                if z.infolist() and all(i.flag_bits & 1 for i in z.infolist()):
                    return "encrypted"
        except zipfile.BadZipFile:
            return "cut short"
    return None


def entries(name: str, data: bytes, depth: int = 3) -> dict[str, bytes]:
    """Path to bytes of a file or of what a zip holds, zips within zips too, without system files."""
    if kind(data[:16]) != "zip" or depth == 0 or re.search(r"(?i)\.(xlsx|docx|ods)$", name):
        return {} if JUNK.search(name) else {name: data}
    out: dict[str, bytes] = {}
    with zipfile.ZipFile(BytesIO(data)) as z:
        for item in z.infolist():
            if not item.is_dir() and not JUNK.search(item.filename) and not item.flag_bits & 1:
                inner = z.read(item)
                for path, held in entries(item.filename, inner, depth - 1).items():
                    out[path if path == item.filename else f"{item.filename}/{path}"] = held
    return out


def same(one: dict[str, bytes], other: dict[str, bytes]) -> bool:
    """Whether two items hold the same files, below their own top folders."""
    mark = lambda files: sorted((p.split("/", 1)[-1].lower(), len(b), zlib.crc32(b)) for p, b in files.items())
    return mark(one) == mark(other)


def part_of(name: str) -> tuple[str, int | None]:
    """(name without its part number, number): takeout-2024-001.zip, export-part2.zip, messages (3).zip."""
    m = re.match(r"(?i)^(.*?)(?:[-_ ]part[-_ ]?(\d+)|-(\d{3})|[-_ ]?\((\d+)\))(\.[a-z0-9.]+)?$", name)
    if not m:
        return name, None
    return m[1] + (m[5] or ""), int(next(x for x in m.groups()[1:4] if x))


@dataclass(frozen=True)
class Found:
    reader: str
    score: float
    files: tuple[str, ...]


#: What tells a reader's files: (reader, pattern of the path, pattern in the first bytes, score).
SIGNS = [
    ("slack", r"(^|/)users\.json$", None, 0.4), ("slack", r"(^|/)(channels|groups|dms|mpims)\.json$", None, 0.6), ("whatsapp", r"(?i)whatsapp chat|_chat\.txt$", None, 0.9), ("whatsapp", r"\.txt$", rb"^\W{0,3}\[?\d{1,2}[/.]\d{1,2}[/.]\d{2,4},? \d", 0.7),
    ("email", r"(?i)\.(mbox|eml)$", None, 0.9), ("calendar", r"(?i)\.ics$", None, 0.9), ("telegram", r"(^|/)result\.json$", rb'"(messages|chats)"', 0.8), ("meta", r"message_\d+\.json$", rb'"participants"', 0.9), ("discord", r"\.json$", rb'"guild"\s*:', 0.8),
    ("x-archive", r"(^|/)(tweets?|like|follower|following)(-part\d+)?\.js$", None, 0.8), ("mastodon", r"(^|/)outbox\.json$", rb"orderedItems", 0.8), ("linkedin", r"(^|/)Connections\.csv$", None, 0.8), ("imessage", r"(^|/)chat\.db$", None, 0.9),
    ("network", r"(?i)\.(graphml|gexf|gml|net|paj|dl)$", None, 0.9), ("reddit", r"\.(jsonl|ndjson)$", rb'"subreddit"', 0.8), ("x-research", r"\.(jsonl|ndjson)$", rb'"author_id"', 0.8), ("tabular", r"(?i)\.(csv|tsv|tab)$", None, 0.3),
]


def detect(files: dict[str, bytes]) -> list[Found]:
    """Readers that may take the files, surest first."""
    hits: dict[str, tuple[float, set[str]]] = {}
    for reader, path, inside, score in SIGNS:
        for name, data in files.items():
            if re.search(path, name) and (inside is None or re.search(inside, data[:4096])):
                best, named = hits.get(reader, (0.0, set()))
                hits[reader] = (max(best, score), named | {name})
    return sorted((Found(r, s, tuple(sorted(n))) for r, (s, n) in hits.items()), key=lambda f: (-f.score, f.reader))


def plan(found: list[Found], names: list[str]) -> tuple[list[Found], list[str]]:
    """(which reader takes which files, files that none takes): readers claim by score from 0.5 on, what is claimed is gone; with no claim, the tabular reader or the first one."""
    claimed: set[str] = set()
    out = []
    for f in found:
        rest = tuple(n for n in f.files if n not in claimed)
        if f.score >= CLAIM and rest:
            out.append(Found(f.reader, f.score, rest))
            claimed |= set(rest)
    if not out and found:
        out = [next((f for f in found if f.reader == "tabular"), found[0])]
        claimed |= set(out[0].files)
    return out, [n for n in names if n not in claimed]
