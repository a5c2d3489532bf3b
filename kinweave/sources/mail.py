"""Mail and calendars: mbox and eml files, iCalendar files. Python's own parsers read each file as a whole in one task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinweave.model import Dataset
from kinweave.sources import base

#: Occurrences of a recurring meeting that are made at most, a parameter.
MOST_OCCURRENCES = 500


def _utc(t: datetime | None) -> datetime | None:
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t is not None and t.tzinfo else t


def _messages(data: bytes) -> Iterator[bytes]:
    """The messages of an mbox, or the one of an eml file."""
    if not data.startswith(b"From "):
        yield data
        return
    for part in re.split(rb"(?m)(?:^|\n)From [^\n]*\n", data)[1:]:
        yield re.sub(rb"(?m)^>(>*From )", rb"\1", part)


def mail_rows(name: str, data: bytes) -> Iterator[dict]:
    for i, raw in enumerate(_messages(data)):
        mail = message_from_bytes(raw, policy=policy.default)
        people = lambda field: [(n.strip(), a.lower()) for n, a in getaddresses([str(v) for v in mail.get_all(field, [])]) if "@" in a]
        sender = people("From")
        if not sender:
            continue
        try:
            t = _utc(parsedate_to_datetime(str(mail["Date"]))) if mail["Date"] else None
        except (ValueError, TypeError):
            t = None
        try:
            body = mail.get_body(preferencelist=("plain", "html"))
            text = body.get_content() if body is not None else None
        except (LookupError, KeyError, ValueError):
            text = None
        ids = lambda field: re.findall(r"<([^<>\s]+)>", str(mail.get(field, "")))
        own = (ids("Message-ID") or [f"{name}#{i}"])[0]
        answers = (ids("In-Reply-To") or ids("References")[-1:] or [None])[0]
        thread = (ids("References") or [answers or own])[0]
        targets = [{"node": f"email:{a}", "role": role} for role in ("to", "cc", "bcc") for _, a in people(role)]
        yield {"key": f"email:{own}", "type": "message", "t": t, "actor": f"email:{sender[0][1]}", "context": f"email:thread:{thread}", "parent": f"email:{answers}" if answers else None, "text": text, "targets": targets, "attrs": {"name": [f"{a}\t{n}" for field in ("From", "To", "Cc") for n, a in people(field) if n]}}


def mail(spark: SparkSession, path: str, pattern: str | None = None) -> Dataset:
    """Messages with their addressees; a message that two folders hold counts once. Names come from the headers."""
    rows = base.parsed(spark, path, mail_rows, pattern=pattern).dropDuplicates(["key"])
    named = rows.select(F.explode("attrs.name").alias("x")).select(F.concat(F.lit("email:"), F.substring_index("x", "\t", 1)).alias("key"), F.substring_index("x", "\t", -1).alias("label"))
    labels = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    places = rows.select(F.col("context").alias("key")).distinct().select("key", F.lit("email_thread").alias("kind"), F.lit("private").alias("visibility"))
    return base.assemble(rows.withColumn("attrs", F.lit(None).cast("map<string, array<string>>")), labels, places, {"format": "email", "medium": "email", "view": "ego"})


# ---- calendars ----

_DAYS = {d: i for i, d in enumerate(["MO", "TU", "WE", "TH", "FR", "SA", "SU"])}


def _moment(value: str, zone: str | None) -> datetime | None:
    try:
        if re.fullmatch(r"\d{8}", value):
            return datetime.strptime(value, "%Y%m%d")
        t = datetime.strptime(value.rstrip("Z"), "%Y%m%dT%H%M%S")
        if value.endswith("Z") or not zone:
            return t
        return _utc(t.replace(tzinfo=ZoneInfo(zone)))
    except (ValueError, KeyError, OSError):
        return None


def occurrences(start: datetime, rule: str, until: datetime | None = None, most: int = MOST_OCCURRENCES) -> list[datetime]:
    """Times of a recurrence rule with FREQ, INTERVAL, COUNT, UNTIL and BYDAY (weekly)."""
    parts = dict(p.split("=", 1) for p in rule.split(";") if "=" in p)
    step, count = int(parts.get("INTERVAL", 1)), min(int(parts.get("COUNT", most)), most)
    end = _moment(parts["UNTIL"], None) if "UNTIL" in parts else until
    days = sorted(_DAYS[d[-2:]] for d in parts.get("BYDAY", "").split(",") if d[-2:] in _DAYS) or [start.weekday()]
    out: list[datetime] = []
    n = 0
    while len(out) < count and n < 10 * most:
        if parts.get("FREQ") == "DAILY":
            found = [start + timedelta(days=n * step)]
        elif parts.get("FREQ") == "WEEKLY":
            monday = start - timedelta(days=start.weekday()) + timedelta(weeks=n * step)
            found = [monday + timedelta(days=d) for d in days]
        elif parts.get("FREQ") in ("MONTHLY", "YEARLY"):
            months = start.month - 1 + n * step * (12 if parts["FREQ"] == "YEARLY" else 1)
            try:
                found = [start.replace(year=start.year + months // 12, month=months % 12 + 1)]
            except ValueError:  # no such day in that month
                found = []
        else:
            return [start]
        for t in found:
            if t >= start and (end is None or t <= end) and len(out) < count:
                out.append(t)
        if end is not None and found and found[0] > end:
            break
        n += 1
    return out


def calendar_rows(name: str, data: bytes) -> Iterator[dict]:
    lines = re.sub(r"\r?\n[ \t]", "", data.decode("utf-8-sig", "replace")).splitlines()
    event: dict | None = None
    for line in lines:
        head, _, value = line.partition(":")
        field, *rest = head.split(";")
        options = dict(p.split("=", 1) for p in rest if "=" in p)
        field = field.upper()
        if field == "BEGIN" and value == "VEVENT":
            event = {"people": [], "out": set()}
        elif field == "END" and value == "VEVENT" and event is not None:
            yield from _meetings(event, name)
            event = None
        elif event is not None:
            if field in ("ORGANIZER", "ATTENDEE"):
                mail = re.sub(r"(?i)^mailto:", "", value).strip().lower()
                if "@" in mail and options.get("PARTSTAT") != "DECLINED":
                    event["people"].append((field, mail, options.get("CN", "").strip('"')))
            elif field == "EXDATE":
                event["out"] |= {_moment(v, options.get("TZID")) for v in value.split(",")}
            elif field in ("UID", "SUMMARY", "RRULE", "STATUS", "DTSTART", "RECURRENCE-ID"):
                event[field] = (value, options.get("TZID"))


def _meetings(event: dict, name: str) -> Iterator[dict]:
    if event.get("STATUS", ("",))[0].upper() == "CANCELLED" or "DTSTART" not in event or not event["people"]:
        return
    start = _moment(*event["DTSTART"])
    uid = event.get("UID", (f"{name}:{event['DTSTART'][0]}",))[0]
    people = sorted(event["people"], key=lambda p: p[0] != "ORGANIZER")
    times = [t for t in occurrences(start, event["RRULE"][0]) if t not in event["out"]] if start and "RRULE" in event else [start]
    for t in times:
        yield {"key": f"ics:{uid}:{t:%Y%m%dT%H%M%S}" if t else f"ics:{uid}", "type": "copresence", "t": t, "actor": f"email:{people[0][1]}", "context": f"ics:{uid}", "text": event.get("SUMMARY", (None,))[0], "targets": [{"node": f"email:{m}", "role": "attendee"} for m in dict.fromkeys(m for _, m, _ in people[1:])], "attrs": {"name": [f"{m}\t{n}" for _, m, n in people if n]}}


def calendar(spark: SparkSession, path: str) -> Dataset:
    """Meetings with organiser and attendees; recurring ones are expanded, exceptions and cancelled ones left out."""
    rows = base.parsed(spark, path, calendar_rows, pattern="*.ics").dropDuplicates(["key"])
    named = rows.select(F.explode("attrs.name").alias("x")).select(F.concat(F.lit("email:"), F.substring_index("x", "\t", 1)).alias("key"), F.substring_index("x", "\t", -1).alias("label")).distinct()
    places = rows.select(F.col("context").alias("key"), F.col("text").alias("name"), F.lit("meeting").alias("kind"), F.lit("private").alias("visibility")).dropDuplicates(["key"])
    return base.assemble(rows.withColumn("attrs", F.lit(None).cast("map<string, array<string>>")), named, places, {"format": "calendar", "medium": "meeting", "view": "ego"})

