"""More services: Teams messages, Threads, and repositories of the AT protocol (CAR files of CBOR blocks)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as words
from kinweave.functions import times
from kinweave.model import Dataset
from kinweave.sources import base


def teams(spark: SparkSession, path: str) -> Dataset:
    """Messages of chats and channels as the service's interface lists them ({"value": [...]} files, or lines of JSON): replies, mentions, reactions, direct chats by the chat's id."""
    user = "struct<id: string, displayName: string>"
    who = f"struct<user: {user}, application: {user}>"
    message = f"id string, replyToId string, messageType string, createdDateTime string, chatId string, channelIdentity struct<teamId: string, channelId: string>, `from` {who}, body struct<content: string>, mentions array<struct<mentioned: {who}>>, reactions array<struct<reactionType: string, user: {who}>>"
    wrapped = spark.read.option("multiLine", "true").schema(f"value array<struct<{', '.join(re.sub(r' ', ': ', p.strip(), count=1) for p in base._fields(message))}>>").json(path)
    rows = wrapped.where("value IS NOT NULL").select(F.explode("value").alias("m")).select("m.*").where("id IS NOT NULL")
    person = lambda c: F.when(F.col(f"{c}.user.id").isNotNull(), F.concat(F.lit("teams:"), f"{c}.user.id")).otherwise(F.concat(F.lit("teams:app:"), f"{c}.application.id"))
    rows = rows.withColumn("who", person("from")).withColumn("place", F.concat(F.lit("teams:"), F.coalesce("channelIdentity.channelId", "chatId"))).withColumn("t", times.from_iso(F.col("createdDateTime")))
    key = lambda i: F.concat_ws(":", F.col("place"), i)
    authors = rows.select("place", F.col("id").alias("replyToId"), F.col("who").alias("answered"))
    said = rows.where("who IS NOT NULL AND (messageType IS NULL OR messageType = 'message')").join(authors, ["place", "replyToId"], "left")
    named = F.transform(F.filter(F.coalesce("mentions", F.array().cast(f"array<struct<mentioned: {who}>>")), lambda m: m["mentioned"]["user"]["id"].isNotNull()), lambda m: F.struct(F.concat(F.lit("teams:"), m["mentioned"]["user"]["id"]).alias("node"), F.lit("mention").alias("role")))
    reply = F.when(F.col("answered").isNotNull(), F.array(F.struct(F.col("answered").alias("node"), F.lit("reply").alias("role")))).otherwise(F.array().cast("array<struct<node: string, role: string>>"))
    messages = said.select(key(F.col("id")).alias("key"), F.lit("message").alias("type"), "t", F.col("who").alias("actor"), F.col("place").alias("context"), F.when(F.col("replyToId").isNotNull(), key(F.col("replyToId"))).alias("parent"), words.html_stripped(F.col("body.content")).alias("text"), F.concat(reply, F.array_distinct(named)).alias("targets"))
    clicks = rows.select("id", "place", "t", "who", F.explode("reactions").alias("r"))
    reactions = clicks.select(F.concat_ws(":", key(F.col("id")), "r.reactionType", "r.user.user.id").alias("key"), F.lit("reaction").alias("type"), "t", person("r.user").alias("actor"), F.col("place").alias("context"), key(F.col("id")).alias("parent"), F.array(F.struct(F.col("who").alias("node"), F.lit("subject").alias("role"))).alias("targets"))
    records = base.shaped(messages, base.RECORDS).unionByName(base.shaped(reactions, base.RECORDS))
    people = said.select(F.col("who").alias("key"), F.coalesce("from.user.displayName", "from.application.displayName").alias("label"), F.col("from.user.id").isNull().alias("is_bot"))
    places = rows.select(F.col("place").alias("key"), F.when(F.col("chatId").contains("@unq.gbl.spaces"), "direct").when(F.col("chatId").isNotNull(), "group").otherwise("public").alias("visibility"), F.when(F.col("chatId").isNotNull(), "chat").otherwise("channel").alias("kind")).distinct()
    return base.assemble(records, people, places, {"format": "teams", "medium": "chat", "view": "full"})


def threads(spark: SparkSession, path: str) -> Dataset:
    """followers.json, following.json and liked posts of a download: lists of entries with string_list_data."""
    entry = "title string, string_list_data array<struct<href: string, value: string, timestamp: bigint>>, string_map_data map<string, struct<value: string, timestamp: bigint>>"
    schema = ", ".join(f"text_post_app_text_post_app_{k} array<struct<{', '.join(re.sub(r' ', ': ', p.strip(), count=1) for p in base._fields(entry))}>>" for k in ("followers", "following"))
    files = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").schema(schema).json(path)
    records = None
    for kind in ("followers", "following"):
        rows = files.select(F.explode(f"text_post_app_text_post_app_{kind}").alias("e")).select(F.explode("e.string_list_data").alias("d")).select(F.concat(F.lit("threads:"), F.lower("d.value")).alias("who"), times.from_seconds(F.col("d.timestamp")).alias("t"))
        actor, target = (F.col("who"), F.lit("threads:self")) if kind == "followers" else (F.lit("threads:self"), F.col("who"))
        part = rows.where("who IS NOT NULL").select(F.concat_ws(":", F.lit(f"threads:{kind}"), "who").alias("key"), F.lit("follow").alias("type"), "t", actor.alias("actor"), F.array(F.struct(target.alias("node"), F.lit("subject").alias("role"))).alias("targets"))
        records = base.joined(records, base.shaped(part, base.RECORDS))
    return base.assemble(records, None, None, {"format": "threads", "medium": "social", "view": "ego"})


# ---- AT protocol ----


def cbor(data: bytes, at: int = 0) -> tuple[object, int]:
    """One CBOR item of the deterministic subset that repositories use, and where the next starts; links (tag 42) are bytes."""
    first = data[at]
    major, info = first >> 5, first & 31
    at += 1
    if major == 7:
        if info == 27:
            return struct.unpack(">d", data[at : at + 8])[0], at + 8
        return {20: False, 21: True, 22: None}.get(info), at
    if info < 24:
        n = info
    else:
        size = 1 << (info - 24)
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major == 2:
        return data[at : at + n], at + n
    if major == 3:
        return data[at : at + n].decode("utf-8", "replace"), at + n
    if major == 4:
        out = []
        for _ in range(n):
            x, at = cbor(data, at)
            out.append(x)
        return out, at
    if major == 5:
        held = {}
        for _ in range(n):
            k, at = cbor(data, at)
            held[k], at = cbor(data, at)
        return held, at
    return cbor(data, at)  # a tag: its content


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out, at, shift = out | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return out, at


def car_blocks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(identifier, block) of a CAR file."""
    size, at = _varint(data, 0)
    at += size
    while at < len(data):
        size, at = _varint(data, at)
        start, end = at, at + size
        version, p = _varint(data, at)
        if version == 1:
            _, p = _varint(data, p)
            _, p = _varint(data, p)
            length, p = _varint(data, p)
            p += length
        else:  # a bare multihash
            p = at + 34
        yield data[start:p], data[p:end]
        at = end


def bluesky_rows(name: str, data: bytes) -> Iterator[dict]:
    """Posts, reposts, likes and follows of one account's repository; the account is that of its commit."""
    blocks = []
    owner = "self"
    for i, (_, block) in enumerate(car_blocks(data)):
        item, _ = cbor(block)
        if isinstance(item, dict):
            if "did" in item and "rev" in item:
                owner = item["did"]
            elif "$type" in item:
                blocks.append((i, item))
    did = lambda uri: (re.match(r"at://(did:[^/]+)", uri or "") or [None, None])[1]
    for i, item in blocks:
        kind = item["$type"].rsplit(".", 1)[-1]
        made = item.get("createdAt")
        try:
            t = datetime.fromisoformat(made.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None) if made else None
        except ValueError:
            t = None
        row = {"key": f"at:{owner}:{kind}:{i}", "t": t, "actor": f"at:{owner}", "context": "at:public"}
        node = lambda d, role: [{"node": f"at:{d}", "role": role}] if d else []
        if kind == "post":
            answered = did(((item.get("reply") or {}).get("parent") or {}).get("uri"))
            named = [f.get("did") for facet in item.get("facets") or [] for f in facet.get("features") or [] if f.get("did")]
            yield row | {"type": "message", "text": item.get("text"), "targets": node(answered, "reply") + [x for d in dict.fromkeys(named) if d != answered for x in node(d, "mention")]}
        elif kind in ("repost", "like"):
            yield row | {"type": kind, "targets": node(did((item.get("subject") or {}).get("uri")), "subject")}
        elif kind == "follow":
            yield row | {"type": "follow", "targets": node(item.get("subject"), "subject")}


def bluesky(spark: SparkSession, path: str) -> Dataset:
    records = base.parsed(spark, path, bluesky_rows, pattern="*.car")
    places = spark.createDataFrame([("at:public", "Bluesky", "public")], "key string, name string, visibility string")
    return base.assemble(records, None, places, {"format": "bluesky", "medium": "social", "view": "authored"})
