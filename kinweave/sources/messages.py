"""Exports of message services. JSON and CSV come through Spark's readers with schemas given, so numbers of 16 digits and more stay text; formats that
Spark has no reader for are parsed file by file."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as words
from kinweave.functions import times
from kinweave.model import Dataset
from kinweave.sources import base

_NONE = "cast(array() AS array<struct<node: string, role: string>>)"


def _key(prefix: str, *parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    whole = F.concat_ws(":", F.lit(prefix), *cols)
    known = cols[0].isNotNull() & (cols[0].cast("string") != "")
    return F.when(known, whole)


def _targets(nodes: Column, role: str) -> Column:
    return F.transform(F.coalesce(nodes, F.array().cast("array<string>")), lambda x: F.struct(x.alias("node"), F.lit(role).alias("role")))


def _one(node: Column, role: str) -> Column:
    return F.when(node.isNotNull(), F.array(F.struct(node.alias("node"), F.lit(role).alias("role")))).otherwise(F.expr(_NONE))


# ---- Slack ----

SLACK = "type string, subtype string, user string, bot_id string, text string, ts string, thread_ts string, parent_user_id string, reactions array<struct<name: string, users: array<string>>>, room struct<participant_history: array<string>>"
SLACK_USERS = "id string, name string, real_name string, is_bot boolean, profile struct<email: string, display_name: string, real_name: string, title: string>"


def slack(spark: SparkSession, path: str) -> Dataset:
    """An export folder: users.json, lists of channels, and a folder of day files for each channel. Threads are replies to their parent's author, <@U1> are mentions, reactions point at the
    author, calls are copresence, messages in a direct channel go to its other member."""
    many = spark.read.option("multiLine", "true")
    exists = lambda f: bool(_listed(spark, path, f))
    lists = [("channels.json", "public", "channel"), ("groups.json", "private", "channel"), ("mpims.json", "group", "group_dm"), ("dms.json", "direct", "dm")]
    channels = None
    for name, layer, kind in lists:
        if exists(name):
            rows = many.schema("id string, name string, members array<string>").json(f"{path}/{name}").select(F.coalesce("name", "id").alias("folder"), "id", "members", F.lit(layer).alias("visibility"), F.lit(kind).alias("kind"))
            channels = base.joined(channels, rows)
    if channels is None:
        channels = spark.createDataFrame([], "folder string, id string, members array<string>, visibility string, kind string")
    users = many.schema(SLACK_USERS).json(f"{path}/users.json") if exists("users.json") else spark.createDataFrame([], SLACK_USERS)
    days = many.schema(SLACK).json(f"{path}/*/*.json").withColumn("folder", F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -2)))
    days = days.join(F.broadcast(channels), "folder", "left").withColumn("who", _key("slack", F.coalesce("user", "bot_id"))).withColumn("t", times.from_seconds(F.col("ts")))
    context = _key("slack", F.coalesce("id", "folder"))
    key = lambda ts: F.concat_ws(":", F.lit("slack"), F.coalesce("id", "folder"), ts)
    mentioned = F.transform(F.regexp_extract_all("text", F.lit(r"<@([UW][A-Z0-9]+)"), F.lit(1)), lambda u: F.concat(F.lit("slack:"), u))
    reply = F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("ts"))
    other = F.when(F.col("kind") == "dm", F.transform(F.filter("members", lambda m: m != F.col("user")), lambda m: F.concat(F.lit("slack:"), m)))
    targets = F.concat(_one(F.when(reply, _key("slack", "parent_user_id")), "reply"), _targets(F.array_distinct(mentioned), "mention"), _targets(other, "dm"))
    said = days.where("type = 'message' AND (subtype IS NULL OR subtype IN ('bot_message', 'me_message', 'thread_broadcast', 'file_share')) AND who IS NOT NULL")
    messages = said.select(key(F.col("ts")).alias("key"), F.lit("message").alias("type"), "t", F.col("who").alias("actor"), context.alias("context"), F.when(reply, key(F.col("thread_ts"))).alias("parent"), "text", targets.alias("targets"))
    clicks = said.select("ts", "t", "who", "id", "folder", F.explode("reactions").alias("r")).select("*", F.explode("r.users").alias("u"))
    reactions = clicks.select(F.concat_ws(":", key(F.col("ts")), F.col("r.name"), F.col("u")).alias("key"), F.lit("reaction").alias("type"), "t", _key("slack", "u").alias("actor"), context.alias("context"), key(F.col("ts")).alias("parent"), _one(F.col("who"), "subject").alias("targets"))
    moves = days.where("subtype IN ('channel_join', 'channel_leave', 'group_join', 'group_leave')").select(F.concat_ws(":", key(F.col("ts")), F.col("subtype")).alias("key"), F.when(F.col("subtype").endswith("join"), "join").otherwise("leave").alias("type"), "t", F.col("who").alias("actor"), context.alias("context"))
    there = F.transform("room.participant_history", lambda u: F.concat(F.lit("slack:"), u))
    calls = days.where("size(room.participant_history) > 1").select(F.concat_ws(":", key(F.col("ts")), F.lit("call")).alias("key"), F.lit("copresence").alias("type"), "t", F.element_at(there, 1).alias("actor"), context.alias("context"), _targets(there, "attendee").alias("targets"))
    records = None
    for part in (messages, reactions, moves, calls):
        records = base.joined(records, base.shaped(part, base.RECORDS))
    attrs = F.map_filter(F.create_map(F.lit("email"), F.lower("profile.email"), F.lit("title"), F.col("profile.title")), lambda _, v: v.isNotNull() & (v != ""))
    people = users.select(_key("slack", "id").alias("key"), F.coalesce(F.when(F.col("profile.real_name") != "", F.col("profile.real_name")), "real_name", "name").alias("label"), "is_bot", attrs.alias("attrs"))
    places = channels.select(_key("slack", "id").alias("key"), F.col("folder").alias("name"), "kind", "visibility")
    return base.assemble(records, people, places, {"format": "slack", "medium": "chat"})


def _listed(spark: SparkSession, path: str, name: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# ---- WhatsApp ----

#: [1/2/24, 14:05:06] Name: text   or   1/2/24, 2:05 PM - Name: text
WHATSAPP = r"^[‎‏]?\[?(\d{1,4}[/.\-]\d{1,2}[/.\-]\d{2,4}),?\s+(\d{1,2}[:.]\d{2}(?:[:.]\d{2})?)\s*([AaPp]\.?[Mm]\.?)?\]?\s*(?:[-–]\s*)?(.*)$"
_JOINED, _LEFT = re.compile(r"(?i)^(.+?) (?:joined|was added|added you|se unió|a rejoint)\b"), re.compile(r"(?i)^(.+?) (?:left|was removed|salió|a quitté)\b")


def day_first(dates: list[tuple[int, int]], default: bool = True) -> bool:
    """Whether a chat's dates are day/month: a first part over 12 says yes, a second part over 12 no; else the order in which dates go back least, then the
    reading whose first part changes more often."""
    if any(a > 12 for a, _ in dates):
        return True
    if any(b > 12 for _, b in dates):
        return False
    back = lambda key: sum(key(x) > key(y) for x, y in zip(dates, dates[1:]))
    day, month = back(lambda d: (d[1], d[0])), back(lambda d: (d[0], d[1]))
    if day != month:
        return day < month
    moves = [sum(x[i] != y[i] for x, y in zip(dates, dates[1:])) for i in (0, 1)]
    return moves[0] > moves[1] if moves[0] != moves[1] else default


def whatsapp_rows(name: str, data: bytes) -> Iterator[dict]:
    """Messages of one chat; lines without a date go on with the message before. Nobody is addressed, so ties come from turns and @mentions."""
    chat = re.sub(r"(?i)^whatsapp chat (?:with|-) |\.txt$", "", name.rsplit("/", 1)[-1])
    found: list[list] = []
    for line in data.decode("utf-8-sig", "replace").splitlines():
        m = re.match(WHATSAPP, line)
        if m:
            found.append([m[1], m[2], m[3], m[4]])
        elif found:
            found[-1][3] += "\n" + line
    parts = [[int(x) for x in re.split(r"[/.\-]", f[0])] for f in found]
    short = [(p[0], p[1]) for p in parts if p[0] <= 31]
    first = day_first(short)
    people = {f[3].split(":", 1)[0].strip("‎ ~") for f in found if ": " in f[3].split("\n", 1)[0]}
    for i, ((_, clock, half, body), p) in enumerate(zip(found, parts)):
        year, month, day = (p[0], p[1], p[2]) if p[0] > 31 else (p[2], p[1], p[0]) if first else (p[2], p[0], p[1])
        h = [int(x) for x in re.split("[:.]", clock)]
        if half:
            h[0] = h[0] % 12 + (12 if half[0] in "pP" else 0)
        try:
            t = datetime(year + 2000 if year < 100 else year, month, day, *h)
        except ValueError:
            t = None
        head, _, text = body.partition(": ")
        row = {"key": f"whatsapp:{chat}:{i}", "t": t, "context": f"whatsapp:{chat}"}
        if _ and "\n" not in head:
            who = head.strip("‎ ~")
            named = [p for p in people if p != who and re.search(rf"@[⁨]?{re.escape(p)}(?!\w)", text)]
            yield row | {"type": "message", "actor": f"whatsapp_name:{who}", "text": text, "targets": [{"node": f"whatsapp_name:{p}", "role": "mention"} for p in sorted(named)]}
        else:
            for kind, found_ in (("join", _JOINED.match(body)), ("leave", _LEFT.match(body))):
                if found_:
                    yield row | {"type": kind, "actor": f"whatsapp_name:{found_[1].strip('‎ ~')}"}


def whatsapp(spark: SparkSession, path: str) -> Dataset:
    records = base.parsed(spark, path, whatsapp_rows, pattern="*.txt")
    places = records.select(F.col("context").alias("key")).distinct().select("key", F.lit("chat").alias("kind"), F.lit("group").alias("visibility"))
    return base.assemble(records, None, places, {"format": "whatsapp", "medium": "chat", "view": "chat"})


# ---- Telegram ----


def telegram(spark: SparkSession, path: str) -> Dataset:
    """result.json of one chat, or of all with chats.list. Replies point at the author of the message they answer, found by its id."""
    message = "id: bigint, type: string, action: string, date_unixtime: string, from: string, from_id: string, actor: string, actor_id: string, reply_to_message_id: bigint, text_entities: array<struct<type: string, text: string, user_id: bigint>>, reactions: array<struct<emoji: string, recent: array<struct<from_id: string>>>>"
    chat = f"name: string, type: string, id: bigint, messages: array<struct<{message}>>"
    schema = f"name string, type string, id bigint, messages array<struct<{message}>>, chats struct<list: array<struct<{chat}>>>"
    files = spark.read.option("multiLine", "true").schema(schema).json(path)
    chats = files.where("messages IS NOT NULL").select("name", "type", "id", "messages").unionByName(files.where("chats IS NOT NULL").select(F.explode("chats.list").alias("c")).select("c.name", "c.type", "c.id", "c.messages"))
    rows = chats.select(F.col("id").alias("chat"), F.col("type").alias("chat_type"), F.col("name").alias("chat_name"), F.explode("messages").alias("m")).select("chat", "chat_type", "chat_name", "m.*")
    who, t = _key("telegram", F.coalesce("from_id", "actor_id")), times.from_seconds(F.col("date_unixtime"))
    key = lambda i: F.concat_ws(":", F.lit("telegram"), F.col("chat").cast("string"), i.cast("string"))
    context = _key("telegram:chat", F.col("chat").cast("string"))
    authors = rows.select(F.col("chat"), F.col("id").alias("reply_to_message_id"), who.alias("answered"))
    said = rows.where("type = 'message'").join(authors, ["chat", "reply_to_message_id"], "left")
    text = F.array_join(F.transform("text_entities", lambda e: e["text"]), "")
    named = F.transform(F.filter("text_entities", lambda e: (e["type"] == "mention_name") & e["user_id"].isNotNull()), lambda e: F.concat(F.lit("telegram:user"), e["user_id"].cast("string")))
    targets = F.concat(_one(F.col("answered"), "reply"), _targets(F.array_distinct(named), "mention"))
    messages = said.select(key(F.col("id")).alias("key"), F.lit("message").alias("type"), t.alias("t"), who.alias("actor"), context.alias("context"), F.when(F.col("reply_to_message_id").isNotNull(), key(F.col("reply_to_message_id"))).alias("parent"), text.alias("text"), targets.alias("targets"))
    clicks = rows.where("type = 'message'").select("chat", "id", who.alias("author"), t.alias("t"), F.explode("reactions").alias("r")).select("*", F.explode("r.recent").alias("u"))
    reactions = clicks.select(F.concat_ws(":", key(F.col("id")), F.col("r.emoji"), F.col("u.from_id")).alias("key"), F.lit("reaction").alias("type"), "t", _key("telegram", "u.from_id").alias("actor"), context.alias("context"), key(F.col("id")).alias("parent"), _one(F.col("author"), "subject").alias("targets"))
    moves = rows.where("type = 'service' AND action IN ('join_group_by_link', 'invite_members', 'remove_members')").select(key(F.col("id")).alias("key"), F.when(F.col("action") == "remove_members", "leave").otherwise("join").alias("type"), t.alias("t"), who.alias("actor"), context.alias("context"))
    records = None
    for part in (messages, reactions, moves):
        records = base.joined(records, base.shaped(part, base.RECORDS))
    people = rows.select(who.alias("key"), F.coalesce("from", "actor").alias("label")).where("key IS NOT NULL").groupBy("key").agg(F.max("label").alias("label"))
    layer = F.when(F.col("chat_type") == "personal_chat", "direct").when(F.col("chat_type").startswith("public"), "public").when(F.col("chat_type").startswith("private"), "group").otherwise("private")
    places = rows.select(context.alias("key"), F.col("chat_name").alias("name"), F.lit("chat").alias("kind"), layer.alias("visibility")).distinct()
    return base.assemble(records, people, places, {"format": "telegram", "medium": "chat", "view": "chat"})


# ---- Messenger and Instagram ----


def meta(spark: SparkSession, path: str) -> Dataset:
    """message_*.json of Messenger or Instagram, in which UTF-8 is escaped as Latin-1. People are known by their names only."""
    schema = "participants array<struct<name: string>>, title string, thread_path string, messages array<struct<sender_name: string, timestamp_ms: bigint, content: string, call_duration: bigint, reactions: array<struct<reaction: string, actor: string>>>>"
    files = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "message_*.json").schema(schema).json(path)
    fixed = lambda c: words.mojibake_fixed(F.col(c))
    rows = files.withColumn("names", F.transform("participants", lambda p: words.mojibake_fixed(p["name"]))).select("thread_path", F.col("title"), "names", F.posexplode("messages").alias("i", "m")).select("thread_path", "title", "names", "i", "m.*")
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("meta:"), c))
    rows = rows.withColumn("who", name(fixed("sender_name"))).withColumn("t", times.from_millis(F.col("timestamp_ms"))).withColumn("context", _key("meta:thread", "thread_path"))
    key = F.concat_ws(":", F.lit("meta"), "thread_path", F.col("timestamp_ms").cast("string"), "who")
    others = F.transform(F.filter("names", lambda n: F.concat(F.lit("meta:"), n) != F.col("who")), lambda n: F.concat(F.lit("meta:"), n))
    call = F.col("call_duration").isNotNull()
    targets = F.when(call, _targets(others, "attendee")).when(F.size("names") == 2, _targets(others, "dm")).otherwise(F.expr(_NONE))
    messages = rows.select(key.alias("key"), F.when(call, "copresence").otherwise("message").alias("type"), "t", F.col("who").alias("actor"), "context", fixed("content").alias("text"), targets.alias("targets"))
    clicks = rows.select(key.alias("of"), "t", "who", "context", F.explode("reactions").alias("r"))
    reactions = clicks.select(F.concat_ws(":", "of", "r.actor").alias("key"), F.lit("reaction").alias("type"), "t", name(words.mojibake_fixed(F.col("r.actor"))).alias("actor"), "context", F.col("of").alias("parent"), _one(F.col("who"), "subject").alias("targets"))
    records = base.shaped(messages, base.RECORDS).unionByName(base.shaped(reactions, base.RECORDS))
    places = rows.select(F.col("context").alias("key"), fixed("title").alias("name"), F.when(F.size("names") == 2, "dm").otherwise("group_dm").alias("kind"), F.when(F.size("names") == 2, "direct").otherwise("group").alias("visibility")).distinct()
    return base.assemble(records, None, places, {"format": "meta", "medium": "chat", "view": "ego"})


# ---- Discord ----


def discord(spark: SparkSession, path: str) -> Dataset:
    """JSON files of a chat exporter, one for each channel; ids stay text."""
    author = "struct<id: string, name: string, nickname: string, isBot: boolean>"
    message = f"id: string, type: string, timestamp: string, content: string, author: {author}, mentions: array<{author}>, reference: struct<messageId: string>, reactions: array<struct<emoji: struct<name: string>, users: array<{author}>>>"
    files = spark.read.option("multiLine", "true").schema(f"guild struct<id: string, name: string>, channel struct<id: string, type: string, name: string>, messages array<struct<{message}>>").json(path)
    rows = files.select(F.col("channel.id").alias("channel"), F.col("channel.name").alias("channel_name"), F.col("channel.type").alias("channel_type"), F.explode("messages").alias("m")).select("channel", "channel_name", "channel_type", "m.*")
    rows = rows.withColumn("who", _key("discord", "author.id")).withColumn("t", times.from_iso(F.col("timestamp"))).withColumn("context", _key("discord:channel", "channel"))
    authors = rows.select(F.col("id").alias("ref"), F.col("who").alias("answered"))
    said = rows.where("type IN ('Default', 'Reply') AND author.id IS NOT NULL").withColumn("ref", F.col("reference.messageId")).join(authors, "ref", "left")
    named = F.transform("mentions", lambda a: F.concat(F.lit("discord:"), a["id"]))
    targets = F.concat(_one(F.col("answered"), "reply"), _targets(F.array_distinct(named), "mention"))
    messages = said.select(_key("discord:message", "id").alias("key"), F.lit("message").alias("type"), "t", F.col("who").alias("actor"), "context", _key("discord:message", "ref").alias("parent"), F.col("content").alias("text"), targets.alias("targets"))
    clicks = rows.select("id", "t", "who", "context", F.explode("reactions").alias("r")).select("*", F.explode("r.users").alias("u"))
    reactions = clicks.select(F.concat_ws(":", _key("discord:message", "id"), "r.emoji.name", "u.id").alias("key"), F.lit("reaction").alias("type"), "t", _key("discord", "u.id").alias("actor"), "context", _key("discord:message", "id").alias("parent"), _one(F.col("who"), "subject").alias("targets"))
    moves = rows.where("type = 'GuildMemberJoin'").select(_key("discord:message", "id").alias("key"), F.lit("join").alias("type"), "t", F.col("who").alias("actor"), "context")
    records = None
    for part in (messages, reactions, moves):
        records = base.joined(records, base.shaped(part, base.RECORDS))
    people = rows.select(F.col("author.*")).unionByName(rows.select(F.explode("mentions").alias("a")).select("a.*")).select(_key("discord", "id").alias("key"), F.coalesce("nickname", "name").alias("label"), F.col("isBot").alias("is_bot"))
    layer = F.when(F.col("channel_type").contains("Direct"), F.lit("direct")).otherwise("group")
    places = rows.select(F.col("context").alias("key"), F.col("channel_name").alias("name"), layer.alias("visibility")).distinct()
    return base.assemble(records, people, places, {"format": "discord", "medium": "chat", "view": "chat"})


# ---- Reddit, X, Mastodon ----


def reddit(spark: SparkSession, path: str) -> Dataset:
    """Lines of JSON, posts and comments; a comment answers the author of its parent, found by a join on the parent's name."""
    rows = spark.read.schema("id string, name string, author string, created_utc string, subreddit string, parent_id string, title string, selftext string, body string").json(path)
    rows = rows.withColumn("full", F.coalesce("name", F.concat(F.when(F.col("body").isNotNull(), "t1_").otherwise("t3_"), F.col("id")))).where("id IS NOT NULL AND author IS NOT NULL")
    gone = F.col("author").isin("[deleted]", "[removed]")
    rows = rows.withColumn("who", F.when(~gone, _key("reddit", "author"))).dropDuplicates(["full"])
    authors = rows.select(F.col("full").alias("parent_id"), F.col("who").alias("answered"))
    said = rows.where("who IS NOT NULL").join(authors, "parent_id", "left")
    text = F.coalesce("body", F.concat_ws("\n", "title", "selftext"))
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:^|[^\w/])/?u/([\w-]{3,20})"), F.lit(1)), lambda u: F.concat(F.lit("reddit:"), u))
    records = said.select(_key("reddit:item", "full").alias("key"), F.lit("message").alias("type"), times.from_seconds(F.col("created_utc")).alias("t"), F.col("who").alias("actor"), _key("reddit:r", "subreddit").alias("context"), _key("reddit:item", "parent_id").alias("parent"), text.alias("text"), F.concat(_one(F.col("answered"), "reply"), _targets(F.array_distinct(named), "mention")).alias("targets"))
    bots = said.select(F.col("who").alias("key"), F.col("author").alias("label"), F.lower("author").isin("automoderator").alias("is_bot")).distinct()
    places = said.select(_key("reddit:r", "subreddit").alias("key"), F.col("subreddit").alias("name"), F.lit("public").alias("visibility")).distinct()
    return base.assemble(records, bots, places, {"format": "reddit", "medium": "social", "view": "sample"})


def x_research(spark: SparkSession, path: str) -> Dataset:
    """Posts of the research API as lines of JSON (version 2). Authors of posts that are answered or passed on come from the posts themselves or from in_reply_to_user_id."""
    schema = "id string, author_id string, created_at string, text string, in_reply_to_user_id string, referenced_tweets array<struct<type: string, id: string>>, entities struct<mentions: array<struct<id: string, username: string>>>, author struct<id: string, username: string, name: string>"
    rows = spark.read.schema(schema).json(path).where("id IS NOT NULL").withColumn("who", _key("x", F.coalesce("author_id", "author.id"))).where("who IS NOT NULL").dropDuplicates(["id"])
    of = lambda kind: F.element_at(F.filter(F.coalesce("referenced_tweets", F.array().cast("array<struct<type: string, id: string>>")), lambda r: r["type"] == kind), 1)["id"]
    sized = lambda kind: F.when(F.exists("referenced_tweets", lambda r: r["type"] == kind), of(kind))
    rows = rows.withColumn("passed", F.coalesce(sized("retweeted"), F.lit(None))).withColumn("answers", sized("replied_to")).withColumn("ref", F.coalesce("passed", "answers"))
    known = rows.select(F.col("id").alias("ref"), F.col("who").alias("of"))
    rows = rows.join(known, "ref", "left")
    answered = F.coalesce(_key("x", "in_reply_to_user_id"), F.when(F.col("answers").isNotNull(), F.col("of")))
    named = F.transform("entities.mentions", lambda m: F.concat(F.lit("x:"), m["id"]))
    repost = F.col("passed").isNotNull()
    targets = F.when(repost, _one(F.col("of"), "subject")).otherwise(F.concat(_one(answered, "reply"), _targets(F.array_except(F.array_distinct(F.coalesce(named, F.array().cast("array<string>"))), F.array(answered)), "mention")))
    records = rows.select(_key("x:post", "id").alias("key"), F.when(repost, "repost").otherwise("message").alias("type"), F.coalesce(times.from_iso(F.col("created_at")), times.from_snowflake(F.col("id"))).alias("t"), F.col("who").alias("actor"), F.lit("x:public").alias("context"), _key("x:post", "ref").alias("parent"), F.when(~repost, F.col("text")).alias("text"), targets.alias("targets"))
    people = rows.select(F.col("who").alias("key"), F.coalesce("author.name", "author.username").alias("label")).unionByName(rows.select(F.explode("entities.mentions").alias("m")).select(_key("x", "m.id").alias("key"), F.col("m.username").alias("label")))
    places = spark.createDataFrame([("x:public", "X", "public")], "key string, name string, visibility string")
    return base.assemble(records, people, places, {"format": "x-research", "medium": "social", "view": "sample"})



def x_archive(spark: SparkSession, path: str) -> Dataset:
    """The data folder of a personal archive: tweets.js, like.js, follower.js, following.js; each a JavaScript assignment of a JSON list."""

    def rows(name: str, data: bytes) -> Iterator[dict]:
        import json

        kind = re.sub(r"(-part\d+)?\.js$", "", name.rsplit("/", 1)[-1])
        body = data.decode("utf-8", "replace")
        items = json.loads(re.sub(r"^[^=]*=\s*", "", body, count=1)) if "=" in body[:200] else json.loads(body)
        for i, item in enumerate(items):
            if kind in ("tweets", "tweet"):
                t = item.get("tweet", item)
                text, when = t.get("full_text") or "", t.get("created_at")
                at = datetime.strptime(when, "%a %b %d %H:%M:%S %z %Y").astimezone(timezone.utc).replace(tzinfo=None) if when else None
                mentions = [m["id_str"] for m in (t.get("entities") or {}).get("user_mentions", []) if m.get("id_str")]
                passed = text.startswith("RT @") and mentions
                answered = t.get("in_reply_to_user_id_str")
                targets = [{"node": f"x:{mentions[0]}", "role": "subject"}] if passed else [*([{"node": f"x:{answered}", "role": "reply"}] if answered else []), *({"node": f"x:{m}", "role": "mention"} for m in dict.fromkeys(mentions) if m != answered)]
                yield {"key": f"x:post:{t.get('id_str')}", "type": "repost" if passed else "message", "t": at, "actor": "x:self", "context": "x:public", "parent": f"x:post:{t['in_reply_to_status_id_str']}" if t.get("in_reply_to_status_id_str") else None, "text": None if passed else text, "targets": targets}
            elif kind in ("follower", "following"):
                who = (item.get(kind) or item).get("accountId")
                a, b = ("x:self", f"x:{who}") if kind == "following" else (f"x:{who}", "x:self")
                yield {"key": f"x:{kind}:{who}", "type": "follow", "actor": a, "context": "x:public", "targets": [{"node": b, "role": "subject"}]}
            elif kind == "like":
                like = item.get("like") or item
                by = re.search(r"(?:twitter|x)\.com/(\w{1,15})/status", like.get("expandedUrl") or "")
                who = f"x:@{by[1].lower()}" if by and by[1] != "i" else None
                yield {"key": f"x:like:{like.get('tweetId')}", "type": "like", "actor": "x:self", "context": "x:public", "targets": [{"node": who, "role": "subject"}] if who else []}

    records = base.parsed(spark, path, rows, pattern="{tweets,tweet,follower,following,like}*.js")
    places = spark.createDataFrame([("x:public", "X", "public")], "key string, name string, visibility string")
    return base.assemble(records, None, places, {"format": "x-archive", "medium": "social", "view": "ego"})


def mastodon(spark: SparkSession, path: str) -> Dataset:
    """outbox.json of an archive (posts and boosts), likes.json and following_accounts.csv where they are."""
    item = "id: string, type: string, actor: string, published: string, object: string"
    box = spark.read.option("multiLine", "true").schema(f"orderedItems array<struct<{item}>>").json(f"{path}/outbox.json").select(F.explode("orderedItems").alias("o")).select("o.*")
    note = F.from_json("object", "id string, content string, inReplyTo string, published string, tag array<struct<type: string, href: string>>")
    person = lambda url: F.when(url.isNotNull(), F.concat(F.lit("mastodon:"), F.regexp_replace(url, r"^(https?://[^/]+/(?:users/|@)[^/]+).*$", "$1")))
    made = box.where("type = 'Create'").withColumn("n", note)
    named = F.transform(F.filter(F.coalesce("n.tag", F.array().cast("array<struct<type: string, href: string>>")), lambda x: x["type"] == "Mention"), lambda x: F.concat(F.lit("mastodon:"), x["href"]))
    answered = person(F.col("n.inReplyTo"))
    posts = made.select(F.concat(F.lit("mastodon:post:"), "n.id").alias("key"), F.lit("message").alias("type"), times.from_iso(F.coalesce("n.published", "published")).alias("t"), F.concat(F.lit("mastodon:"), "actor").alias("actor"), F.lit("mastodon:public").alias("context"), F.concat(F.lit("mastodon:post:"), "n.inReplyTo").alias("parent"), words.html_stripped(F.col("n.content")).alias("text"), F.concat(_one(answered, "reply"), _targets(F.filter(F.array_distinct(named), lambda x: ~x.eqNullSafe(answered)), "mention")).alias("targets"))
    boosts = box.where("type = 'Announce'").select(F.concat(F.lit("mastodon:boost:"), "id").alias("key"), F.lit("repost").alias("type"), times.from_iso(F.col("published")).alias("t"), F.concat(F.lit("mastodon:"), "actor").alias("actor"), F.lit("mastodon:public").alias("context"), _one(person(F.col("object")), "subject").alias("targets"))
    records = base.shaped(posts, base.RECORDS).unionByName(base.shaped(boosts, base.RECORDS))
    owner = records.select("actor").limit(1)
    if _listed(spark, path, "following_accounts.csv"):
        table = spark.read.option("header", "true").csv(f"{path}/following_accounts.csv")
        follows = table.select(F.col(f"`{table.columns[0]}`").alias("acct")).join(F.broadcast(owner)).select(F.concat(F.lit("mastodon:follow:"), "acct").alias("key"), F.lit("follow").alias("type"), "actor", _one(F.concat(F.lit("mastodon:@"), F.col("acct")), "subject").alias("targets"))
        records = records.unionByName(base.shaped(follows, base.RECORDS))
    if _listed(spark, path, "likes.json"):
        likes = spark.read.option("multiLine", "true").schema("orderedItems array<string>").json(f"{path}/likes.json").select(F.explode("orderedItems").alias("url")).join(F.broadcast(owner))
        records = records.unionByName(base.shaped(likes.select(F.concat(F.lit("mastodon:like:"), "url").alias("key"), F.lit("like").alias("type"), "actor", _one(person(F.col("url")), "subject").alias("targets")), base.RECORDS))
    places = spark.createDataFrame([("mastodon:public", "Mastodon", "public")], "key string, name string, visibility string")
    return base.assemble(records, None, places, {"format": "mastodon", "medium": "social", "view": "ego"})


# ---- LinkedIn ----


def linkedin(spark: SparkSession, path: str, owner: str = "self") -> Dataset:
    """Connections.csv and messages.csv of an archive. Connections are undirected declared ties; a conversation's others are addressed."""
    me = f"linkedin:{owner}"
    person = lambda url, name: F.concat(F.lit("linkedin:"), F.coalesce(F.lower(F.regexp_extract(url, r"/in/([^/?]+)", 1)), F.lower(name)))
    records, people = None, None
    if _listed(spark, path, "Connections.csv"):
        table = _after_notes(spark, f"{path}/Connections.csv")
        name = F.concat_ws(" ", "First Name", "Last Name")
        key = person(F.col("URL"), name)
        on = F.try_to_timestamp(F.col("Connected On"), F.lit("dd MMM yyyy")).cast("timestamp_ntz")
        rows = table.where(name != "").select(F.concat(F.lit("linkedin:connection:"), key).alias("key"), F.lit("declared").alias("type"), on.alias("t"), F.lit(me).alias("actor"), F.lit("linkedin:connections").alias("context"), _one(key, "declared").alias("targets"))
        records = base.joined(records, base.shaped(rows, base.RECORDS))
        attrs = F.map_filter(F.create_map(F.lit("company"), F.col("Company"), F.lit("position"), F.col("Position")), lambda _, v: v.isNotNull())
        people = table.where(name != "").select(key.alias("key"), name.alias("label"), attrs.alias("attrs"))
    if _listed(spark, path, "messages.csv"):
        table = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{path}/messages.csv")
        sender = person(F.col("SENDER PROFILE URL"), F.col("FROM"))
        to = F.transform(F.split("RECIPIENT PROFILE URLS", ","), lambda u: F.concat(F.lit("linkedin:"), F.lower(F.regexp_extract(u, r"/in/([^/?]+)", 1))))
        rows = table.select(F.concat_ws(":", F.lit("linkedin:message"), F.col("CONVERSATION ID"), F.col("DATE"), sender).alias("key"), F.lit("message").alias("type"), F.try_to_timestamp(F.regexp_replace("DATE", " UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("t"), sender.alias("actor"), F.concat(F.lit("linkedin:conversation:"), F.col("CONVERSATION ID")).alias("context"), F.col("CONTENT").alias("text"), _targets(to, "dm").alias("targets"))
        records = base.joined(records, base.shaped(rows, base.RECORDS))
    if records is None:
        records = spark.createDataFrame([], base.RECORDS)
    return base.assemble(records, people, None, {"format": "linkedin", "medium": "social", "view": "ego", "directed": False})


def _after_notes(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose header comes after some lines of notes: the first line that names First Name is the header."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)(First Name,.*)$", 1).alias("value"))
    lines = text.select(F.explode(F.split("value", r"\r?\n")).alias("line")).where("trim(line) <> ''")
    head = text.select(F.element_at(F.split("value", r"\r?\n"), 1).alias("h")).collect()
    names = [n.strip() for n in head[0]["h"].split(",")] if head and head[0]["h"] else ["First Name", "Last Name", "URL", "Company", "Position", "Connected On"]
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = lines.where(F.col("line") != (head[0]["h"] if head else "")).select(F.from_csv("line", schema, {"sep": ",", "quote": '"', "escape": '"'}).alias("r"))
    return parsed.select("r.*")


# ---- iMessage ----


def imessage_rows(name: str, data: bytes) -> Iterator[dict]:
    """chat.db, opened in memory. Times count nanoseconds (older: seconds) from 2001; tapbacks are reactions; messages of a chat with one other go to that person."""
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    start = datetime(2001, 1, 1)
    members: dict[int, list[str]] = {}
    for chat, handle in con.execute("SELECT chat_id, id FROM chat_handle_join JOIN handle ON handle.ROWID = handle_id ORDER BY 1, 2"):
        members.setdefault(chat, []).append(handle)
    authors = dict(con.execute("SELECT message.guid, CASE WHEN is_from_me THEN 'self' ELSE handle.id END FROM message LEFT JOIN handle ON handle.ROWID = handle_id"))
    query = "SELECT message.guid, date, is_from_me, handle.id, text, chat_id, associated_message_guid, associated_message_type, item_type FROM message JOIN chat_message_join ON message_id = message.ROWID LEFT JOIN handle ON handle.ROWID = handle_id ORDER BY message.ROWID"
    for guid, date, mine, handle, text, chat, of, kind, item in con.execute(query):
        who = "self" if mine else handle
        if not who:
            continue
        t = start + (timedelta(microseconds=date / 1000) if date > 1e11 else timedelta(seconds=date)) if date else None
        row = {"key": f"imessage:{guid}", "t": t, "actor": f"imessage:{who}", "context": f"imessage:chat:{chat}"}
        if kind and 2000 <= kind < 3000:
            parent = re.sub(r"^(p:\d+/|bp:)", "", of or "")
            author = authors.get(parent)
            yield row | {"type": "reaction", "parent": f"imessage:{parent}", "targets": [{"node": f"imessage:{author}", "role": "subject"}] if author else []}
        elif not kind and not item:
            others = members.get(chat, [])
            to = (others if mine else ["self"]) if len(others) == 1 else []
            yield row | {"type": "message", "text": text, "targets": [{"node": f"imessage:{p}", "role": "dm"} for p in to]}
    con.close()


def imessage(spark: SparkSession, path: str) -> Dataset:
    records = base.parsed(spark, path, imessage_rows)
    phones = records.select(F.col("actor").alias("key")).distinct().select("key", F.map_filter(F.create_map(F.lit("phone"), words.phone(F.substring("key", 10, 100))), lambda _, v: v.isNotNull()).alias("attrs"))
    return base.assemble(records, phones, None, {"format": "imessage", "medium": "chat", "view": "ego"})
