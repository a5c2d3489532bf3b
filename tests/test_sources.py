"""Readers on small exports, network files both ways."""

import datetime as dt
import json
import sqlite3

import pytest
from graphs import CLASS, CLUBS, MAJORS
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.operators import construct
from kinweave.sinks import networks as out
from kinweave.sources import base, mail, messages, networks, tabular

D = dt.datetime


def events(ds):
    """(type, time, actor, [(target, role)], parent) with keys for numbers."""
    names = {r.node_id: r.key for r in ds.nodes.collect()}
    keys = {r.event_id: r.key for r in ds.events.collect()}
    return sorted((r.type, r.t, names[r.actor], [(names[x.node], x.role) for x in r.targets], keys.get(r.parent)) for r in ds.events.collect())


def labels(ds):
    return {r.key: r.label for r in ds.nodes.collect()}


def test_event_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿From;To;When;Kind;Weight;Text\nann;ben, cai;01/02/2024 10:00;;2,5;"a;b"\nben;;02/02/2024;;1;x\ncai;ann;13/02/2024;mention;;\nann;ben;03/02/2024;likes;zz;\n', encoding="utf-8")
    table = tabular.read(spark, str(tmp_path / "t.csv"))
    assert table.columns == ["From", "To", "When", "Kind", "Weight", "Text"] and table.count() == 4
    ds = tabular.events(table, tabular.Mapping("From", "To", "When", "dmy", weight="Weight", type="Kind", text="Text", separator=","))
    got = events(ds)
    assert got == [("message", D(2024, 2, 1, 10), "csv:ann", [("csv:ben", "to"), ("csv:cai", "to")], None), ("message", D(2024, 2, 13), "csv:cai", [("csv:ann", "mention")], None)]
    assert {r.weight for r in ds.events.collect()} == {2.5, 1.0} and labels(ds)["csv:ben"] == "ben"
    assert tabular.unique(["a", "b", "a", ""]) == ["a", "b", "a_2", ""] and [tabular.sniff(x) for x in ("a,b", "a;b,c;d", "a\tb", '"a;b",c')] == [",", ";", "\t", ","]


def test_edge_node_and_incidence_tables(spark):
    rows = spark.createDataFrame([("a", "b", "2", "undirected"), ("b", "c", "0", "false"), ("c", "a", "", "no")], "s string, t string, w string, d string")
    ds = tabular.edges(rows, tabular.Mapping("s", "t", weight="w", directed="d", name="e"))
    assert [(e[0], e[2], e[3]) for e in events(ds)] == [("declared", "csv:a", [("csv:b", "declared")]), ("declared", "csv:c", [("csv:a", "declared")])]
    assert ds.sources.collect()[0].directed is False
    people = tabular.nodes(spark.createDataFrame([("a", "Ann", "x"), ("z", None, "")], "id string, label string, team string"), tabular.Mapping("id", label="label", attrs=("team",)))
    assert sorted(map(tuple, people.collect()), key=str) == [("csv:a", "Ann", {"team": "x"}), ("csv:z", "z", {})]
    grid = spark.createDataFrame([("ann", "x", "", "1"), ("ben", "no", "yes", "0"), ("cai", "", "", "")], "who string, chess string, choir string, drama string")
    two = tabular.incidence(grid, tabular.Mapping("who", events=("chess", "choir", "drama")))
    assert [(e[2], e[3][0][0]) for e in events(two)] == [("csv:ann", "csv:event:chess"), ("csv:ann", "csv:event:drama"), ("csv:ben", "csv:event:choir")]
    assert settings.default_settings(two).two_mode and two.nodes.count() == 6
    listed = tabular.affiliations(spark.createDataFrame([("ann", "chess; choir")], "a string, b string"), tabular.Mapping("a", "b"))
    assert len(events(listed)) == 2
    square = spark.createDataFrame([("a", "0", "1", "2"), ("b", "1", "0", ""), ("c", "2", "", "0")], "n string, a string, b string, c string")
    assert [(e[2], e[3][0][0]) for e in events(tabular.matrix(square, tabular.Mapping("n")))] == [("csv:a", "csv:b"), ("csv:a", "csv:c")]
    pasted = tabular.pasted(spark, "Ann -> Ben, 3\n# note\nBen - Cai\nCai, Dee 2\nZoe")
    got = {(e[2], e[3][0][0]) for e in events(pasted)}
    assert {("paste:Ann", "paste:Ben"), ("paste:Ben", "paste:Cai")} <= got and "paste:Zoe" in labels(pasted)


NET = [("a", "b", 1.0), ("b", "c", 2.5), ("c", "a", 1.0), ("c", "d", 4.0)]


def network_tables(spark, two=False):
    names = {"a": 'A "x" & <y>', "b": "Bé", "c": "c", "d": "d"}
    nodes = spark.createDataFrame([(n, x, 1.5 if n == "a" else None, int(n in "bd")) for n, x in names.items()], "node string, label string, score double, mode int")
    return (nodes if two else nodes.drop("mode")), spark.createDataFrame(NET, "src string, dst string, w double")


@pytest.mark.parametrize("kind", ["graphml", "gexf", "gml", "net", "dl"])
@pytest.mark.parametrize("directed", [True, False])
def test_network_files_both_ways(spark, tmp_path, kind, directed):
    nodes, ties = network_tables(spark)
    writer = {"graphml": out.graphml, "gexf": out.gexf, "gml": out.gml, "net": out.pajek, "dl": out.dl}[kind]
    path = str(tmp_path / f"n.{kind}")
    out.collected(writer(nodes, ties, directed=directed), path)
    ds = networks.read(spark, path)
    shown = {r.node: r.label if kind not in ("net", "dl") else r.label.replace('"', "'") for r in nodes.collect()}
    by = settings.default_settings(ds)
    names = {r.node_id: r.label for r in ds.nodes.collect()}
    got = {(names[r.src], names[r.dst]): r.w for r in construct.build(ds, by).ties.collect()}
    want = {(shown[a], shown[b]): w for a, b, w in NET}
    if kind == "dl":  # lists both directions of undirected ties, and doesn't say which kind it is
        assert want.items() <= got.items() and len(got) == (4 if directed else 8)
    else:
        assert by.directed == directed
        assert {frozenset(k): v for k, v in got.items()} == {frozenset(k): v for k, v in want.items()} and (not directed or got == want)
    # the written parts, joined in the order of their names, are the document
    out.write(writer(nodes, ties, directed=directed), str(tmp_path / "parts"), 3)
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "parts").glob("part-*")))
    assert text == (tmp_path / f"n.{kind}").read_text(encoding="utf-8")


def test_two_mode_files_and_matrices(spark, tmp_path):
    nodes, _ = network_tables(spark, two=True)
    ties = spark.createDataFrame([("a", "b", 1.0), ("c", "b", 2.0), ("c", "d", 1.0)], "src string, dst string, w double")
    out.collected(out.pajek(nodes, ties, False), str(tmp_path / "n.net"))
    assert (tmp_path / "n.net").read_text().splitlines()[0] == "*Vertices 4 2"
    assert settings.default_settings(networks.read(spark, str(tmp_path / "n.net"))).two_mode
    out.collected(out.dl(nodes, ties, "matrix"), str(tmp_path / "n.dl"))
    two = networks.read(spark, str(tmp_path / "n.dl"))
    assert len(events(two)) == 3 and settings.default_settings(two).two_mode
    out.collected(out.dl(nodes.drop("mode"), ties, "fullmatrix"), str(tmp_path / "m.dl"))
    assert len(events(networks.read(spark, str(tmp_path / "m.dl")))) == 3
    with pytest.raises(ValueError):
        out.dl(nodes.drop("mode"), ties, "fullmatrix", most_cells=3).count()


def test_csv_and_spells(spark, tmp_path):
    nodes, ties = network_tables(spark)
    out.collected(out.csv_nodes(nodes), str(tmp_path / "n.csv"))
    assert (tmp_path / "n.csv").read_text().splitlines()[:3] == ["Id,Label,score", 'a,"A ""x"" & <y>",1.5', "b,Bé,"]
    out.collected(out.csv_edges(ties.withColumn("evidence_to", F.lit(2.0))), str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_text().splitlines()[:3] == ["Source,Target,Type,Weight,evidence_to", "a,b,Directed,1,2", "b,c,Directed,2.5,2"]
    hidden = out.node_table(nodes.withColumn("attrs", F.create_map(F.lit("email"), F.lit("x@y.z"), F.lit("team"), F.lit("t"))), omit_contacts=True)
    assert "email" not in hidden.columns and "team" in hidden.columns and {r.label for r in hidden.collect()} == {"p1", "p2", "p3", "p4"}
    said = spark.createDataFrame([(1, D(2024, 1, 2), [(2, "to")]), (1, D(2024, 1, 1), [(2, "to"), (3, "cc")]), (1, None, [(2, "to")]), (1, D(2024, 1, 1), [(2, "cc")])], "actor bigint, t timestamp_ntz, targets array<struct<node: bigint, role: string>>")
    pair = spark.createDataFrame([(1, 2, 1.0)], "src bigint, dst bigint, w double")
    times = out.edge_times(said, pair)
    assert [(r.src, r.dst, r.times) for r in times.collect()] == [(1, 2, [D(2024, 1, 1), D(2024, 1, 2)])]
    out.collected(out.gexf(spark.createDataFrame([(1,), (2,)], "node bigint"), pair, True, times), str(tmp_path / "d.gexf"))
    text = (tmp_path / "d.gexf").read_text()
    assert text.count("<spell ") == 2 and 'mode="dynamic"' in text


def test_saved_dataset(spark, tmp_path):
    data = {
        "meta": {"sources": [{"format": "draw", "directed": False, "tieFields": [{"key": "kind"}]}]},
        "nodes": {"count": 3, "keys": ["n:a", "n:b", "n:c"], "labels": ["A", "B", "C"], "attrs": [{"age": 3, "ok": True}, {}, {}], "isBot": {"__ta": "Uint8Array", "d": [0, 0, 1]}, "platformIds": [{}, {}, {}]},
        "contexts": {"count": 1, "keys": ["c"], "names": ["C"], "kinds": ["canvas"], "visibility": {"__ta": "Uint8Array", "d": [1]}, "medium": ["chat"], "members": [None]},
        "events": {"count": 2, "type": {"__ta": "Uint8Array", "d": [2, 0]}, "t": {"__ta": "Float64Array", "d": [None, 86400000]}, "actor": {"d": [0, 1]}, "context": {"d": [0, -1]}, "parent": {"d": [-1, 0]}, "weight": {"d": [2, 1]}, "source": {"d": [0, 0]}, "tOff": {"d": [0, 1, 3]}, "tgt": {"d": [1, 0, 2]}, "role": {"d": [8, 0, 1]}, "text": [None, "hi"], "keys": [None, None], "attrs": [{"kind": ["x", "y"]}, None]},
    }
    (tmp_path / "d.json").write_text(json.dumps(data))
    ds = networks.saved(spark, str(tmp_path / "d.json"))
    rows = {r.event_id: r for r in ds.events.collect()}
    assert rows[0].type == "declared" and rows[0].attrs == {"kind": ["x", "y"]} and rows[1].t == D(1970, 1, 2) and [(x.node, x.role) for x in rows[1].targets] == [(0, "to"), (2, "cc")] and rows[1].parent == 0
    assert ds.nodes.where("node_id = 0").collect()[0].attrs == {"age": "3", "ok": "true"} and ds.sources.collect()[0].directed is False


def test_slack(spark, tmp_path):
    (tmp_path / "general").mkdir()
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x))
    put("users.json", [{"id": "U1", "name": "ann", "profile": {"real_name": "Ann B", "email": "ANN@x.y"}}, {"id": "U2", "name": "ben"}, {"id": "B1", "name": "bot", "is_bot": True}])
    put("channels.json", [{"id": "C1", "name": "general", "members": ["U1", "U2"]}])
    put("general/2024-01-01.json", [
        {"type": "message", "user": "U1", "text": "hi <@U2>", "ts": "1704103200.000100", "reactions": [{"name": "ok", "users": ["U2"], "count": 1}]},
        {"type": "message", "user": "U2", "text": "yes", "ts": "1704103260.000200", "thread_ts": "1704103200.000100", "parent_user_id": "U1"},
        {"type": "message", "subtype": "channel_join", "user": "U2", "ts": "1704103100.000000", "text": "joined"},
        {"type": "message", "subtype": "bot_message", "bot_id": "B1", "text": "beep", "ts": "1704103300.0"},
    ])
    ds = messages.slack(spark, str(tmp_path))
    got = events(ds)
    assert [(e[0], e[2], e[3], e[4]) for e in got] == [
        ("join", "slack:U2", [], None), ("message", "slack:U1", [("slack:U2", "mention")], None), ("message", "slack:U2", [("slack:U1", "reply")], "slack:C1:1704103200.000100"), ("message", "slack:B1", [], None),
        ("reaction", "slack:U2", [("slack:U1", "subject")], "slack:C1:1704103200.000100"),
    ]
    assert labels(ds)["slack:U1"] == "Ann B" and got[1][1] == D(2024, 1, 1, 10, 0, 0, 100)
    assert {(r.key, r.visibility) for r in ds.contexts.collect()} == {("slack:C1", "public")} and [r.key for r in ds.nodes.where("is_bot").collect()] == ["slack:B1"]


def test_whatsapp(spark, tmp_path):
    (tmp_path / "WhatsApp Chat with Team.txt").write_text("[13/01/24, 14:05:06] Ann: hello @Ben\nmore\n[13/01/24, 14:06:00] Ben: yes\n[14/01/24, 09:00:00] Cai joined using a link\n14/01/24, 9:01 PM - Cai: hi\n", encoding="utf-8")
    ds = messages.whatsapp(spark, str(tmp_path))
    assert events(ds) == [
        ("join", D(2024, 1, 14, 9), "whatsapp_name:Cai", [], None), ("message", D(2024, 1, 13, 14, 5, 6), "whatsapp_name:Ann", [("whatsapp_name:Ben", "mention")], None),
        ("message", D(2024, 1, 13, 14, 6), "whatsapp_name:Ben", [], None), ("message", D(2024, 1, 14, 21, 1), "whatsapp_name:Cai", [], None),
    ]
    assert [r.text for r in ds.events.where("text LIKE 'hello%'").collect()] == ["hello @Ben\nmore"]
    assert messages.day_first([(1, 2), (1, 3), (1, 4)]) is False and messages.day_first([(28, 1)]) and messages.day_first([(1, 2), (2, 2), (3, 2), (4, 2)])


def test_chats_in_json(spark, tmp_path):
    tg = {"name": "G", "type": "private_group", "id": 5, "messages": [
        {"id": 1, "type": "message", "date_unixtime": "1704103200", "from": "Ann", "from_id": "user1", "text_entities": [{"type": "plain", "text": "hi"}], "reactions": [{"emoji": "ok", "recent": [{"from_id": "user2"}]}]},
        {"id": 2, "type": "message", "date_unixtime": "1704103260", "from": "Ben", "from_id": "user2", "reply_to_message_id": 1, "text_entities": []},
        {"id": 3, "type": "service", "action": "join_group_by_link", "date_unixtime": "1704103100", "actor": "Cai", "actor_id": "user3"}]}
    (tmp_path / "result.json").write_text(json.dumps(tg))
    ds = messages.telegram(spark, str(tmp_path / "result.json"))
    assert [(e[0], e[2], e[3]) for e in events(ds)] == [("join", "telegram:user3", []), ("message", "telegram:user1", []), ("message", "telegram:user2", [("telegram:user1", "reply")]), ("reaction", "telegram:user2", [("telegram:user1", "subject")])]
    (tmp_path / "m").mkdir()
    inbox = {"participants": [{"name": "Ann"}, {"name": "JosÃ©"}], "title": "JosÃ©", "thread_path": "inbox/x", "messages": [{"sender_name": "JosÃ©", "timestamp_ms": 1704103200000, "content": "hÃ©", "reactions": [{"reaction": "ok", "actor": "Ann"}]}, {"sender_name": "Ann", "timestamp_ms": 1704103260000, "call_duration": 5}]}
    (tmp_path / "m" / "message_1.json").write_text(json.dumps(inbox))
    ds = messages.meta(spark, str(tmp_path / "m"))
    assert [(e[0], e[2], e[3]) for e in events(ds)] == [("copresence", "meta:Ann", [("meta:José", "attendee")]), ("message", "meta:José", [("meta:Ann", "dm")]), ("reaction", "meta:Ann", [("meta:José", "subject")])]
    dc = {"guild": {"id": "9"}, "channel": {"id": "7", "type": "GuildTextChat", "name": "g"}, "messages": [
        {"id": "111111111111111111", "type": "Default", "timestamp": "2024-01-01T10:00:00+00:00", "content": "x", "author": {"id": "1", "name": "ann", "isBot": False}, "mentions": [{"id": "2", "name": "ben"}], "reactions": [{"emoji": {"name": "ok"}, "users": [{"id": "2", "name": "ben"}]}]},
        {"id": "111111111111111112", "type": "Reply", "timestamp": "2024-01-01T12:00:00+02:00", "content": "y", "author": {"id": "2", "name": "ben"}, "reference": {"messageId": "111111111111111111"}}]}
    (tmp_path / "d.json").write_text(json.dumps(dc))
    ds = messages.discord(spark, str(tmp_path / "d.json"))
    got = events(ds)
    assert [(e[0], e[1], e[2], e[3], e[4]) for e in got if e[0] == "message"] == [("message", D(2024, 1, 1, 10), "discord:1", [("discord:2", "mention")], None), ("message", D(2024, 1, 1, 10), "discord:2", [("discord:1", "reply")], "discord:message:111111111111111111")]


def test_social(spark, tmp_path):
    lines = [{"id": "a1", "name": "t3_a1", "author": "ann", "created_utc": 1704103200, "subreddit": "s", "title": "T", "selftext": ""}, {"id": "b1", "author": "ben", "created_utc": 1704103260, "subreddit": "s", "parent_id": "t3_a1", "body": "see u/cai"}, {"id": "b2", "author": "[deleted]", "created_utc": 1, "subreddit": "s", "parent_id": "t3_a1", "body": "x"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = events(messages.reddit(spark, str(tmp_path / "r.jsonl")))
    assert [(e[2], e[3], e[4]) for e in got] == [("reddit:ann", [], None), ("reddit:ben", [("reddit:ann", "reply"), ("reddit:cai", "mention")], "reddit:item:t3_a1")]
    lines = [{"id": "10", "author_id": "1", "created_at": "2024-01-01T10:00:00.000Z", "text": "x", "entities": {"mentions": [{"id": "3", "username": "cai"}]}}, {"id": "11", "author_id": "2", "created_at": "2024-01-01T11:00:00.000Z", "referenced_tweets": [{"type": "retweeted", "id": "10"}]}, {"id": "12", "author_id": "3", "in_reply_to_user_id": "1", "referenced_tweets": [{"type": "replied_to", "id": "10"}], "entities": {"mentions": [{"id": "1", "username": "ann"}]}, "created_at": "2024-01-01T12:00:00Z"}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = events(messages.x_research(spark, str(tmp_path / "x.jsonl")))
    assert [(e[0], e[2], e[3]) for e in got] == [("message", "x:1", [("x:3", "mention")]), ("message", "x:3", [("x:1", "reply")]), ("repost", "x:2", [("x:1", "subject")])]
    box = tmp_path / "arch"
    box.mkdir()
    (box / "tweets.js").write_text('window.YTD.tweets.part0 = [{"tweet": {"id_str": "5", "full_text": "hi @b", "created_at": "Mon Jan 01 10:00:00 +0000 2024", "entities": {"user_mentions": [{"id_str": "22"}]}}}, {"tweet": {"id_str": "6", "full_text": "RT @c: x", "created_at": "Mon Jan 01 11:00:00 +0000 2024", "entities": {"user_mentions": [{"id_str": "33"}]}}}]')
    (box / "following.js").write_text('window.YTD.following.part0 = [{"following": {"accountId": "44"}}]')
    got = events(messages.x_archive(spark, str(box)))
    assert [(e[0], e[2], e[3]) for e in got if e[0] != "follow"] == [("message", "x:self", [("x:22", "mention")]), ("repost", "x:self", [("x:33", "subject")])] and sum(e[0] == "follow" for e in got) == 1
    arch = tmp_path / "m"
    arch.mkdir()
    me = "https://a.social/users/ann"
    (arch / "outbox.json").write_text(json.dumps({"orderedItems": [{"id": "1", "type": "Create", "actor": me, "published": "2024-01-01T10:00:00Z", "object": {"id": "n1", "content": "<p>hey</p>", "published": "2024-01-01T10:00:00Z", "inReplyTo": "https://b.social/users/ben/statuses/9", "tag": [{"type": "Mention", "href": "https://c.social/users/cai"}]}}, {"id": "2", "type": "Announce", "actor": me, "published": "2024-01-02T10:00:00Z", "object": "https://b.social/users/ben/statuses/9"}]}))
    got = events(messages.mastodon(spark, str(arch)))
    assert [(e[0], e[3]) for e in got] == [("message", [("mastodon:https://b.social/users/ben", "reply"), ("mastodon:https://c.social/users/cai", "mention")]), ("repost", [("mastodon:https://b.social/users/ben", "subject")])]
    ln = tmp_path / "ln"
    ln.mkdir()
    (ln / "Connections.csv").write_text('Notes:\n"When exporting your data, some are missing."\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\nBen,Okafor,https://www.linkedin.com/in/ben-o,,Acme,"Lead, Ops",05 Jan 2024\n')
    (ln / "messages.csv").write_text("CONVERSATION ID,FROM,SENDER PROFILE URL,RECIPIENT PROFILE URLS,DATE,CONTENT\nc1,Ann,https://www.linkedin.com/in/ann,https://www.linkedin.com/in/ben-o,2024-01-06 10:00:00 UTC,hi\n")
    ds = messages.linkedin(spark, str(ln), "ann")
    assert [(e[0], e[1], e[2], e[3]) for e in events(ds)] == [("declared", D(2024, 1, 5), "linkedin:ann", [("linkedin:ben-o", "declared")]), ("message", D(2024, 1, 6, 10), "linkedin:ann", [("linkedin:ben-o", "dm")])]
    assert labels(ds)["linkedin:ben-o"] == "Ben Okafor"


def test_imessage(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "chat.db")
    con.executescript("""CREATE TABLE handle(id TEXT); CREATE TABLE message(guid TEXT, date INTEGER, is_from_me INTEGER, handle_id INTEGER, text TEXT, associated_message_guid TEXT, associated_message_type INTEGER, item_type INTEGER);
        CREATE TABLE chat_message_join(chat_id INTEGER, message_id INTEGER); CREATE TABLE chat_handle_join(chat_id INTEGER, handle_id INTEGER);
        INSERT INTO handle VALUES('+15550001111'); INSERT INTO chat_handle_join VALUES(1, 1);
        INSERT INTO message VALUES('g1', 725796000000000000, 1, 0, 'hi', NULL, 0, 0), ('g2', 725796060000000000, 0, 1, 'yo', NULL, 0, 0), ('g3', 725796120000000000, 0, 1, NULL, 'p:0/g1', 2000, 0);
        INSERT INTO chat_message_join VALUES(1, 1), (1, 2), (1, 3);""")
    con.commit()
    con.close()
    got = events(messages.imessage(spark, str(tmp_path / "chat.db")))
    other = "imessage:+15550001111"
    assert [(e[0], e[2], e[3]) for e in got] == [("message", "imessage:self", [(other, "dm")]), ("message", other, [("imessage:self", "dm")]), ("reaction", other, [("imessage:self", "subject")])]


def test_mail_and_calendar(spark, tmp_path):
    box = "From x\nFrom: Ann B <ANN@x.y>\nTo: ben@x.y, Cai <cai@x.y>\nCc: dee@x.y\nDate: Mon, 1 Jan 2024 12:00:00 +0200\nMessage-ID: <m1@x>\nSubject: s\n\nhello\n>From here\n\nFrom y\nFrom: ben@x.y\nTo: ann@x.y\nDate: Mon, 1 Jan 2024 11:00:00 +0000\nMessage-ID: <m2@x>\nIn-Reply-To: <m1@x>\nReferences: <m1@x>\n\nok\n"
    (tmp_path / "a.mbox").write_text(box)
    ds = mail.mail(spark, str(tmp_path), "*.mbox")
    assert events(ds) == [
        ("message", D(2024, 1, 1, 10), "email:ann@x.y", [("email:ben@x.y", "to"), ("email:cai@x.y", "to"), ("email:dee@x.y", "cc")], None),
        ("message", D(2024, 1, 1, 11), "email:ben@x.y", [("email:ann@x.y", "to")], "email:m1@x"),
    ]
    assert labels(ds)["email:ann@x.y"] == "Ann B" and ds.contexts.count() == 1
    # the reply is addressed, so its parent says that it is a reply
    ties = {(r.rule) for r in construct.evidence(ds, settings.default_settings(ds)).collect()}
    assert ties == {"to", "cc", "reply"}
    ics = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:e1\nDTSTART:20240101T100000Z\nRRULE:FREQ=WEEKLY;COUNT=4;BYDAY=MO,WE\nEXDATE:20240103T100000Z\nSUMMARY:Sync\nORGANIZER;CN=Ann:mailto:ann@x.y\nATTENDEE;CN=Ben:mailto:ben@x\n .y\nATTENDEE;PARTSTAT=DECLINED:mailto:no@x.y\nEND:VEVENT\nBEGIN:VEVENT\nUID:e2\nSTATUS:CANCELLED\nDTSTART:20240101T100000Z\nORGANIZER:mailto:ann@x.y\nEND:VEVENT\nEND:VCALENDAR\n"
    (tmp_path / "c.ics").write_text(ics)
    got = events(mail.calendar(spark, str(tmp_path)))
    assert [(e[0], e[1], e[3]) for e in got] == [("copresence", D(2024, 1, d, 10), [("email:ben@x.y", "attendee")]) for d in (1, 8, 10)]
    assert len(mail.occurrences(D(2024, 1, 31), "FREQ=MONTHLY;COUNT=3")) == 3 and mail.occurrences(D(2024, 1, 31), "FREQ=MONTHLY;COUNT=3")[1] == D(2024, 3, 31)


def test_numbers_of_keys(spark):
    table = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string").select(base.number("k").alias("n")).collect()
    assert table[0].n == table[1].n >= 0 and table[2].n is None and table[3].n != table[0].n
    assert len(CLASS) == 18 and len(MAJORS) == 13 and len(CLUBS) == 10
