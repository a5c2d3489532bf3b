"""Texts: cleaning, words, times, keywords, tone, spread of words, agreement."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kinweave.functions import text, times
from kinweave.model import Dataset
from kinweave.operators import content


def column(spark, rows, expression):
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, text string")
    return [r.x for r in table.withColumn("x", expression).orderBy("i").collect()]


def test_cleaned(spark):
    rows = [
        "one line", None, "> quoted only", "hello\n> old\nbye", "yes\nOn Tue, Ann wrote:\nold words", "yes\nOn Tue 4 Feb 2025 at 10:12, a very long name\n<x@y.z> wrote:\nold", "ok\nLe lundi, Ann a écrit :\nvieux",
        "a\n-----Original Message-----\nb", "a\nFrom: Ann\nSent: Monday\nSubject: x", "a\n-- \nAnn\nBoss", "a\nSent from my phone\nb", "We agreed\nOn time.\nfine", "a\r\nb", "x\n________\nFrom: y",
    ]
    got = column(spark, rows, text.cleaned("text"))
    assert [None if g is None else (g.text, g.quoted, g.signature) for g in got] == [
        ("one line", False, False), None, ("", True, False), ("hello\nbye", True, False), ("yes", True, False), ("yes", True, False), ("ok", True, False),
        ("a", True, False), ("a", True, False), ("a", False, True), ("a\nb", False, True), ("We agreed\nOn time.\nfine", False, False), ("a\nb", False, False), ("x", True, False),
    ]


def test_tokens(spark):
    rows = ["See https://a.b/c?d and www.x.y or mail ann.b@mail.com!", "<@U123> asked @ben_x: it's Ben's Ünïcode-word :tada: 2nd x", "don’t DONT -- 'quoted' a", None]
    assert column(spark, rows, text.tokens("text", text.english_stopwords())) == [["see", "mail"], ["asked", "ben", "ünïcode-word", "nd"], ["quoted"], None]
    assert column(spark, ["The cat's 😀 hat"], text.tokens("text")) == [["the", "cat", "hat"]]
    assert "won't" in text.english_stopwords() and "dont" in text.english_stopwords() and "they've" in text.english_stopwords()
    common = ["run", "try", "use", "big", "ask", "kind"]
    assert column(spark, ["running", "tries", "used", "biggest", "asked", "kindly", "novel", "s"], text.is_common(F.col("text"), common)) == [True, True, True, True, True, True, False, False]


def test_small_texts(spark):
    assert column(spark, ["Okafor, Ben", "  José  da Silva ", "O'Neil (Ann)"], F.array_join(text.name_tokens(F.col("text")), " ")) == ["ben okafor", "jose da silva", "o'neil ann"]
    assert column(spark, ["+44 (0)20 7946 0018", "0044 20 7946 0018", "020 7946 0018", "12", None], text.phone(F.col("text"))) == ["+442079460018", "+442079460018", "02079460018", None, None]
    assert column(spark, ["a &amp; b &lt;c&gt; &#233;&#x41; &amp;lt;"], text.entities_decoded(F.col("text"))) == ["a & b <c> éA &lt;"]
    assert column(spark, ["<p>One<br>two</p><script>x()</script><b>three</b>"], text.html_stripped(F.col("text"))) == ["One\ntwo\nthree"]
    assert column(spark, ["cafÃ©", "café", "plain", "日本"], text.mojibake_fixed(F.col("text"))) == ["café", "café", "plain", "日本"]
    assert column(spark, ["Héllo,  World!"], text.slug(F.col("text"))) == ["hello-world"]
    assert column(spark, ["x" * 300], F.length(text.clipped(F.col("text")))) == [280]


def test_times(spark):
    t = dt.datetime(2024, 2, 3, 14, 5, 6)
    cases = [("iso", "2024-02-03T14:05:06"), ("iso", "2024-02-03T16:05:06+02:00"), ("mdy", "2/3/2024 2:05:06 PM"), ("dmy", "03.02.24, 14:05:06"), ("seconds", "1706969106"), ("millis", "1706969106000"), ("excel", "45325.58687499")]
    for kind, value in cases:
        got = column(spark, [value, "nonsense"], times.to_time(F.col("text"), kind))
        assert abs((got[0] - t).total_seconds()) < 1 and got[1] is None, kind
    assert column(spark, ["Wed Oct 10 20:19:24 +0000 2018"], times.from_twitter(F.col("text"))) == [dt.datetime(2018, 10, 10, 20, 19, 24)]
    assert column(spark, ["1050118621198921728"], times.from_snowflake(F.col("text")))[0].date() == dt.date(2018, 10, 10)
    assert column(spark, ["2024-07-01T12:00:00"], times.in_zone(times.from_iso(F.col("text")), "Europe/Paris")) == [dt.datetime(2024, 7, 1, 10)]
    tell = lambda rows: times.detect(spark.createDataFrame([(r,) for r in rows], "x string"), "x")
    assert [tell(r) for r in (["2024-01-02"], ["1/2/24", "13/2/24"], ["1/2/24", "1/22/24"], ["1706969106"], ["1706969106000"], ["45325"], ["abc"], [])] == ["iso", "dmy", "mdy", "seconds", "millis", "excel", None, None]


def dataset(spark, rows):
    """rows: (actor, minute, text)"""
    start = dt.datetime(2024, 1, 1)
    data = [(i, a, start + dt.timedelta(minutes=m), t) for i, (a, m, t) in enumerate(rows)]
    nodes = spark.createDataFrame([(i, f"email:p{i}@acme.com", f"Person{i} Smith", i == 9, {"team": "x" if i < 3 else "y"}) for i in range(1, 10)], "node_id bigint, key string, label string, is_bot boolean, attrs map<string, string>")
    return Dataset.of(nodes, spark.createDataFrame(data, "event_id bigint, actor bigint, t timestamp_ntz, text string"))


def test_corpus_and_keywords(spark):
    rows = [(1, i, "Budget plans and budget forecasts for Smith\n> old stuff") for i in range(8)] + [(4, i, "kittens kittens photos of kittens") for i in range(8)] + [(2, 3, None), (9, 3, "budget")]
    ds = dataset(spark, rows)
    docs = content.corpus(ds)
    first = docs.where("event_id = 0").collect()[0]
    assert first.tokens == ["budget", "plans", "budget", "forecasts"] and first.quoted
    assert docs.count() == 16 and content.corpus(ds, exclude_bots=False).count() == 17
    got = {(r.unit, r.term): (r.n, round(r.score, 6), r.place) for r in content.keywords_of(content.unit(ds, docs, "group", "team")).collect()}
    assert got["x", "budget"] == (16, round(16 / 32 * (math.log(3 / 2) + 1), 6), 1)
    assert got["y", "kittens"] == (24, round(24 / 32 * (math.log(3 / 2) + 1), 6), 1)
    top = content.overall_terms(docs, 2).collect()
    assert [(r.term, r.n, r.messages) for r in top] == [("kittens", 24, 8), ("budget", 16, 8)]
    for by in ("all", "node", "context", "source", "visibility", "window"):
        assert "unit" in content.unit(ds, docs, by).columns


def test_tone(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("great", 3.1), ("bad", -2.5)], "word string, valence double")
    rows = ["This is good", "This is not good", "This is very good", "This is GOOD", "great!!!", "bad, bad day", "the table", "", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "event_id bigint, text string")
    got = {r.event_id: r for r in content.tone(table, lexicon).collect()}
    norm = lambda v: v / math.sqrt(v * v + 15)
    want = [1.9, 1.9 * -0.74, 1.9 + 0.293, 1.9 + 0.733, 3.1 + 3 * 0.292, -5.0, 0, 0]
    assert [round(got[i].compound, 6) for i in range(8)] == [round(norm(v), 6) for v in want] and 8 not in got
    assert all(r.pos + r.neg + r.neu == pytest.approx(1) or r.event_id == 7 for r in got.values())
    table = content.tone_by_unit(content.tone(table, lexicon).withColumn("unit", F.lit("u"))).collect()[0]
    assert table.n == 8 and table.pos_share == 0.5 and table.neg_share == 0.25


def test_diffusion(spark):
    """A word that walks along a line of friends, and one whose times are scattered."""
    start = dt.datetime(2024, 1, 1)
    line = [(i, i + 1) for i in range(1, 20)]
    pairs = spark.createDataFrame(line + [(b, a) for a, b in line], "u bigint, v bigint")
    order = [1, 11, 4, 17, 8, 20, 2, 14, 6, 12]
    uses = [("walks", i, start + dt.timedelta(days=i)) for i in range(1, 21)] + [("scattered", n, start + dt.timedelta(days=k)) for k, n in enumerate(order)]
    rows = {r.term: r for r in content.diffusion(spark.createDataFrame(uses, "term string, node bigint, t timestamp_ntz"), pairs, reps=60).collect()}
    walk, rest = rows["walks"], rows["scattered"]
    assert (walk.adopters, walk.eligible, walk.exposed, walk.roots, walk.depth, walk.largest) == (20, 19, 19, 1, 19, 20) and walk.p == pytest.approx(1 / 61) and walk.p_adjusted == pytest.approx(2 / 61)
    assert rest.roots >= 5 and rest.p > 0.1 and 0 < walk["mean"] < 1
    docs = spark.createDataFrame([(1, start, ["old"]), *[(i, start + dt.timedelta(days=5 + i), ["old", "novel", "running"]) for i in range(1, 8)]], "actor bigint, t timestamp_ntz, tokens array<string>")
    first = content.first_uses(docs)
    assert [r.term for r in content.new_terms(first, docs, ["run"]).collect()] == ["novel"]


def test_samples_and_agreement(spark):
    table = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else None) for i in range(100)], "event_id bigint, kind string")
    got = content.stratified(table, "kind", 20)
    assert {r.kind: r.n for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"a": 18, "b": 1, None: 1}
    assert content.thinned(table, 10).count() == 10 and content.thinned(table, 1000).count() == 100
    codes = [(1, "x", "p"), (1, "y", "p"), (2, "x", "p"), (2, "y", "q"), (3, "x", "q"), (3, "y", "q"), (4, "x", "q")]
    table = spark.createDataFrame(codes, "item bigint, coder string, code string")
    row = content.krippendorff(table).collect()[0]
    observed, expected = 2 / 6, 1 - (3 * 2 + 3 * 2) / (6 * 5)
    assert row["items"] == 3 and row.alpha == pytest.approx(1 - observed / expected)
    assert {r.code: r.agreement for r in content.agreement_by_code(table, "x", "y").collect()} == {"p": 0.5, "q": pytest.approx(1 / 3)}


def test_topics(spark):
    rows = [(i, ["cat", "dog", "pet", f"w{i}"] * 3 if i % 2 else ["tax", "budget", "audit", f"w{i}"] * 3) for i in range(80)]
    terms, shares = content.topics(spark.createDataFrame(rows, "event_id bigint, tokens array<string>"), k=2, rounds=20, most_df=0.6, top=3)
    words = {}
    for r in terms.collect():
        words.setdefault(r.topic, set()).add(r.term)
    assert {frozenset(w) for w in words.values()} == {frozenset(["cat", "dog", "pet"]), frozenset(["tax", "budget", "audit"])}
    assert shares.groupBy("event_id").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
