"""Exact and near dedup against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinweave.llm import exact_dedup, near_dedup

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "x") for i, t in enumerate(texts)], SCHEMA)


def brute_components(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def near_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", "  \t", "One", "one", "a b c", "A b\tc", "a b c d", "x " * 3000]
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.choice([6, 40, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_brute_force(spark, seed):
    texts = near_texts(seed)
    rows = near_dedup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute_components(texts)


def test_sketches_lose_no_link(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    one, other, a, b = [], [], [], []
    for n in [1, 2, 3, 7, 20, 100, 700, 5000] * 25:
        shared = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        extra = rng.integers(0, 1 << 63, n // 3, np.uint64)
        x, y = np.unique(np.concatenate([shared, extra[::2]])), np.unique(np.concatenate([shared, extra[1::2]]))
        one.append(near_dedup.fine_sketch(x)), other.append(near_dedup.fine_sketch(y)), a.append(len(x)), b.append(len(y))
    assert near_dedup.may_be_linked(np.array(one), np.array(other), np.array(a), np.array(b), 75).all()


def copies_at_the_threshold(n, words=400, replaced=7, seed=11):
    """Copies of one text, which is absent, with words replaced: most pairs lie just below a link, some above."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(words), replaced):
            copy[at] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    return texts


def pairs_made(spark, texts):
    """Rows that leave the blocks of round two, and the result."""
    made = []
    inner = near_dedup.across_components

    def counted(*args):
        out = inner(*args).persist()
        made.append(out.count())
        return out

    near_dedup.across_components = counted
    try:
        return near_dedup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect(), made[0]
    finally:
        near_dedup.across_components = inner


def test_large_group_near_the_threshold(spark):
    """Exact components, and rows between the rounds that grow with the group, not with its square."""
    made = {}
    for n in (200, 800):
        texts = copies_at_the_threshold(n)
        rows, made[n] = pairs_made(spark, texts)
        if n == 200:
            assert [tuple(r) for r in rows] == brute_components(texts)
    assert all(made[n] <= 4 * n for n in made)  # all pairs are 19,900 and 319,600


def test_large_sets_near_the_threshold(spark):
    """Sets that go into blocks as sketches."""
    texts = copies_at_the_threshold(40, words=1200, replaced=22) + copies_at_the_threshold(20, words=520, replaced=9, seed=5)
    assert any(len(near_dedup.shingle_set(t)) > near_dedup.WHOLE for t in texts)
    rows = near_dedup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute_components(texts)


def test_repeated_and_missing_ids(spark):
    """An id may stand for several texts, or be missing; links of each text count."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    rows = [(5, a), (5, b), (1, near(b)), (2, near(a)), (None, c), (None, near(c)), (3, "alone"), (None, None), (3, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__id__", F.lit("clash"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == sorted([("5", 56, "2", False), ("5", 56, "1", False), ("1", 57, "1", True), ("2", 57, "2", True), ("None", 56, "None", True), ("None", 57, "None", True), ("3", 1, "3", True), ("None", 0, "None", True), ("3", 1, "3", True)])
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "3", "None", "None", "None"]


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups_equal_brute_force(spark, bits):
    rng = random.Random(5)
    texts = [None, "", " ", "\t\n", "a  b", "a b", "a\x0bb", "ab", "x" * 10_000, "x" * 10_000, "x" * 9_999] + [" ".join(rng.choices(["bad", "cold", "tend,", "dim"], k=rng.randint(1, 6))) for _ in range(60)]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    rows = exact_dedup.exact_groups(table(spark, texts), bits).orderBy("doc_id").collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows] == [(i, norm.index(t), norm.count(t), norm.index(t) == i) for i, t in enumerate(norm)]


def test_chunks_follow_content_in_any_script(spark):
    """After an insertion at the front most chunks are the same again."""
    rng = random.Random(9)
    scripts = {"latin": ("abcdefghijklmnopqrst", " "), "cyrillic": ("абвгдежзийклмнопрст", " "), "han": ("的一是不了人我在有他这中大来上国" * 4 + "。", "")}
    rows = []
    for name, (letters, space) in scripts.items():
        text = space.join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(4000))
        rows += [(name, text), (name, letters[0] + text)]
    cut = exact_dedup.chunked(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    for name in scripts:
        one, other = (set(r.chunks) for r in cut if r.id == name)
        assert len(one) > 20 and len(one & other) >= len(one) - 2, name
    assert all("".join(r.chunks) in (t for _, t in rows) for r in cut)


def test_repeated_rows_and_clashing_names(spark):
    rows = [(2, "a  b", "p"), (1, "a b", "q"), (1, "a b", "r"), (3, None, "s"), (None, "x", "t"), (7, "x", "u"), (4, "", "v"), (1, "c", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __row__ string").withColumn("id", F.lit(0)).withColumn("H", F.lit(1))
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert got == [("1", "a b"), ("1", "c"), ("3", "None"), ("7", "x")]


def test_empty_and_extra_columns(spark):
    empty = table(spark, ["a"]).where("doc_id < 0")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0
    docs = table(spark, ["a b", "a  b", None])
    assert exact_dedup.keep_first(docs).columns == docs.columns
    assert {r.doc_id for r in exact_dedup.keep_first(docs).collect()} == {0, 2}
    assert near_dedup.keep_representatives(docs).where(F.col("kept") == "x").count() == 2


def test_members_of_a_bucket_move_once(spark, monkeypatch):
    """Rows that are dealt to round two grow with a group, however many blocks it makes; blocks and bytes in a file give the same components."""
    dealt = {}
    inner = near_dedup._common.mapped

    def counted(df, run, schema, *args, **kwargs):
        if "sure" in str(schema):
            dealt[len(dealt)] = (df.count(), df.select("key", "cls").distinct().count())
        return inner(df, run, schema, *args, **kwargs)

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "HELD", 20_000)
    monkeypatch.setattr(near_dedup._common, "mapped", counted)
    texts = copies_at_the_threshold(120)
    rows = near_dedup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute_components(texts)
    assert dealt[0][0] == dealt[0][1] > 120
