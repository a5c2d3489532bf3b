"""Fingerprints of unspaced texts after small edits."""

import random

import pytest

from kinweave.llm import fingerprints


@pytest.mark.parametrize("letters", [[chr(c) for c in range(0x4E00, 0x9000)], list("ABCDEFGHabcdefgh0123456789+/"), [chr(c) for c in range(0x20000, 0x22000)]], ids=["cjk", "encoded", "beyond_bmp"])
def test_insertion_into_unspaced_text(spark, letters):
    rng = random.Random(1)
    text = "".join(rng.choices(letters, k=3000))
    other = "".join(rng.choices(letters, k=3000))
    rows = [("front", text, letters[0] + text), ("middle", text, text[:1501] + letters[0] + text[1501:]), ("removed", text, text[1:]), ("other", text, other)]
    made = spark.createDataFrame(rows, "edit string, a string, b string").select("edit", fingerprints.signature("a").alias("x"), fingerprints.signature("b").alias("y"))
    likeness = {r.edit: r.likeness for r in made.select("edit", fingerprints.likeness("x", "y").alias("likeness")).collect()}
    assert likeness["front"] > 0.8 and likeness["middle"] > 0.5 and likeness["removed"] > 0.8 and likeness["other"] < 0.1


def test_kmers_of_words_and_runs(spark):
    kmers = rf"regexp_extract_all(text, r'(?=({fingerprints.UNIT}\s*{fingerprints.UNIT})){fingerprints.STEP}', 1)"
    texts = ["one two  three", "abcdefghijklmn op", "abcdefghijkl m"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr(kmers).collect()]
    assert found == [["one two", "two  three", "three"], ["abcdefghijklmn", "bcdefghijklmn", "cdefghijklmn op", "op"], ["abcdefghijkl m"]]


def brute_signature(spark, text):
    """Order MinHash from its definition: the two occurrence-numbered k-mers of smallest hash in each bin, in text order, as a tuple."""
    import re

    unit, found, at = fingerprints.UNIT, [], 0
    step = re.compile(fingerprints.STEP.replace("}+(", "}(?:)("))  # python's own possessive form differs only in name
    for m in re.finditer(rf"(?=({unit}\s*{unit}))", text):
        if m.start() >= at:
            moved = step.match(text, m.start())
            found.append(m[1])
            at = moved.end()
    found = found or [text]
    bits, out = fingerprints.HASH_BITS, {}
    hashed = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(found)], "i int, s string").orderBy("i").selectExpr(f"pmod(xxhash64(s), {1 << bits}L)").collect()]
    seen = {}
    entries = []
    for i, h in enumerate(hashed):
        entries.append((h, seen.get(h, 0), i))
        seen[h] = seen.get(h, 0) + 1
    keyed = [r[0] for r in spark.createDataFrame([(n, h, o) for n, (h, o, _) in enumerate(entries)], "n int, h bigint, o int").orderBy("n").selectExpr("xxhash64(h, o)").collect()]
    bins = {}
    for (h, _, i), k in zip(entries, keyed):
        bins.setdefault(h >> (bits - fingerprints.BINS_LOG2), []).append((k, i))
    rows = []
    for b, members in sorted(bins.items()):
        chosen = sorted(members)[:2]
        rows.append((b, *[k for k, _ in sorted(chosen, key=lambda x: x[1])]))
    shift = 32 - fingerprints.BINS_LOG2
    for b, *ks in rows:
        expr = f"pmod(xxhash64({', '.join(f'{k}L' if k > -(1 << 63) else 'cast(-9223372036854775808 AS bigint)' for k in ks)}), {1 << shift}L)"
        value = (b << shift) + spark.range(1).selectExpr(expr).collect()[0][0]
        out[b] = value - (1 << 32) if value >= 1 << 31 else value
    return [out[b] for b in sorted(out)]


@pytest.mark.parametrize("text", ["", "one", "a b a b a b c a b", "the cat sat on the mat and the dog sat on the cat " * 3, "abcdefghijklmnopqrstuvwxyz0123456789 tail"])
def test_signature_equals_its_definition(spark, text):
    ours = spark.createDataFrame([(text,)], "t string").select(fingerprints.signature("t").alias("x")).collect()[0].x
    assert ours == brute_signature(spark, text)


def test_rows_that_repeat_or_lack_an_id(spark):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "other text here"), (None, "no id at all"), (2, None), (3, "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 AS key", "'x' AS marks", "1 AS next_key")
    got = fingerprints.with_edited(docs).collect()
    assert len(got) == len(rows)
    assert len({(r.edited_sha256, r.fingerprint) for r in got if r.doc_id == 1 and r.n_chars == 16}) == 1
    # each document's edited text ends with the head of the one that follows it
    order = sorted({(r[0] is not None, r[0] or 0) for r in rows})
    assert order[0] == (False, 0) and {r.n_chars for r in got} == {16, 15, 12, 0, 300_000}
