"""Removal of lines against brute force and, at its least length, against the SQL."""

import hashlib
import random
from collections import defaultdict

import duckdb

from kinweave.llm import _common, line_dedup

SF = "/root/testdata/sf0.001"


def brute(rows):
    sites = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip():
                sites[line.strip(" ")].add(source or "")
    common = {line for line, on in sites.items() if len(on) >= line_dedup.MIN_SITES}
    out = {}
    for i, text, _ in rows:
        split = None if text is None else text.split("\n")
        kept = [x for x in split or [] if x.strip(" ") not in common]
        out[i] = (None if text is None else "\n".join(kept), len(split or []), len(split or []) - len(kept))
    return out


def test_short_lines_are_removed_like_long_ones(spark):
    rng = random.Random(7)
    hot = ["Les.", "Read more", "x", "  Log in ", "A line of more than sixteen characters", "", "   ", "\t", "\r"]
    rows = [(i, "\n".join(rng.choices(hot, k=5) + [f"own {i}", f"{i % 3}"]), None if i % 9 == 0 else f"s{i % 9}") for i in range(90)]
    rows += [(90, None, "s1"), (91, "", "s1"), (92, "five\nfew", "s1"), (93, "five", "s2"), (94, "five", "s3"), (95, "five", "s4"), (96, "five", "s5")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: (r.clean_text, r.n_lines, r.n_removed) for r in line_dedup.remove_boilerplate(table).collect()}
    assert found == brute(rows)
    assert found[92][0] == "five\nfew" and "\t" in "".join(t or "" for t, _, _ in found.values())
    assert not any("Les." in (t or "") for t, _, _ in found.values())


def test_least_length_of_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = {r[0]: tuple(r[1:]) for r in con.execute(line_dedup.OP3_SQL).fetchall()}
    rows = line_dedup.remove_boilerplate(_common.documents(spark, SF), min_chars=line_dedup.MIN_CHARS).collect()
    ours = {r.doc_id: (r.n_lines, r.n_removed, len(r.clean_text), hashlib.sha256(r.clean_text.encode()).hexdigest()) for r in rows if r.clean_text is not None}
    assert ours == {i: t for i, t in theirs.items() if i in ours} and ours


def test_edges_of_line_removal(spark):
    """Empty tables, null sites and texts, repeated rows, other columns with clashing names."""
    rows = [(i, "common line\nown", f"s{i}" if i else None) for i in range(8)] + [(3, "common line\nown", "s3"), (None, "common line", "s1"), (9, None, None), (10, "", "s2"), (11, "x " * 50_000 + "\ncommon line", "s9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS line", "2 AS line_hash", "3 AS row", "4 AS removed", "5 AS site")
    got = line_dedup.remove_boilerplate(docs).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) == 20
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.clean_text, r.n_lines, r.n_removed))
    assert by[9] == [(None, 0, 0)] and by[10] == [("", 1, 0)] and by[3] == [("", 2, 2)] * 2 and by[None] == [("", 1, 1)] and by[11][0][2] == 1
    assert line_dedup.remove_boilerplate(docs.where("false")).count() == 0


def test_sql_of_a_table(spark):
    """The query against its SQL, whole."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    theirs = sorted(con.execute("SELECT doc_id, n_lines, n_removed, clean_chars, clean_sha256 FROM (" + line_dedup.OP3_SQL + ")").fetchall())
    ours = sorted(tuple(r) for r in line_dedup.op3_line_dedup(spark, "/root/testdata/sf0.01").select("doc_id", "n_lines", "n_removed", "clean_chars", "clean_sha256").collect())
    assert ours == theirs
