import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import exact_blocks as E

SCHEMA = "doc_id long, text string"
ROWS = [
    (1, "ab cd ef gh ij"), (2, "abcdefghij"), (3, "ab\ncd\tef\x0bgh\x0cij\r"), (4, "abcdefghijk"), (5, None), (6, ""),
    (7, " \n"), (None, "abcdefghij"), (8, "ééé日本語"), (9, "é é é 日本 語"), (10, "abcdabcdabcd"), (11, "abcd"),
    (11, "abcd"), (12, "abcdabcd"), (13, "x" * 1000), (14, "x" * 1001), (15, " x" * 1000), (16, "dcba"), (17, "abce"),
]


def expected(rows):
    groups = {}
    for k, t in rows:
        normal = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(normal, []).append((-len(t or ""), k is None, k or 0, k))
    out = []
    for k, t in rows:
        normal = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[normal])
        out.append((k, best[3], len(groups[normal]), (k, -len(t or "")) == (best[3], best[0]),
                    hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 4, 7, 4096])
def test_groups(spark, size):
    got = E.exact_groups(spark.createDataFrame(ROWS, SCHEMA), block_bytes=size).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


@pytest.mark.parametrize("weak", [F.length, lambda c: F.lit(1), lambda c: F.length(c) % 2])
def test_shared_fingerprints_do_no_harm(spark, weak):
    got = E.exact_groups(spark.createDataFrame(ROWS, SCHEMA), block_bytes=4, fingerprint=lambda c: weak(c).cast("long"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_a_group_with_a_third_of_all_rows(spark):
    rows = [(k, "same text " * 20 if k % 3 == 0 else f"text {k} " * 20) for k in range(600)]
    got = E.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), block_bytes=16).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_dropping_keeps_columns_and_one_row_each(spark):
    docs = spark.createDataFrame([(k, t, "v", 1) for k, t in ROWS], SCHEMA + ", kept string, group_size int")
    left = E.drop_exact(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    keep = {(x[0], x[4]) for x in expected(ROWS) if x[3]}
    assert len(rows) == len(keep) and all(r["kept"] == "v" for r in rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.exact_groups(empty).count() == 0 and E.drop_exact(empty).count() == 0


def test_one_row_stays_where_only_white_space_differs(spark):
    rows = [(1, "a bc"), (1, "ab c"), (1, "ab c"), (2, "abc"), (3, "x")]
    left = E.drop_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"].replace(" ", "")) for r in left) == [(1, "abc"), (3, "x")]
