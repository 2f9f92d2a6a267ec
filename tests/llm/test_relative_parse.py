import hashlib
import random

import pytest

from ebbtide.llm import relative_parse as R

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    texts = [(t or "").split() for _, t in rows]
    times = {}
    for w in texts:
        for i in range(len(w) - window + 1):
            times[tuple(w[i : i + window])] = times.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for (k, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        edges = [i + d for i in range(len(w)) for d in (0, 1) if i in gone and i - 1 + 2 * d not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), edges))
    return sorted(out, key=str)


def make(seed, n, words):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(words)}"
    passage = [word() for _ in range(90)]
    rows = []
    for k in range(n):
        text = [word() for _ in range(rnd.randrange(0, 160))]
        if k % 3 == 0:
            a = rnd.randrange(0, 50)
            text[10:10] = passage[a : a + rnd.randrange(20, 60)]
        if k % 7 == 0:
            text += text[-40:]
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,words,window,anchor", [(1, 5000, 35, 8), (2, 3, 35, 8), (3, 2, 9, 4), (4, 400, 12, 3)])
def test_against_all_windows(spark, seed, words, window, anchor):
    rows = make(seed, 120, words)
    got = R.remove_repeated(spark.createDataFrame(rows, SCHEMA), window=window, anchor=anchor).collect()
    assert sorted([(*r[:4], list(r[4])) for r in got], key=str) == brute(rows, window)


def test_odd_rows(spark):
    w = " ".join(f"a{k}" for k in range(35))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, w), (4, w), (5, w + " x\x0by\x0c"), (None, "z z"), (6, "\xa0 \x85 q"),
            (7, "y " * 36), (8, "u " * 35)]
    docs = spark.createDataFrame([(*r, "v") for r in rows], SCHEMA + ", key string")
    got = R.remove_repeated(docs).collect()
    want = [(k, n, m) for k, n, m in [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 35, 35), (4, 35, 35), (5, 37, 35),
                                      (None, 2, 0), (6, 3, 0), (7, 36, 36), (8, 35, 0)]]
    assert sorted([tuple(r[:3]) for r in got], key=str) == sorted(want, key=str)
    assert R.remove_repeated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_row_numbers_do_not_depend_on_how_the_input_is_split(spark, monkeypatch, tmp_path):
    rows = make(5, 90, 5000)
    for k in range(6):  # files of different sizes: packed largest first
        part = rows[k * (k + 1) * 2 : (k + 1) * (k + 2) * 2] if k < 5 else rows[60:]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    splits, write = iter(["1m", "1k", "20k"] * 10), R.materialise

    def written(df, name="table"):
        out = write(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(splits))  # as if executors came and went
        return out

    monkeypatch.setattr(R, "materialise", written)
    try:
        got = R.remove_repeated(spark.read.parquet(str(tmp_path / "docs"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted([(*r[:4], list(r[4])) for r in got], key=str) == brute(rows, 35)
