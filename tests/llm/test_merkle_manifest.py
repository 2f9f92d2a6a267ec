import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row):
    k, text, lang, source, n = row
    return h(*map(field, (k, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    steps = []
    for nodes in tree[:-1]:
        first = at // 3 * 3
        steps.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            steps = path(trees[s], at) + path(top, place)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf((r[0], r[1].replace("\n", ""), *r[2:])) if bad else leaf(r)
            for a, b in steps:
                node = h(a, node, b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in steps)), node,
                        node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "v", 1) for r in rows], SCHEMA + ", leaf string, place int").repartition(parts)
    got = M.manifest(docs)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def row(k, source, text="a\nb", lang="en"):
    return (k, text, lang, source, k)


def test_groups_of_all_small_sizes(spark):
    check(spark, [row(k * 5 - 9, f"s{n:02}", f"t {k}\n") for n in range(1, 32) for k in range(n)])


def test_odd_rows(spark):
    rows = [row(k, "a") for k in (0, 1, -1, 63, 64, 65, 2**62, -(2**62), 2**63 - 1, -(2**63), 32767, 32768)]
    rows += [(None, "x\ny", None, "a", None), (None, None, None, None, None), (None, "", None, None, 0),
             (7, "", "", "", 0), (8, None, "\n", "ü", 5), (9, "\n\n", "ü\n", "zz", None), (10, "x" * 100001, "l", "zz", 1)]
    check(spark, rows)


def test_repeated_keys_and_rows(spark):
    rnd = random.Random(2)
    rows = [row(k, rnd.choice(["a", "b", None]), f"text {rnd.randrange(3)}\n") for k in range(200) for _ in range(rnd.randrange(4))]
    rows += [row(77, "a", "same\n")] * 1600 + [row(78, "a", f"t{k}") for k in range(900)]
    rows += [(None, f"n{k % 7}", "en", "a", 1) for k in range(300)]
    check(spark, rows)


def test_several_arrays_and_containers(spark):
    rnd = random.Random(4)
    rows = [row(k * 977, "big", f"t{k % 5}\n") for k in rnd.sample(range(10**6), 2300)]
    rows += [row(rnd.randrange(-(2**62), 2**62), "wide") for _ in range(750)] + [row(k, f"s{k % 11}") for k in range(40)]
    check(spark, rows, 5)


def test_more_groups_than_an_array_has_slots(spark):
    check(spark, [row(k, f"s{k % 800}") for k in range(900)])


@pytest.mark.parametrize("places", [[3], [-5000, 4, 10**7], list(range(0, 60000, 7)), [k * 10**14 - 2**62 for k in range(300)]])
def test_directory_adds_up_what_is_before(spark, places):
    rows = [(g, p, i % 3 + 1) for g in (1, 2) for i, p in enumerate(places[g - 1 :])]
    got = M.rows_before(spark.createDataFrame(rows, "g int, place long, n long"), ["g"], "place", bits=4).collect()
    want, total = {}, {1: 0, 2: 0}
    for g, p, n in sorted(rows):
        want[(g, p)] = total[g]
        total[g] += n
    assert {(r["g"], r["place"]): r["base"] for r in got} == want


def test_a_changed_leaf_fails_and_others_pass(spark, small):
    got = M.op13_merkle_manifest(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in docs.collect()])
    assert got.where("not verified").count() > 0 and got.where("verified").count() > 0
    none = M.manifest(docs, tampered=F.lit(False))
    assert none.where("not verified").count() == 0


def test_empty_table(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
