"""The n-gram join, the filter audit and the resampling against brute force, and rows that are easy to mistreat."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from factspark.llm import filter_audit, jaccard, resampling

SCHEMA = "doc_id long, text string, source string, n long, key long, file string, part int, step string, comp long"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "f", 0, "s", 0) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out, base = [], words(rng, 120).split()
    for i in range(60):  # a crowd of near copies, of which not all link directly
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = words(rng, 1)
        out.append((i, " ".join(own), f"s{i % 3}"))
    out += [(100 + i, words(rng, rng.randint(1, 60), "ab"), "x") for i in range(40)]
    out += [(200, "One two", "x"), (201, "one  TWO", "x"), (202, "two one", None), (203, None, "x"), (204, "", "x"), (205, " \t\n", "x"), (None, out[0][1], "x"), (None, None, None), (0, out[1][1], "x"), out[3], out[3]]
    return out + [(300, "É é " + words(rng, 20000, "abc"), "long"), (301, "é É " + words(random.Random(3), 20000, "abc"), "long")]


def jaccard_brute_force(rows, size, percent):
    sets = []
    for _, text, _ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[find(i)] = find(j)
    out = Counter()
    for i, (doc_id, _, _) in enumerate(rows):
        group = [k for k in range(len(rows)) if find(k) == find(i)]
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out[doc_id, len(sets[i]), min(ids) if ids else None, len(group)] += 1
    return out


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_against_brute_force(spark, rows, size, percent):
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table(spark, rows), size, percent).collect())
    want = jaccard_brute_force(rows, size, percent)
    assert got == want and any(k[3] > 30 for k in want)


def test_jaccard_without_leaders_is_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "TURNS", 0)
    assert Counter(tuple(r) for r in jaccard.jaccard_components(table(spark, rows)).collect()) == jaccard_brute_force(rows, 3, 90)


def test_empty_tables(spark):
    empty = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.jaccard_components(empty).count() == 0
    assert filter_audit.audit(filter_audit.flagged(empty, labels)).count() == 0
    assert resampling.resample(empty, empty).count() == 0


def test_filter_audit_against_brute_force(spark, rows):
    rng = random.Random(5)
    rows = [*rows, (400, "Mixed CASE Words " * 30, ""), (401, "50% of $5 " + words(rng, 80, "abcdefghijklmnop"), None), (402, words(rng, 90, "abcdefghijklmnop"), "x")]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 410, 2)] + [(2, 1, 0), (None, 1, 1)]
    docs, labels = table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(filter_audit.flagged(docs, labels)).collect()}
    good, toxic = {i for i, q, _ in marks if i is not None and q == 1}, {i for i, _, x in marks if i is not None and x == 1}
    flags = []
    for doc_id, text, part in rows:
        text = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        same = [i for i, t, _ in rows if (t or "") == text and i is not None]
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and min(same) < doc_id}
        flags.append((part or "", {k for k, v in failed.items() if v}, doc_id in good, doc_id in toxic))
    parts, orders = {f[0] for f in flags}, ["".join(p) for p in permutations("ABCDE")]
    assert len(got) == 600 * len(parts)
    removed_by = Counter()
    for part in parts:
        own = [f for f in flags if f[0] == part]
        for order in orders:
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                here = [f for f in left if letter in f[1]]
                earlier, left = gone, [f for f in left if letter not in f[1]]
                r = got[part, order, step]
                assert (r.kept, r.removed, r.redundant) == (len(left), len(here), sum(letter in f[1] for f in earlier))
                assert (r.unique_fails, r.good_lost, r.toxic_lost) == (sum(f[1] == {letter} for f in own), sum(f[2] for f in here), sum(f[3] for f in here))
                gone = gone + here
                removed_by[part, letter] += len(here)
    assert all(r.shapley == removed_by[part, order[step - 1]] for (part, order, step), r in got.items())


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_against_brute_force(spark, rows, longest):
    target = [(1, "One two", "x"), (2, None, "x"), (3, words(random.Random(9), 50), "x")]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in resampling.resample(table(spark, rows), table(spark, target), percent=30, longest=longest, buckets=97).collect()), key=str)

    def runs(text):
        w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 97 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(runs(text)[1])
    for _, text, _ in target:
        t.update(runs(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 97) / ((s[b] + 1.0) * (t.total() + 97)))) for b in range(97)]
    found = []
    for doc_id, text, _ in rows:
        w, f = runs(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        found.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((f for f in found if f[4]), key=lambda f: (-f[3], f[0] is None, f[0] or 0))
    drawn = 30 * len(able) // 100
    ranks = [f[:4] for f in able[:drawn]]
    assert Counter(g[:4] for g in got) == Counter(f[:4] for f in found)
    assert [g[:4] for g in sorted((g for g in got if g[4] is not None), key=lambda g: g[4])] == ranks and sorted(g[4] for g in got if g[4] is not None) == list(range(1, drawn + 1))
