"""Exact, line and near deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrafoot.llm import near_dedup
from terrafoot.llm.exact_dedup import exact_dedup
from terrafoot.llm.line_dedup import line_dedup
from terrafoot.llm.near_dedup import connected, keep_one, near_groups
from terrafoot.llm.words import PIECE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i if i is not None else 0, i))
    out = []
    for text, own in groups.items():
        best = min(own)
        for x in own:
            out.append((x[3], best[3], len(own), x == best, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(spark, table):
    long = "wörd " * 30_000
    rows = [(5, "a b"), (3, "ab"), (4, " a  b "), (9, None), (8, ""), (7, " \n"), (1, "abc"), (2, long + "x"), (6, long + "y"), (10, long + "x"), (11, "é" * 32), (12, "é" * 16), (13, "é" * 32), (None, "solo"), (None, "pair"), (14, "pair")]
    got = sorted((tuple(r) for r in exact_dedup(table(rows)).collect()), key=repr)
    assert got == exact_brute(rows)
    same = exact_dedup(table([(1, "t"), (1, "t"), (1, "t")])).collect()
    assert sum(r.kept for r in same) == 1 and {r.group_size for r in same} == {3}
    assert exact_dedup(table([])).count() == 0


def lines_brute(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines(spark, table):
    pick = random.Random(3)
    common = [f"This is the common line number {i} of all ÄÖ" for i in range(6)]
    rows = [(i, "\n".join(pick.choice(common + ["short", "", f"own line {i} {pick.random()} only here"]) + pick.choice(["", " ", "\t"]) for _ in range(pick.randint(1, 30)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, common[0].upper().replace("ÄÖ", "ÄÖ")), (503, "\n".join([common[0]] * 40))]
    found = line_dedup(table(rows)).select("doc_id", "__n_lines", "__n_dropped", "__kept")
    assert sorted(map(tuple, found.collect())) == lines_brute(rows)
    hot = [(i, common[0] + f"\nline of its own for number {i:05d}") for i in range(3000)]
    spread = line_dedup(table(hot).repartition(8)).select("doc_id", "__n_lines", "__n_dropped", "__kept")
    assert sorted(map(tuple, spread.collect())) == lines_brute(hot)
    assert line_dedup(table([])).count() == 0
    nulls = line_dedup(table([(None, common[0]), (1, common[0]), (2, common[0])]))
    assert {(r.doc_id, r["__n_dropped"]) for r in nulls.collect()} == {(None, 1), (1, 1), (2, 0)}


def near_brute(rows, k=2, similarity=80):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_rows(n=260, seed=5):
    """Random texts, and groups of near copies around the threshold, linked in chains as well."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    while i < n:
        base = [pick.choice(words) for _ in range(pick.choice([3, 12, 40, 90]))]
        for _ in range(pick.choice([1, 1, 2, 5, 25])):
            own = list(base)
            for _ in range(pick.choice([0, 0, 1, len(base) // 20, len(base) // 12, len(base) // 8])):
                own[pick.randrange(len(own))] = pick.choice(words)
            rows.append((i * 7 % 1009, " ".join(own).upper() if pick.random() < 0.2 else "  ".join(own)))
            i += 1
            if pick.random() < 0.3:
                base = own
    return [*rows, (2001, None), (2002, ""), (2003, "one"), (2004, "ONE"), (2005, " \t ")]


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, table, k, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 600)
    monkeypatch.setattr(near_dedup, "COPIES", 4)
    rows = near_rows()
    got = near_groups(table(rows), k=k).select("doc_id", "n_shingles", "component_id")
    want = near_brute(rows, k)
    assert sorted(map(tuple, got.collect())) == want
    if k == 5:
        kept = keep_one(table(rows), k=5)
        assert kept.columns == table(rows).columns
        assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in want if i == c]


def test_near_edges(spark, table):
    assert near_groups(table([])).count() == 0
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, "A B C D"), (None, "x y z"), (3, "other text"), (9, None)]
    found = sorted((tuple(r)[::2] + (r.component_id,) for r in near_groups(table(rows)).select("doc_id", "mark", "n_shingles", "component_id").collect()), key=repr)
    assert found == sorted([(None, 3, 3), (3, 3, 3), (3, 3, 3), (4, 3, 3), (None, 2, None), (3, 1, 3), (9, 0, 9)], key=repr)
    assert keep_one(table([(1, "a b c"), (1, "a b c"), (2, "a b c")]), k=2).count() == 1


def test_connected_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionAll(spark.createDataFrame([(100, 101)], "a long, b long"))
    got = {tuple(r) for r in connected(edges).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_near_long_texts(spark, table):
    """Texts of very many words, and words longer than a piece of bytes, are read whole."""
    pick = random.Random(11)
    words = [f"w{i}" for i in range(60_000)]
    long = [pick.choice(words) for _ in range(80_000)]
    changed = [*long]
    for _ in range(2_000):
        changed[pick.randrange(len(changed))] = "other"
    giant = "x" * (3 * PIECE + 17)
    rows = [(1, " ".join(long)), (2, " ".join(changed)), (3, " ".join(long[:40_000])), (4, f"{giant} a b c d e f g h i"), (5, f"{giant.upper()} a b c d e f g h i j"), (6, f"{giant}y a b c d e f g h i"), (7, " \n" * 200_000)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(table(rows)).collect())
    assert got == near_brute(rows) and [c for _, _, c in got] == [1, 1, 3, 4, 4, 4, 7]


def test_near_threshold_group_in_blocks(spark, table, monkeypatch):
    """One bucket whose pairs lie at the threshold and far below it, in many blocks, after pruning by prefixes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 400)
    monkeypatch.setattr(near_dedup, "COPIES", 2)
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", 1)
    pick = random.Random(12)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(160):
        own = [*base]
        for _ in range(pick.choice([0, 2, 3, 4, 5, 9])):
            own[pick.randrange(40)] = f"v{i}x{pick.random()}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, " ".join([*base[:25], *[f"page{i}word{j}" for j in range(15)]])) for i in range(60)]  # a template with own words
    got = near_groups(table(rows)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == near_brute(rows)


def test_lines_of_long_texts(spark, table):
    line = "a line that very many texts have in common"
    long = "\n".join(f"{i} own line of the long text" if i % 3 else line for i in range(60_000))
    rows = [(1, long), (2, line + "\n" + "z" * 2_000_000), (3, f"{line}\n{'z' * 2_000_000}\n" + "z" * 2_000_000), (4, "z" * 2_000_000), (5, "\n" * 100_000)]
    found = line_dedup(table(rows)).select("doc_id", "__n_lines", "__n_dropped", "__kept")
    assert sorted(map(tuple, found.collect())) == lines_brute(rows)
