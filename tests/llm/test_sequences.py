"""Fill-in-the-middle, runs of repeated words and byte-level BPE, against brute force and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from terrafoot.llm import byte_bpe, fill_in_middle, periodic_runs, queries
from terrafoot.llm.common import buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()

ODD = ["", None, " ", "\n\t ", "word", " word", "word ", "é\x0bß   x y ", "a <P> b", "<S>", "x<M", "<<P", "P> <S <M", "a" * 30_000, "ä \n" * 20_000, "x " * 50_000 + "  ", "😀 😀\r\n" * 40]


def fim_brute(doc_id, text):
    text = text or ""
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    w = TOKEN.findall(text)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    prefix, middle, suffix = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(w), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(w), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(w), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_is_brute_force(spark, table):
    rng = random.Random(3)
    rows = [(i * 50 + k, t) for i, t in enumerate(ODD) for k in range(12)] + [(None, "one two three"), (7, "same row"), (7, "same row")]
    rows += [(1000 + i, "".join(rng.choice("ab \n<>PSMé") for _ in range(rng.randrange(60)))) for i in range(400)]
    found = fill_in_middle.fill_in_middle(table(rows)).withColumn("text", fill_in_middle.restored("output", "form")).collect()
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, []).append((*fim_brute(doc_id, text), text or ""))
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "spm", "psm"}
    for r in found:
        own = want[r.doc_id]
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) in own
        assert r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.text)
    assert fill_in_middle.fill_in_middle(table([])).count() == 0


def test_piece_table_restores_any_order():
    """Cuts at equal places and at the ends leave empty pieces, and every arrangement goes back."""
    texts = ["abcdef", "", "xy"]
    at = np.cumsum([0, *map(len, texts)])
    raw = memoryview("".join(texts).encode())
    table = fill_in_middle.PieceTable.of(at).cut(np.array([0, 0, 1, 1, 2, 2]), np.array([4, 0, 6, 6, 8, 8]))
    parts = [[bytes(x) for x in s] for s in table.streams(raw, 3)]
    assert parts == [[b"", b"abcd", b"ef"], [b"", b"", b""], [b"xy", b"", b""]]
    for order in fill_in_middle.ORDERS.values():
        back = table.marked().arranged(order).restored(order).unmarked()
        assert [[bytes(x) for x in s] for s in back.streams(raw, 3)] == parts


def runs_brute(w, least=24, periods=3):
    n, out = len(w), []
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, periods * p):
                own = w[i : j + p]
                if not any(all(x == y for x, y in zip(own, own[q:])) for q in range(1, p)):  # noqa: B905
                    out.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, n, kinds, planted):
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(planted):
        p, a, m = rng.randrange(1, 12), rng.randrange(max(1, n)), rng.randrange(10, 60)
        for i in range(a, min(n, a + m)):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least, periods", [(24, 3), (6, 3), (2, 2), (8, 4)])
def test_runs_are_brute_force(least, periods):
    rng = random.Random(least)
    for _ in range(300):
        texts = [some_words(rng, rng.randrange(90), rng.choice([1, 2, 3, 60]), rng.randrange(4)) for _ in range(3)]
        assert periodic_runs.runs_of_texts(texts, least, periods) == [runs_brute(w, least, periods) for w in texts]


def test_suffix_tree_extensions_and_ranks_are_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        s = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(rng.randrange(1, 120))]
        tree = periodic_runs.SuffixTree(s)
        suffixes = [[*s[i:], 0] for i in range(len(s) + 1)]
        assert [suffixes[i] for i in np.argsort(tree.ranks())] == sorted(suffixes)
        i, j = np.triu_indices(len(suffixes), 1)
        want = [next(k for k, (x, y) in enumerate(zip(suffixes[a], suffixes[b], strict=False)) if x != y) for a, b in zip(i, j, strict=True)]
        assert tree.common(j, i).tolist() == want


def test_periodic_runs_of_odd_rows(spark, table):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "la " * 30), (50, "la " * 30), (50, "la " * 30)]
    rows += [(100 + i, "  ".join(some_words(rng, rng.randrange(200), rng.choice([2, 500]), 3))) for i in range(60)]
    rows.append((900, " ".join(some_words(rng, 60_000, 400, 200))))
    found = periodic_runs.periodic_runs(table(rows)).withColumn("best", periodic_runs.strongest(F.col("runs"))).collect()
    want = {}
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        runs = runs_brute(w) if len(w) < 2000 else None
        want.setdefault(doc_id, []).append((w, runs))
    assert len(found) == len(rows)
    for r in found:
        w, runs = next(x for x in want[r.doc_id])
        got = [(x.start, x.length, x.period) for x in r.runs]
        if runs is None:  # long texts: each is a run, maximal, and none is lost around the planted ones
            assert all(w[s + p : s + n] == w[s : s + n - p] and (s == 0 or w[s - 1] != w[s + p - 1]) and (s + n == len(w) or w[s + n] != w[s + n - p]) for s, n, p in got)
            if len(w) > 50_000 and len(set(w)) > 1:
                pieces = [(a, runs_brute(w[a : a + 400])) for a in range(0, len(w), 200)]
                inner = {(a + s, n, p) for a, found_ in pieces for s, n, p in found_ if 0 < s and s + n < 400}
                assert inner and inner <= set(got)
            continue
        assert got == runs
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.best and tuple(r.best)) == best
    assert periodic_runs.periodic_runs(table([])).count() == 0


def op12_brute(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_brute(w)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = (None,) * 4
    for s, k, p in runs:
        if best[0] is None or k * best[2] > best[1] * p:
            best = (s, k, p, 1000 * k // p)
    return doc_id, len(runs), *best, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_op12_is_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    short = [(i, t) for i, t in rows if len(WORD.findall(t or "")) < 1500] + [(10_000 + i, t if t is None else t[:3000]) for i, t in enumerate(ODD)]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert found == sorted(op12_brute(i, t) for i, t in short) and sum(r[1] for r in found) > 10


def library(path=queries.BYTE_BPE_RANKS):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=queries.BYTE_BPE_PATTERN, mergeable_ranks=byte_bpe.vocabulary(path).ranks, special_tokens={})


def test_pattern_is_the_published_one():
    import public_tokenizers

    assert queries.BYTE_BPE_PATTERN == public_tokenizers.PATTERN


def test_byte_bpe_is_the_library(spark, table):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "twice"), (3, "twice"), (80, "<|endoftext|> it's"), (81, "".join(rng.choice("abcdefgh") for _ in range(200_000))), (82, "\x00\x1c  ퟿")]
    rows += [(100 + i, "".join(rng.choice("aab é\t\n1'stᵫ字 ") for _ in range(rng.randrange(200)))) for i in range(300)]
    found = byte_bpe.encode(table(rows), queries.BYTE_BPE_RANKS, queries.BYTE_BPE_PATTERN).collect()
    tok = library()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append((tok.encode_ordinary(t or ""), (t or "").encode()))
    assert len(found) == len(rows)
    for r in found:
        assert (r.ids, bytes(r.decoded)) in want[r.doc_id] and r.n_tokens == len(r.ids)
    assert byte_bpe.encode(table([]), queries.BYTE_BPE_RANKS, queries.BYTE_BPE_PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(table(rows), queries.BYTE_BPE_RANKS, queries.BYTE_BPE_PATTERN, decoded=False), queries.BYTE_BPE_RANKS)
    assert all((r.ids, bytes(r.decoded)) in want[r.doc_id] for r in back.collect())


def test_op13_is_the_library(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tok = library()
    want = sorted((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in rows for ids in [tok.encode_ordinary(t or "")])
    assert sorted(map(tuple, queries.op13_byte_bpe(spark, str(tmp_path)).collect())) == want


def test_merges_in_odd_vocabularies():
    """Ranks in any order: a merge may make pairs of a lower rank than its own, and different pairs of one rank."""

    def brute(ranks, data):
        parts = [bytes([x]) for x in data]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not pairs:
                return [ranks[x] for x in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(6)
    for _ in range(150):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(2, 40))}
        names = [*tokens, *(bytes([x]) for x in range(256))]
        ranks = dict(zip(names, rng.sample(range(2000), len(names)), strict=True))
        words = byte_bpe.Vocabulary(ranks)
        for n in (1, 5, 30, 200):
            data = bytes(rng.choice(b"abcd") for _ in range(n))
            assert words.merged(data) == ([ranks[data]] if data in ranks else brute(ranks, data))


def test_parts_end_between_pretokens(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 10)
    rng = random.Random(8)
    split = regex.compile(queries.BYTE_BPE_PATTERN)
    for _ in range(500):
        text = "".join(rng.choice("ab '\n .1st") for _ in range(rng.randrange(120)))
        assert [x for p in byte_bpe.parts(text) for x in split.findall(p)] == split.findall(text)


def test_memory_of_pretokens_keeps_ids(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 3)
    words = byte_bpe.Vocabulary(byte_bpe.vocabulary(queries.BYTE_BPE_RANKS).ranks)
    split = regex.compile(queries.BYTE_BPE_PATTERN)
    text = "one two three four five six one two three seven"
    assert words.encode(text, split).tolist() == library().encode_ordinary(text) and len(words.memo) <= 3


def test_token_ends_are_brute_force():
    import pyarrow as pa

    texts = [t or "" for t in ODD]
    at, data = buffers(pa.array(texts))
    first, ends = fill_in_middle.token_ends(at, data)
    for i, t in enumerate(texts):
        want = np.cumsum([len(x.encode()) for x in TOKEN.findall(t)]) + at[i]
        assert ends[first[i] : first[i + 1]].tolist() == want.tolist()
