"""Licences, quality, language, tokens, WARC records and mixing."""

import collections
import hashlib
import itertools
import random
import re
import struct
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafoot.llm import language_id, license_scan, mixing, quality_classifier, quality_rules, warc
from terrafoot.llm import sentencepiece_codec as codec
from terrafoot.llm.queries import SENTENCEPIECE_MODEL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_licenses(spark, table):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "released UNDER the mit licence!"), (3, None), (4, ""), (5, "the license"), (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (7, "word " * 50_000), (1, "x\nReleased under the MIT License.\ny")]
    found = sorted((r.doc_id, r.n_matches, r.licenses) for r in license_scan.license_scan(table(rows)).collect())
    assert found == [(1, 1, ["MIT"]), (1, 1, ["MIT"]), (6, 2, ["CC-BY-NC-4.0", "MIT"])]
    assert license_scan.license_scan(table([])).count() == 0
    for name, text in license_scan.TEMPLATES.items():
        assert license_scan.license_matches(table([(1, text)])).first().dice == 1.0, name


def test_licenses_across_and_within_lines(spark, table):
    grant = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files, to deal in\nthe Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software."
    header = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n"
    own = {k: v for k, v in license_scan.TEMPLATES.items()}
    rows = [(1, "Copyright 2020 X\n\n" + grant + "\nmore"), (2, "int x;\n" + header + "int y;"), (3, "This project is released under the MIT License. See LICENSE for details."), (4, "word " * 30_000 + "Released under\nthe MIT License. " + "word " * 30_000), (5, "released by the\nlicense of version"), (6, "a\nReleased under the MIT License.\nReleased under the MIT\nLicense. Licensed under CC BY-NC 4.0.")]
    found = {r.doc_id: (r.n_matches, r.licenses, r.best_dice) for r in license_scan.license_scan(table(rows), templates=own).collect()}
    assert found == {1: (1, ["MIT-grant"], 1.0), 2: (1, ["GPL-3.0-header"], 1.0), 3: (1, ["MIT"], 1.0), 4: (1, ["MIT"], 1.0), 6: (3, ["CC-BY-NC-4.0", "MIT"], 1.0)}
    assert {(r.doc_id, r.line) for r in license_scan.license_matches(table(rows), templates=own).collect()} == {(1, 3), (2, 2), (3, 1), (4, 1), (6, 2), (6, 3), (6, 4)}
    assert license_scan.license_scan(table([(1, "say Proprietary now")]), templates={"P": "proprietary"}).first().licenses == ["P"]


def test_license_texts_in_customary_form(spark, table):
    wrap = lambda name, width=66: "\n".join(" * " + x for x in textwrap.wrap(license_scan.NOTICES[name], width))
    names = ["MIT-text", "ISC-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "Unlicense", "AGPL-3.0-header", "LGPL-2.1-header", "Apache-2.0-grant", "MPL-2.0-grant", "GPL-3.0-opening"]
    rows = [(i, f"/*\n{wrap(name)}\n */\ncode") for i, name in enumerate(names)]
    rows += [(50, "This project is licensed under the MIT License."), (51, wrap("BSD-2-Clause-text").replace("REGENTS", "COPYRIGHT HOLDERS")), (52, wrap("ISC-text").replace("THE AUTHOR", "EXAMPLE INC")), (53, "GNU in a zoo, free of charge")]
    found = {r.doc_id: r.licenses for r in license_scan.license_scan(table(rows)).collect()}
    assert {i: found[i] for i in range(len(names))} == {i: [name] for i, name in enumerate(names)}
    assert found[50] == ["MIT-licensed"] and found[51] == ["BSD-disclaimer", "BSD-grant"] and found[52] == ["ISC-grant"] and 53 not in found


def test_licenses_of_long_texts(spark, table, monkeypatch):
    """Very many matches in one text, one line of 5 MB, and chunks smaller than a template: nothing is lost at the chunks' bounds."""
    text = license_scan.NOTICES["MIT-text"]
    rows = [(1, "\n".join([text] * 1500)), (2, "word " * 500_000 + "Released under the MIT License. " + "word " * 500_000), (3, "x " * 1023 + "Released under\nthe MIT License.")]
    found = {r.doc_id: (r.n_matches, r.licenses) for r in license_scan.license_scan(table(rows)).collect()}
    assert found == {1: (1500, ["MIT-text"]), 2: (1, ["MIT"]), 3: (1, ["MIT"])}
    mixed = [(i, " ".join(f"w{k}" for k in range(i * 7)) + "\n" + "\n\n".join(list(license_scan.NOTICES.values())[i : i + 5])) for i in range(12)]
    want = sorted(map(tuple, license_scan.license_matches(table(mixed)).drop("row").collect()))
    monkeypatch.setattr(license_scan, "CHUNK_WORDS", 50)
    assert sorted(map(tuple, license_scan.license_matches(table(mixed)).drop("row").collect())) == want and len(want) >= 50


def test_license_sql_is_the_scan(spark, table):
    """The query's SQL on what the test tables don't hold: wrapped, commented, joined, overlapping and reworded texts."""
    import duckdb
    import pandas as pd

    from terrafoot.llm.queries import ORACLE_SQL

    wrap = lambda name, width: "\n".join(" * " + x for x in textwrap.wrap(license_scan.NOTICES[name], width))
    rows = [(i, f"head\n{wrap(name, 40 + i)}\n\ntail") for i, name in enumerate(license_scan.NOTICES)]
    rows += [(100, wrap("MIT-text", 70) + "\n" + wrap("BSD-2-Clause-text", 50)), (101, "This project is licensed under the MIT License. See LICENSE."), (102, wrap("ISC-text", 66).replace("THE AUTHOR", "EXAMPLE INC")), (103, "GNU in a zoo, free of charge"), (104, None), (105, ""), (0, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (0, "Released under the MIT License. Licensed under CC BY-NC 4.0.")]
    rows += [(106, "free software: you can redistribute it and/or\n" * 3 + license_scan.NOTICES["GPL-2.0-header"] + " " + license_scan.NOTICES["GPL-3.0-header"])]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.sql(ORACLE_SQL["op2_license_scan"]).fetchall())
    found = sorted((r.doc_id, r.n_matches, ",".join(r.licenses), r.best_dice) for r in license_scan.license_scan(table(rows)).collect())
    assert found == want and len(found) > 40


def quality_brute(text):
    words = WORD.findall(text or "")
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again)


def test_quality_rules(spark, table):
    pick = random.Random(2)
    common = "the of and to in is it that was for".split()
    clean = [" ".join(pick.choice(common) if pick.random() < 0.5 else "".join(pick.choice("aeioubcdlnrst") for _ in range(pick.randint(2, 8))) for _ in range(200)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(clean)]
    rows += [(100, None, "en"), (101, "", None), (102, "a b c\na b c\n a\n\n", "xx"), (103, clean[0].upper(), "en"), (104, re.sub(" ", "### ", clean[1]), "en"), (105, "ab cd é ñ 日本 " * 200, "en"), (None, clean[2] + " " + clean[2], "en"), (107, " ".join(f"w{i}" for i in range(19)), "en")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(rows)).collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_brute(text), i
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in (100, 101, 102, 103, 104, 105, None, 107))
    assert quality_rules.quality_rules(table([])).count() == 0


def tongue(seed):
    """A text maker of an invented language: 50 words cover about 30 % of its texts, 3,000 others the rest."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("aeioubcdlnrstmpg") for _ in range(pick.randint(2, 9)))
    common, others = [word() for _ in range(50)], [word() for _ in range(3000)]
    return lambda n: " ".join((pick.choices(common, [1 / (i + 2) for i in range(50)])[0] if pick.random() < 0.3 else pick.choice(others)) for _ in range(n))


def test_word_distance_at_realistic_coverage(spark, table):
    pick = random.Random(5)
    english, spanish = tongue(31), tongue(32)
    rows = [(i, english(300), "en") for i in range(100)] + [(100 + i, spanish(300), "es") for i in range(60)]
    rows += [(200 + i, "| 7 -- " * 30, "es") for i in range(60)]  # frequent, but without a letter
    noise = lambda n: " ".join("".join(pick.choice("aeioubcdlnrstmpg") for _ in range(pick.randint(10, 12))) for _ in range(n))
    rows += [(300, noise(500), "en"), (301, noise(120), "es"), (302, spanish(300), "en"), (303, english(300), "es")]
    rows += [(304, noise(500), None), (305, noise(500), "xx"), (306, spanish(300), None), (307, english(300), "yy")]
    words = dict(quality_rules.common_words(table(rows)))
    assert not {"|", "7", "--"} & {w for ws in words.values() for w in ws} and set(words) == {"", "en", "es"}
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(rows)).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in (*range(160), 306, 307))
    assert not any(got[i].kept or got[i].base_failed for i in range(300, 306))


def test_small_groups_are_not_their_own_reference(spark, table):
    english = tongue(33)
    rows = [(i, english(300), "en") for i in range(60)] + [(100, " ".join(f"qz{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)), "xx")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(rows)).collect()}
    assert got[100].word_distance > 0.3 and not got[100].kept and not got[100].base_failed and all(got[i].kept for i in range(60))


def js_brute(p, q):
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    return np.sqrt((kl(p) + kl(q)) / 2)


def test_js_distance(spark):
    counts = [([1.0, 2.0, 0.0], [0.0, 5.0, 5.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])]
    rows = spark.createDataFrame(counts, "p array<double>, q array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, v: x + v)
    rows = rows.select(*[quality_rules._shares(F.col(c), total(c)).alias(c) for c in "pq"])
    a, b, c = (r[0] for r in rows.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect())
    assert a == pytest.approx(js_brute([1, 2, 0], [0, 5, 5])) and b == pytest.approx(1.0) and c == 0.0


def class_of(c):
    """The class of a character, told by its first UTF-8 byte."""
    if ord(c) < 128:
        return 0 if c in "aeiou" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in " \t\n\x0b\x0c\r" else 5
    return 6 if 0xC0 <= ord(c) < 0x280 else 7


def verdict_brute(rows, least_reference):
    """(class_distance, word_distance, kept) of every row, from whole histograms."""
    words = lambda t: WORD.findall((t or "").lower())
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        counts[lang or ""].update(words(text))
    own = [x for x in counts if x and counts[x].total() >= least_reference]
    pooled = sum(counts.values(), collections.Counter())
    first = lambda c: [w for w, _ in sorted(((w, n) for w, n in c.items() if any(map(str.isalpha, w))), key=lambda x: (-x[1], x[0]))[:50]]
    lists = {"": first(pooled)} | {x: first(counts[x]) for x in sorted(own)}

    def histogram(text, name):
        place = {w: i for i, w in enumerate(lists[name])}
        out = np.zeros(51)
        for w in words(text):
            out[place.get(w, 50)] += 1
        return out

    classes = lambda t: np.bincount([class_of(c) for c in t or ""], minlength=8).astype(float)
    facts = []
    for _, text, lang in rows:
        ref = lang if lang in own else ""
        name = ref or max(lists, key=lambda x: (50 * len(words(text)) - histogram(text, x)[50], x == "", [-ord(c) for c in x]))
        facts.append((ref, name, classes(text), histogram(text, name), histogram(text, "")))
    all_classes = {x: sum((f[2] for f in facts if f[0] == x), np.zeros(8)) for x in own} | {"": sum(f[2] for f in facts)}
    all_words = {x: sum((f[3] for f in facts if f[0] == x), np.zeros(51)) for x in own} | {"": sum(f[4] for f in facts)}
    out = {}
    for (i, text, _), (ref, name, by_class, by_word, _) in zip(rows, facts, strict=True):
        n, length = len(words(text)), len(text or "")
        by = js_brute(by_class, all_classes[ref]) if length else 0.0
        word = js_brute(by_word, all_words[name]) if n else 0.0
        strange = js_brute([0] * 50 + [1], all_words[name])
        covered = 1 - all_words[name][50] / all_words[name].sum()
        near = (length < 200 or by <= quality_rules.CLASS_DISTANCE) and (n < 100 or n * covered < 20 or word <= quality_rules.WORD_SHARE * strange)
        _, _, _, _, again = quality_brute(text)
        out[i] = (by, word, near and n >= 20 and 100 * again <= 30 * n)
    return out


def test_quality_verdict_is_brute_force(spark, table, monkeypatch):
    """Both histograms, both distances and the verdict, with more languages than a machine word has bits."""
    monkeypatch.setattr(quality_rules, "LEAST_REFERENCE", 400)
    pick, rows = random.Random(21), []
    for k in range(70):
        make = tongue(100 + k)
        rows += [(k * 10 + i, make(pick.randint(120, 200)), f"x{k}") for i in range(4)] + [(k * 10 + 5, make(150), pick.choice([None, "rare", f"x{(k + 1) % 70}"]))]
    rows += [(900, None, "x1"), (901, "", None), (902, "ÀÉ ñ 日本 😀 " * 60, "x1"), (903, "AB12 ;; " * 80, None), (904, tongue(100)(40_000), "x0")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(rows)).collect()}
    want = verdict_brute(rows, 400)
    assert len(got) == len(want) and len({r[2] for r in rows}) > 70
    for i, (by, word, kept) in want.items():
        assert got[i].class_distance == pytest.approx(by, abs=1e-7) and got[i].word_distance == pytest.approx(word, abs=1e-7) and got[i].kept == kept, i
    assert 0 < sum(k for *_, k in want.values()) < len(want)


def test_language(spark, table):
    pick = random.Random(4)
    parts = {"en": "th he in er an re on at", "fr": "é ou le ai eau ment qu è", "de": "sch ein ung ü ch ge ver ß"}
    rows = [(i, " ".join("".join(pick.choices(parts[lang].split(), k=3)) for _ in range(pick.randint(3, 60))), lang) for i, lang in enumerate(pick.choices(list(parts), [6, 3, 1], k=600))]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!", "en"), (903, "the " * 100_000, None), (None, "schein verung", "de")]
    docs = table(rows)
    model = language_id.fit(docs, ~language_id.held_out() & F.col("doc_id").isNotNull())
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == len(rows) and model.languages == ["de", "en", "fr"]
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    truth = {r[0]: r[2] for r in rows}
    held = [r.doc_id for r in docs.where(language_id.held_out() & (F.col("doc_id") < 900)).collect()]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held) and len(held) > 80
    assert all(0 <= r.score <= 1 for r in got.values())
    assert (model.weights == 0).mean() > 0.5  # sparse
    alone = {r.doc_id: r for r in language_id.identify(docs.where("doc_id = 17"), model).collect()}
    assert alone[17].score == got[17].score
    kept = language_id.recognised(docs, model)
    assert kept.columns == docs.columns and not {900, 901, 902} & {r.doc_id for r in kept.collect()}
    assert language_id.identify(docs.limit(0), model).count() == 0
    empty = language_id.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def ngrams_brute(text):
    """Buckets of the n-grams of 1 to 3 characters, one by one."""
    text, out = " " + (text or "").lower() + " ", []
    for i, c in enumerate(text):
        if c.isalpha() or i == 0 or text[i - 1].isalpha():
            out.append(ord(c) if c.isalpha() else 32)
    found = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(out) - n + 1):
            h = out[i]
            for x in out[i + 1 : i + n]:
                h = (h * 0x100000001B3 + x) % (1 << 64)
            found[((h + n) * 0x9E3779B97F4A7C15) % (1 << 64) >> 48] += 1
    return found


@pytest.mark.parametrize("size", [2, 7, 1 << 18])
def test_ngrams_in_slices_are_brute_force(size, monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", size)
    pick = random.Random(15)
    texts = [None, "", " ", "12", "Ab cd! é", "ΑΣ σ"] + ["".join(pick.choice("abcé ,XΣ\n日") for _ in range(pick.randint(0, 150))) for _ in range(60)]
    found = [collections.Counter() for _ in texts]
    for owner, bucket in language_id.ngrams(texts):
        for i, b in zip(owner.tolist(), bucket.tolist(), strict=True):
            found[i][b] += 1
    assert found == [ngrams_brute(t) for t in texts]


def test_predictions_are_brute_force_for_very_many_languages(spark, table):
    """More languages than a byte holds, each with few rows; very long texts give what their parts give."""
    rows = [(k * 8 + i, tongue(500 + k)(20), f"l{k:03d}") for k in range(300) for i in range(8)]
    docs = table(rows)
    model = language_id.fit(docs, ~language_id.held_out(), sample_rows=64, least_rows=2)
    assert len(model.languages) == 300
    texts = [r[1] for r in rows[::40]] + [rows[0][1] + " " + rows[9][1], "a", "é!", "", None, "1"]
    lang, score = model.predict(texts)
    for text, name, p in zip(texts, lang, score, strict=True):
        counts = ngrams_brute(text)
        if not any(map(str.isalpha, text or "")):
            assert (name, p) == ("und", 0.0)
            continue
        logits = sum((n * model.weights[b].astype(float) for b, n in counts.items()), np.zeros(300)) * model.unit / counts.total() + model.bias
        chances = np.exp((logits - logits.max()) / model.temperature)
        assert name == model.languages[logits.argmax()] and p == pytest.approx((chances / chances.sum()).max(), abs=1e-9)
    long = " ".join([rows[5][1]] * 4000)
    assert model.predict([long])[0] == model.predict([rows[5][1]])[0]


def test_every_language_is_learned(spark, table):
    """Languages of one to three rows, rows that share an id, and languages without any letter beside a large one."""
    rows = [(k, tongue(500 + k)(20), "big") for k in range(2000)]
    rows += [(5000 + 10 * k + i, tongue(900 + k)(20), f"l{k:03d}") for k in range(120) for i in range(1 + k % 3)]
    rows += [(7000, tongue(1)(9), "same")] * 40 + [(7001 + i, "12 !", "none") for i in range(9)] + [(7100, None, "null"), (None, "x", None)]
    model = language_id.fit(table(rows), F.lit(True), sample_rows=64, least_rows=2)
    assert model.languages == sorted({"big", "same", *(f"l{k:03d}" for k in range(120))})
    assert (np.abs(model.weights).max(0) > 0).all()


def test_held_back_rows_leave_every_language_one():
    pick = random.Random(3)
    for _ in range(50):
        langs = [f"l{pick.randrange(60)}" for _ in range(pick.randrange(1, 200))]
        back = language_id.held_back(langs)
        assert {x for x, b in zip(langs, back, strict=True) if not b} == set(langs)
        assert sum(back) <= len(langs) // 8 + 1 and (len(langs) >= 32 or not any(back))
    assert sum(language_id.held_back(["a"] * 80)) == 10


def test_sentencepiece_is_the_library(spark, table):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    pick = random.Random(6)
    texts = [None, "", " ", "  a  b ", "\n\n x\t\ty \n", "日本語 🤦🏼‍♂️ ok", "<s> </s> <0x41> \x00", "a" * 3000, "ab" * 40 + "é" * 60, "x" * 49]
    texts += ["".join(pick.choice(" ab\né日😀etion\t") for _ in range(pick.randint(1, 200))) for _ in range(80)]
    rows = codec.encode(table(list(enumerate(texts))), SENTENCEPIECE_MODEL)
    got = {r.doc_id: r for r in rows.collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == library.encode(text or "") and got[i].n_tokens == len(got[i].ids) and got[i].round_trip, i
    back = {r.doc_id: r.text for r in codec.decode(rows, SENTENCEPIECE_MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert codec.encode(table([]), SENTENCEPIECE_MODEL).count() == 0
    assert not codec.encode(table([(1, "a▁b")]), SENTENCEPIECE_MODEL).first().round_trip


def test_viterbi_is_brute_force():
    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "cab"]
    scores = np.array([0, -3, -2.1, -2.2, -2.3, -3.1, -3.3, -6.5, -2.5, -4.0, -5.1])
    p = codec.Pieces(names, scores, np.array([codec.UNKNOWN] + [codec.NORMAL] * 10), codec.UNIGRAM)
    score = {n: s for n, s in zip(names[1:], scores[1:], strict=True)}
    for n in range(1, 5):
        for word in map("".join, itertools.product("abcx", repeat=n)):
            text = "▁" + word
            best = max((sum(score.get(text[a:b], p.worst) for a, b in itertools.pairwise(cut)) for cut in ([0, *inner, len(text)] for k in range(len(text)) for inner in itertools.combinations(range(1, len(text)), k)) if all(text[a:b] in score or b - a == 1 for a, b in itertools.pairwise(cut))), default=None)
            points = np.array([[ord(c) for c in text]], np.uint64)
            cuts = codec.viterbi(codec._substrings(points, p), p)[0]
            assert sum(score.get(text[i : cuts[i]], p.worst) for i in np.flatnonzero(cuts)) == pytest.approx(best), word
            start, ids = codec._viterbi_long(points[0], p)
            assert start.tolist() == np.flatnonzero(cuts).tolist() and [names[k] if k >= 0 else "x" for k in ids] == [text[i : cuts[i]] for i in start]


def message(*fields):
    """Protocol-buffer bytes of (number, value) pairs."""

    def varint(v):
        out = b""
        while True:
            v, low = v >> 7, v & 127
            out += bytes([low | (128 if v else 0)])
            if not v:
                return out

    def one(n, v):
        if isinstance(v, int):
            return varint(n << 3) + varint(v)
        return varint(n << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(n << 3 | 2) + varint(len(v)) + v

    return b"".join(one(n, v) for n, v in fields)


@pytest.mark.parametrize("kind", [codec.UNIGRAM, codec.BPE])
@pytest.mark.parametrize(("mapped", "given", "dummy", "squeeze", "fallback"), [(0, 0, 1, 1, 0), (1, 1, 1, 1, 0), (0, 1, 0, 0, 1), (1, 0, 1, 0, 1)])
def test_assembled_models_are_the_library(kind, mapped, given, dummy, squeeze, fallback):
    """Models put together by hand, none is trained: character maps, given pieces, white space, unknown characters."""
    import sentencepiece

    pick = random.Random(13)
    rules = dict(codec._fields(dict(codec._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]))[2]
    names = {**{c: -3 - 5 * pick.random() for c in "▁abcdeé日本fi1A"}, **{pick.choice("▁abcdeé日本") + "".join(pick.choices("abcdeé日本", k=pick.randint(1, 4))): -2 - 8 * pick.random() for _ in range(300)}}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((n, s, 1) for n, s in names.items())]
    rows += [(n, 0.0, 4) for n in ("@@", "abba") if given] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback]
    pieces = [(1, message((1, n.encode()), (2, s), (3, k))) for n, s, k in rows]
    data = message(*pieces, (2, message((3, kind), (35, fallback))), (3, message((1, b"x"), *([(2, rules)] if mapped else []), (3, dummy), (4, squeeze))))
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), codec.Codec(codec.parse_model(data))
    texts = ["".join(pick.choice("abcdeé日本語ﬁ①Ａ  \n\t\x00\u0301\u3000fa@x😀") for _ in range(pick.randint(0, 60))) for _ in range(300)]
    texts += ["", "  ", "@@", "a@@b", "abba", "a" * 3000, "日本" * 500, "x" * 200, "\x00", "ab" * 9000, "日" * 70]
    at, ids = own.encode(texts)
    found = [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    alike = [a == library.encode(t) for a, t in zip(found, texts, strict=True)]
    same = lambda a, t: sorted(a) == sorted(library.encode(t))  # noqa: E731  paths whose sums are equal but for rounding
    assert all(ok or kind == codec.UNIGRAM and same(a, t) for ok, a, t in zip(alike, found, texts, strict=True)) and sum(alike) >= len(texts) - 3


def test_long_units_are_the_library():
    """Units without spaces: cut where nothing reaches across, characters outside the vocabulary, one letter for long."""
    import sentencepiece

    library, pick = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL), random.Random(14)
    texts = ["a" * 30_000, "".join(pick.choices("abcdefghijklmnopqrstuvwxyzABCXYZ0189+/", k=30_000)), "".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(5_000)), "😀é" * 3_000]
    at, ids = codec.Codec(codec.read_model(SENTENCEPIECE_MODEL)).encode(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text), i


def test_warc(spark, tmp_path):
    long, short = "<p>" + "ü" * 100 + "</p>\r\n\r\nWARC/1.1\r\n", "x" * 99
    rows = [(8, "http://long", "<p>ä</p>\n" * 300_000), (3, "http://a", long), (1, "http://b\r\nWARC-Type: x", long), (2, None, short), (4, "u", short), (5, "u", None), (6, "u", ""), (None, "n", long), (7, "u", "y" * 100), (1, "again", long)]
    pages = spark.createDataFrame([(*r, "k", b"z") for r in rows], "page_id long, url string, html string, digest string, payload binary")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    found = sorted(((r.page_id, bytes(r.payload).decode(), r.record_type, r.refers_to, r.payload_digest) for r in warc.read_archive(spark, path).collect()), key=repr)
    want = [(i, h or "", "revisit" if h == long and i != 1 else "response", 1 if h == long and i != 1 else None, hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows]
    assert found == sorted(want, key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == 5  # each payload once
    records = [bytes(r.record) for r in warc.read_archive(spark, path).collect()]
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
    warc.export_warc(warc.read_archive(spark, path).coalesce(1), f"file://{tmp_path}/out")
    assert sorted(b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))) == sorted(b"".join(records))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"!")).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-2/records")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, f"{path}-2").collect()


def targets_brute(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = budget - sum(cap * sizes[s] for s in capped)
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else rest * weight[s] / total for s in order}
        capped |= over


def test_mixing(spark, table):
    pick = random.Random(8)
    rows = [(i, "w " * int(pick.paretovariate(1.2) * 20 % 5000), None, pick.choice(["a"] * 6 + ["b", "c", "é", None, "Z"])) for i in range(1500)]
    rows += [(1999, "word\n" * 300_000, None, "Z"), (2000, None, None, "a"), (2001, "", None, "b"), (None, "x y", None, "a"), (2500, "x y z", None, "a"), (2500, "x y z", None, "a")] + [(3000 + i, "same size", None, "hot") for i in range(9000)]
    docs = table(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    source = {}
    for i, t, _, s in rows:
        source.setdefault(i, s)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets_brute(sizes)
    taken, longest = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r["__id"]]
        assert r["__source_size"] == sizes[s] and r["__target"] == pytest.approx(want[s]) and 0 <= r["__copies"] <= 2
        taken[s] += r["__copies"] * r["__size"]
        longest[s] = max(longest[s], r["__size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s], (s, taken[s], want[s])
    again = {(r["__id"], r["__size"]): r["__copies"] for r in mixing.mix(docs.repartition(7)).collect() if r["__id"] != 2500}
    assert again == {(r["__id"], r["__size"]): r["__copies"] for r in got if r["__id"] != 2500}
    assert mixing.mix(table([])).count() == 0 and mixing.mix(table([(1, None), (2, "")])).count() == 2
    carried = mixing.mix(docs, carry=True)
    assert carried.count() == len(rows) and set(docs.columns) <= set(carried.columns)


def test_mixing_splits_rows_that_share_an_id(spark):
    """One id, or none, on very many rows of one source and size: no part is much above its rows, and the mix is the same in number."""
    rows = spark.range(100_000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL WHEN id % 4 = 1 THEN 7 ELSE id END AS __id", "'ss' AS skey", "3L AS size", "id AS row")
    dealt, counts = mixing.salted(rows.withColumn("hash", F.xxhash64("__id")).withColumn("salt", F.pmod("hash", F.lit(196))))
    assert dealt.count() == counts.agg(F.sum("here")).first()[0] == 100_000
    assert counts.agg(F.max("here")).first()[0] <= 2 * mixing.CELL_ROWS
    docs = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'a b c' AS text", "'s' AS source").unionAll(spark.range(50).selectExpr("id", "'a b'", "'t'"))
    got = mixing.mix(docs).groupBy("__source_size").agg(F.sum(F.col("__copies") * F.col("__size")).alias("taken"), F.first("__target").alias("target")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= 6 for r in got)


def test_quality_classifier(spark, table):
    pick = random.Random(9)
    good = [(i, " ".join(pick.choice(["the", "of", "and", "rain", "sun", "tree"]) for _ in range(pick.randint(5, 80)))) for i in range(300)]
    bad = [(1000 + i, " ".join(pick.choice(["BUY", "NOW!!", "###", "win", "the"]) for _ in range(pick.randint(5, 80)))) for i in range(100)]
    rows = [*good, *bad, (5000, None), (5001, ""), (None, "the rain")]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1000 + i, 0) for i in range(0, 100, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.resample(table(rows), labels, buckets=1000).collect()}
    share = 150 + 1
    assert sum(r.kept for r in got.values()) == round(len(rows) * share / (share + 50))
    assert sorted(r.place for r in got.values()) == list(range(len(rows)))
    kept_good, kept_bad = sum(got[i].kept for i, _ in good), sum(got[i].kept for i, _ in bad)
    assert kept_good >= 0.95 * len(good) and kept_bad <= 0.2 * len(bad)
    assert got[5000].log_weight == got[5001].log_weight == 0
    assert quality_classifier.resample(table([]), labels).count() == 0
    assert all(r.kept for r in quality_classifier.resample(table(rows), labels.limit(0)).collect())


def test_rates_have_one_multiplier_a_source(spark):
    """The solved rates against a bisection for each source; what meets the cap stays there."""
    pick = random.Random(22)
    cells = {(s, n): pick.randint(1, 40) for s in "abcd" for n in {int(pick.paretovariate(1.1) * 5) for _ in range(60)}}
    total = {s: sum(n * k for (x, n), k in cells.items() if x == s) for s in "abcd"}
    target = {s: share * total[s] for s, share in zip("abcd", (0.3, 1.0, 1.7, 2.0), strict=True)}
    rows = spark.createDataFrame([("s" + s, n, k) for (s, n), k in cells.items()] + [("sa", 0, 9)], "skey string, size long, n long")
    targets = spark.createDataFrame([("s" + s, total[s], float(target[s])) for s in total], "skey string, source_size long, target double")
    got = {(r.skey[1:], r.size): r.rate for r in mixing.tilted_rates(rows, targets, 2.0).collect()}
    assert got.pop(("a", 0)) == 0.0 and set(got) == set(cells)
    for s in "abcd":
        own = [(n, k) for (x, n), k in cells.items() if x == s]
        low, high = -50.0, 50.0
        for _ in range(200):
            middle = (low + high) / 2
            words = sum(n * k * min(2.0, np.exp(min(9.0, middle * n / 10))) for n, k in own)
            low, high = (middle, high) if words < target[s] else (low, middle)
        for n, _ in own:
            want = 2.0 if s == "d" else min(2.0, np.exp(min(9.0, high * n / 10)))
            assert got[s, n] == pytest.approx(want, rel=1e-6), (s, n)


def test_resampling_is_brute_force(spark, table):
    """Counts, ratios, keys and places, with ties, repeated ids, null ids and a very long text."""
    import xxhash

    pick = random.Random(23)
    rows = [(i, " ".join(pick.choice(["The", "of", "rain", "sun", "x"]) for _ in range(pick.randint(0, 30)))) for i in range(120)]
    rows += [(7, rows[7][1]), (7, "Other text"), (8, rows[8][1]), (None, "the rain"), (None, "the rain"), (500, None), (501, ""), (502, "word " * 20_000 + "rain")]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(None, 1), (7, None), (6, 1)]
    buckets = 97
    got = quality_classifier.resample(table(rows), spark.createDataFrame(labels, "doc_id long, quality int"), buckets=buckets).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = lambda w: int(quality_classifier.word_hashes(np.array([0, len(w.encode())]), np.frombuffer(w.encode(), np.uint8))[1][0])
    known = {}

    def grams(text):
        words = [known.setdefault(w, hashed(w)) for w in WORD.findall((text or "").translate(lower))]
        pairs = [int(quality_classifier.mixed(np.array([(a * 3 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(words[:2000], words[1:2001], strict=False)] if len(words) < 2000 else None
        if pairs is None:  # the long text repeats one pair
            pair = lambda a, b: int(quality_classifier.mixed(np.array([(a * 3 + b) % (1 << 64)], np.uint64))[0])
            pairs = [pair(words[0], words[1])] * (len(words) - 2) + [pair(words[-2], words[-1])]
        return collections.Counter(h % buckets for h in [*words, *pairs])

    good = {i for i, q in labels if q == 1 and i is not None}
    raw, target = np.ones(buckets), np.ones(buckets)
    for i, text in rows:
        for b, n in grams(text).items():
            raw[b] += n
            target[b] += n * (i in good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    noise = lambda i: ((0 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))
    keys = []
    for i, text in rows:
        own = grams(text)
        seed = xxhash.xxh64_intdigest(struct.pack("<i", 17), noise(i) if i is not None else 42)
        u = (seed % (1 << 52) + 0.5) / (1 << 52)
        weight = sum(n * ratio[b] for b, n in own.items())
        keys.append((i, own.total(), weight, weight - np.log(-np.log(u))))
    plain = lambda rs: sorted(((-1 if r[0] is None else r[0], r[1], round(r[2], 6), round(r[3], 6)) for r in rs))
    assert plain((r.doc_id, r.n_grams, r.log_weight, r.gumbel_key) for r in got) == plain(keys)
    placed = sorted(got, key=lambda r: r.place)
    assert [r.place for r in placed] == list(range(len(rows)))
    assert all((-a.gumbel_key, a.doc_id is None, a.doc_id or 0) <= (-b.gumbel_key, b.doc_id is None, b.doc_id or 0) for a, b in itertools.pairwise(placed))
    share = sum(q == 1 for _, q in labels) / sum(q is not None for _, q in labels)
    assert [r.place < round(len(rows) * share) for r in got] == [r.kept for r in got]
