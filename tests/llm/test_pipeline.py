"""The pipeline's stages against brute force on the smallest tables, and its queries against SQL."""

import collections
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from test_entry import DATA, compared  # noqa: E402

import corpus_pipeline  # noqa: E402
from terrafoot.llm.common import cut, table  # noqa: E402
from terrafoot.llm.language_id import fit, held_out, identify, recognised  # noqa: E402
from terrafoot.llm.queries import SENTENCEPIECE_MODEL  # noqa: E402
from test_dedup import WORD, lines_brute, near_brute  # noqa: E402
from test_texts import targets_brute  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_line_dedup", "op6_warc", "op8_exact_dedup", "op11_fill_in_middle"])
def test_query_matches_sql(spark, name):
    found, want = compared(spark, name)
    assert found == want and found


def test_stages(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    docs, seen = table(spark, str(DATA), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, str(DATA)), f"test-{name}")
        seen[name] = docs
        if name == "language_id":
            model = fit(before, ~held_out() & F.col("doc_id").isNotNull())
            want = {r.doc_id for r in identify(before, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
            assert docs.columns == before.columns and {r.doc_id for r in docs.collect()} == want
        if name == "line_dedup":
            want = {i: text for i, _, dropped, text in lines_brute([(r.doc_id, r.text) for r in before.collect()]) if not dropped or text.split()}
            assert {r.doc_id: r.text for r in docs.collect()} == want
        if name == "near_dedup":
            want = {i for i, _, c in near_brute([(r.doc_id, r.text) for r in before.collect()], 5) if i == c}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "mixing":
            assert docs.columns == before.columns
            assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
            sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
            for rows, into in ((before, sizes), (docs, taken)):
                for r in rows.collect():
                    n = len(WORD.findall(r.text or ""))
                    into[r.source] += n
                    longest[r.source] = max(longest[r.source], n)
            for source, target in targets_brute(sizes).items():
                assert abs(taken[source] - target) <= 2 * longest[source], source
        if name == "sentencepiece":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.ids == library.encode(texts[r.doc_id]) for r in docs.collect())
    assert docs.count() == seen["mixing"].count() and docs.where("NOT round_trip").count() == 0


def test_stages_on_odd_rows(spark):
    """Null texts, ids, languages and sources, repeated rows, columns with clashing names; and no rows at all."""
    words = lambda i: " ".join(f"{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}{'rstuvwxy'[j % 8]}e{'aeiou'[j % 5]}" for j in range(30))
    rows = [(i, words(i), "en" if i % 3 else None, "s" if i % 2 else None, None) for i in range(40)]
    rows += [(None, words(50), "en", "s", 1), (None, None, None, None, None), (60, None, "en", "s", 0), (61, "", None, None, 0), (62, "12 !!", "en", "s", 6), (5, words(5), "en", "s", 7), (5, words(5), "en", "s", 7)]
    odd = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, size long, kept string, ids string")
    empty = odd.limit(0)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = odd
        odd = cut(stage(spark, odd, ""), f"test-odd-{name}")
        counts.append(odd.count())
        if name != "sentencepiece":
            assert odd.columns == before.columns, name
        empty = cut(stage(spark, empty, ""), f"test-empty-{name}")
        assert empty.count() == 0 and empty.columns == odd.columns, name
        if name == "language_id":
            assert {r.doc_id for r in odd.collect()} == {None, *range(40)} and odd.where("text IS NULL").count() == 0
        if name == "near_dedup":
            assert odd.where("doc_id = 5").count() == 1 and odd.where("doc_id IS NULL").count() == 1
    assert counts[0] == 43 and counts[2] == 41 and odd.where("NOT round_trip").count() == 0 and {r.doc_id for r in odd.collect()} <= {None, *range(40)}
    low = [(i, f"{i} qqq", "ab"[i % 2], "s", 0) for i in range(60)]  # equal texts in two languages: no score reaches one half by much
    unsure = spark.createDataFrame(low, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, unsure, "").collect()}
    model = fit(unsure, ~held_out())
    assert kept == {r.doc_id for r in identify(unsure, model).collect() if r.score >= 0.5} and model.languages == ["a", "b"]
    scores = {r.doc_id: r.score for r in identify(unsure, model).collect()}
    for least in (0.5, sorted(scores.values())[30], 1.01):
        assert {r.doc_id for r in recognised(unsure, model, least=least).collect()} == {i for i, x in scores.items() if x >= least}
