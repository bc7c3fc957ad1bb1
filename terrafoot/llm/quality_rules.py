"""Quality rules: text statistics, and divergence from language references.

Each text's histogram over character classes and over the common words of its language is compared
with the histogram of all texts of that language by Jensen-Shannon distance. Texts too short for a
histogram to mean much are not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafoot.llm.common import WORD, buffers, cut, local, pieces
from terrafoot.llm.words import PIECE, SPACE, mixed, word_hashes

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words in a list, and the least number of words of a language with a reference of its own: a minimum-length guard,
#: since fewer words make no reference, only an echo of a few texts.
COMMON, LEAST_REFERENCE = 50, 5_000
#: Guards: texts with fewer words (words histogram) or code points (classes histogram) are not judged.
LEAST_WORDS, LEAST_CHARS = 100, 200
#: Common words that the reference lets expect in a text of its length; below this the words histogram says little.
LEAST_EXPECTED = 20
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a text that stays: of words as a share of the distance that
#: a text without any common word has to the same reference, of classes as such.
WORD_SHARE, CLASS_DISTANCE = 0.90, 0.30

#: Classes of characters by first UTF-8 byte: vowel, other small letter, capital, digit, white space,
#: punctuation, Latin letter beyond ASCII, anything else.
CLASSES = 8


def _class_table() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)
    kind[ord("a") : ord("z") + 1] = 1
    kind[[ord(c) for c in "aeiou"]] = 0
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[SPACE] = 4
    kind[0x80:0xC0] = 255
    kind[0xC0:] = 7
    kind[0xC3:0xCA] = 6
    return kind


KIND = _class_table()
IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(firsts: np.ndarray, words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text the number of words inside a ``window``-word run that occurs twice or more in it."""
    n, texts = len(words), len(firsts) - 1
    if n < window:
        return np.zeros(texts, np.int64)
    with np.errstate(over="ignore"):
        gram = words[: n - window + 1].copy()
        for j in range(1, window):
            gram = mixed(gram * np.uint64(3) + words[j : n - window + 1 + j])
        doc = np.repeat(np.arange(texts), np.diff(firsts))[: len(gram)]
        valid = np.flatnonzero(np.arange(len(gram)) + window <= firsts[doc + 1])
        key = mixed(gram[valid] ^ mixed(doc[valid].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    spot = valid[again]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, spot, 1)
    np.add.at(cover, spot + window, -1)
    return _sums(np.cumsum(cover[:-1]) > 0, firsts)


def _measures(batch_lists: list[tuple[str, list[str]]]):
    """Statistics and histograms per text; the lists of common words are (language, words), '' for all texts.

    A text without a list of its own goes by the list that holds most of its words, '' at a tie. ``pooled`` is
    every text's histogram over the list ''. Lists are kept as sorted (list, word) pairs, so work and memory
    follow their words, not languages times words.
    """
    code = {lang: i for i, (lang, _) in enumerate(batch_lists)}
    pooled = code.get("", 0)
    vocab = sorted({w for _, ws in batch_lists for w in ws})
    rank = {w: i for i, w in enumerate(vocab)}
    pairs = sorted((rank[w], i, j) for i, (_, ws) in enumerate(batch_lists) for j, w in enumerate(ws))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [w.encode() for w in vocab]
        at = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
        _, hashes = word_hashes(at, np.frombuffer(b"".join(raw), np.uint8))
        order = np.argsort(hashes)
        known, size = hashes[order], len(batch_lists)
        of_word, of_list, place = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        keys = of_word * size + of_list
        first = np.searchsorted(of_word, np.arange(len(vocab) + 2))  # the pairs of each word; none of the last, which stands for all others

        def slot(which, word):
            if not len(keys):
                return np.full(len(word), COMMON)
            wanted = word * size + which
            spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[spot] == wanted, place[spot], COMMON)

        for batch in batches:
            at, data = buffers(batch.column("text"))
            langs = batch.column("ref").to_pylist()
            for s, e in pieces(at, PIECE):
                here, part = at[s : e + 1] - at[s], data[at[s] : at[e]]
                n = e - s
                firsts, exact = word_hashes(here, part, lower=False)
                _, folded = word_hashes(*buffers(pc.utf8_lower(batch.column("text")[s:e])), lower=False)
                n_words = np.diff(firsts)
                lead = (part & 0xC0) != 0x80
                kind = KIND[part]
                owner = np.repeat(np.arange(n), np.diff(here))
                seen = kind != 255
                classes = np.bincount(owner[seen] * CLASSES + kind[seen], minlength=n * CLASSES).reshape(n, CLASSES)
                dup = []
                for text in batch.column("text")[s:e].to_pylist():
                    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
                    dup.append(len(lines) - len(set(lines)))
                if len(known):
                    spot = np.minimum(np.searchsorted(known, folded), len(known) - 1)
                    word = np.where(known[spot] == folded, order[spot], len(vocab))
                else:
                    word = np.zeros(len(folded), np.int64)
                doc = np.repeat(np.arange(n), n_words)
                lang = np.array([code.get(x, pooled) for x in langs[s:e]], np.int64)
                loose = lang == pooled
                if loose.any():
                    hit = np.flatnonzero((word < len(vocab)) & loose[doc])
                    held = first[word[hit] + 1] - first[word[hit]]
                    spot = np.repeat(first[word[hit]], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
                    pair, counts = np.unique(np.repeat(doc[hit], held) * size + of_list[spot], return_counts=True)
                    best = np.lexsort((pair % size != pooled, -counts, pair // size))  # a text's lists by words held, the pooled one first
                    own, start = np.unique(pair[best] // size, return_index=True)
                    lang[own] = pair[best][start] % size
                over = lambda which: np.bincount(doc * (COMMON + 1) + slot(which, word), minlength=n * (COMMON + 1)).reshape(n, -1)
                ints = lambda x: pa.array(np.asarray(x, np.int64))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[s:e], batch.column("ref")[s:e], ints(n_words), ints(_sums(~SPACE[part] & lead, here)), ints(_sums(IS_SYMBOL[part], here)), ints(dup), ints(repeated_words(firsts, exact)), ints(_sums(lead, here)), lists(classes), pa.array([batch_lists[i][0] for i in lang.tolist()], pa.string()), lists(over(lang[doc])), lists(over(pooled))],
                    ["doc_id", "ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_points", "classes", "list", "words", "pooled"],
                )

    return run


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = COMMON) -> list[tuple[str, list[str]]]:
    """The ``most`` most frequent words of each language of LEAST_REFERENCE words or more, and of all texts under ''.

    Counted over all texts, in lower case; a word holds a letter, and ties go to the smaller word. Only the lists
    come to the driver: ``most`` words for each language.
    """
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)))
    counts = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("ref"), word.alias("word")).groupBy("ref", "word").count()
    counts = cut(counts, "word-counts")
    own = counts.groupBy("ref").agg(F.sum("count").alias("n")).where((F.col("n") >= LEAST_REFERENCE) & (F.col("ref") != "")).select("ref")
    lettered = counts.where(F.col("word").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("count"), "word"))
    firsts = lettered.withColumn("rank", rank).where(F.col("rank") <= most)  # each task cuts its part of a language down to the list's size first
    total = lettered.groupBy("word").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "word").limit(most)
    lists: dict[str, list[tuple[int, str]]] = {"": [(i, r["word"]) for i, r in enumerate(total.collect())], **{r["ref"]: [] for r in own.collect()}}
    for r in firsts.join(own, "ref").collect():
        lists[r["ref"]].append((r["rank"], r["word"]))
    return [(x, [w for _, w in sorted(ws)]) for x, ws in sorted(lists.items())]


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two distributions of equal length; 0 if either has no or null shares."""
    zero = F.lit(0.0)

    def half(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(zero)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a)), zero, lambda a, v: a + v)
    return F.coalesce(F.sqrt(F.greatest(zero, total / 2)), zero)


def _shares(counts: Column, total: Column) -> Column:
    """Counts as shares of ``total``, a column of its own that is not summed up anew for each of them; null ones of nothing."""
    return F.transform(counts, lambda v: v / F.nullif(total, F.lit(0)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance.

    A null text has no words and fails the base rules. A text of no language, or of one with fewer than
    LEAST_REFERENCE words, is held against the classes of all texts together, and against the words of the
    list that holds most of its own: a language's, or at a tie that of all texts. Repeated rows are judged
    one by one; an empty table gives no rows; texts of any length are read whole, in slices of rows.
    Reference histograms are sums over all texts, combined map-side; one row per language.

    A text without common words has the same distance to its reference whatever else it holds; the
    word rule's bound is a share of that, so such a text fails at any coverage of the list.
    """
    lists = common_words(docs, text_col, lang_col)
    named = local(docs.sparkSession, pa.schema({"ref": pa.string()}), [(x,) for x, _ in lists if x])
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = own.join(F.broadcast(named), F.col("lang") == F.col("ref"), "left").select("doc_id", F.coalesce("ref", F.lit("")).alias("ref"), "text")  # one name for each language
    schema = "doc_id long, ref string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_points long, classes array<long>, list string, words array<long>, pooled array<long>"
    found = cut(rows.mapInArrow(_measures(lists), schema), "measures")
    at = lambda c, n: [F.sum(F.element_at(c, i + 1)).alias(f"{c}{i}") for i in range(n)]
    sums = found.groupBy("ref").agg(F.sum("n_words").alias("w"), F.sum("n_points").alias("p"), *at("classes", CLASSES), *at("words", COMMON + 1), *at("pooled", COMMON + 1))
    shares = lambda c, n, total: _shares(F.array(*[F.col(f"{c}{i}") for i in range(n)]), F.col(total))
    each = sums.where("ref != ''").select("ref", shares("classes", CLASSES, "p").alias("all_classes"), shares("words", COMMON + 1, "w").alias("all_words"))
    total = sums.agg(*[F.sum(c).alias(c) for c in sums.columns if c != "ref"])  # all texts, for those without a reference of their own
    total = total.select(F.lit("").alias("ref"), shares("classes", CLASSES, "p").alias("all_classes"), shares("pooled", COMMON + 1, "w").alias("all_words"))
    sums = cut(each.unionByName(total), "references")
    strange = F.transform("all_words", lambda v, i: F.when(i == COMMON, 1.0).otherwise(0.0))  # a text without common words
    by_words = cut(sums.select(F.col("ref").alias("list"), "all_words", js_distance(strange, F.col("all_words")).alias("strange"), (1 - F.element_at("all_words", -1)).alias("covered")), "references")
    judged = found.join(F.broadcast(sums.select("ref", "all_classes")), "ref").join(F.broadcast(by_words), "list").withColumns({  # one row for each language
        "class_distance": js_distance(_shares(F.col("classes"), F.col("n_points")), F.col("all_classes")),
        "word_distance": js_distance(_shares(F.col("words"), F.col("n_words")), F.col("all_words")),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    few = (F.col("n_words") < LEAST_WORDS) | (F.col("n_words") * F.col("covered") < LEAST_EXPECTED) | F.col("covered").isNull()
    near = ((F.col("n_points") < LEAST_CHARS) | (F.col("class_distance") <= CLASS_DISTANCE)) & (few | (F.col("word_distance") <= WORD_SHARE * F.col("strange")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance")
