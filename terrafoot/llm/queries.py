"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafoot.llm import byte_bpe
from terrafoot.llm.common import WORD, table
from terrafoot.llm.exact_dedup import exact_dedup
from terrafoot.llm.fill_in_middle import fill_in_middle
from terrafoot.llm.language_id import fit, held_out, identify
from terrafoot.llm.license_scan import LEAST_DICE, NOTICES, anchors, license_scan
from terrafoot.llm.line_dedup import line_dedup
from terrafoot.llm.mixing import mix
from terrafoot.llm.near_dedup import near_groups
from terrafoot.llm.periodic_runs import periodic_runs, strongest
from terrafoot.llm.quality_classifier import resample
from terrafoot.llm.quality_rules import quality_rules
from terrafoot.llm.sentencepiece_codec import encode
from terrafoot.llm.warc import warc_round_trip

#: A parameter of the queries that tokenize: any ``.model`` file that every machine can read.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The same for the rank file of byte-level BPE, and the fixed pattern that splits texts before its merges.
BYTE_BPE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(table(spark, sf_dir, "documents"), k=2, similarity=80)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan(table(spark, sf_dir, "documents"))
    return rows.withColumn("licenses", F.array_join("licenses", ","))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


def _periodic(id: Column, text: Column) -> Column:
    """The contract's texts: one in ten repeats its words from a place on, both by the id's checksum."""
    h = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        words = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, F.get(w, i.cast("int"))).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(words, " ")).otherwise("")

    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))  # one element, so that words are found once
    return F.when(h % 10 == 0, F.transform(words, rewritten)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = periodic_runs(docs.select("doc_id", _periodic(F.col("doc_id"), F.col("text")).alias("text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = rows.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE_RANKS, BYTE_BPE_PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+(?:[.\-][\p{{L}}\p{{N}}]+)*')"
_BIGRAMS = "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'{}'".format(x.replace("'", "''")) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def _license_sql() -> str:
    """Lines with a rare bigram, and runs at its place, scored and thinned out by one pass over a text's matches, best first."""
    places = []
    for license, template in NOTICES.items():
        words = re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", template.lower())  # templates are ASCII
        places += [(license, b, i) for b, i in anchors(words, list(dict.fromkeys(map(" ".join, itertools.pairwise(words)))), LEAST_DICE)]
    return f"""
        WITH t AS (SELECT license, len(w) AS length, {_BIGRAMS} AS b FROM (SELECT license, {_WORDS.format("template")} AS w FROM (VALUES {_values(list(NOTICES.items()))}) AS v(license, template))),
        a(license, bigram, place) AS (VALUES {_values(places)}),
        d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
        l AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
        w AS (SELECT row, doc_id, pos, {_WORDS.format("line")} AS w FROM l),
        f AS (SELECT *, CAST(coalesce(sum(len(w)) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM w),
        n AS (SELECT row, doc_id, pos, first + unnest(range(0, len(w))) AS spot, unnest(w) AS word FROM f),
        g AS (SELECT row, doc_id, pos, spot, word || ' ' || lead(word) OVER (PARTITION BY row ORDER BY spot) AS bigram, lead(pos) OVER (PARTITION BY row ORDER BY spot) AS next_pos FROM n),
        h AS (SELECT g.row, g.doc_id, g.pos, g.next_pos, a.license, greatest(0, g.spot - a.place) AS first FROM g JOIN a ON g.bigram = a.bigram),
        whole AS (SELECT DISTINCT h.row, h.doc_id, h.pos, h.license, f.first, f.w FROM h JOIN f ON h.row = f.row AND h.pos = f.pos WHERE h.next_pos = h.pos),
        texts AS (SELECT row, list(word ORDER BY spot) AS ws, list(pos ORDER BY spot) AS ls FROM n WHERE row IN (SELECT row FROM h) GROUP BY row),
        runs AS (SELECT DISTINCT h.row, h.doc_id, texts.ls[h.first + 1] AS pos, h.license, h.first, texts.ws[h.first + 1 : h.first + t.length] AS w FROM h JOIN texts ON h.row = texts.row JOIN t ON h.license = t.license),
        b AS (SELECT row, doc_id, pos, license, first, first + len(w) AS last, {_BIGRAMS} AS b FROM (SELECT * FROM whole UNION SELECT * FROM runs)),
        m AS (SELECT DISTINCT row, doc_id, pos, b.license, first, last, 2.0 * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice
              FROM b JOIN t ON b.license = t.license WHERE 200 * len(list_intersect(b.b, t.b)) >= {LEAST_DICE} * (len(b.b) + len(t.b))),
        k AS (SELECT row, doc_id, list([struct_pack(first := first, last := last, license := license, dice := CAST(dice AS DOUBLE))] ORDER BY dice DESC, first - last, license, first, last, pos) AS found FROM m GROUP BY row, doc_id),
        s AS (SELECT row, doc_id, unnest(list_reduce(found, lambda y, x: CASE WHEN len(list_filter(y, lambda z: z.first < x[1].last AND x[1].first < z.last)) > 0 THEN y ELSE list_concat(y, x) END)) AS m FROM k)
        SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT m.license, ',' ORDER BY m.license) AS licenses, round(max(m.dice), 6) AS best_dice FROM s GROUP BY row, doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> r.last, false) AS dropped FROM k LEFT JOIN r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes < 100 OR page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes < 100 OR page_id = holder THEN NULL ELSE holder END AS refers_to
        FROM r""",
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS squeezed FROM documents),
        g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY squeezed ORDER BY chars DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY squeezed) AS group_size, sha256(squeezed) AS text_sha256 FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                     CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                          WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
        p AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
