"""The registered opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from freightlens.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.quality_rules import judge

    return judge(documents(spark, sf_dir))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM win JOIN twice USING (doc_id, g), range(0, 5) AS r(k) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM raw_lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, host, string_split(lower(regexp_replace(t, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), chr(10)) AS ls FROM d),
line AS (SELECT doc_id, host, generate_subscripts(ls, 1) AS pos, unnest(list_transform(ls, lambda x: trim(x, ' '))) AS l FROM norm),
near AS (SELECT *, lag(l) OVER o AS before, lead(l) OVER o AS after FROM line WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
held AS (SELECT doc_id, host, l, sum(len(string_split(l, ' '))) AS n, arg_min(row(coalesce(before, chr(1)), coalesce(after, chr(1))), pos) AS c FROM near WHERE l <> '' GROUP BY ALL),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
boiler AS (SELECT h.host, l FROM held h JOIN hosts USING (host) GROUP BY h.host, l HAVING count(*) >= 10 AND count(DISTINCT c) >= 0.5 * count(*) AND count(*) >= 0.01 * any_value(docs)),
gone AS (SELECT doc_id, sum(n) AS n FROM held JOIN boiler USING (host, l) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND (removed_words = 0 OR (n_words - removed_words >= 10 AND n_words - removed_words >= 0.3 * n_words)) AS kept
FROM m
"""


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.secret_scan import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.fingerprint import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.quality_model import score_quality

    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.lang_crf import predict

    return predict(documents(spark, sf_dir))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.lm_nce import score

    return score(documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.ngram_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=4, percent=85)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir))


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from freightlens.llm.sp_sampling import encode_samples

    return encode_samples(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freightlens.llm.phrases import collocations

    return collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
pieces AS (SELECT doc, lang, generate_subscripts(ps, 1) AS piece, unnest(ps) AS p FROM d),
lists AS (SELECT doc, lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT doc, lang, piece, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM lists),
near AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY doc, piece ORDER BY pos)),
f AS (SELECT lang, 1 AS k, w AS g, count(*) AS f FROM near GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2 AS g, count(*) FROM near WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 AS g, count(*) FROM near WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 AS g, count(*) FROM near WHERE w4 IS NOT NULL GROUP BY ALL),
often AS (SELECT * FROM f WHERE f >= 30),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS ws FROM often WHERE k > 1),
ways AS (SELECT lang, g, a, unnest(range(1, k)) AS j, ws, k FROM c),
halves AS (SELECT lang, g, a, j, array_to_string(ws[1:j], ' ') AS lg, array_to_string(ws[j + 1:k], ' ') AS rg FROM ways),
cuts AS (SELECT h.lang, h.g, a, j, b.f AS l, e.f AS r, (2000000::HUGEINT * a) // (b.f + e.f) AS score FROM halves h
  JOIN often b ON b.lang = h.lang AND b.g = h.lg JOIN often e ON e.lang = h.lang AND e.g = h.rg),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner2 AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS part FROM c, range(2, 4) AS x(m), range(1, 4) AS y(i) WHERE m < k AND i + m - 1 <= k),
longer AS (SELECT lang, part, max(a) AS most FROM inner2 GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN longer ON longer.lang = worst.lang AND longer.part = worst.g WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT lang, g AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from freightlens.llm.shared import table
    from freightlens.llm.token_align import align, pair_counts, weigh

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = align(documents(spark, sf_dir), *files, columns=("groups", "links"))
    aligned = table(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest, "links"), "links")
    return weigh(aligned, pair_counts(aligned))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from freightlens.llm.byte_bpe import digests, encode

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode(documents(spark, sf_dir), ranks), ranks)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_ngram_join, op3_secret_scans, op4_packing, op5_quality_classifier, op6_quality_rules,
        op7_line_dedup, op8_sentencepiece_sampling, op9_fingerprints, op10_language_id, op11_phrases, op12_token_alignment, op13_byte_bpe,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op11_phrases": OP11_SQL}
