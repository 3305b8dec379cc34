"""Queries over the operators of this subpackage, one for each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.lines import dedup_lines

    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 0: rated low; 1: rated high but toxic; 2: rated high and clean."""
    from tenderlake.llm.grading import grade_documents

    labels = read_table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return grade_documents(read_table(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")))


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False).drop("ids")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.pii import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents"), redact=False).drop("redacted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``n_near`` of the search whose queries are the documents whose id is divisible by 100."""
    from tenderlake.llm.fingerprints import count_near, fingerprint_documents

    prints = fingerprint_documents(read_table(spark, sf_dir, "documents"))
    return count_near(prints, F.col("doc_id") % 100 == 0).drop("simhash")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.language import identify_language

    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    got = identify_language(docs, ~held_out)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.suffixes import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.divergence import audit_sources

    return audit_sources(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has an even checksum are verified against a text without line breaks."""
    from tenderlake.llm.manifest import folded, leaf_of, merkle_manifest, proof_digest

    docs, fields = read_table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    changed = leaf_of([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields])
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    got = merkle_manifest(docs, suspect=F.when(tampered, changed).otherwise(leaf_of([F.col(c) for c in fields])))
    out = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("suspect_leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenderlake.llm.toxicity import score_toxicity

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    got = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out)
    return got.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_minhash, op3_best_fit_packing, op4_quality_classifier, op5_bpe_roundtrip, op6_personal_data, op7_quality_rules, op8_simhash, op9_language_id, op10_suffix_repeats, op11_source_divergence, op12_merkle_manifest, op13_toxicity)}
WORDS = r"list_filter(regexp_split_to_array(%s, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: For op12: the leaf of a row with a given text, and the checksum of its id, bit by bit.
LEAF = "sha256(concat(%s))" % ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "txt"))
CHECKSUM = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""
SQL: dict[str, str] = {
    "op2_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS % LOWER} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
    SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op7_quality_rules": f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), w AS (SELECT *, {WORDS % 't'} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    k AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5), m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM k),
    r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM m, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY 1),
    c AS (SELECT w.doc_id, source, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols > 0.1::DOUBLE * n_words OR n_dup_lines > 0.3::DOUBLE * len(string_split(t, chr(10))) AS soft FROM c),
    h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS failed FROM f WHERE source IS NOT NULL GROUP BY 1),
    a AS (SELECT least(greatest(sum(failed) / sum(n), 0.001), 0.999) AS mean, coalesce(var_samp(failed / n), 0) AS var, avg(1 / n) AS inv FROM h),
    b AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-6) - 1, 2.0), 1e4) AS s FROM a), p AS (SELECT source, n, s, mean, (failed + s * mean) / (n + s) AS rate FROM h, b),
    v AS (SELECT source, round(rate, 6) AS rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)) > least(3 * mean, 1.0) AS bad FROM p)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(bad, false) AND (base_failed OR soft)) AS kept, f.source AS host, rate AS host_rate FROM f LEFT JOIN v ON v.source = f.source""",
    "op11_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    o AS (SELECT i, lang, source, unnest(w) AS t FROM d), s AS (SELECT DISTINCT lang, source FROM d), k AS (SELECT lang, t FROM o GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
    c AS (SELECT o.lang, source, t, count(*) AS n FROM o JOIN k USING (lang, t) GROUP BY ALL), g AS (SELECT s.lang, s.source, k.t, coalesce(n, 0)::HUGEINT AS n FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.t = k.t),
    p AS (SELECT lang, source, t, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM g),
    l AS (SELECT lang, t, sum(n) AS n FROM g GROUP BY 1, 2), q AS (SELECT lang, t, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
    x AS (SELECT a.lang, a.source, b.source AS item, coalesce(v, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL) y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source),
    r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM x
    UNION ALL SELECT lang, source, 'term', t, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(t)) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op12_merkle_manifest": f"""WITH RECURSIVE x AS (SELECT *, text AS txt FROM documents), y AS (SELECT doc_id, source, lang, n_chars, CASE WHEN {CHECKSUM} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS txt, {LEAF} AS leaf FROM x),
    d AS (SELECT doc_id, source, leaf, {LEAF} AS bad, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM y),
    t AS (SELECT 0 AS lvl, source, i, n, leaf AS h FROM d UNION ALL SELECT lvl + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lvl, source, i // 3, n),
    s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (SELECT 0 AS lvl, i, n, subroot AS h FROM s UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
    a AS (SELECT lvl, source, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM t WHERE n > 1 WINDOW w AS (PARTITION BY lvl, source, i // 3 ORDER BY i)),
    b AS (SELECT lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM u WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 3 ORDER BY i)),
    k AS (SELECT d.source, d.i, list({{'l': l, 'r': r}} ORDER BY lvl) AS steps FROM d JOIN a ON a.source IS NOT DISTINCT FROM d.source AND a.i = d.i // (3 ** lvl)::BIGINT GROUP BY 1, 2),
    m AS (SELECT s.source, list({{'l': l, 'r': r}} ORDER BY lvl) AS steps FROM s JOIN b ON b.i = s.i // (3 ** lvl)::BIGINT GROUP BY 1),
    p AS (SELECT doc_id, leaf, bad, subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(k.steps, []), coalesce(m.steps, [])) AS steps FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.i = d.i LEFT JOIN m ON m.source IS NOT DISTINCT FROM d.source),
    f AS (SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(steps, lambda z: z.l || z.r)), 'string_agg', '')) AS proof_sha256, list_reduce(list_concat([{{'l': bad, 'r': ''}}], steps), lambda v, z: {{'l': sha256(z.l || v.l || z.r), 'r': ''}}).l AS folded_root FROM p)
    SELECT *, folded_root = root AS verified FROM f""",
}
