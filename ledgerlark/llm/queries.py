"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chunks, decontaminate, language, lines, neighbours, pieces, pseudonyms, quality, secrets, simhash, toxicity, whitening
from .common import fold, read, shared_dir

#: The vocabulary file that op6 and the pipeline encode with.
PIECE_MODEL = "piece_bpe_32k.model"
#: The byte-level vocabulary file that op12 aligns with it.
BYTE_MODEL = "byte_bpe_50k.json"
#: The key of the registered query's pseudonyms; real runs give their own.
PSEUDONYM_KEY = "an example key"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold("doc_id", 5) != 0))
    found = quality.scored(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeats(read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a ledger of its own for each run: the whole table is scanned
    found = secrets.scan_into(f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", read(spark, sf_dir, "documents"), "doc_id", "text")
    counts = [secrets.count("found", rule).alias(f"n_{rule.kind}") for rule in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.listed("found", secrets.BASE), 256).alias("base_sha256"), secrets.listed("found", secrets.RULES).alias("spans"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_duplicates(read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents"), piece_model(), ["doc_id"], with_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    found = toxicity.scored(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("bigint").alias("n_offending"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    n = lambda *kinds: F.size(F.filter("kinds", lambda k: k.isin(*kinds))).cast("bigint")
    counts = {"n_mail": ["mail"], "n_address": ["address"], "n_date": ["iso_date", "day_date"], "n_social": ["social"], "n_card": ["card"], "n_phone": ["phone"]}
    return found.select("doc_id", *[n(*kinds).alias(name) for name, kinds in counts.items()], F.col("clean_text").alias("text"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(fold("doc_id", 4) != 2))
    found = language.predicted(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignment.aligned(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL), piece_model(), ["doc_id"], with_groups=False)
    return found.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_secrets": op3_secrets,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_pieces": op6_pieces,
    "op7_toxicity": op7_toxicity,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_neighbours": op13_neighbours,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _spans_sql(rule: secrets.Rule) -> str:
    """DuckDB SQL for the spans of a rule: lengths of matches and of what stands between them, summed up."""
    pattern, vs = rule.pattern.replace("'", "''"), f"regexp_extract_all(text, '{rule.pattern.replace(chr(39), chr(39) * 2)}', {rule.group})"
    lead = "0"
    if rule.before:  # the character before a match is read with it and taken off its start
        pattern, lead = f"(^|[^{rule.before[1:]})({pattern})", "len(ms[m.i]) - len(vs[m.i])"
        vs = f"regexp_extract_all(text, '{pattern}', 2)"
    return f"""SELECT doc_id, m.start + {lead} AS s, m.start + len(ms[m.i]) AS e FROM (
        SELECT doc_id, ms, vs, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{'i': i,
            'start': CAST(list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: len(g))), 0) AS BIGINT)}})) AS m
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, {vs} AS vs, string_split_regex(text, '{pattern}') AS gaps
              FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE regexp_matches(text, '{pattern}')))
        WHERE len(vs[m.i]) >= {rule.least}"""


ORACLE_SQL: dict[str, str] = {
    "op3_secrets": f"""
        WITH found AS ({" UNION ALL ".join(f"SELECT doc_id, s, {i} AS k, '{r.kind}:' || s || ':' || e AS shown FROM ({_spans_sql(r)})" for i, r in enumerate(secrets.RULES))}),
        own AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))},
            string_agg(shown, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(shown, ',' ORDER BY s, k) AS spans FROM found GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN own USING (doc_id)""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op5_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
               FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
               FROM d, sizes WHERE len(w) >= n),
        m AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN bw USING (n, gram)),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
