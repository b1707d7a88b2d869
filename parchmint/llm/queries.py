"""Queries opN_<name> over the documents and pages tables, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.quality_rules import quality_rules

    docs = table(spark, sf_dir, "documents")
    found = quality_rules(docs, docs, table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.line_dedup import drop_spread_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_spread_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op4_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.html_main import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from parchmint.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.secrets import secret_spans

    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.simhash import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    from parchmint.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    import public_tokenizers

    from parchmint.llm.word_tokens import token_counts

    found = token_counts(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), limit)
    return found.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > limit)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.vector_codes import vector_codes

    found = vector_codes(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from parchmint.llm.token_files import written_and_read

    return written_and_read(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_main": op4_html_main,
    "op5_packing": op5_packing,
    "op6_quality_model": op6_quality_model,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_files": op13_token_files,
}


def _codes_sql(rounds: int = 4) -> str:
    """Plain comparison of every part with every entry, round by round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
            SELECT a.row, a.p, min((list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) AS best
            FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY a.row, a.p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
            WITH summed AS (SELECT n.p, n.best[2] AS e, i, CAST(floor(sum(a.v[i]) / count(*)) AS BIGINT) AS x
                            FROM near{k} n JOIN parts a ON a.row = n.row AND a.p = n.p, unnest(range(1, len(a.v) + 1)) u(i) GROUP BY 1, 2, 3),
                 moved AS (SELECT p, e, list(x ORDER BY i) AS v FROM summed GROUP BY p, e)
            SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN moved m ON m.p = b.p AND m.e = b.e)""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT row, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM kept, range(4) t(p)
        ), book0 AS MATERIALIZED (SELECT p, row - 1 AS e, v FROM parts WHERE row <= 256),
        {", ".join(steps)},
        coded AS (
            SELECT k.vec_id, k.label, string_agg(printf('%02x', n.best[2]), '' ORDER BY n.p) AS code, CAST(sum(n.best[1]) AS BIGINT) AS error
            FROM kept k JOIN near{rounds} n ON n.row = k.row GROUP BY k.row, k.vec_id, k.label
        ), digest AS (
            SELECT sha256(string_agg(CAST(v[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
            FROM book{rounds}, unnest(range(1, len(v) + 1)) u(i)
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
    """


ORACLES: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op12_lexical_search": r"""
        WITH split AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents WHERE text IS NOT NULL
        ), size AS (SELECT (count(*) FILTER (WHERE len(terms) > 0))::BIGINT AS docs, sum(len(terms))::BIGINT AS terms FROM split),
        postings AS (
            SELECT row, doc_id, term, count(*)::BIGINT AS tf, any_value(75 + (25 * n * size.docs) // size.terms)::BIGINT AS m
            FROM (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM split), size GROUP BY row, doc_id, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(size.docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, size GROUP BY term
        ), wanted AS (
            SELECT item, item_id, term, count(*)::BIGINT AS uses FROM (
                SELECT row_number() OVER () AS item, item_id,
                       unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark) GROUP BY item, item_id, term
        ), scored AS (
            SELECT item, item_id, row, doc_id, sum(uses * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM wanted JOIN postings USING (term) JOIN weights USING (term) GROUP BY item, item_id, row, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20
    """,
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents WHERE text IS NOT NULL
        ), spread AS (
            SELECT line, count(DISTINCT source) AS sites, min((doc_id, pos)) AS first
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') AND doc_id IS NOT NULL GROUP BY line
        ), judged AS (
            SELECT l.doc_id, l.pos, l.line, coalesce(s.sites >= 5 AND s.first <> (l.doc_id, l.pos), false) AS gone
            FROM lines l LEFT JOIN spread s USING (line)
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
        FROM judged GROUP BY doc_id
    """,
}
