"""The contract queries of the ten operators: ``QUERIES`` and, where SQL can express them, ``ORACLE``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contentsort import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).drop("h")


ORACLE["op4_content_sort"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


@query
def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")


@query
def op9_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: (verdict, host, path prefix)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import by_id, top_k

    return top_k(table(spark, sf_dir, "embeddings"), by_id(100))


ORACLE["op7_sorted_lists"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op6_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


@query
def op10_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link_documents

    return link_documents(table(spark, sf_dir, "documents")).drop("h", "group")


@query
def op8_fm_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import remove_repeats

    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import collapse, longest_runs

    return longest_runs(collapse(table(spark, sf_dir, "documents"), echo=True))


@query
def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .transducer import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op13_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress, with_label_errors

    codes, book = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of assignment and means; ``b`` tables are codebooks, ``a`` tables have each part's entry and distance."""
    near = "SELECT vec_id, label, p.part, min_by(entry, (d, entry)) AS entry, min(d) AS d, any_value(v) AS v FROM (SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {b} b USING (part)) p GROUP BY vec_id, label, p.part"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(b=f'b{k}')})")
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT part, entry, k, floor(sum(v[k])::DOUBLE / count(*))::BIGINT AS x FROM a{k}, range(1, len(v) + 1) r(k) GROUP BY ALL), "
                f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, entry, list(x ORDER BY k) AS v FROM m{k} GROUP BY ALL) n USING (part, entry))"
            )
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM e, range({parts}) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries})),
{", ".join(steps)},
c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c
"""


ORACLE["op13_gnat_codes"] = _codes_sql()


# ---- columns of op2 and op6 that SQL can express


@query
def url_rule_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and given rule of every page's URL."""
    from .urlrules import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule")


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


ORACLE["url_rule_columns"] = f"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])))} END AS rule FROM p
"""


@query
def base_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of each kind in every text."""
    from .pii import KINDS, base_spans
    from .shared import texts

    docs = texts(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", *[F.size(base_spans(F.col("text"), k)).cast("long").alias(f"n_{k}") for k in KINDS])


ORACLE["base_span_counts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, t,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards,
  list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones,
  list_transform(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_transform(string_split(x, '.'), lambda y: ltrim(y, '0'))) AS ips FROM d)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(ips, lambda x: len(list_filter(x, lambda y: length(y) > 3 OR coalesce(try_cast(left(y, 3) AS INTEGER), 0) > 255)) = 0)) AS n_ip,
  len(list_filter(cards, lambda g: length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(g)), lambda i: CASE WHEN i % 2 = 0 THEN substr(g, length(g) - i, 1)::INTEGER
    WHEN substr(g, length(g) - i, 1)::INTEGER > 4 THEN substr(g, length(g) - i, 1)::INTEGER * 2 - 9 ELSE substr(g, length(g) - i, 1)::INTEGER * 2 END)) % 10 = 0)) AS n_card,
  len(list_filter(phones, lambda g: length(g) BETWEEN 9 AND 15)) AS n_phone FROM m
"""
