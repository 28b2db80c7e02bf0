"""Queries of text normalising and tokenising."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import text as T
from kvasir.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


def tokenize_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.tokens(F.col("text")), "|").alias("terms"))


def term_frequency(spark, d):
    terms = _docs(spark, d).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def stopword_filter(spark, d):
    kept = F.size(T.raw_tokens(F.col("text"))).cast("bigint")
    return _docs(spark, d).where("text is not null").select("doc_id", kept.alias("kept"))


def stem_suffix(spark, d):
    words = _docs(spark, d).select(F.explode(T.raw_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


def model_codes(spark, d):
    codes = _docs(spark, d).select("doc_id", F.explode(T.model_codes(F.col("text"))).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("documents"))


def numeric_skus(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.numeric_skus(F.col("text"))).alias("number"))


def clean_text(spark, d):
    clean = T.clean_text(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.length(clean).cast("bigint").alias("n_clean"), F.md5(clean).alias("digest"))


def strip_footnotes(spark, d):
    chunks = table(spark, d, "document_chunks").where("content is not null")
    return chunks.select("id", F.md5(T.strip_footnotes(F.col("content"))).alias("digest")).distinct()


def token_estimate(spark, d):
    chunks = table(spark, d, "document_chunks").where("content is not null")
    chunks = chunks.select("id", T.estimate_tokens(F.col("content")).alias("n"), "tokenCount").distinct()
    return chunks.groupBy("tokenCount").agg(F.sum("n").cast("bigint").alias("estimated"), F.count(F.lit(1)).alias("chunks"))


def normalize_line(spark, d):
    return table(spark, d, "sections").select("id", T.normalize_line(F.col("title")).alias("title")).distinct()


def section_paths(spark, d):
    paths = table(spark, d, "document_chunks").select(T.section_path(F.col("sectionPath")).alias("path"))
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))


def section_titles(spark, d):
    return table(spark, d, "sections").select("id", T.section_title(F.col("title")).alias("title")).distinct()


def table_cells(spark, d):
    cells = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line like '|%|'")
    parts = F.split("line", r"\|")
    cells = cells.select("doc_id", F.explode(F.slice(parts, F.lit(2), F.size(parts) - 2)).alias("cell"))
    return cells.groupBy(T.table_cell(F.col("cell")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def detect_script(spark, d):
    chunks = table(spark, d, "document_chunks").select("id", T.script(F.col("content")).alias("script"), "language").distinct()
    return chunks.groupBy("language", "script").agg(F.count(F.lit(1)).alias("n"))


def sku_keys(spark, d):
    rows = table(spark, d, "products").select("id", T.sku_key(F.col("sku")).alias("key")).distinct()
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("products"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, term_frequency, stopword_filter, stem_suffix, model_codes, numeric_skus, clean_text, strip_footnotes,
        token_estimate, normalize_line, section_paths, section_titles, table_cells, detect_script, sku_keys,
    )
}

_RAW = T.sql_raw_tokens("text")
_FOOT = r"regexp_replace(regexp_replace({0}, '([^\s\p{{Z}}])[\x{{00B9}}\x{{00B2}}\x{{00B3}}\x{{2070}}-\x{{2079}}]|\([0-9]{{1,2}}\)', '\1', 'g'), '\s+[0-9]{{1,2}}(\s+[^0-9\s]+\s+[0-9])', ' \1', 'g')"
ORACLES = {
    "tokenize_terms": f"select doc_id, coalesce(array_to_string(list_transform({_RAW}, lambda w: {T.sql_stem('w')}), '|'), '') terms from documents",
    "term_frequency": f"with t as (select doc_id, unnest({_RAW}) w from documents) select doc_id, {T.sql_stem('w')} term, count(*) tf from t group by all",
    "stopword_filter": f"select doc_id, len({_RAW}) kept from documents where text is not null",
    "stem_suffix": f"with t as (select distinct unnest({_RAW}) w from documents) select w word, {T.sql_stem('w')} stem from t",
    "model_codes": r"""with t as (select doc_id, unnest(list_distinct(regexp_extract_all(upper(text), '(?:^|[^A-Z0-9-])([A-Z]{2}-[0-9]{2}(?:-[0-9]{4})?)', 1))) code from documents)
        select code, count(*) documents from t group by all""",
    "numeric_skus": r"""with t as (select doc_id, regexp_replace(text, '([^\p{L}\p{N}])', '\1\1', 'g') t from documents)
        select doc_id, unnest(list_distinct(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}])([0-9]{4,8})(?:$|[^\p{L}\p{N}])', 1))) "number" from t""",
    "token_estimate": "select tokenCount, sum(greatest(1, ceil(length(content) / 4)))::bigint estimated, count(*) chunks from (select distinct id, content, tokenCount from document_chunks) where content is not null group by all",
    "section_titles": r"select distinct id, left(trim(regexp_replace(title, '\s+', ' ', 'g')), 300) title from sections",
    "section_paths": r"""with p as (select regexp_replace(replace(regexp_replace(sectionPath, '\.$', ''), ',', '.'), '[^0-9.]', '', 'g') b from document_chunks),
        q as (select b, list_filter(string_split(b, '.'), lambda x: x <> '') parts from p)
        select coalesce(case when len(parts) > 4 then array_to_string(parts[1:4], '.') else b end, '') path, count(*) chunks from q group by all""",
    "normalize_line": r"""select distinct id, trim(regexp_replace(regexp_replace(replace(translate(title, chr(160) || chr(8239), '  '), chr(65279), ''), '[\x{2024}\x{2025}\x{FE52}\x{FF0E}]', '.', 'g'),
        '[\x{2010}-\x{2015}\x{2212}]', '-', 'g')) title from sections""",
    "detect_script": """select "language", case when regexp_matches(content, '[а-яА-ЯёЁ]') then 'ru' when regexp_matches(content, '[a-zA-Z]') then 'en' else 'unknown' end script, count(*) n
        from (select distinct id, content, "language" from document_chunks) group by all""",
    "sku_keys": r"""with k as (select distinct id, nullif(regexp_replace(upper(sku), '[^\p{L}\p{N}]', '', 'g'), '') key from products) select key, count(*) products from k group by all""",
}
