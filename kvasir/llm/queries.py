"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.functions.blank import IDLE, MISSING_WORDS
from kvasir.llm.abuse import abuse_rates, abuse_scores, fit_abuse
from kvasir.llm.conversations import conversations
from kvasir.llm.defects import defective_pairs
from kvasir.llm.mixing import mix, reached_shares
from kvasir.llm.neighbours import similar_pairs
from kvasir.llm.residue import residue_scores
from kvasir.llm.tokens import count_tokens, encode
from kvasir.sources.tables import cut, spread, table


def _texts(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, name).select(*columns))


def _chat_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "chat_history", "id", "source", "query", "response")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs of chunks and of FAQ entries."""
    chunks, faq = (similar_pairs(_texts(spark, d, name, "id", "embedding")).select(F.lit(name).alias("tab"), "id_a", "id_b") for name in ("document_chunks", "faq_entries"))
    return chunks.unionByName(faq)


def _abuse(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    chat = _chat_texts(spark, d)
    model = fit_abuse(chat, table(spark, d, "review_labels"))
    return abuse_scores(chat, model), model.threshold if model else 1.0


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every query and response."""
    scores, _ = _abuse(spark, d)
    return scores.select("id", "field", "source", *(F.round(c, 4).alias(c) for c in ("abuse", "hate", "sexual", "score")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Queries and responses with abusive, hateful or sexual content."""
    scores, threshold = _abuse(spark, d)
    return scores.where(F.col("score") >= threshold).select("id", "field")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of such texts by source and field."""
    return abuse_rates(*_abuse(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the conversations that are kept."""
    return conversations(table(spark, d, "chat_history")).select("session", "pos", "role", "id")


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """Messages and first position of each stretch of a conversation without a long pause."""
    found = conversations(table(spark, d, "chat_history"))
    return found.groupBy("session", "segment").agg(F.count(F.lit(1)).alias("messages"), F.min("pos").alias("first_pos"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose response is a bad answer, with the defect."""
    return defective_pairs(_chat_texts(spark, d), _texts(spark, d, "documents", "text", "lang"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Records of each defect by source of the exchange."""
    chat = table(spark, d, "chat_history").select("id", "source").dropDuplicates(["id"])
    found = p5_found(spark, d).join(chat, "id")
    return found.groupBy("source", "defect").agg(F.count(F.lit(1)).alias("records"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode(_texts(spark, d, "documents", "doc_id", "text"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return mix(cut(count_tokens(_texts(spark, d, "documents", "doc_id", "source", "text"))), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix, in training order."""
    return _mixed(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return reached_shares(_mixed(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue or error-page text."""
    return residue_scores(_texts(spark, d, "documents", "doc_id", "text")).where("score > 0").select("doc_id").distinct()


def _blank(column: str) -> str:
    words = ", ".join(f"'{w.replace('/', '')}'" for w in ("", *MISSING_WORDS))
    return f"coalesce(lower(regexp_replace({column}, '{IDLE}', '', 'g')) in ({words}), true)"


_CONVERSATIONS = rf"""
with r as (
  select distinct lower(regexp_replace(sessionId, '^[\s\p{{Z}}\p{{C}}]+|[\s\p{{Z}}\p{{C}}]+$', '', 'g')) s,
    id, userId, query q, response a, createdAt c,
    {_blank("query")} or {_blank("response")} or coalesce(year(createdAt) not between 2020 and 2030, true) bad
  from chat_history where not {_blank("sessionId")}),
kept as (select s from r group by s having not bool_or(bad) and (min(userId) is null or min(userId) = max(userId))),
o as (select *, coalesce(c - lag(c) over (partition by s, q, a order by c, id) <= interval 10 seconds, false) again from r semi join kept using (s)),
n as (select *, row_number() over (partition by s order by c, id) n from o where not again)
"""

QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}
# The calibrated gap: gaps by half powers of two, the emptiest place between the two largest heaps.
_SEGMENTS = _CONVERSATIONS.rstrip() + """,
t as (select s, id, c from r where coalesce(year(c) between 2020 and 2030, false)),
gaps as (select date_diff('microsecond', lag(c) over (partition by s order by c, id), c) / 1e6 g from t),
heaps as (select floor(log2(greatest(g, 1.0)) * 2)::int i, count(*) k from gaps where g is not null group by 1),
steps as (select i, coalesce(k, 0) k from (select unnest(range(0, (select max(i) from heaps) + 1)) i) left join heaps using (i)),
one as (select arg_max(i, (k, -i)) a from steps), two as (select arg_max(i, (k, i)) b from steps, one where i >= a + 2 and k > 0),
valley as (select arg_max(i, (-k, i)) v from steps, one, two where i between a + 1 and b),
cut_ as (select case when b is null then least(2592000, greatest(60, 10 * 2 ^ ((a + 1) / 2))) else least(2592000, greatest(60, 2 ^ ((v + 1) / 2))) end lim from one, two, valley),
gone as (select s, n, case when date_diff('microsecond', lag(c) over (partition by s order by c, id), c) / 1e6 > lim then 1 else 0 end brk from n, cut_),
seg as (select s, n, 1 + sum(brk) over (partition by s order by n) g from gone)
select s session, g::bigint segment, 2 * count(*) messages, min(2 * n - 1) first_pos from seg group by all
"""
ORACLES = {
    "p4_segments": _SEGMENTS,
    "p4_found": _CONVERSATIONS + "select s session, 2 * n - 1 + m pos, case m when 0 then 'user' else 'assistant' end \"role\", id from n, (values (0), (1)) v(m)",
}
