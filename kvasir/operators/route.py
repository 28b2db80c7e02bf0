"""Rules that route a question, its session's history, and the catalogue's look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions.text import fold, stem

MOST_STEMS = 100_000


def words(text: Column) -> Column:
    """The folded words of a text, each between spaces, so that phrases can be found as parts."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def route(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, rule, term``: the first enabled rule, by ``rule_no`` and then ``term_no``, one of whose terms is in the question.

    ``rules`` has ``rule_no, rule, enabled, term_no, term``; a term is a phrase of whole words, a star at its end stands for
    any ending. Rules are a settings table of a few rows and are joined by broadcast; they are checked to be at most 10,000.
    """
    active = rules.where("enabled").withColumn("open", F.endswith("term", F.lit("*")))
    active = active.withColumn("phrase", F.rtrim(words(F.regexp_replace("term", r"\*$", ""))))
    active = active.select("rule_no", "rule", "term_no", "term", F.when(F.col("open"), F.col("phrase")).otherwise(F.concat("phrase", F.lit(" "))).alias("phrase"))
    if active.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 rule terms")
    rows = questions.select("id", words(F.col("text")).alias("w"))
    hits = rows.join(F.broadcast(active), F.contains("w", "phrase"))
    return hits.groupBy("id").agg(F.min(F.struct("rule_no", "term_no", "rule", "term")).alias("r")).select("id", "r.rule", "r.term")


def session_history(chat: DataFrame, session: str, *, last: int = 3) -> DataFrame:
    """``id, previous``: how many of the ``last`` exchanges before each one its session has."""
    w = Window.partitionBy(session).orderBy("createdAt", "id")
    got = sum((F.when(F.lag("id", i).over(w).isNotNull(), 1).otherwise(0) for i in range(1, last + 1)), F.lit(0))
    return chat.where(F.col(session).isNotNull() & F.col("createdAt").isNotNull()).select("id", got.cast("bigint").alias("previous"))


def recommendations(traces: DataFrame, known: DataFrame, least: int = 2, examples: int = 3) -> DataFrame:
    """``key, n, examples``: groups of traces (``id, key, text``) not yet known, the most frequent first.

    ``examples`` are the first texts by id. Only the few first rows of a group are ever gathered.
    """
    rows = traces.join(known.select("key").distinct(), "key", "left_anti")
    count = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("key").orderBy("id")
    firsts = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= examples)
    texts = firsts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rn", "text"))).alias("t"))
    out = count.join(texts, "key").select("key", "n", F.array_join(F.transform("t", lambda s: s["text"]), " | ").alias("examples"))
    return out.orderBy(F.desc("n"), "key")


def walk_up(sections: DataFrame, depth: int = 4) -> DataFrame:
    """``id, step, ancestor``: the sections above each one by its path, at most ``depth`` levels."""
    parts = F.split("sectionPath", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda n: F.array_join(F.slice(parts, 1, F.size(parts) - n), "."))
    rows = sections.where("sectionPath is not null").select("id", "documentId", F.posexplode(ups).alias("step", "path")).where("path <> ''")
    above = sections.groupBy("documentId", F.col("sectionPath").alias("path")).agg(F.min("id").alias("ancestor"))
    return rows.join(above, ["documentId", "path"]).select("id", (F.col("step") + 1).cast("bigint").alias("step"), "ancestor")


def title_score(queries: DataFrame, titles: DataFrame, most: int = 5) -> DataFrame:
    """``query_id, id, hits``: titles (``id, title``) by how many distinct stems they share with a query, the best ``most``.

    A query is never compared with a title that shares no stem. Stems of a batch of queries are broadcast if they are at
    most :data:`MOST_STEMS`, so that a stem that many titles have is no hot key; more meet in a shuffle.
    """

    def stems(df: DataFrame, key: str, text: str) -> DataFrame:
        tokens = F.filter(F.split(F.trim(words(F.col(text))), " "), lambda w: F.length(w) >= 3)
        return df.select(key, F.explode(F.array_distinct(F.transform(tokens, stem))).alias("s"))

    asked = stems(queries, "query_id", "text")
    small = asked.limit(MOST_STEMS + 1).count() <= MOST_STEMS
    hits = stems(titles, "id", "title").join(F.broadcast(asked) if small else asked, "s").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "id")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def one_edit_apart(df: DataFrame, id_col: str, word_col: str, least: int = 5) -> DataFrame:
    """``a, b``: words of ``least`` or more letters that differ by one letter, as pairs of distinct words.

    Candidates share the word with one letter left out; only they are compared.
    """
    own = df.where(F.length(word_col) >= least).select(F.col(word_col).alias("w")).distinct()
    cuts = F.transform(F.sequence(F.lit(0), F.length("w")), lambda i: F.when(i == 0, F.col("w")).otherwise(F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, F.length("w")))))
    rows = own.select("w", F.explode(F.array_distinct(cuts)).alias("cut"))
    pairs = rows.select(F.col("w").alias("a"), "cut").join(rows.select(F.col("w").alias("b"), "cut"), "cut").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b") <= 1)


def document_types(target: Column) -> Column:
    """The kinds of documents that a target of a rule stands for."""
    return F.when(target == "installation", F.array(F.lit("installation"), F.lit("instruction"))).otherwise(F.array(target))


def stage_counts(seen: DataFrame, traces: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """``stage, status, n``: traces (``id``) by stage; a stage of ``stages`` that ``seen`` (``id, stage``) lacks is skipped.

    The stages are a fixed list, so what isn't seen is the number of traces less those seen, and no row is made for it.
    """
    took = seen.distinct().groupBy("stage").agg(F.count(F.lit(1)).alias("took"))
    every = traces.select("id").distinct().agg(F.count(F.lit(1)).alias("every"))
    listed = traces.sparkSession.createDataFrame([(s,) for s in stages], "stage string").crossJoin(F.broadcast(every)).join(F.broadcast(took), "stage", "left").fillna(0, ["took"])
    both = F.array(F.struct(F.lit("success").alias("status"), F.col("took").alias("n")), F.struct(F.lit("skipped").alias("status"), (F.col("every") - F.col("took")).alias("n")))
    return listed.select("stage", F.explode(both).alias("s")).select("stage", "s.status", "s.n").where("n > 0")


def group_traces(traces: DataFrame, least: int = 2) -> DataFrame:
    """``key, targets, terms, n, first_id``: traces (``id, targets, terms``) by the digest of what they aim at and their terms."""
    rows = traces.groupBy("targets", "terms").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= least)
    return rows.select(F.sha2(F.concat("targets", F.lit("|"), "terms"), 256).alias("key"), "targets", "terms", "n", "first_id")


def accept_terms(rules: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """``rule, terms``: the terms of each rule with the ``most`` most frequent ones found for it (``rule, term, n``) added, sorted and joined."""
    w = Window.partitionBy("rule").orderBy(F.desc("n"), "term")
    top = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("rule", "term")
    every = rules.select("rule", "term").unionByName(top).distinct()
    return every.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("terms"))
