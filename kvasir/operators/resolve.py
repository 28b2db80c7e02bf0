"""Which part of the catalogue a question means: models, subjects, assortments, titles, and the documents bound to products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions import intent as I
from kvasir.functions.text import fold, models, stem
from kvasir.operators.joins import skew_left_join

SLICE = 512  # keys that are written out together

# Headings that don't own a product, and families of products by their words.
NOT_OWNER = "характеристик|принадлежност|аксессуар|размер|таблиц|ниппель|трубка|монтаж"
NOT_SUBJECT = "характеристик|монтаж|инструмент|насадк|подключ|размер|таблиц|гидравлич|номенклатур"
NOT_ASSORTMENT = "монтаж|характеристик|таблица|размер|гидравлич|инструкц|номенклатур|сертифик|паспорт|упоминание|значени[ея]|настройк|подбор|комплектующ"
FAMILIES = (
    "труб", "фитинг", "редуктор", "клапан", "коллектор", "радиатор", "насос", "кран", "заглуш", "муфт", "тройник", "переходник", "термостат", "счетчик",
    "фильтр", "водонагревател", "термоголов", "воздухоотводчик",
)
LISTING = "каки[ех]|какая есть|какой есть|какое есть|ассортимент|перечисл|список|виды|типы"
NOT_LISTING = "паспорт|сертифик|монтаж|подключ|подход|совмест|температур|диаметр|толщин|какое давление|лучше|отличи|выбрать|выбор|нужна|нужен"
COMMON = (
    "^(характеристик[аи]|параметры|описание|расскажи(те)?|подскажи(те)?|скажи(те)?|общ(ее|ие)|технические|основные|пожалуйста|мне|о|об|про|для|нужн[ыо]|дай|покажи(те)?|"
    "какие|каких|какой|какая|какое|есть|имеются|бывают|у|в|на|по|и|или|из|ассортимент|перечисли(те)?|список|виды|типы|все|вас|ваши)$"
)


def _terms(text: Column) -> Column:
    """The distinct stems of the words that tell what a text is about."""
    words = F.regexp_extract_all(fold(text), F.lit("[а-яa-z0-9]+"), 0)
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.rlike(COMMON)), stem))


def _beginnings(code: Column) -> Column:
    """The code up to each of its hyphens, and the whole."""
    parts = F.split(code, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))


def model_scope(questions: DataFrame, headings: DataFrame) -> DataFrame:
    """``query_id, model, found, sections``: of questions (``query_id, text``) that name one model, whether headings own it.

    ``found`` is ``exact`` if a heading (``name, documentId, sectionPath``) has that model alone, ``related`` if one has a
    model that it continues or that continues it, else ``none``; ``sections`` counts these headings. Codes meet by
    equality of their beginnings, never as all pairs.
    """
    asked = questions.select("query_id", models(F.col("text")).alias("m")).where(F.size("m") == 1).select("query_id", F.col("m")[0].alias("model"))
    owners = headings.where(~fold(F.col("name")).rlike(NOT_OWNER)).select("documentId", "sectionPath", "name", models(F.col("name")).alias("codes")).distinct()
    single = owners.where(F.size("codes") == 1).select(F.col("codes")[0].alias("model"), "documentId", "sectionPath")
    exact = asked.select("model").distinct().join(single, "model").groupBy("model").agg(F.count(F.lit(1)).alias("exact"))
    codes = owners.select("documentId", "sectionPath", F.explode("codes").alias("code"))
    models_ = asked.select("model").distinct()
    longer = models_.join(codes.select("documentId", "sectionPath", "code", F.explode(_beginnings(F.col("code"))).alias("model")).where("code <> model"), "model")
    shorter = models_.select("model", F.explode(_beginnings(F.col("model"))).alias("code")).where("code <> model").join(codes, "code")
    near = longer.select("model", "documentId", "sectionPath").unionByName(shorter.select("model", "documentId", "sectionPath")).distinct()
    related = near.groupBy("model").agg(F.count(F.lit(1)).alias("related"))
    both = asked.join(exact, "model", "left").join(related, "model", "left")
    found = F.when(F.col("exact").isNotNull(), "exact").when(F.col("related").isNotNull(), "related").otherwise("none")
    return both.select("query_id", "model", found.alias("found"), F.coalesce("exact", "related", F.lit(0)).alias("sections"))


def subject_match(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``query_id, name``: the one name (``name``) that has all the stems of a question; none if several different ones have.

    Names of the same stems are one, the first in order. Questions meet names by their stems and are counted.
    """
    asked = questions.select("query_id", _terms(F.col("text")).alias("terms")).where(F.exists("terms", lambda t: t.rlike("^[а-яa-z]{3,}$")))
    owners = names.where(I.has_product(F.col("name")) & ~fold(F.col("name")).rlike(NOT_SUBJECT)).select("name").distinct()
    words = F.array_distinct(F.transform(F.regexp_extract_all(fold(F.col("name")), F.lit("[а-яa-z0-9]+"), 0), stem))
    owners = owners.select(words.alias("stems"), "name").groupBy(F.array_sort("stems").alias("stems")).agg(F.min("name").alias("name"))
    hits = asked.select("query_id", F.size("terms").alias("size"), F.explode("terms").alias("s")).join(owners.select("name", F.explode("stems").alias("s")), "s")
    whole = hits.groupBy("query_id", "name").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("n = size")
    return whole.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).where("n = 1").select("query_id", "name")


def families(text: Column) -> Column:
    """The families of products that a text names."""
    low = fold(text)
    return F.filter(F.array(*(F.when(low.contains(f), F.lit(f)) for f in FAMILIES)), lambda f: f.isNotNull())


def asks_assortment(text: Column) -> Column:
    """Whether a question asks what there is of a family of products."""
    low = fold(text)
    return low.rlike(LISTING) & ~low.rlike(NOT_LISTING) & (F.size(families(text)) > 0)


def qualifiers(text: Column) -> Column:
    """The stems of a question that narrow an assortment: neither common words nor families."""
    words = F.regexp_extract_all(fold(text), F.lit("[а-яa-z0-9]+"), 0)
    kept = F.filter(words, lambda w: ~w.rlike(COMMON) & ~w.rlike("|".join(FAMILIES)))
    return F.array_distinct(F.transform(kept, stem))


def same_qualifier(a: Column, b: Column) -> Column:
    """Equal, or two long Cyrillic words one edit apart."""
    long = a.rlike("^[а-я]{6,}$") & b.rlike("^[а-я]{6,}$")
    return (a == b) | (long & (F.levenshtein(a, b) <= 1))


def assortment(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """``query_id, name, kind``: what there is (``name, kind, priority``) of the families that questions ask for, each line once.

    An entry must name a family of the question and match each of its qualifiers, with one typing error in long words.
    Entries of the same stems are one: that of the highest priority, then the first by name. Families are few, so a
    question meets only the entries of its own.
    """
    asked = questions.where(asks_assortment(F.col("text"))).select("query_id", families(F.col("text")).alias("fs"), qualifiers(F.col("text")).alias("qs"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"(?i)\.(md|pdf)$", ""), "_", " "), r"^[0-9]+(\.[0-9]+)*\.?\s*", ""))
    own = entries.select(plain.alias("name"), "kind", "priority").where(~fold(F.col("name")).rlike(NOT_ASSORTMENT))
    stems = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(fold(F.col("name")), F.lit("[а-яa-z0-9]+"), 0), stem)))
    own = own.select("name", "kind", "priority", stems.alias("stems"), families(F.col("name")).alias("own")).where(F.size("own") > 0)
    w = Window.partitionBy("stems").orderBy(F.desc("priority"), "name", "kind")
    own = own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    pairs = asked.select("query_id", "qs", F.explode("fs").alias("f")).join(own.select("name", "kind", "stems", F.explode("own").alias("f")), "f")
    fits = F.forall("qs", lambda q: F.exists("stems", lambda s: same_qualifier(q, s)))
    return pairs.where(fits).select("query_id", "name", "kind").distinct()


def _stem_sets(df: DataFrame, key: str, text: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``key, set``: the distinct stems of three letters or more of each text, as one string; rows without any are left out."""
    words = F.filter(F.regexp_extract_all(fold(F.col(text)), F.lit("[а-яa-z0-9]+"), 0), lambda w: (F.length(w) >= 3) & ~w.isin(*(ignored or ("",))))
    return df.select(key, F.array_join(F.array_distinct(F.transform(words, stem)), " ").alias("set")).where(F.col("set") != "").distinct()


def _matching_sets(own: DataFrame, titles: DataFrame) -> DataFrame:
    """``own_set, title_set, shared``: the distinct sets of stems of which the second has enough of the first. Stems meet in a join."""
    left, right = own.select(F.col("set").alias("own_set")).distinct(), titles.select(F.col("set").alias("title_set")).distinct()
    left = left.withColumn("s", F.split("own_set", " ")).select("own_set", F.size("s").alias("n"), F.explode("s").alias("s"))
    counted = left.join(right.select("title_set", F.explode(F.split("title_set", " ")).alias("s")), "s").groupBy("own_set", "title_set", "n").agg(F.count(F.lit(1)).alias("shared"))
    return counted.where(F.col("shared") >= F.greatest(F.least(F.lit(2), F.col("n")), F.ceil(F.col("n") * 0.6))).select("own_set", "title_set", "shared")


def _slices(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``name_set, name_slot, name_keys``: the keys of each set in slices of about :data:`SLICE`, so that no task gathers a frequent set."""
    counts = rows.groupBy("set").agg(F.count(F.lit(1)).alias("_members"))
    slot = F.pmod(F.xxhash64(key), F.ceil(F.col("_members") / SLICE)).alias(f"{name}_slot")
    dealt = skew_left_join(rows, counts, "set").select(F.col("set").alias(f"{name}_set"), slot, key)
    return dealt.groupBy(f"{name}_set", f"{name}_slot").agg(F.collect_list(key).alias(f"{name}_keys"))


def title_matches(groups: DataFrame, documents: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``id, doc_id, shared``: documents (``doc_id, title``) whose title has enough of the stems of a group's name (``id, name``).

    Enough are 60 % of its stems of three letters or more, at least two or all of them. Names and titles of the same stems
    are compared once; what matches is written out from pairs of slices, each at most about :data:`SLICE` squared rows, so
    that the pairs themselves are not shuffled.
    """
    own, titles = _stem_sets(groups, "id", "name", ignored), _stem_sets(documents, "doc_id", "title", ignored)
    pairs = _matching_sets(own, titles).join(_slices(own, "id", "own"), "own_set").join(_slices(titles, "doc_id", "title"), "title_set")
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, "own_set", "own_slot", "title_set", "title_slot")
    each = pairs.select(F.explode("own_keys").alias("id"), "title_keys", "shared")
    return each.select("id", F.explode("title_keys").alias("doc_id"), "shared")


def title_match_counts(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, matched``: how many documents :func:`title_matches` finds for each group with any, counted by sets of stems."""
    own, titles = _stem_sets(groups, "id", "name"), _stem_sets(documents, "doc_id", "title")
    members = titles.groupBy(F.col("set").alias("title_set")).agg(F.count(F.lit(1)).alias("n"))
    counts = _matching_sets(own, titles).join(members, "title_set").groupBy(F.col("own_set").alias("set")).agg(F.sum("n").alias("n"))
    return skew_left_join(own, counts, "set").where("n is not null").groupBy("id").agg(F.sum("n").alias("matched"))


def applicable(asked: DataFrame, matches: DataFrame, bindings: DataFrame) -> DataFrame:
    """``sku, documentId, score``: the documents bound to product numbers (``sku``), the best score of each.

    ``bindings`` has ``documentId, skus, categories, lines, catalogs`` (arrays), ``matches`` what the catalogue knows of a
    number (``sku, catalogId, label``). 3: the number itself is bound; 2: a category and a line are, each if given; 1: only
    the catalogue is. A given catalogue must be that of the match.
    """
    norm = lambda c: F.trim(F.regexp_replace(fold(c), r"[_\s]+", " "))
    own = asked.select("sku").distinct()
    direct = bindings.select("documentId", F.explode("skus").alias("sku")).join(own, "sku").select("sku", "documentId", F.lit(3).alias("score"))
    known = matches.join(own, "sku").select("sku", "catalogId", norm(F.col("label")).alias("label")).distinct()

    def bound(column: str) -> DataFrame:
        labels = bindings.where(F.size(column) > 0).select("documentId", "catalogs", F.explode(column).alias("label"))
        hits = labels.withColumn("label", norm(F.col("label"))).join(known, "label")
        return hits.where((F.size("catalogs") == 0) | F.array_contains("catalogs", F.col("catalogId"))).select("sku", "documentId").distinct()

    given = bindings.select("documentId", (F.size("categories") > 0).alias("c"), (F.size("lines") > 0).alias("l"))
    both = bound("categories").withColumn("hit", F.lit("c")).unionByName(bound("lines").withColumn("hit", F.lit("l")))
    two = both.groupBy("sku", "documentId").agg(F.max(F.col("hit") == "c").alias("hc"), F.max(F.col("hit") == "l").alias("hl")).join(given, "documentId")
    two = two.where("(hc or not c) and (hl or not l)").select("sku", "documentId", F.lit(2).alias("score"))
    bare = bindings.where("size(categories) = 0 and size(lines) = 0").select("documentId", F.explode("catalogs").alias("catalogId"))
    one = bare.join(known.select("sku", "catalogId").distinct(), "catalogId").select("sku", "documentId", F.lit(1).alias("score"))
    return direct.unionByName(two).unionByName(one).groupBy("sku", "documentId").agg(F.max("score").alias("score"))


def document_url(doc_id: Column, companion: Column, base: str = "") -> Column:
    """The address of a document's file, of its companion if it has one."""
    own = F.when(F.trim(companion) != "", F.lit("companion")).otherwise(F.lit("file"))
    return F.concat(F.lit(base.rstrip("/") + "/api/documents/"), doc_id.cast("string"), F.lit("/"), own)


def sibling_model(answer: Column, model: Column) -> Column:
    """Whether a text names another model of the same family."""
    family = F.get(F.split(model, "-"), 0)
    return F.exists(models(answer), lambda c: (c != model) & (F.get(F.split(c, "-"), 0) == family))


def own_manuals(hits: DataFrame) -> DataFrame:
    """The hits (``query_id, model, documentId, docType, title``) of documents whose title has the question's model alone; all of a question if there are none."""
    own = F.col("docType").isin("installation", "instruction") & (F.size(models(F.col("title"))) == 1) & (models(F.col("title"))[0] == F.col("model"))
    rows = hits.withColumn("_own", F.coalesce(own, F.lit(False)))
    rows = rows.withColumn("_any", F.max("_own").over(Window.partitionBy("query_id")))
    owners = rows.where("_own").select("query_id", "documentId").distinct().withColumn("_keep", F.lit(True))
    return rows.join(owners, ["query_id", "documentId"], "left").where("not _any or _keep").drop("_own", "_any", "_keep")
