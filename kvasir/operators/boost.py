"""Rules that raise or lower the score of a hit, with the reasons, and the fusion with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much each rule weighs, the stems that tell no product, and the bounds of the sum.
WEIGHTS = {
    "section_match": 0.1, "title_match": 0.08, "title_coverage": 0.32, "tag_match": 0.05, "sku_match": 0.12, "instruction_priority": 0.2, "catalog_priority": 0.15,
    "term_overlap": 0.05, "radiator": 0.35, "variant_match": 0.35,
}
GENERIC_STEMS = (
    "труб", "фитинг", "издели", "систем", "каталог", "характеристик", "параметр", "описан", "применен", "монтаж", "монтир", "монтировать", "смонтировать", "установ",
    "устанавливать", "установить", "подключ", "подключать", "подключить", "инструкц", "номенклатур", "раздел", "документ", "баз", "знан",
)
LOWEST, HIGHEST = -0.5, 0.85
MAKER_STEMS = ("производител", "производитель", "изготовител", "изготовитель")


def distinctive(stems: Column) -> Column:
    """The stems that tell a product: of four letters or more, none of the usual ones."""
    return F.filter(stems, lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC_STEMS))


def title_source(title: Column, filename: Column) -> Column:
    """A document's title or, without one, its file name as words."""
    name = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]+$", ""), "[_-]+", " ")
    return F.coalesce(F.when(F.trim(title) != "", title), name)


def content_hit(stems: Column, terms: Column, content: Column) -> Column:
    """Whether a stem is among a text's terms or in it, or begins like one of its terms, up to six letters."""
    begins = lambda t: F.exists(terms, lambda x: F.startswith(x, F.substring(t, 1, 6)) | F.startswith(t, F.substring(x, 1, 6)))
    return F.exists(stems, lambda t: F.array_contains(terms, t) | F.contains(content, t) | begins(t))


def rules() -> list[tuple[str, Column, Column]]:
    """Each rule as its reason, its condition and what it adds.

    Over rows with the stems of the question (``q``, an array with repeats), of the document's ``title``, the chunk's
    ``section``, ``tags``, ``variant`` and ``terms``; the lower-case ``query``, ``content``, ``path`` and ``head``; the
    question's product numbers ``skus`` and how many of the document's products have one, ``sku_products``; ``docType``;
    and whether the question asks for ``installation`` or the ``catalog``.
    """
    c, w, lit = F.col, WEIGHTS, F.lit
    maker = c("query").rlike("производ|изготов")
    asked = F.when(maker, F.array_union(c("q"), F.array(*map(F.lit, MAKER_STEMS)))).otherwise(F.array_distinct(c("q")))
    warranty = c("query").contains("гарант")
    overlap = F.size(F.filter("title", lambda t: F.array_contains(asked, t)))
    share, asked_share = overlap / F.greatest(F.size("title"), F.lit(1)), overlap / F.greatest(F.size("q"), F.lit(1))
    titled = (F.size("title") > 0) & (overlap > 0)
    own = distinctive(c("q"))
    in_title = F.exists(own, lambda t: F.array_contains(c("title"), t))
    in_content = content_hit(own, c("terms"), c("content"))
    gate = (c("catalog") & (c("docType") == "catalog")) | (c("docType") == "instruction")
    missed = (F.size(own) > 0) & gate & ~in_title & ~in_content
    manual, product = c("docType") == "instruction", c("docType") == "catalog"
    parts = c("path").contains("номенклатур") | c("head").contains("[таблица номенклатуры") | (c("head").contains("артикул") & ~c("head").rlike("монтаж|установ|подключ|креплен"))
    variant = F.size(F.filter("variant", lambda t: F.array_contains(asked, t)))
    terms = F.size(F.filter(F.array_distinct("q"), lambda t: F.array_contains(c("terms"), t)))
    bare = F.upper(F.regexp_replace("content", "[-–]", ""))
    radiator = c("installation") & c("query").contains("радиатор")
    meter = c("installation") & c("query").contains("теплосчет")
    meter_hit = F.exists("title", lambda t: F.startswith(t, lit("теплосчет"))) | c("content").contains("теплосчет")
    made = maker & ~warranty
    return [
        ("section_match", F.exists("section", lambda t: F.array_contains(asked, t)), lit(w["section_match"])),
        ("manufacturer_guarantee_penalty", made & c("path").contains("гарант"), lit(-0.7)),
        ("manufacturer_guarantee_phrase_penalty", made & c("content").contains("производитель гарантирует"), lit(-0.4)),
        ("manufacturer_section_bonus", maker & c("path").contains("изготов"), lit(0.8)),
        ("manufacturer_section_soft_bonus", maker & ~c("path").contains("изготов") & c("path").contains("производ") & ~c("path").contains("гарант"), lit(0.35)),
        ("title_match", titled, lit(w["title_match"])),
        ("title_coverage", titled & ((share >= 0.5) | ((overlap >= 2) & (asked_share >= 0.4))), w["title_coverage"] * F.least(lit(1.0), F.greatest(share, asked_share))),
        ("title_strong_match", titled & (share >= 0.75) & (overlap >= 2), lit(0.2)),
        ("missing_distinctive_terms", missed, F.when(c("installation"), -0.55).otherwise(-0.35)),
        ("distinctive_title_hit", ~missed & in_title, F.when(c("installation"), 0.28).otherwise(0.18)),
        ("distinctive_content_hit", ~missed & ~in_title & in_content & c("installation"), lit(0.12)),
        ("installation_nomenclature_penalty", c("installation") & manual & parts, lit(-0.4)),
        ("tag_match", F.exists("tags", lambda t: F.array_contains(asked, t)), lit(w["tag_match"])),
        ("variant_match", variant > 0, lit(w["variant_match"])),
        ("variant_strong_match", (variant >= 2) & (variant / F.greatest(F.size("variant"), lit(1)) >= 0.5), lit(w["variant_match"] * 0.5)),
        ("sku_match_chunk", F.exists("skus", lambda s: F.contains(bare, s)), lit(w["sku_match"])),
        ("sku_match_document", (F.size("skus") > 0) & (c("sku_products") > 0), F.least(w["sku_match"] * c("sku_products"), lit(2 * w["sku_match"]))),
        ("installation_instruction_priority", c("installation") & manual, lit(w["instruction_priority"])),
        ("installation_catalog_penalty", c("installation") & product, lit(-w["catalog_priority"] / 2)),
        ("catalog_priority", c("catalog") & product, lit(w["catalog_priority"])),
        ("catalog_instruction_penalty", c("catalog") & manual, lit(-w["catalog_priority"] / 2)),
        ("term_overlap", terms > 0, w["term_overlap"] * F.least(terms, lit(4))),
        ("radiator_keyword", radiator & c("content").contains("радиатор"), lit(w["radiator"])),
        ("radiator_section", radiator & (c("path").startswith("1.5") | c("path").contains("радиатор")), lit(w["radiator"] / 2)),
        ("heat_meter_keyword", meter & meter_hit, lit(w["radiator"])),
        ("heat_meter_mismatch", meter & ~meter_hit & manual, lit(-0.25)),
    ]


def with_boosts(rows: DataFrame) -> DataFrame:
    """``rows``, as :func:`rules` reads them, with ``boost``, the sum of all rules that hold, and ``reasons``."""
    listed = [(n, F.coalesce(cond, F.lit(False)), amount) for n, cond, amount in rules()]
    total = reduce(Column.__add__, (F.when(cond, amount.cast("double")).otherwise(0.0) for _, cond, amount in listed))
    reasons = F.filter(F.array(*(F.when(cond, F.lit(n)) for n, cond, _ in listed)), lambda r: r.isNotNull())
    return rows.withColumns({"boost": total, "reasons": reasons})


def fused(sim: Column, norm: Column, boost: Column, has_vector: Column, w_vector: float = 0.6, w_lexical: float = 0.4) -> Column:
    """Cosine and normalised lexical score weighed, with the boost within its bounds; without a vector 0.15 and 0.85 are the weights."""
    a = F.when(has_vector, w_vector).otherwise(0.15)
    b = F.when(has_vector, w_lexical).otherwise(0.85)
    return a * F.coalesce(sim, F.lit(0.0)) + b * F.coalesce(norm, F.lit(0.0)) + F.least(F.greatest(boost, F.lit(LOWEST)), F.lit(HIGHEST))


def normal_weights(w_vector: float, w_lexical: float, default: tuple[float, float] = (0.6, 0.4)) -> tuple[float, float]:
    """Weights over their sum; the default if the sum is 0."""
    total = w_vector + w_lexical
    return (w_vector / total, w_lexical / total) if total > 0 else default
