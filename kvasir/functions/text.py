"""Normalising, tokenising and stemming as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The case endings that a stem is freed of, tried in this order.
SUFFIXES = (
    "иями ями ами ыми ими ого его ому ему ией ием иям иях ии ий ия ие ей ой ый ем им ым ом ью ья ее ые ое ов ев ёв их ых ую юю ая яя ях ах "
    "а я у ю е о и ы"
).split()

# Words that carry no meaning in a search.
STOPWORDS = """
и но а же или что это тот такой как который быть есть по на для без со при под над между из из-за у от к с в во не нет да ли то чтобы если
когда где куда откуда почему зачем какой какая какие которые так уже ещё также ему ей их кто кого кому кем чем этот эта эти вам нас лишь
только всего очень можно должен нужно нужен нужна нужны будет будут будем буду был была были будучи является являться являясь меня тебя
твоё ваш наш ваша наша ваши наши его её сам сама сами само собой
""".split()

_ENDINGS = frozenset(SUFFIXES)

TOKEN = r"\p{L}[\p{L}0-9/+-]*"
LEAST_STEM = 3


def stopwords(extra: tuple[str, ...] = ()) -> list[str]:
    """The stopwords in the form in which tokens are compared with them."""
    return sorted({w.lower().replace("ё", "е") for w in (*STOPWORDS, *extra)})


def fold(text: Column) -> Column:
    """Lower case with one letter for е and ё."""
    return F.translate(F.lower(text), "ё", "е")


def stem(token: Column) -> Column:
    """A token without the first ending of the list that leaves at least three letters.

    The list runs from long to short, so endings of one length are looked up in a set, the longest first.
    """
    n, found = F.length(token), None
    for size in sorted({len(s) for s in SUFFIXES}, reverse=True):
        ends = (n >= LEAST_STEM + size) & F.substring(token, -size, size).isin(*(s for s in SUFFIXES if len(s) == size))
        rest = F.substring(token, F.lit(1), n - size)
        found = F.when(ends, rest) if found is None else found.when(ends, rest)
    return found.otherwise(token)


def plain_stem(token: str) -> str:
    """:func:`stem` in Python."""
    for size in sorted({len(s) for s in SUFFIXES}, reverse=True):
        if len(token) >= LEAST_STEM + size and token[-size:] in _ENDINGS:
            return token[:-size]
    return token


def raw_tokens(text: Column) -> Column:
    """The words of a text of two or more characters, stopwords left out, in order."""
    words = F.regexp_extract_all(fold(text), F.lit(TOKEN), 0)
    bare = F.regexp_extract_all(fold(text), F.lit("[a-z0-9/+-]+"), 0)
    words = F.when(text.rlike(r"\p{L}"), words).otherwise(bare)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords()))  # looked up in a set


def tokens(text: Column) -> Column:
    """The stemmed tokens of a text, in order; none for a null or empty one."""
    return F.coalesce(F.transform(raw_tokens(text), stem), F.array().cast("array<string>"))


def strip_footnotes(text: Column) -> Column:
    """A text without superscript and bracketed footnote marks and without marks between a label and its number."""
    text = F.regexp_replace(text, r"(?<=\S)[¹²³⁰-⁹]|\(\d{1,2}\)", "")
    return F.regexp_replace(text, r"\s+\d{1,2}(?=\s+[^\d\s]+\s+[0-9])", " ")


def clean_text(text: Column) -> Column:
    """A page's text on one line: page numbers, hyphenation, repeated white space and footnote marks removed."""
    text = F.regexp_replace(text, r"(?m)^[0-9]+$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"-[\s ]*\n[\s ]*", "")
    text = F.trim(F.regexp_replace(text, r"[\s\p{Z}﻿]+", " "))
    return strip_footnotes(text)


def normalize_line(text: Column) -> Column:
    """A line with plain spaces, dots and hyphens."""
    text = F.regexp_replace(F.translate(text, "  ", "  "), "﻿", "")
    text = F.regexp_replace(text, "[․‥﹒．]", ".")
    return F.trim(F.regexp_replace(text, "[‐-―−]", "-"))


def section_path(path: Column, levels: int = 4) -> Column:
    """A section number of digits and dots, at most ``levels`` levels deep; empty for null."""
    bare = F.regexp_replace(F.translate(F.regexp_replace(path, r"\.$", ""), ",", "."), r"[^0-9.]", "")
    parts = F.filter(F.split(bare, r"\."), lambda p: p != "")
    return F.coalesce(F.when(F.size(parts) > levels, F.array_join(F.slice(parts, 1, levels), ".")).otherwise(bare), F.lit(""))


def section_title(title: Column, most: int = 300) -> Column:
    """A title on one line of at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(title, r"\s+", " ")), 1, most)


def table_cell(value: Column) -> Column:
    """A table cell as text: bars escaped, white space collapsed, ``12 5`` read as ``12,5``; empty for null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(strip_footnotes(value), r"\|", r"\\|"), r"\s+", " "))
    return F.coalesce(F.regexp_replace(text, r"^([0-9]+)\s+([0-9]{1,2})$", "$1,$2"), F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """The usual estimate of a text's tokens: one in four characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def script(text: Column) -> Column:
    """``ru`` for a text with Cyrillic letters, ``en`` for one with Latin letters alone, else ``unknown``."""
    return F.when(text.rlike("[а-яА-ЯёЁ]"), "ru").when(text.rlike("[a-zA-Z]"), "en").otherwise("unknown")


def model_codes(text: Column) -> Column:
    """The distinct product codes of a text, two letters and groups of digits joined by hyphens, in upper case."""
    codes = F.regexp_extract_all(F.upper(text), F.lit(r"(?:^|[^A-Z0-9-])([A-Z]{2}-[0-9]{2}(?:-[0-9]{4})?)"), 1)
    return F.coalesce(F.array_distinct(codes), F.array().cast("array<string>"))


def numeric_skus(text: Column) -> Column:
    """The distinct numbers of four to eight digits that stand alone."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])[0-9]{4,8}(?![\p{L}\p{N}])"), 0)
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def sku_key(sku: Column) -> Column:
    """A product number in one spelling: upper case, letters and digits alone; null if nothing is left."""
    bare = F.regexp_replace(F.upper(sku), r"[^\p{L}\p{N}]", "")
    return F.when(bare != "", bare)


def sql_stem(token: str) -> str:
    """:func:`stem` in SQL."""
    cases = " ".join(f"when ends_with({token}, '{s}') and length({token}) >= {LEAST_STEM + len(s)} then left({token}, length({token}) - {len(s)})" for s in SUFFIXES)
    return f"(case {cases} else {token} end)"


def sql_raw_tokens(text: str) -> str:
    """:func:`raw_tokens` in SQL."""
    folded = f"replace(lower({text}), 'ё', 'е')"
    words = f"regexp_extract_all({folded}, '{TOKEN}')"
    words = f"(case when len({words}) > 0 then {words} else regexp_extract_all({folded}, '[a-z0-9/+-]+') end)"
    stop = ", ".join(f"'{w}'" for w in stopwords())
    return f"list_filter({words}, lambda w: length(w) >= 2 and w not in ({stop}))"


_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def sku_candidates(text: Column) -> Column:
    """The words of a text that may be product numbers, without dashes, in upper case, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"(?iu){_EDGE}[а-яa-z0-9]{{2,}}[-–/]?[а-яa-z0-9]{{2,}}{_EDGE}"), 0)
    return F.transform(found, lambda w: F.upper(F.regexp_replace(w, "[-–]", "")))


def preview(text: Column, most: int) -> Column:
    """A text cut to ``most`` characters, with an ellipsis if anything is missing."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


# What looks like a model code and is none.
NO_MODELS = "LITE|DN[0-9]*|PN[0-9]*|PDF|MD|PE|PEX|PE-XA|PE-RT|EVOH|PPSU|KVS|KV|PA6|EPDM|HNBR|DZR"
MODEL = r"[A-Z][A-Z0-9]+(?:-[A-ZА-Я0-9]+)*(?:\s+[HН](?=$|[^A-ZА-Я0-9]))?"


def models(text: Column, own: tuple[str, ...] = ()) -> Column:
    """The distinct model codes of a text: Latin letters and digits with parts joined by hyphens; not of ``own`` names or :data:`NO_MODELS`."""
    upper = F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), "[‐‑–—]", "-"), r"\s+", " "))
    found = F.regexp_extract_all(upper, F.lit(rf"(?<![A-ZА-Я0-9])({MODEL})(?=$|[^A-ZА-Я0-9])"), 1)
    plain = F.transform(found, lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+[НH]$", "-H"), "-Н$", "-H"), "-С$", "-C"))
    none = "^(" + "|".join((NO_MODELS, *own)) + ")$"
    return F.coalesce(F.array_distinct(F.filter(plain, lambda c: ~c.rlike(none))), F.array().cast("array<string>"))


def section_name(title: Column) -> Column:
    """A heading without its number; null for an empty one and for headings that name no product."""
    name = F.regexp_replace(F.trim(title), r"^[0-9]+(\.[0-9]+)*\.?\s*", "")
    return F.when((name != "") & ~fold(name).rlike(r"^(страница\s*[0-9]+|номенклатура|характеристики|технические характеристики|каталог|root)$"), name)


def name_from_content(content: Column) -> Column:
    """A product's name from the first line of its text, without what follows its number."""
    first = F.get(F.split(content, r"\n|\|"), 0)
    return section_name(F.regexp_replace(first, r"(?iu)\s+Артикул\s*:.*", ""))


def family_markers(text: Column, ignored: tuple[str, ...] = ()) -> Column:
    """The sorted distinct Latin words of three or more letters and digits that name a product line."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]*(?:-[a-z0-9]+)*"), 0)
    plain = F.transform(found, lambda w: F.replace(w, F.lit("-"), F.lit("")))
    out = ("pdf", "catalog", "catalogue", "doc", *ignored)
    kept = F.filter(plain, lambda w: (F.length(w) >= 3) & ~w.isin(*out) & ~w.rlike("^(dn|pn|v|rev|ver)[0-9]+$"))
    return F.array_sort(F.array_distinct(kept))


def category_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(fold(value), r"[_\s]+", " "))


def safe_filename(raw: Column, most: int = 180) -> Column:
    """A file name without its folders, encoding and signs that file systems refuse, at most ``most`` characters long."""
    base = F.regexp_extract(F.coalesce(F.try_url_decode(raw), raw), r"([^/]*)/*$", 1)
    name = F.trim(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_"))
    name = F.when(name == "", "document.pdf").otherwise(name)
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 4), F.lit(".pdf"))).otherwise(name)


def without_prefix(title: Column, prefix: str) -> Column:
    """A title on one line without a prefix, in any letter case."""
    line = F.trim(F.regexp_replace(title, r"\s+", " "))
    return F.when(F.startswith(F.lower(line), F.lower(F.lit(prefix))), F.trim(F.substring(line, len(prefix) + 1, 1 << 30))).otherwise(line)


def has_extension(url: Column, extension: str) -> Column:
    """Whether the path of an address ends with an extension."""
    dotted = "." + extension.lower().lstrip(".")
    return F.endswith(F.lower(F.regexp_replace(url, r"[?#].*$", "")), F.lit(dotted))


def document_kind(filename: Column) -> Column:
    """The kind of a document by the words of its name."""
    low = F.lower(filename)
    kind = F.when(low.contains("каталог"), "catalog").when(low.rlike("инструк|пособ"), "instruction").when(low.contains("сертифик"), "certificate")
    return kind.when(low.contains("паспорт"), "passport").when(low.contains("гарант") & low.rlike("вопрос|faq"), "warranty_faq").otherwise("general")


def element_kind(kind: Column, has_rows: Column) -> Column:
    """The element type as it is stored: a table without rows is text, an unknown one too."""
    return F.when(kind.isin("mixed", "table"), F.when(has_rows, "table").otherwise("text")).when(kind.isin("figure", "list", "header"), kind).otherwise("text")


def first_page(pages: Column) -> Column:
    """The first number of ``a-b``."""
    return F.regexp_extract(pages, r"^\s*([0-9]+)", 1).try_cast("int")


def variant_key(*candidates: Column) -> Column:
    """The first filled candidate, in lower case, of letters and digits alone."""
    first = F.coalesce(*(F.when(F.trim(c) != "", c) for c in candidates))
    return F.trim(F.regexp_replace(F.lower(first), r"[^a-z0-9а-яё]+", " "))


def match_tokens(text: Column) -> Column:
    """The words of three or more letters and digits of a text, in lower case."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), "[^0-9a-zа-яё]+", " ")), " "), lambda w: F.length(w) >= 3)


def tokens_at_least_words(text: Column) -> Column:
    """The estimate that counts at least the words: of a quarter of the characters, rounded, and the words the larger one; 0 if empty."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(words, F.floor(F.length(text) / 4 + 0.5).cast("int"))).cast("bigint")


def tokens_or_none(text: Column) -> Column:
    """The usual estimate, but 0 for an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(estimate_tokens(text)).cast("bigint")


def faq_answer(content: Column, marker: str = "\n\nответ:") -> Column:
    """What follows the answer's marker in a question and answer text; null without any."""
    at = F.instr(F.lower(content), marker)
    answer = F.trim(F.substring(content, at + len(marker), F.lit(1 << 30)))
    return F.when((at > 0) & (answer != ""), answer)


def technical_block(text: Column) -> Column:
    """The part of a page from its technical data to the next heading, null without any."""
    at = F.instr(F.lower(text), "технические характеристики")
    tail = F.substring(text, at, F.lit(1 << 30))
    return F.when(at > 0, F.trim(F.regexp_replace(tail, r"(?s)\n##.*$", "")))


def answer_spacing(text: Column) -> Column:
    """Plain spaces, no spaces before line ends, at most one blank line in a row."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, " ", " "), "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))
