"""What a question asks for, told by words, as column expressions; all patterns are read over folded text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvasir.functions.text import fold

# Beginnings of words, by which questions are told apart. All are lower case with е for ё.
TASK = (
    "характерист|параметр|описани|обзор|размер|диаметр|давлен|температур|подбор|подобрать|выбор|расскажи|расскажите|материал|корпус|масса|вес|длин|высот|"
    "ширин|резьб|присоедин|расход|ттх|назначен|что такое|для чего"
)
NOT_CATALOG = "монтаж|эксплуатац|совмест|подключ|установ|опрессов|сертифик|паспорт|гарант|неисправ"
PRODUCT = "труб|фитинг|редуктор|клапан|коллектор|радиатор|насос|кран|заглуш|муфт|тройник|переходник|термостат|счетчик"
PRODUCT_TASK = (
    "монтаж|монтир|установ|подключ|подбор|подобра|подобрать|выбра|выбор|характерист|параметр|описани|расска|обзор|что такое|для чего|зачем|как |како|каки|"
    "сколько|чем |можно|нужно ли|совмест|подойдет|размер|диаметр|давлен|температур|расход|стоим|паспорт|сертифик|гарант|неисправ|теч[ьеи]|слома|замен|"
    "опрессов|радиус|инструкц"
)
PRODUCT_TOPIC = "что это|назначени|применени|информаци|преимуществ|отличи|свойств|принцип|ассортимент|виды|типы"
INSTALLATION = (
    "монтаж", "монтажный", "монтировать", "смонтировать", "установка", "устанавливать", "установить", "подключение", "подключать", "подключить",
    "подсоединение", "укладка", "опрессовка", "промывка", "наладка", "регулировка", "коллекторная", "коллектор", "монолит", "насосная", "пусконаладка",
    "обвязка", "крепление", "изоляция",
)
CATALOG = (
    "артикул", "sku", "каталог", "диаметр", "фитинг", "труба", "pex", "pe-xa", "evoh", "серия", "модель", "комплектация", "характеристик", "описание",
    "параметр", "размер", "материал", "применение", "преимуществ", "свойств",
)
ATTRIBUTES = (
    ("толщина стенки", ("толщина", "стенка")), ("диаметр", ("диаметр",)), ("рабочее давление", ("давление",)), ("температура", ("температура",)),
    ("материал", ("материал",)), ("срок службы", ("срок службы",)), ("длина бухты", ("длина бухт",)), ("длина", ("длина",)), ("вес бухты", ("вес",)),
)
REPLACEMENT = "(^| )(аналог[а-я]*|замен[а-я]*|альтернатив[а-я]*|эквивалент[а-я]*|взаимозамен[а-я]*|так[а-я]* же)( |$)"
OTHER_MAKER = (
    "(^| )(конкурент[а-я]*|(друг[а-я]*|сторонн[а-я]*|чуж[а-я]*|ин(ой|ого|ому|ым|ом|ые|ых|ыми|ая|ую)) (производител[а-я]*|бренд[а-я]*|марк[а-я]*))( |$)"
)
FOLLOW_UP = "^(а )?((есть|бывает) )?у (друг[а-я]* (производител[а-я]*|бренд[а-я]*)|конкурент[а-я]*)( есть)?$"
GENERIC = "характерист|параметр|свойств|данн|описан|таблиц|размер|диаметр|толщин|давлен|температур|материал|длин"
QUESTION = "какой|какая|какие|сколько|как|почему|зачем|описан|характерист|таблиц|давлен|толщин|диаметр|температур|материал|длин"
REFUSALS = "не могу (помочь|ответить)|не нашлось|нет информации|не располагаю|can.t help|no information|unable to|keine informationen|aucune information"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def catalog_only(text: Column) -> Column:
    """Whether a question about a product is answered from the catalogue alone: it asks for a property and not for a manual."""
    low = fold(text)
    return low.rlike(TASK) & ~low.rlike(NOT_CATALOG)


def is_comparison(text: Column) -> Column:
    """Whether a question compares the catalogue with a data sheet."""
    low = fold(text)
    return low.rlike("сравн|сопостав") & low.rlike("каталог") & low.rlike("паспорт")


def has_product(text: Column) -> Column:
    return fold(text).rlike(PRODUCT)


def task_targets(text: Column) -> Column:
    """The kinds of documents, joined by commas, that a question's task is answered from."""
    low = fold(text)
    return F.when(low.rlike("совмест"), "installation,catalog").when(low.rlike("монтаж|установ|подключ|эксплуатац"), "installation").otherwise("catalog")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def names_product_only(text: Column) -> Column:
    """Whether a question of at most twelve words names a product and no task."""
    low = fold(text)
    return (word_count(text) <= 12) & low.rlike(PRODUCT) & ~low.rlike(PRODUCT_TASK) & ~low.rlike(PRODUCT_TOPIC)


def asks_competitor(text: Column, brands: tuple[str, ...], own: tuple[str, ...] = ()) -> Column:
    """Whether a question asks for another maker's replacement, of ``brands`` or any; not if a product of ``own`` is to be the replacement."""
    t = F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}\p{M}]+", " "))
    named = _any(F.concat(F.lit(" "), t, F.lit(" ")), tuple(f" {b} " for b in brands)) if brands else F.lit(False)
    names = "|".join(own)
    wanted = t.rlike(f"(^| )((из (каталога|ассортимента)|у) ({names})|({names}) (взамен|вместо|на замену))( |$)") if own else F.lit(False)
    return t.rlike(FOLLOW_UP) | (t.rlike(REPLACEMENT) & ~wanted & (t.rlike(OTHER_MAKER) | named))


def asks_installation(text: Column) -> Column:
    return _any(fold(text), INSTALLATION)


def asks_catalog(text: Column) -> Column:
    return _any(fold(text), CATALOG)


def attribute(text: Column) -> Column:
    """The first attribute of the list that a question names, or null."""
    low = fold(text)
    return reduce(lambda chain, a: chain.when(_any(low, a[1]), a[0]), ATTRIBUTES[1:], F.when(_any(low, ATTRIBUTES[0][1]), ATTRIBUTES[0][0]))


def block(text: Column) -> Column:
    """Which block of a product page a question asks for, or null."""
    low = fold(text)
    return (
        F.when(low.rlike("описан|о товаре|для чего|назначен"), "description").when(low.rlike("техническ.*характерист|тех.*характерист"), "technical")
        .when(low.rlike("артикул|номенклатур"), "articles").when(low.rlike("размер.*бухт|вес.*бухт|высота.*бухт|внешн.*диаметр.*бухт"), "coils")
    )


def quick_mode(text: Column) -> Column:
    """How briefly a question that names a product can be answered, or null."""
    low = fold(text)
    description = low.rlike("описан|что это|о товаре|для чего")
    technical = low.rlike("характеристик|параметр|таблиц") & ~low.rlike("толщин|диаметр|давлен|температур|материал|длин")
    signal = low.rlike(r"[0-9]{3}|труб|фитинг|коллектор|радиатор|серия|модель|артикул|sku")
    mode = F.when(description, "description").when(technical, "technical").when(~low.rlike(QUESTION) & (word_count(low) <= 6), "product")
    return F.when(signal, mode)


def too_generic(text: Column) -> Column:
    """Whether a question of at most four words asks for a property and names nothing."""
    low = fold(text)
    specific = low.rlike(PRODUCT) | low.rlike(r"артикул|sku|модель|серия|[0-9]{3}") | text.rlike(r"(^|\s)[А-ЯЁA-Z]{2,8}(\s|$)")
    return low.rlike(GENERIC) & ~specific & (word_count(low) <= 4)


def confident(query: Column, title: Column) -> Column:
    """Whether a title surely is the product of a question: one of its long numbers, else half of its long words, is in it."""
    q, t = fold(query), fold(title)
    numbers = F.regexp_extract_all(q, F.lit("[0-9]{3,}"), 0)
    words = F.filter(F.split(q, r"\s+"), lambda w: (F.length(w) >= 4) & ~w.rlike("^(описание|технические|характеристик[аи]|артикулы?|какая|какой|какие|сколько)$"))
    hits = F.size(F.filter(words, lambda w: F.contains(t, w)))
    enough = (F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.ceil(F.size(words) * 0.5)))
    return F.when(F.size(numbers) > 0, F.exists(numbers, lambda n: F.contains(t, n))).otherwise(enough)


def keeps_numbers(query: Column, rewritten: Column) -> Column:
    """Whether every number of a question is also in its rewriting."""
    return F.forall(F.regexp_extract_all(query, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), 0), lambda n: F.contains(rewritten, n))


def refuses(text: Column) -> Column:
    """Whether an answer declines, by its wording."""
    return fold(text).rlike(REFUSALS)


def ends_open(text: Column) -> Column:
    """Whether an answer stops without a closing sign."""
    return text.rlike(r"[^\s\p{Z}]") & ~text.rlike(r"[.!?…:;)»\"|][\s\p{Z}]*$")
