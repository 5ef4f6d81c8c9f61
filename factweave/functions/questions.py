"""Column functions over questions: search terms, numbers, intent, filters, rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import values as V


def _distinct(values: Column) -> Column:
    """The first of values that differ by case only, in order."""
    return T.bind(values, lambda v: T.bind(F.transform(v, F.lower), lambda keys: F.filter(v, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)))


def name_phrases(q: Column) -> Column:
    """Runs of capitalised words: two or more Latin ones, one to four Cyrillic ones, each with its parts of three letters or more."""
    latin = T.every(q, rf"(?<!{T.WORD})[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?!{T.WORD})")
    cyrillic = T.every(q, r"(?<![а-яёА-ЯЁ])([А-ЯЁ][а-яё]{2,}(?:\s+[А-ЯЁ][а-яё]{2,}){0,3})(?![а-яёА-ЯЁ])", 1)
    parts = lambda m: F.concat(F.array(m), F.filter(F.split(m, r"\s+"), lambda p: F.length(p) >= 3))
    return F.flatten(F.concat(F.transform(latin, parts), F.transform(cyrillic, parts)))


def hyphen_terms(q: Column) -> Column:
    found = T.every(q, rf"(?<!{T.WORD})[A-Za-z]+(?:-[A-Za-z0-9]+)+(?!{T.WORD})")
    return F.flatten(F.transform(found, lambda m: F.concat(F.array(m), F.filter(F.split(m, "-"), lambda p: F.length(p) >= 2))))


def chemical_terms(q: Column) -> Column:
    """Words that begin with a chemical symbol or name."""
    return T.every(q, rf"(?iu)(?<!{T.WORD})(?:{V.CHEMICAL}){T.WORD}*")


def spelled_alike(terms: Column) -> Column:
    """The other spelling of each term that has one."""
    return F.filter(F.transform(terms, lambda t: T.lookup(V.SPELLING, F.lower(t))), lambda t: t.isNotNull())


def glossary_terms(q: Column) -> Column:
    """Words and phrases of the glossary entries that a question holds, in both languages."""
    words = lambda name: F.transform(F.filter(F.split(name, r"[\s/\-]+"), lambda p: F.length(p) >= 2), F.lower)
    both = lambda name: F.concat(words(name), F.when(F.length(name) >= 4, F.array(F.lower(name))).otherwise(F.array().cast("array<string>")))
    side = lambda key, at: T.lookup({k: names[at] for k, names in V.GLOSSARY.items()}, key)
    return F.flatten(F.transform(T.glossary_keys(q), lambda k: F.concat(both(side(k, 0)), both(side(k, 1)))))


def search_terms(q: Column, limit: int = 16) -> Column:
    """Terms to search a question by: content words, names, hyphenated, chemical and short technical terms; then other spellings, Russian stems and glossary names."""
    short = F.filter(T.tokens(q), lambda t: t.isin(*V.SHORT_TERMS))
    ph = F.when(T.has(q, T.bounded("ph")), F.array(F.lit("ph"))).otherwise(F.array().cast("array<string>"))
    low = lambda a: F.filter(F.transform(a, lambda t: T.strip(F.lower(t))), lambda t: t != "")
    own = F.array_distinct(F.concat(T.significant_terms(q), low(name_phrases(q)), low(hyphen_terms(q)), low(chemical_terms(q)), ph, short))
    more = lambda o: F.array_distinct(F.concat(o, F.filter(T.tokens(q), lambda t: ~t.isin(*V.STOPWORDS))))
    spelled = lambda base: F.array_distinct(F.concat(base, spelled_alike(base)))
    stemmed = lambda s: F.concat(s, F.flatten(F.transform(s, T.prefix_stems)))
    base = T.bind(own, lambda o: F.when(F.size(o) >= 2, o).otherwise(more(o)))
    return F.slice(F.array_distinct(F.concat(T.bind(T.bind(base, spelled), stemmed), glossary_terms(q))), 1, limit)


def numeric_anchors(q: Column) -> Column:
    """Numbers and ranges with their units, then chemical terms; 16 at most."""
    numbers = F.array_distinct(T.every(q, "(?iu)" + V.NUMERIC_ANCHOR))
    return F.slice(F.concat(numbers, _distinct(chemical_terms(q))), 1, 16)


def asks_name(q: Column) -> Column:
    return T.has(q, T.bounded(V.NAME_WORDS))


def asks_time(q: Column) -> Column:
    return T.has(q, T.bounded(V.TEMPORAL_WORDS))


def asks_experiments(q: Column) -> Column:
    return T.has(q, "(?iu)" + V.EXPERIMENT_LIST)


def asks_comparison(q: Column) -> Column:
    return T.has(q, T.bounded(V.COMPARISON_WORDS))


def asks_aggregate(q: Column) -> Column:
    return T.has(q, T.bounded(V.AGGREGATE_WORDS))


def asks_harm(q: Column) -> Column:
    return T.any_of(F.lower(q), V.HARM_TERMS)


def asks_technical(q: Column) -> Column:
    """Whether technical values are asked for: by a technical word, a quantity with a number, a list of experiments, or two anchors and five content words."""
    by_word = T.has(q, "(?iu)" + V.TECHNICAL) | T.has(q, T.bounded(V.TECHNICAL_WORDS))
    by_number = T.has(q, T.bounded(V.QUANTITY_WORDS)) & T.has(q, r"\d")
    many = (F.size(numeric_anchors(q)) >= 2) & (F.size(T.significant_terms(q)) >= 5)
    return (T.strip(q) != "") & (by_word | by_number | asks_experiments(q) | many)


def asks_quantity(q: Column) -> Column:
    return T.has(q, T.bounded(V.QUANTITY_WORDS)) | asks_technical(q) | (F.size(T.page_references(q)) > 0)


def intent(q: Column) -> Column:
    """All that a question tells about what it asks for."""
    return F.struct(
        T.strip(q).alias("original"), T.letter_language(q).alias("language"), asks_name(q).alias("is_name"), asks_time(q).alias("is_temporal"), asks_quantity(q).alias("is_quantitative"),
        asks_technical(q).alias("is_technical"), asks_experiments(q).alias("wants_experiments"), asks_harm(q).alias("harm"), search_terms(q).alias("terms"), numeric_anchors(q).alias("anchors"),
        T.page_references(q).alias("pages"),
    )


def keyword_string(q: Column, extra: Column | None = None) -> Column:
    """Up to twelve search terms, and the content words of extra keywords, as one string."""
    terms = search_terms(q, 14)
    if extra is not None:
        words = F.filter(F.flatten(F.transform(extra, T.tokens)), lambda t: ~t.isin(*V.STOPWORDS))
        terms = F.array_distinct(F.concat(terms, words))
    return T.bind(terms, lambda t: F.when(F.size(t) > 0, F.array_join(F.slice(t, 1, 12), " ")).otherwise(T.strip(q)))


def rewrite(q: Column) -> Column:
    """A question with its keywords, as search_query and keywords: search terms and the anchors that are not among them, twelve at most."""
    extra = lambda terms: T.bind(F.transform(terms, F.lower), lambda low: F.filter(numeric_anchors(q), lambda a: ~F.array_contains(low, F.lower(a))))
    words = T.bind(search_terms(q, 14), lambda terms: F.slice(F.concat(terms, extra(terms)), 1, 12))
    label = F.when(T.letter_language(q) == "ru", "ключевые термины").otherwise("keywords")
    said = lambda w: F.when(F.size(w) > 0, F.concat(T.strip(q), F.lit(" — "), label, F.lit(": "), F.array_join(F.slice(w, 1, 10), ", "))).otherwise(T.strip(q))
    return T.bind(words, lambda w: F.struct(said(w).alias("search_query"), w.alias("keywords")))


def parsed_rewrite(answer: Column) -> Column:
    """search_query, search_query_en and keywords (ten at most) of the first JSON object in a model's answer that has a search_query; null without one."""
    kind = "struct<search_query:string,search_query_en:string,keywords:array<string>>"
    found = F.filter(F.transform(T.every(answer, r"(?s)\{[^{}]*\}"), lambda x: F.from_json(x, kind)), lambda o: T.strip(F.coalesce(o["search_query"], F.lit(""))) != "")
    words = lambda o: F.slice(F.filter(F.transform(F.coalesce(o["keywords"], F.array().cast("array<string>")), T.strip), lambda k: k != ""), 1, 10)
    return F.get(F.transform(found, lambda o: F.struct(T.strip(o["search_query"]).alias("search_query"), T.strip(F.coalesce(o["search_query_en"], F.lit(""))).alias("search_query_en"), words(o).alias("keywords"))), F.lit(0))


def auxiliary_queries(q: Column) -> Column:
    """Further queries beside a question: its rewrite and its keyword string, where they differ from it."""
    both = T.bind(rewrite(q), lambda r: F.array(r["search_query"], keyword_string(q, r["keywords"])))
    return F.array_distinct(F.filter(both, lambda s: (s != T.strip(q)) & (s != "")))


def inferred_filters(q: Column, this_year: Column | None = None) -> Column:
    """geography, year_from and year_to that a question implies."""
    low = F.lower(q)
    place = F.when(T.any_of(low, V.DOMESTIC_MARKERS), "domestic").when(T.any_of(low, V.INTERNATIONAL_MARKERS), "international")
    span = r"(20\d{2})\s*[-–]\s*(20\d{2})"
    year = lambda i: F.nullif(F.regexp_extract(q, span, i), F.lit("")).cast("int")
    recent = T.has(low, rf"last\s+5\s+years|последн{T.WORD}*\s+5\s+лет")
    now = F.year(F.current_date()) if this_year is None else this_year
    return F.struct(place.alias("geography"), F.coalesce(year(1), F.when(recent, now - 5)).alias("year_from"), year(2).alias("year_to"))


def focus_query(q: Column, material: Column, process: Column) -> Column:
    """A question after the material and process that it is about."""
    given = F.array_join(F.filter(F.array(T.strip(material), T.strip(process)), lambda x: x != ""), " ")
    return F.when(given == "", q).otherwise(T.strip(F.concat_ws(" ", given, q)))


def focus_terms(q: Column, material: Column, process: Column, prop: Column) -> Column:
    """The filters in lower case and the content words of four letters or more."""
    given = F.filter(F.transform(F.array(material, process, prop), lambda x: F.lower(T.strip(x))), lambda x: x != "")
    return F.array_distinct(F.concat(given, T.significant_terms(q, 4)))


def title_named(q: Column, title: Column) -> Column:
    """Whether a question names a title: two of its words, one of five letters or more, or the whole of four or more."""
    words = F.slice(F.filter(T.tokens(title), lambda t: (F.length(t) >= 3) & ~t.isin(*V.TITLE_STOPWORDS)), 1, 8)
    low = F.lower(q)
    hits = F.filter(words, lambda t: F.contains(low, t))
    whole = F.regexp_replace(T.strip(F.lower(title)), r"\s+", " ")
    return F.coalesce((F.size(words) > 0) & ((F.size(hits) >= 2) | ((F.size(hits) == 1) & (F.length(F.get(hits, F.lit(0))) >= 5)) | ((F.length(whole) >= 4) & F.contains(low, whole))), F.lit(False))


def context_chars(tokens: Column) -> Column:
    """Characters of excerpts that a model's context of so many tokens takes: what is left of it after instructions and answer."""
    small = tokens <= 8192
    left = F.greatest(F.lit(1200), tokens - F.when(small, 3000).otherwise(2500))
    return F.floor(left * F.when(small, 2.7).otherwise(3.2)).cast("int")


def chunk_chars(tokens: Column, chunks: Column) -> Column:
    """Characters of each of so many chunks: an even share among twelve at most, 480 to 2,200."""
    return F.greatest(F.lit(480), F.least(F.lit(2200), F.floor(context_chars(tokens) / F.greatest(F.lit(1), F.least(chunks, F.lit(12)))))).cast("int")
