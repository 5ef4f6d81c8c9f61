"""Registered queries of the text functions: over questions, passages, names, values and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import classify as K
from factweave.functions import questions as Q
from factweave.functions import scores as S
from factweave.functions import text as T
from factweave.functions import values as V
from factweave.plans.corpus_graph import Corpus
from factweave.registry import query


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# DuckDB's word boundaries know ASCII letters only and look no further, so a boundary is a character of another kind or an end.
_EDGE = "[^\\p{L}\\p{N}_]"


def _bounded(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i)(^|{_EDGE})(?:{pattern})($|{_EDGE})')"


def _holds(text: str, parts) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, p.replace("'", "''")) for p in parts) + ")"


_CYR, _LAT = "len(regexp_extract_all(q, '[\\x{0400}-\\x{04FF}]'))", "len(regexp_extract_all(q, '[A-Za-z]'))"
_LANG = f"CASE WHEN {_CYR} >= 3 AND {_CYR} > {_LAT} THEN 'ru' WHEN {_CYR} > 0 AND {_LAT} > 0 THEN 'mixed' ELSE 'en' END"
_BLANK = "E' \\t\\n\\r'"
_TOK = "regexp_extract_all(lower(q), '[A-Za-z\\x{0400}-\\x{04FF}0-9]{2,}')"
_STOP = _list(V.STOPWORDS)
#: The question's own rows: distinct in order by list_distinct would lose the order, so the first places are kept.
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_KEPT = f"list_filter({_TOK}, lambda t: length(t) >= CASE WHEN {_LANG} = 'en' THEN 3 ELSE 2 END AND NOT list_contains({_STOP}, t))"
_TERMS = f"CASE WHEN len({_KEPT}) > 0 THEN {_FIRST.format(_KEPT)} WHEN trim(q, {_BLANK}) = '' THEN []::VARCHAR[] ELSE [trim(lower(q), {_BLANK})[:48]] END"


@query(f"SELECT conv_id, turn, {_LANG} AS language, CASE WHEN {_LANG} = 'ru' OR ({_LANG} = 'mixed' AND {_CYR} > {_LAT}) THEN 'ru' ELSE 'en' END AS answer_language FROM questions")
def question_languages(c: Corpus) -> DataFrame:
    q = F.col("q")
    return c.questions.select("conv_id", "turn", T.letter_language(q).alias("language"), T.answer_language(q).alias("answer_language"))


@query("""SELECT doc_id, CASE WHEN len(regexp_extract_all(left(coalesce(text, ''), 12000), '[А-Яа-яЁё]')) > greatest(0.25 * len(regexp_extract_all(left(coalesce(text, ''), 12000), '[A-Za-z]')), 40) THEN 'ru' ELSE 'en' END AS language FROM documents""", over_graph=False)
def document_languages(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", T.document_language(F.col("text")).alias("language"))


@query(f"SELECT conv_id, turn, array_to_string({_TERMS}, ' ') AS terms FROM questions")
def question_terms(c: Corpus) -> DataFrame:
    return c.questions.select("conv_id", "turn", F.array_join(T.significant_terms(F.col("q")), " ").alias("terms"))


# Letters beyond ASCII end a phrase as an underscore would.
_ASCII = "regexp_replace(q, '[^\\x00-\\x7F]', '_', 'g')"
_PHRASES = f"regexp_extract_all({_ASCII}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')"
_PARTED = f"flatten(list_transform({_PHRASES}, lambda m: [m] || list_filter(regexp_split_to_array(m, '\\s+'), lambda p: length(p) >= 3)))"
_HYPHEN = f"flatten(list_transform(regexp_extract_all({_ASCII}, '\\b[A-Za-z]+(?:-[A-Za-z0-9]+)+\\b'), lambda m: [m] || list_filter(string_split(m, '-'), lambda p: length(p) >= 2)))"
_CHEM = f"list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '(?i)^(?:{V.CHEMICAL})'))"
_LOWER = "list_filter(list_transform({0}, lambda x: trim(lower(x), E' \\t\\n\\r')), lambda x: x <> '')"
_OWN = (
    f"({_TERMS}) || {_LOWER.format(_PARTED)} || {_LOWER.format(_HYPHEN)} || {_LOWER.format(_CHEM)} || CASE WHEN {_bounded('q', 'ph')} THEN ['ph'] ELSE []::VARCHAR[] END || list_filter({_TOK}, lambda t: list_contains({_list(V.SHORT_TERMS)}, t))"
)
_WITH_OWN = f"own0 AS (SELECT *, {_OWN} AS o FROM questions), own AS (SELECT *, {_FIRST.format('o')} AS own FROM own0)"
_WITH_BASE = f"""base0 AS (SELECT *, CASE WHEN len(own) >= 2 THEN own ELSE own || list_filter({_TOK}, lambda t: NOT list_contains({_STOP}, t)) END AS b FROM own),
base AS (SELECT *, {_FIRST.format('b')} AS base FROM base0)"""
_SPELL = "list_filter(list_transform(base, lambda t: CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.SPELLING.items()) + " END), lambda t: t IS NOT NULL)"
_GLOSS = "[" + ", ".join(
    "{'forms': " + _list(dict.fromkeys((k.replace("_", " "), ru.lower(), en.lower(), k))) + ", 'says': "
    + _list([x for name in (ru, en) for x in [*(p.lower() for p in name.replace("/", " ").replace("-", " ").split() if len(p) >= 2), *([name.lower()] if len(name) >= 4 else [])]]) + "}"
    for k, (ru, en) in V.GLOSSARY.items()
) + "]"
_GLOSSED = f"flatten(list_transform(list_filter({_GLOSS}, lambda e: len(list_filter(e.forms, lambda f: contains(lower(q), f))) > 0), lambda e: e.says))"
_WITH_ALL = f"all0 AS (SELECT *, base || {_SPELL} || {_GLOSSED} AS a FROM base), searched AS (SELECT *, {_FIRST.format('a')} AS terms FROM all0)"
_SEARCHED = f", {_WITH_OWN}, {_WITH_BASE}, {_WITH_ALL}"


@query(f"{_SEARCHED} SELECT conv_id, turn, array_to_string(terms[:16], '|') AS terms FROM searched")
def search_terms(c: Corpus) -> DataFrame:
    return c.questions.select("conv_id", "turn", F.array_join(Q.search_terms(F.col("q")), "|").alias("terms"))


_NUMBERS = f"regexp_extract_all(q, '(?i){V.NUMERIC_ANCHOR}')"
_CHEM1 = f"list_filter({_CHEM}, lambda x, i: list_position(list_transform({_CHEM}, lambda y: lower(y)), lower(x)) = i)"
_ANCHORS = f"({_FIRST.format(_NUMBERS)} || {_CHEM1})[:16]"
_TECH = f"""(trim(q, {_BLANK}) <> '' AND (regexp_matches(q, '(?i){V.TECHNICAL}') OR {_bounded("q", "ph")} OR ({_bounded("q", V.QUANTITY_WORDS)} AND regexp_matches(q, '[0-9]')) OR regexp_matches(q, '(?i){V.EXPERIMENT_LIST}') OR (len({_ANCHORS}) >= 2 AND len({_TERMS}) >= 5)))"""
_PAGES = f"list_filter(list_transform(regexp_extract_all(q, '(?i)(?:^|{_EDGE})(?:page|pages|p\\.|pp\\.|стр\\.?|страниц(?:а|е|ы)?)\\s*[#:]?\\s*(\\d{{1,4}})\\b', 1), lambda x: x::INT), lambda x: x > 0)"


@query(f"""SELECT conv_id, turn, {_bounded("q", V.NAME_WORDS)} AS is_name, {_bounded("q", V.TEMPORAL_WORDS)} AS is_temporal, {_TECH} AS is_technical, {_bounded("q", V.QUANTITY_WORDS)} OR {_TECH} OR len({_PAGES}) > 0 AS is_quantitative,
regexp_matches(q, '(?i){V.EXPERIMENT_LIST}') AS wants_experiments, {_holds("lower(q)", V.HARM_TERMS)} AS harm, {_bounded("q", V.COMPARISON_WORDS)} AS compares, {_bounded("q", V.AGGREGATE_WORDS)} AS aggregates,
array_to_string({_ANCHORS}, '|') AS anchors, array_to_string({_FIRST.format(_PAGES)}[:8], '|') AS pages,
CASE WHEN {_holds("lower(q)", V.DOMESTIC_MARKERS)} THEN 'domestic' WHEN {_holds("lower(q)", V.INTERNATIONAL_MARKERS)} THEN 'international' END AS geography FROM questions""")
def question_intents(c: Corpus) -> DataFrame:
    q = F.col("q")
    i = c.questions.select("conv_id", "turn", "q", Q.intent(q).alias("i"))
    return i.select(
        "conv_id", "turn", *(F.col(f"i.{f}").alias(f) for f in ("is_name", "is_temporal", "is_technical", "is_quantitative", "wants_experiments", "harm")), Q.asks_comparison(q).alias("compares"), Q.asks_aggregate(q).alias("aggregates"),
        F.array_join("i.anchors", "|").alias("anchors"), F.array_join(F.col("i.pages").cast("array<string>"), "|").alias("pages"), Q.inferred_filters(q)["geography"].alias("geography"),
    )


_WORDS12 = f"(terms[:14] || list_filter({_ANCHORS}, lambda a: NOT list_contains(list_transform(terms[:14], lambda t: lower(t)), lower(a))))[:12]"


@query(f"""{_SEARCHED} SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN trim(q, {_BLANK}) || ' — ' || CASE WHEN {_LANG} = 'ru' THEN 'ключевые термины' ELSE 'keywords' END || ': ' || array_to_string(k[:10], ', ') ELSE trim(q, {_BLANK}) END AS search_query,
CASE WHEN len(terms) > 0 THEN array_to_string(terms[:12], ' ') ELSE trim(q, {_BLANK}) END AS keyword_query FROM (SELECT *, {_WORDS12} AS k FROM searched)""")
def question_rewrites(c: Corpus) -> DataFrame:
    return c.questions.select("conv_id", "turn", Q.rewrite(F.col("q"))["search_query"].alias("search_query"), Q.keyword_string(F.col("q")).alias("keyword_query"))


@query(f"""SELECT conv_id, turn, coalesce((len(w) > 0 AND (len(h) >= 2 OR (len(h) = 1 AND length(h[1]) >= 5) OR (length(title) >= 4 AND contains(lower(q), lower(title))))), false) AS named
FROM (SELECT *, list_filter(w, lambda t: contains(lower(q), t)) AS h FROM (SELECT *, list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{2,}}'), lambda t: length(t) >= 3 AND NOT list_contains({_list(V.TITLE_STOPWORDS)}, t))[:8] AS w FROM (SELECT conv_id, turn, title, CASE turn % 4 WHEN 0 THEN q ELSE 'on ' || lower(title) || q END AS q FROM questions JOIN (SELECT doc_id, regexp_extract(coalesce(text, ''), '^[^\\n.]*') AS title FROM documents) ON doc_id = conv_id)))""")
def titles_named(c: Corpus) -> DataFrame:
    """Questions and the first sentence of the document with their conversation's number; but for every second they hold it."""
    titles = c.table("documents").select(F.col("doc_id").alias("conv_id"), F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n.]*", 0).alias("title"))
    asked = F.when(F.col("turn") % 4 == 0, F.col("q")).otherwise(F.concat(F.lit("on "), F.lower("title"), "q"))
    return c.questions.join(titles, "conv_id").select("conv_id", "turn", Q.title_named(asked, F.col("title")).alias("named"))


_CTX = "floor(greatest(1200, n - CASE WHEN n <= 8192 THEN 3000 ELSE 2500 END) * CASE WHEN n <= 8192 THEN 2.7 ELSE 3.2 END)::INT"


@query(f"SELECT p_partkey AS id, {_CTX} AS total, greatest(480, least(2200, floor({_CTX} / greatest(1, least(p_size, 12)))))::INT AS each_ FROM (SELECT *, (p_size * 700)::INT AS n FROM part)", over_graph=False)
def context_sizes(c: Corpus) -> DataFrame:
    n = F.col("p_size") * 700
    return c.table("part").select(F.col("p_partkey").alias("id"), Q.context_chars(n).alias("total"), Q.chunk_chars(n, F.col("p_size")).alias("each_"))


# Passages

_UNIT = f"(?i)(?:{V.UNITS}|mt\\b)"
_NUMERIC = f"CASE WHEN trim(text, {_BLANK}) = '' THEN 0 ELSE 0.55 * least(1, len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) / 6.0) + 0.45 * least(1, len(regexp_extract_all(text, '{_UNIT}')) / 3.0) END"
_YEARS = "len(regexp_extract_all(text, '\\b(?:19|20)\\d{2}\\b'))"
_BIB = f"least(0.5, CASE WHEN {_holds('lower(text)[:400]', V.REFERENCE_MARKERS)} THEN 0.25 ELSE 0 END + CASE WHEN len(string_split(lower(text), 'doi')) > 2 OR contains(lower(text), 'ssrn') THEN 0.35 ELSE 0 END + CASE WHEN {_YEARS} > 8 THEN 0.2 ELSE 0 END)"
_NAMES = "len(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'))"
_SHORT = "list_filter(ls, lambda x: length(x) < 55 AND len(regexp_split_to_array(x, '\\s+')) <= 6 AND upper(x[1]) = x[1] AND lower(x[1]) <> x[1] AND NOT ends_with(x, '.'))"


@query(f"""SELECT doc_id, round({_NUMERIC}, 6) AS numeric, least(1, {_YEARS} / 4.0)::DOUBLE AS years, round({_BIB}, 6)::DOUBLE AS bibliography, least(1, {_NAMES} / 5.0)::DOUBLE AS names,
round(least(1, ({" + ".join(f"contains(lower(text), '{t}')::INT" for t in V.HARM_TERMS)}) / 3.0), 6)::DOUBLE AS harm,
CASE WHEN len(ls) >= 4 AND len({_SHORT}) >= 3 AND len({_SHORT}) / len(ls) >= 0.45 THEN 0.35 ELSE 0.0 END::DOUBLE AS contents
FROM (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS ls FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""", over_graph=False)
def passage_scores(c: Corpus) -> DataFrame:
    t = F.col("t")
    rows = c.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    six = lambda x, n: F.round(x, 6).alias(n)
    return rows.select("doc_id", six(S.numeric_density(t), "numeric"), six(S.year_density(t), "years"), six(S.bibliography_penalty(t), "bibliography"), six(S.name_density(t), "names"), six(S.harm(t), "harm"), S.contents_penalty(t).cast("double").alias("contents"))


_HEAD = f"list_filter(list_transform(string_split(text, chr(10))[:3], lambda x: trim(x, {_BLANK})), lambda x: x <> '' AND length(x) <= 100 AND ((upper(x) = x AND lower(x) <> x) OR {' OR '.join(f'''starts_with(x, '{s}')''' for s in V.SECTION_STARTS)} OR list_contains({_list(V.SECTION_NAMES)}, lower(x))))[1]"
_CAPTION = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_BLANK})), lambda x: {_holds('lower(x)', V.CAPTION_MARKS)})[1]"


@query(f"""SELECT doc_id, {_HEAD} AS section, {_CAPTION} AS caption, CASE {" ".join(f"WHEN {_holds('lower(coalesce(' + _CAPTION + ''', ''))''', m)} THEN '{k}'" for k, m in V.IMAGE_TYPES.items())} ELSE 'other' END AS image,
greatest(CASE WHEN w = 0 THEN 0 ELSE greatest(1, ceil(w / 400.0)) END)::INT AS pages, {_bounded("text", "table\\s*[0-9]+|таблица\\s*[0-9]+|tabular")} AND NOT regexp_matches(text, '(?is)\\[TABLE\\]') AS lacks_table,
{_holds("lower(text)", V.REFUSALS)} AND NOT contains(text, '{{') AS refusal, {_holds("lower(text)", V.OVERFLOWS)} AS overflow
FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""", over_graph=False)
def document_marks(c: Corpus) -> DataFrame:
    t = F.col("t")
    rows = c.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    return rows.select("doc_id", T.section_title(t).alias("section"), T.figure_caption(t).alias("caption"), T.image_type(T.figure_caption(t)).alias("image"), T.page_estimate(words, F.lit(0)).alias("pages"), T.lacks_table(t).alias("lacks_table"), T.is_refusal(t).alias("refusal"), T.is_overflow(t).alias("overflow"))


# Names and values


@query(f"""SELECT p_partkey AS id, array_to_string(list_filter(list_transform(regexp_split_to_array(raw, '[|/,;]+'), lambda x: trim(trim(x, {_BLANK}), '.')), lambda x: length(x) >= 2 OR regexp_matches(x, '^\\p{{L}}$')), '|') AS parts,
trim(regexp_replace(p_name, '\\s+', ' ', 'g'), ' .;,') AS clean, CASE p_type {" ".join(f"WHEN '{a.upper()}' THEN '{b}'" for a, b in ({x: x for x in V.MATERIAL_CLASSES} | V.CLASS_ALIASES).items())} END AS class
FROM (SELECT *, p_name || ' / ' || p_brand || '; ' || p_type AS raw FROM part)""", over_graph=False)
def name_parts(c: Corpus) -> DataFrame:
    p = c.table("part")
    raw = F.concat("p_name", F.lit(" / "), "p_brand", F.lit("; "), "p_type")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(T.compound_parts(raw), "|").alias("parts"), T.entity_name(F.col("p_name")).alias("clean"), T.material_class(F.col("p_type")).alias("class"))


_REGIME_LIST = "[" + ", ".join(f"{{'a': '{a}', 'r': '{r}'}}" for a, r in V.REGIME_ALIASES.items()) + "]"


def _regime(x: str) -> str:
    key = f"replace(replace({x}, ' ', '_'), '-', '_')"
    itself = f"CASE WHEN list_contains({_list(V.REGIMES)}, {key}) THEN {key} END"
    part = f"list_filter(list_transform(string_split(replace({x}, '_', ' '), '|'), lambda p: trim(p, ' ')), lambda p: list_contains({_list(V.REGIMES)}, p))[1]"
    alias, near = (f"list_filter({_REGIME_LIST}, lambda e: {test})[1].r" for test in (f"e.a = {key}", f"contains({key}, e.a) OR contains(e.a, {key})"))
    return f"coalesce({itself}, {part}, {alias}, {near})"


_HINTED = "CASE " + " ".join(f"WHEN {_holds('t || n', [h])} THEN '{r}'" for r, hints in V.REGIME_HINTS.items() for h in hints) + " ELSE 'other' END"


@query(f"""SELECT p_partkey AS id, coalesce({_regime("t")}, {_regime("n")}, {_HINTED.replace("t || n", "t || ' ' || n")}) AS regime, CASE WHEN list_contains(['solid', 'liquid', 'powder', 'film'], t) THEN t ELSE 'solid' END AS state
FROM (SELECT p_partkey, trim(lower(p_type), ' ') AS t, trim(lower(p_name), ' ') AS n FROM part)""", over_graph=False)
def regimes_and_states(c: Corpus) -> DataFrame:
    p = c.table("part")
    return p.select(F.col("p_partkey").alias("id"), T.regime_type(F.col("p_type"), F.col("p_name"), F.lit(None).cast("string")).alias("regime"), T.material_state(F.col("p_type")).alias("state"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN l_quantity - 273.15 WHEN 1 THEN (l_quantity - 32) * 5 / 9 ELSE l_quantity END AS celsius,
CASE l_linenumber % 3 WHEN 0 THEN l_quantity / 60 WHEN 1 THEN l_quantity / 3600 ELSE l_quantity END AS hours, l_quantity BETWEEN 0 AND 100 AS share, l_linenumber::DOUBLE AS low, l_linenumber + 0.5 AS high,
((l_linenumber + l_linenumber + 0.5) / 2)::DOUBLE AS middle FROM lineitem""", over_graph=False)
def unit_values(c: Corpus) -> DataFrame:
    li, kind = c.table("lineitem"), F.col("l_linenumber") % 3
    q = F.col("l_quantity")
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(" – "), (F.col("l_linenumber") + 0.5).cast("string"))
    none = F.lit(None).cast("double")
    r, v = T.value_range(text), T.property_value(text, none, none, F.lit(None).cast("string"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.celsius(q, F.when(kind == 0, "K").when(kind == 1, "°F").otherwise("°C")).alias("celsius"), T.hours(q, F.when(kind == 0, "min").when(kind == 1, "s").otherwise("h")).alias("hours"),
        T.valid_share(q).alias("share"), r["low"].alias("low"), r["high"].alias("high"), v["value"].cast("double").alias("middle"),
    )


@query("""SELECT src, dst, 'Measured ' || name AS label, value || ' kg' AS shown FROM (SELECT src, dst, value, upper(dst[6]) || lower(dst[7:]) AS name FROM measured)""")
def shown_values(c: Corpus) -> DataFrame:
    none = F.lit(None).cast("double")
    return c.measured.select("src", "dst", T.property_label(F.concat(F.lit("measured_"), F.substring("dst", 6, 99))).alias("label"), T.display_value(F.col("value"), none, none, F.lit("kg")).alias("shown"))


@query(f"""SELECT id, array_to_string(list_transform(list_filter({"[" + ", ".join("{'k': '" + k + "', 'forms': " + _list(dict.fromkeys((k.replace("_", " "), ru.lower(), en.lower(), k))) + "}" for k, (ru, en) in V.GLOSSARY.items()) + "]"}, lambda e: len(list_filter(e.forms, lambda f: contains(lower(name), f))) > 0), lambda e: e.k), '|') AS keys FROM nodes""")
def glossary_mentions(c: Corpus) -> DataFrame:
    return c.nodes.select("id", F.array_join(T.glossary_keys(F.col("name")), "|").alias("keys"))


@query(f"""SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) IN ({", ".join(repr(h) for h in V.BLOCKED_HOSTS)}) AS blocked,
contains(lower(html), 'idp.nature.com') OR (contains(lower(html), 'springer nature') AND contains(lower(html), 'sign in')) OR (contains(lower(html), 'sign in') AND (contains(lower(html), 'password') OR contains(lower(html), 'institutional access')) AND length(html) < 80000) AS login,
left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '_+', ' ', 'g'), '\\s+', ' ', 'g'), ' '), 300) AS title FROM pages WHERE contains(url, '.')""", over_graph=False)
def page_marks(c: Corpus) -> DataFrame:
    p = c.table("pages").where(F.contains("url", F.lit(".")))
    return p.select("page_id", T.blocked_host(F.col("url")).alias("blocked"), T.is_login_page(F.col("html")).alias("login"), T.upload_title(F.col("url")).alias("title"))


@query("""SELECT vec_id, round(0.72 + (greatest(0.40, least(0.75, s)) - 0.40) / 0.35 * 0.22, 6) AS vector, round(least(1, least(1, s + CASE WHEN label >= 3 THEN 0.03 ELSE 0 END) + CASE WHEN label = 0 THEN 0 ELSE 0.04 END), 3) AS final
FROM (SELECT vec_id, label, abs(embedding[1]::DOUBLE) AS s FROM embeddings)""", over_graph=False)
def confidences(c: Corpus) -> DataFrame:
    e = c.table("embeddings").withColumn("s", F.abs(F.col("embedding")[0].cast("double")))
    answer = F.when(F.col("label") == 0, "No source.").otherwise("So it is [1].")
    return e.select("vec_id", F.round(T.rescaled_confidence(F.col("s")), 6).alias("vector"), T.final_confidence(F.col("s"), F.col("label"), "vector", answer).alias("final"))


@query("""SELECT conv_id, turn, CASE WHEN n = 0 THEN 0.0 ELSE round((n - 1) / n, 6) END AS coverage FROM (SELECT conv_id, turn, len(list_filter(string_split(regexp_replace(trim(q, E' \\t\\n\\r'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::DOUBLE AS n FROM questions WHERE NOT contains(q, '[') AND regexp_matches(q, '[.!?]\\s*$'))""")
def citation_coverages(c: Corpus) -> DataFrame:
    """Questions as answers, with a citation in each sentence but the last, whose number is out of range."""
    q = T.strip(F.col("q"))
    rows = c.questions.where(~F.contains("q", F.lit("[")) & T.has(F.col("q"), r"[.!?]\s*$"))
    cited = F.concat(F.regexp_replace(F.regexp_replace(q, r"([.!?])(\s+)", " [1]$1$2"), r"([.!?])$", " [1][9]$1"))
    return rows.select("conv_id", "turn", F.round(T.citation_coverage(cited, F.lit(3)), 6).alias("coverage"))


@query()
def name_tests(c: Corpus) -> DataFrame:
    """What the names of nodes are taken for: classes of matter, materials, persons, headings."""
    n = F.col("name")
    return c.nodes.select("name").distinct().select("name", K.generic_class(n).alias("generic"), K.material_name(n).alias("material"), K.person(n).alias("person"), K.heading(n).alias("heading"), K.foreign_script(n).alias("foreign"))
