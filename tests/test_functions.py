"""Functions on literal rows, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from factweave.functions import classify as K
from factweave.functions import questions as Q
from factweave.functions import scores as S
from factweave.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first().x


CASES = [
    (T.letter_language, "аб", "en"), (T.letter_language, "абв", "ru"), (T.letter_language, "абв abcd", "mixed"), (T.letter_language, "abc", "en"), (T.letter_language, "", "en"),
    (T.answer_language, "абвг abc", "ru"), (T.answer_language, "абв abcd", "en"), (T.document_language, "я" * 41, "ru"), (T.document_language, "я" * 40, "en"), (T.document_language, "я" * 50 + "a" * 300, "en"),
    (T.significant_terms, "What is the nickel of it", ["nickel"]), (T.significant_terms, "что в руде Ni", ["руде", "ni"]), (T.significant_terms, "the of", ["the of"]), (T.significant_terms, " ", []),
    (T.page_references, "pages 12, p. 3 and pp. 4; стр. 5, page 0, homepage 7, page 12", [12, 3, 4, 5]), (T.page_references, "страница 8 страницы 9", [8, 9]),
    (T.prefix_stems, "обогащение", ["обог", "обога", "обогащ"]), (T.prefix_stems, "enrichment", []), (T.prefix_stems, "руда", []), (T.prefix_stems, "ёлочка", ["елоч"]),
    (T.canonical_key, "Ni (99.9%)", "ni_(99.9%)"), (T.canonical_key, "Серная  кислота", "h2so4"), (T.canonical_key, "de-Zn", "de_zn"), (T.canonical_key, "ＨＣｌ", "hcl"), (T.canonical_key, "Heap_leaching", "heap_leaching"), (T.canonical_key, "", ""),
    (T.canonical_url, "not a url", "not a url"), (T.canonical_url, "HTTP://A.Com", "http://a.com/"), (T.canonical_url, "http://a.com/b/?ref=1&mc_cid=2&a=&UTM_source=x#f", "http://a.com/b?a=&ref=1"), (T.canonical_url, "http://a.com/", "http://a.com/"),
    (T.first_number, "1,5 MPa", 1.5), (T.first_number, "x", None), (T.compound_parts, "a|Ni, Cu; x.../", ["a", "Ni", "Cu", "x"]), (T.compound_parts, " ", []),
    (T.person_name, "Smith, John A.", "John A. Smith"), (T.person_name, "John  Smith", "John Smith"), (T.material_class, "rock | Stainless Steel", "alloy"), (T.material_class, "ore", "ore"), (T.material_class, "xyz", None),
    (T.material_state, "LIQUID|solid", "liquid"), (T.material_state, None, "solid"), (T.upload_title, "a/1_My__Report.docx", "1 My Report"), (T.upload_title, "x_y", "x y"), (T.blocked_host, "https://Example.com/x", True), (T.blocked_host, "https://a.example.com/x", False),
    (T.section_title, "\nABSTRACT\nx", "ABSTRACT"), (T.section_title, "x\n1. Aim\ny", "1. Aim"), (T.section_title, "a\nb\nc\nABSTRACT", None), (T.section_title, "Введение", "Введение"), (T.figure_caption, "a\n Fig. 3 x", "Fig. 3 x"), (T.image_type, "Table of a chart", "plot"), (T.image_type, None, "other"),
    (T.is_refusal, "I can't discuss that", True), (T.is_refusal, '{"a": "i can\'t discuss"}', False), (T.is_login_page, "<b>Sign in</b> password", True), (T.is_login_page, "sign in", False), (T.lacks_table, "see Table 3", True),
    (T.lacks_table, "Table 3 [TABLE]|a|b|c|\n|---|\n|d|e|[/TABLE]", False), (T.lacks_table, "no", False), (T.entity_name, " a  b.; ", "a b"), (T.property_label, "flow_rate", "Flow rate"), (T.property_label, "grain_SIZE", "Grain Size"), (T.property_label, "", "Measured parameter"),
    (K.entity_kind, "перегородки", "equipment"), (K.entity_kind, "Flotation", "process"), (K.entity_kind, "1999", "temporal"), (K.entity_kind, "nickel_content", "parameter"), (K.entity_kind, "Acme Group", "organization"), (K.entity_kind, "J. Smith", "person"), (K.entity_kind, "Иванов И.И.", "person"),
    (K.entity_kind, "Kola mine", "facility"), (K.entity_kind, "H2SO4", None), (K.entity_kind, "granite", None), (K.entity_kind, "хвосты обогащения", None), (K.generic_class, "ore|concentrate", True), (K.generic_class, "flotation feed", False), (K.generic_class, "feed product", True), (K.generic_class, "", True),
    (K.heading, "Auxiliary Facility", True), (K.heading, "Chris Fleming and Joe Ferron", False), (K.person, "Copper Matte", False), (K.foreign_script, "镍", True), (K.material_name, "granite", True), (K.material_name, "ore", False),
    (Q.search_terms, "How is Coral Bay de-Zn pH?", ["coral", "bay", "coral bay", "de-zn", "de", "zn", "ph"]), (Q.numeric_anchors, "200–300 мг/л of Ni, Ni and 5 %", ["200–300 мг/л", "5 %", "Ni"]),
    (Q.asks_name, "Кто упомянут?", True), (Q.asks_name, "unnamed", False), (Q.asks_time, "how  long", True), (Q.asks_comparison, "A vs. B", True), (Q.asks_aggregate, "по всем документам", False), (Q.asks_aggregate, "in every report", True), (Q.asks_technical, "pH?", True), (Q.asks_technical, "how many 3", True), (Q.asks_technical, "hello", False),
    (Q.asks_quantity, "see page 3", True), (Q.asks_harm, "the DAMAGE", True),
    (S.numeric_density, "1 2 3 mg/l 5 % 6", 0.45 * 2 / 3 + 0.55 * 5 / 6), (S.numeric_density, " ", 0.0), (S.year_density, "1999 and 2001, 12000", 0.5), (S.bibliography_penalty, "References doi x doi", 0.5), (S.contents_penalty, "Aim\nScope\nPlan of it\nx y z.", 0.35), (S.contents_penalty, "Aim\nScope", 0.0), (S.name_density, "John Smith met Иван Петров", 0.4),
]


def test_functions(one):
    for f, given, want in CASES:
        got = one(f(F.lit(given).cast("string")))
        assert got == (pytest.approx(want) if isinstance(want, float) else want), (f.__name__, given, got)


def test_values(one):
    c = lambda x: F.lit(x).cast("double")
    assert one(T.celsius(c(212), F.lit("°F"))) == 100 and one(T.celsius(c(273.15), F.lit("K"))) == 0 and one(T.hours(c(90), F.lit("min"))) == 1.5
    assert tuple(one(T.value_range(F.lit("1.5 – 2")))) == (1.5, 2.0) and tuple(one(T.value_range(F.lit("1 to <2")))) == (1.0, None) and tuple(one(T.value_range(F.lit("x")))) == (None, None)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    assert tuple(one(T.property_value(F.lit("1-3"), none, none, text))) == ("2.0", 1.0, 3.0)
    assert tuple(one(T.property_value(F.lit("x"), none, none, text))) == ("x", None, None)
    assert one(T.property_value(text, none, none, F.lit("src")))["value"] == "src" and one(T.property_value(text, c(4), none, text))["value"] == "4.0"
    assert one(T.display_value(text, c(1), c(2), F.lit("MPa"))) == "1.0-2.0 MPa" and one(T.display_value(F.lit("5"), none, none, text)) == "5"
    assert [one(F.round(T.rescaled_confidence(c(x)), 6)) for x in (0.2, 0.4, 0.575, 0.9)] == [0.72, 0.72, 0.83, 0.94]
    assert one(T.citation_coverage(F.lit("A [1][99]. B [1]. C."), F.lit(1))) == pytest.approx(1 / 3) and one(T.citation_coverage(F.lit("A [1][99]."), F.lit(1))) == 0
    assert one(T.final_confidence(c(0.8), F.lit(3), "hybrid", F.lit("x [1]"))) == 0.87 and one(T.final_confidence(c(0.9), F.lit(1), "keyword", F.lit("Insufficient data"))) == 0.58
    assert one(T.one_language(F.lit("католит - Catholyte"), "en")) == "Catholyte" and one(T.one_language(F.lit("католит - Catholyte"), "ru")) == "католит" and one(T.one_language(F.lit("a - b"), "ru")) == "a - b"
    assert one(T.regime_type(text, F.lit("heap leaching"), text)) == "chemical" and one(T.regime_type(text, text, F.lit("in a furnace"))) == "heat_treatment" and one(T.regime_type(text, text, text)) == "other"
    assert one(T.glossary_name(F.lit("Nickel"), "ru")) == "никель" and one(T.glossary_name(F.lit(" rope "), "ru")) == "rope" and one(T.glossary_keys(F.lit("Серная кислота"))) == ["sulfuric_acid", "h2so4"]
    assert one(T.page_estimate(F.lit(401), F.lit(0))) == 2 and one(T.page_estimate(F.lit(0), F.lit(0))) == 0 and one(T.page_estimate(F.lit(5), F.lit(3))) == 4
    assert one(T.term_matches(F.lit("обогащение"), F.lit("по обогащению"))) and not one(T.term_matches(F.lit("zinc"), F.lit("zin")))
    f = one(Q.inferred_filters(F.lit("Отечественный опыт 2010-2015")))
    assert tuple(f) == ("domestic", 2010, 2015) and tuple(one(Q.inferred_filters(F.lit("abroad, last 5 years"), F.lit(2024)))) == ("international", 2019, None)
    assert one(Q.title_named(F.lit("what about Birch"), F.lit("Birch"))) and not one(Q.title_named(F.lit("what of it"), F.lit("Oak"))) and not one(Q.title_named(F.lit("x"), F.lit(None).cast("string")))
    assert one(Q.context_chars(F.lit(8192))) == 14018 and one(Q.chunk_chars(F.lit(8192), F.lit(40))) == 1168 and one(Q.chunk_chars(F.lit(32768), F.lit(2))) == 2200
    assert one(Q.rewrite(F.lit("zinc 5 %")))["search_query"] == "zinc 5 % — keywords: zinc, цинк, 5 %"
    assert one(Q.focus_query(F.lit("q"), F.lit("ore"), text)) == "ore q" and one(Q.focus_terms(F.lit("the long nickel ore"), F.lit("Ore"), text, text)) == ["ore", "long", "nickel"]
    assert one(K.blocklisted(F.lit("Nickel plant"), ["nickel"])) and not one(K.blocklisted(F.lit("Nickel plant"), ["nickel"], exact=True))
