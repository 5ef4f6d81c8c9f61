"""Names of persons and institutions: what is shaped like one, and those that texts state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import classify as K
from factweave.functions import text as T
from factweave.functions import values as V


def affiliation_name(name: Column) -> Column:
    clean = T.entity_name(name)
    return (clean != "") & (K.organisation_name(clean) | T.any_of(F.lower(clean), V.AFFILIATION_MARKS))


def first_names_first(name: Column) -> Column:
    """A clean name, "Last, First" turned round."""
    return T.entity_name(T.person_name(T.entity_name(name)))


def _unique(names: Column) -> Column:
    """The first of names that differ by case alone."""
    return T.bind(names, lambda c: T.bind(F.transform(c, F.lower), lambda keys: F.filter(c, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)))


def _authors(candidates: Column) -> Column:
    return F.filter(F.transform(candidates, first_names_first), K.author_name)


def _split(lines: Column) -> Column:
    """The names of lines that list several."""
    return F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, V.NAME_DELIMITERS))), T.entity_name), lambda n: n != "")


def _labelled(text: Column, labels: list[str]) -> Column:
    return _split(F.concat(*(T.every(text, p, 1) for p in labels)))


def listed_people(text: Column, reach: int = 8000) -> Column:
    """Names of a roster: in the ``reach`` characters after its heading, with a role after a dash, or numbered and alone on their line."""
    after = F.regexp_extract(text, V.ROSTER_HEADING.replace("(?iu)", "(?iu)(?:", 1) + rf")(?s:(.{{0,{reach}}}))", 1)
    return _unique(_authors(F.concat(T.every(after, V.ROSTER_ITEM, 1), T.every(after, V.NUMBERED_NAME, 1))))


def numbered_people(text: Column) -> Column:
    """Names of lists without a heading, in a whole text."""
    return _unique(_authors(F.concat(T.every(text, V.ROSTER_ITEM, 1), T.every(text, V.NUMBERED_NAME, 1))))


def labelled_authors(text: Column, short: int = 400) -> Column:
    """Names after labels of authors and in a roster; a text under ``short`` characters without any is taken as a line of names."""
    stated = _authors(_labelled(text, V.AUTHOR_LABELS))
    bare = _authors(_split(F.array(text)))
    front = T.bind(stated, lambda s: F.when((F.size(s) == 0) & (F.length(text) < short) & (F.trim(text) != ""), bare).otherwise(s))
    return _unique(F.concat(front, listed_people(text)))


def organisations(text: Column, plain: bool = False) -> Column:
    """Institutions after labels and by their legal form, the longest first, without those that a longer one holds; ``plain`` texts have no marks of slides or sections."""
    legal = lambda n: T.bind(F.regexp_extract(n, V.LEGAL_NAME, 0), lambda m: F.when(m != "", T.entity_name(m)).otherwise(T.entity_name(n)))
    found = F.filter(F.transform(F.concat(*(T.every(text, p, 1) for p in V.INSTITUTION_LABELS)), legal), lambda n: K.organisation_name(n, plain))
    ordered = F.array_sort(F.transform(_unique(found), lambda n, i: F.struct((-F.length(n)).alias("n"), i.alias("i"), n.alias("name"))))
    names = F.transform(ordered, lambda x: x["name"])
    return T.bind(names, lambda c: F.filter(c, lambda n: ~F.exists(c, lambda o: (F.lower(o) != F.lower(n)) & F.contains(F.lower(o), F.lower(n)))))


# Persons in running text


def parted_text(text: Column) -> Column:
    """A text whose words that ran together at a capital or at a verb of speech are parted again."""
    said = "said|noted|shared|stated|сказал|сказала|отметил|отметила|заявил|подчеркнул"
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{FFFD}\x{00AD}\x{00A0}]", " ")
    out = F.regexp_replace(out, rf"(?iu)({said})([A-ZА-ЯЁ])", "$1 $2")
    out = F.regexp_replace(out, r"(?iu)([a-zа-яё])(said|noted|shared|stated|сказал|сказала|отметил|отметила)(?![\p{L}\p{N}_])", "$1 $2")
    out = F.regexp_replace(out, r"(?iu)([a-zа-яё])(noted|said|отметил|сказал)(?![\p{L}\p{N}_])", "$1 $2")
    out = F.regexp_replace(F.regexp_replace(out, "([a-z])([A-Z])", "$1 $2"), "([а-яё])([А-ЯЁ])", "$1 $2")
    return F.regexp_replace(out, r"(?U)\s+", " ")


def person_names(text: Column, parts: list[str] = V.NO_NAME_PARTS, ends: list[str] = V.PATRONYMIC_ENDS) -> Column:
    """Names of three and of two words in a parted text, each once, that can be a person's: none of their words is listed, they hold none of ``parts`` and have none of ``ends``."""
    bounded = lambda p: rf"(?<!{T.WORD}){p}(?!{T.WORD})"
    found = F.transform(F.concat(T.every(text, bounded(V.THREE_NAMES), 1), T.every(text, bounded(V.TWO_NAMES), 1)), lambda n: F.regexp_replace(T.strip(n), r"\s+", " "))

    def likely(name: Column) -> Column:
        words = F.split(name, " ")
        good = F.forall(words, lambda w: (F.length(w) >= 3) & T.has(w, r"^\p{L}+$") & ~w.isin(V.NO_SURNAMES))
        for end in ends:
            good = good & ~F.endswith(name, F.lit(end))
        return F.size(words).between(2, 3) & good & ~T.any_of(name, parts)

    return F.filter(_unique(found), likely)


def role_of(text: Column, name: Column) -> Column:
    """The first role, in the order of the list, in the 80 characters before the first place of a name and the 120 after it; null without one.

    A name stands where its words are whole, not inside of others, and its own letters are no role.
    """
    place = F.concat(F.lit(rf"(?iu)(?<!{T.WORD})\Q"), name, F.lit(rf"\E(?!{T.WORD})"))
    window = T.bind(F.split(text, place, 2), lambda s: F.lower(F.concat(F.right(F.get(s, F.lit(0)), F.lit(80)), F.lit("\n"), F.left(F.get(s, F.lit(1)), F.lit(120)))))
    return T.bind(window, lambda w: F.get(F.filter(F.array(*map(F.lit, V.ROLE_HINTS)), lambda h: F.contains(w, h)), F.lit(0)))


def acts(text: Column, name: Column) -> Column:
    """Whether a text speaks of a name as a person: with a role near, after a verb of speech, or before a comma or bracket."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    spoken = F.rlike(text, F.concat(F.lit(rf"(?iu)(?<!{T.WORD})(?:said|stated|сказал|сказала|отметил|отметила)\s+"), quoted, F.lit(rf"(?!{T.WORD})")))
    marked = F.rlike(text, F.concat(F.lit(rf"(?<!{T.WORD})"), quoted, F.lit(r"\s*[,(]")))
    return role_of(text, name).isNotNull() | spoken | marked
