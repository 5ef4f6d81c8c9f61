"""Column expressions that score a passage for a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import values as V


def share(n: Column, full: float) -> Column:
    return F.least(F.lit(1.0), n / full)


def numeric_density(text: Column) -> Column:
    """0.55 for six numbers, 0.45 for three units, in proportion below."""
    units = T.count(text, rf"(?iu){V.UNITS}|mt(?!{T.WORD})")
    return F.when(T.strip(text) == "", 0.0).otherwise(0.55 * share(T.count(text, V.NUMBER), 6) + 0.45 * share(units, 3))


def years(text: Column) -> Column:
    return T.count(text, T.bounded(V.YEAR))


def year_density(text: Column) -> Column:
    return share(years(text), 4)


def harm(text: Column) -> Column:
    """A third for each term of harm."""
    low = F.lower(text)
    return share(sum((F.contains(low, F.lit(t)).cast("int") for t in V.HARM_TERMS), F.lit(0)), 3)


def bibliography_penalty(text: Column) -> Column:
    """What a list of references loses: its heading 0.25, DOIs 0.35, more than eight years 0.2; 0.5 at most."""
    low = F.lower(text)
    headed = F.when(T.any_of(F.substring(low, 1, 400), V.REFERENCE_MARKERS), 0.25).otherwise(0.0)
    cited = F.when((T.count(low, "doi") >= 2) | F.contains(low, F.lit("ssrn")), 0.35).otherwise(0.0)
    return F.least(F.lit(0.5), headed + cited + F.when(years(text) > 8, 0.2).otherwise(0.0))


def contents_penalty(text: Column) -> Column:
    """0.35 for a table of contents: four lines or more, of which three and 45 % are short headings without full stop."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"), T.strip), lambda x: x != "")

    def heading(line: Column) -> Column:
        first = F.substring(line, 1, 1)
        return (F.length(line) < 55) & (F.size(F.split(line, r"\s+")) <= 6) & (F.upper(first) == first) & (F.lower(first) != first) & ~F.endswith(line, F.lit("."))

    short = F.size(F.filter(lines, heading))
    return F.when((F.size(lines) >= 4) & (short >= 3) & (short / F.size(lines) >= 0.45), 0.35).otherwise(0.0)


def name_density(text: Column) -> Column:
    """A fifth for each run of capitalised words."""
    return share(T.count(text, rf"(?<!{T.WORD})(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)+)(?!{T.WORD})"), 5)


def title_boost(title: Column, terms: list[str]) -> Column:
    """0.08 for each term in the title, 0.25 at most."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.least(F.lit(0.25), 0.08 * sum((T.term_matches(F.lit(t), low).cast("int") for t in terms), F.lit(0)))


def coverage(text: Column, weights: dict[str, float]) -> Column:
    """Weight of the terms that a text holds, Russian ones by their stems too, over the weight of all."""
    low, total = F.lower(text), sum(weights.values()) or 1.0
    return sum((F.when(T.term_matches(F.lit(t), low), w).otherwise(0.0) for t, w in weights.items()), F.lit(0.0)) / total


def bigram_share(text: Column, words: list[str]) -> Column:
    """Share of neighbouring words of a question that a text has side by side."""
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(f"{a} {b}")).cast("int") for a, b in zip(words, words[1:], strict=False)), F.lit(0))
    return F.least(F.lit(1.0), hits / max(1, len(words) - 1))


def lexical(text: Column, weights: dict[str, float], words: list[str]) -> Column:
    return 0.72 * coverage(text, weights) + 0.28 * bigram_share(text, words)


def final_score(intent, weights: dict[str, float]) -> Column:
    """The score of a chunk of the pool (text, title, rrf, sources) for a question; names weigh more where a name is asked for."""
    text, zero = F.col("text"), F.lit(0.0)
    named = bool(intent.is_name)
    parts = {
        "lexical": (0.2 if named else 0.3) * coverage(text, weights),
        "name": 0.3 * name_density(text) if named else zero,
        "harm": (0.15 if named else 0.2) * harm(text) if intent.harm else zero,
        "year": (0.15 if named else 0.2) * year_density(text) if intent.is_temporal else zero,
        "numeric": (0.2 if named else 0.25) * numeric_density(text) if intent.is_technical or intent.is_quantitative else zero,
        "percent": F.when(F.contains(text, F.lit("%")), 0.1).otherwise(0.0) if intent.is_quantitative and not named else zero,
        "title": title_boost(F.col("title"), list(weights)),
        "page": F.when(F.array_contains("sources", "page"), 0.45).otherwise(0.0),
        "two": F.when(F.size("sources") > 1, 0.05).otherwise(0.0),
    }
    return sum(parts.values(), F.col("rrf")) - bibliography_penalty(text) - contents_penalty(text)
