"""Column functions over text: languages, tokens, keys, hashes, values."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import values as V

#: Spelling of the word class that counts as a token; letters, digits and underscores of any script.
TOKEN = r"[A-Za-z\x{0400}-\x{04FF}0-9]{2,}"
WORD = r"[\p{L}\p{N}_]"
CYRILLIC = r"[\x{0400}-\x{04FF}]"
STOPWORDS = V.STOPWORDS
TRACKING = V.TRACKING


def bounded(pattern: str) -> str:
    """A pattern between word boundaries of any script, in either case."""
    return rf"(?iu)(?<!{WORD})(?:{pattern})(?!{WORD})"


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether a text holds one of some literal parts: many of them as one pattern, so that expressions stay small."""
    if len(parts) > 8:
        return has(text, "|".join(f"\\Q{p}\\E" for p in parts))
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def bind(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a small table of fixed values, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def letter_language(text: Column) -> Column:
    """ru, mixed or en by counts of Cyrillic and Latin letters; three or more Cyrillic ones in the majority are ru."""
    cyrillic, latin = count(text, CYRILLIC), count(text, "[A-Za-z]")
    return F.when((cyrillic >= 3) & (cyrillic > latin), "ru").when((cyrillic > 0) & (latin > 0), "mixed").otherwise("en")


def answer_language(question: Column) -> Column:
    """ru or en: of a mixed question the script with more letters."""
    language = letter_language(question)
    more = count(question, CYRILLIC) > count(question, "[A-Za-z]")
    return F.when((language == "ru") | ((language == "mixed") & more), "ru").otherwise("en")


def document_language(text: Column, configured: str = "auto") -> Column:
    """ru if the first 12,000 characters have more Cyrillic letters than 40 and a quarter of the Latin ones, else en; or the configured one."""
    if configured.strip().lower() in ("ru", "en"):
        return F.lit(configured.strip().lower())
    head = F.substring(F.coalesce(text, F.lit("")), 1, 12_000)
    return F.when(count(head, "[А-Яа-яЁё]") > F.greatest(count(head, "[A-Za-z]") * 0.25, F.lit(40.0)), "ru").otherwise("en")


def tokens(text: Column) -> Column:
    return every(F.lower(text), TOKEN)


def significant_terms(text: Column, least: int = 2) -> Column:
    """Distinct tokens in order, without stop words and short ones (two letters count in Russian and mixed texts, else three); the first 48 characters if none is left."""
    short = F.greatest(F.when(letter_language(text) == "en", 3).otherwise(2), F.lit(least))
    kept = bind(short, lambda n: F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= n) & ~t.isin(*V.STOPWORDS))))
    head = F.substring(strip(F.lower(text)), 1, 48)
    return bind(kept, lambda k: F.when(F.size(k) > 0, k).when(head == "", F.array().cast("array<string>")).otherwise(F.array(head)))


def page_references(text: Column) -> Column:
    """Numbers over 0 after "page", "pages", "p.", "pp." or the Russian forms; the first eight distinct ones."""
    found = every(text, rf"(?iu)(?<!{WORD})(?:page|pages|p\.|pp\.|стр\.?|страниц(?:а|е|ы)?)\s*[#:]?\s*(\d{{1,4}})(?!{WORD})", 1)
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda p: p > 0)), 1, 8)


def prefix_stems(token: Column) -> Column:
    """Prefixes of 4 to 6 letters of a Russian word that leave two or more; none of other words."""
    plain = F.translate(F.lower(token), "ё", "е")
    stems = F.filter(F.transform(F.array(F.lit(4), F.lit(5), F.lit(6)), lambda n: F.when(F.length(plain) >= n + 2, F.substring(plain, F.lit(1), n))), lambda s: s.isNotNull())
    return F.when(has(token, CYRILLIC) & (F.length(plain) >= 5), stems).otherwise(F.array().cast("array<string>"))


def term_matches(term: Column, low: Column) -> Column:
    """Whether a lower-case text holds a term or one of its Russian stems."""
    return (term != "") & (F.contains(low, term) | F.exists(prefix_stems(term), lambda s: F.contains(low, s)))


def _compatible() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form (NFKC) is one other character, and those forms."""
    pairs = [(c, n) for c in map(chr, range(0x80, 0x10000)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ODD, _PLAIN = _compatible()


def plain_name(name: Column) -> Column:
    """A name as keys see it: lower-case, compatibility characters as plain ones (those of one character), ё as е, one blank for runs of blanks, underscores and hyphens."""
    low = F.regexp_replace(F.translate(strip(F.lower(F.coalesce(name, F.lit("")))), _ODD, _PLAIN), "ё", "е")
    return strip(F.regexp_replace(F.regexp_replace(low, r"[_\-]+", " "), r"\s+", " "))


def _glossary_forms() -> dict[str, str]:
    forms = {}
    for key, (ru, en) in V.GLOSSARY.items():
        for form in (key, ru, en):
            forms[" ".join(form.lower().replace("ё", "е").replace("_", " ").replace("-", " ").split())] = key
    return forms


#: Spellings of the glossary's terms; of terms with one spelling the later one counts.
GLOSSARY_FORMS = _glossary_forms()


def canonical_key(name: Column) -> Column:
    """The glossary's key of a known name, else its plain form with underscores."""
    plain = plain_name(name)
    return F.coalesce(lookup(GLOSSARY_FORMS, plain), F.regexp_replace(plain, r"\s+", "_"))


def glossary_name(name: Column, language: str) -> Column:
    """A known name in Russian or English, any other as it is."""
    at = 1 if language == "en" else 0
    return F.coalesce(lookup({form: V.GLOSSARY[key][at] for form, key in GLOSSARY_FORMS.items()}, plain_name(name)), strip(name))


def glossary_keys(text: Column) -> Column:
    """Keys of the glossary terms that a text holds in any spelling, in the order of the glossary."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.array(*(F.lit(f) for f in dict.fromkeys((k.replace("_", " "), ru.lower(), en.lower(), k)))).alias("forms")) for k, (ru, en) in V.GLOSSARY.items()))
    low = F.lower(text)
    return F.transform(F.filter(entries, lambda e: F.exists(e["forms"], lambda f: F.contains(low, f))), lambda e: e["key"])


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, path without closing slash (but for the root), no fragment and tracking parameters, the rest of the query sorted; text without scheme or host as it is."""
    bare = strip(url)
    scheme, host = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(bare, r"://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    short = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(bare, r"^[^#?]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*V.TRACKING)))
    shown = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), short, F.when(F.size(kept) > 0, F.concat(F.lit("?"), shown)).otherwise(""))
    return F.when((scheme == "") | (host == ""), bare).otherwise(whole)


def hash_text(text: Column) -> Column:
    """Text as it is hashed: trimmed, lower-cased, white space as one blank."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def chunk_key(chunk_id: Column, text: Column) -> Column:
    """A chunk's id, or the first 32 hex digits of its text's sha256."""
    return F.coalesce(F.nullif(chunk_id.cast("string"), F.lit("")), F.substring(F.sha2(strip(text), 256), 1, 32))


def first_number(text: Column) -> Column:
    """The first token as a number, with a decimal comma allowed; null otherwise."""
    return F.replace(F.substring_index(F.trim(text), " ", 1), F.lit(","), F.lit(".")).try_cast("double")


def plain_number(text: Column) -> Column:
    """A number with decimal point or comma; null for anything else, comparisons included."""
    return F.when(~has(text, r"^\s*[<>]"), F.replace(strip(text), F.lit(","), F.lit(".")).try_cast("double"))


def value_range(text: Column) -> Column:
    """low, high of "a-b" with any dash or "to"; both null for other text, an end null that is compared ("<5")."""
    pattern = r"(?iu)^\s*([<>]?\s*[\d.]+)\s*[-–—~to]+\s*([<>]?\s*[\d.]+)\s*$"
    part = lambda i: plain_number(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")))
    return F.struct(part(1).alias("low"), part(2).alias("high"))


def property_value(value: Column, low: Column, high: Column, source: Column) -> Column:
    """value, low, high of a raw property: a range as its middle, else the value itself, else an end that is given, else the source text."""

    def of(r: Column) -> Column:
        ranged = r["low"].isNotNull() & r["high"].isNotNull()
        least, most = F.when(ranged, F.coalesce(low, r["low"])).otherwise(low), F.when(ranged, F.coalesce(high, r["high"])).otherwise(high)
        middle = F.coalesce((least + most) / 2, least, most).cast("string")
        return F.struct(F.when(value.isNotNull() & ~F.coalesce(ranged, F.lit(False)), value).otherwise(F.coalesce(middle, source)).alias("value"), least.alias("low"), most.alias("high"))

    return bind(value_range(value), of)


def display_value(value: Column, low: Column, high: Column, unit: Column) -> Column:
    """A property value to show: "low-high unit" or "value unit"."""
    shown = F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low.cast("string"), high.cast("string"))).otherwise(value)
    return F.trim(F.concat_ws(" ", shown, F.coalesce(unit, F.lit(""))))


def property_label(name: Column, language: str = "en") -> Column:
    """A property's label: of the table, else its words in title case (English) or with blanks (Russian)."""
    key = strip(F.coalesce(name, F.lit("")))
    words = F.filter(F.split(key, "_"), lambda w: w != "")
    other = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ") if language == "en" else F.replace(key, F.lit("_"), F.lit(" "))
    known = lookup({k: en if language == "en" else ru for k, (en, ru) in V.PROPERTY_LABELS.items()}, key)
    return F.when(key == "", "Measured parameter" if language == "en" else "Измеряемый параметр").otherwise(F.coalesce(known, other))


def celsius(value: Column, unit: Column) -> Column:
    return F.when(unit == "K", value - 273.15).when(unit == "°F", (value - 32) * 5 / 9).otherwise(value)


def hours(value: Column, unit: Column) -> Column:
    return F.when(unit == "min", value / 60).when(unit == "s", value / 3600).otherwise(value)


def valid_share(percent: Column) -> Column:
    """Whether a mass fraction lies between 0 and 100 percent."""
    return percent.between(0, 100)


def compound_parts(text: Column) -> Column:
    """The names in a field that joins them with | / , or ; (one of a single sign only if that is a letter); the whole text if none is left."""
    bare = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[.…]{2,}$", "")
    parts = F.transform(F.split(bare, r"[|/,;]+"), lambda p: F.regexp_replace(strip(p), r"^\.+|\.+$", ""))
    kept = F.filter(parts, lambda p: (F.length(p) >= 2) | has(p, r"^\p{L}$"))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).when(F.size(kept) > 0, kept).otherwise(F.array(strip(bare)))


def one_language(name: Column, language: str) -> Column:
    """The side of a label such as "католит - Catholyte" that is in the language; labels in one script as they are."""
    clean = entity_name(name)
    out = clean
    for sign in (" / ", ": ", " — ", " – ", " - "):  # the first that tells the sides apart counts, so it is applied last
        left, right = strip(F.substring_index(clean, sign, 1)), strip(F.substring(clean, F.instr(clean, sign) + len(sign), F.length(clean)))
        cyrillic = lambda side: has(side, "[А-Яа-яЁё]")
        apart = F.contains(clean, F.lit(sign)) & (left != "") & (right != "") & (cyrillic(left) != cyrillic(right))
        wanted = cyrillic(left) if language == "ru" else ~cyrillic(left)
        out = F.when(apart, F.when(wanted, left).otherwise(right)).otherwise(out)
    return out


def entity_name(name: Column) -> Column:
    """A name without blanks and .;, at its ends and with single blanks inside."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[ .;,]+|[ .;,]+$", ""), r"\s+", " ")


def person_name(name: Column) -> Column:
    """First Last of "Last, First M."; other names with single blanks."""
    clean = strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    reversed_ = has(clean, r"^[A-Z][a-zA-Z\-']+,\s+[A-Z][a-zA-Z\-'.]+(?:\s+[A-Z][a-zA-Z\-'.]+)?$")
    return F.when(reversed_, F.concat_ws(" ", strip(F.regexp_replace(clean, "^[^,]*,", "")), strip(F.substring_index(clean, ",", 1)))).otherwise(clean)


def material_class(raw: Column) -> Column:
    """The class that a raw label names, itself or by an alias: of several labels the first known one; null if none is."""
    known = {c: c for c in V.MATERIAL_CLASSES} | V.CLASS_ALIASES
    labels = F.filter(F.transform(F.split(strip(raw), r"[|/,;]+"), lambda t: F.regexp_replace(strip(F.lower(t)), "[ -]", "_")), lambda t: t != "")
    return F.get(F.filter(F.transform(labels, lambda t: F.coalesce(lookup(known, t), lookup(known, F.replace(t, F.lit("_"), F.lit(" "))))), lambda c: c.isNotNull()), F.lit(0))


def material_state(raw: Column) -> Column:
    """solid, liquid, powder or film; of several the first known one, else solid."""
    parts = F.transform(F.split(F.lower(F.coalesce(raw, F.lit(""))), r"\|"), strip)
    return F.coalesce(F.get(F.filter(parts, lambda p: p.isin("solid", "liquid", "powder", "film")), F.lit(0)), F.lit("solid"))


def regime_type(raw: Column, name: Column, description: Column) -> Column:
    """The regime that a raw type, else a name, else a description stands for: itself, by an alias that it holds or is held by, or by a hint in all three."""
    texts = F.filter(F.transform(F.array(raw, name, description), lambda c: strip(F.lower(c))), lambda c: c != "")
    aliases = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(r).alias("regime")) for a, r in V.REGIME_ALIASES.items()))

    def of(text: Column) -> Column:
        key = F.regexp_replace(text, "[ -]", "_")
        part = F.get(F.filter(F.transform(F.split(F.replace(text, F.lit("_"), F.lit(" ")), r"\|"), strip), lambda p: p.isin(*V.REGIMES)), F.lit(0))
        near = F.get(F.filter(aliases, lambda a: F.contains(key, a["alias"]) | F.contains(a["alias"], key)), F.lit(0))["regime"]
        return F.coalesce(F.when(key.isin(*V.REGIMES), key), part, lookup(V.REGIME_ALIASES, key), near)

    found = F.get(F.filter(F.transform(texts, of), lambda r: r.isNotNull()), F.lit(0))
    blob = F.array_join(texts, " ")
    hinted = F.lit("other")
    for regime, hints in reversed(V.REGIME_HINTS.items()):
        hinted = F.when(any_of(blob, hints), regime).otherwise(hinted)
    return F.coalesce(found, hinted)


def upload_title(name: Column) -> Column:
    """A file name as a title: without extension, underscores as blanks, 300 characters at most."""
    raw = strip(F.coalesce(name, F.lit("")))
    base = F.regexp_replace(raw, r"^.*/", "")
    stem = F.when(F.contains(raw, F.lit(".")), F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")).otherwise(raw)
    return F.substring(strip(F.regexp_replace(F.regexp_replace(strip(stem), "_+", " "), r"\s+", " ")), 1, 300)


def blocked_host(url: Column) -> Column:
    """Whether a URL's host is one that is not taken in."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).isin(*V.BLOCKED_HOSTS)


def section_title(text: Column) -> Column:
    """The heading among the first three lines of a page: in capitals, numbered, or a known one; 100 characters at most."""

    def heading(line: Column) -> Column:
        numbered = F.lit(False)
        for s in V.SECTION_STARTS:
            numbered = numbered | F.startswith(line, F.lit(s))
        capitals = (F.upper(line) == line) & (F.lower(line) != line)
        return (line != "") & (F.length(line) <= 100) & (capitals | numbered | F.lower(line).isin(*V.SECTION_NAMES))

    return F.get(F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 3), strip), heading), F.lit(0))


def figure_caption(text: Column) -> Column:
    """The first line that names a figure."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda line: any_of(F.lower(line), V.CAPTION_MARKS)), F.lit(0))


def image_type(caption: Column) -> Column:
    """Kind of a picture by the words of its caption; the first kind that fits."""
    kind, low = F.lit("other"), F.lower(F.coalesce(caption, F.lit("")))
    for name, marks in reversed(V.IMAGE_TYPES.items()):
        kind = F.when(any_of(low, marks), name).otherwise(kind)
    return kind


def page_estimate(words: Column, breaks: Column) -> Column:
    """Pages of a text of so many words and page breaks: 400 words a page, or one more than the breaks."""
    by_words, by_breaks = F.greatest(F.lit(1), F.ceil(words / 400)), F.when(breaks > 0, breaks + 1).otherwise(0)
    return F.when((words == 0) & (breaks == 0), 0).otherwise(F.greatest(by_words, by_breaks)).cast("int")


def is_refusal(text: Column) -> Column:
    """Whether a model's answer declines, and is no JSON."""
    return any_of(F.lower(F.coalesce(text, F.lit(""))), V.REFUSALS) & ~F.contains(F.coalesce(text, F.lit("")), F.lit("{"))


def is_overflow(message: Column) -> Column:
    return any_of(F.lower(F.coalesce(message, F.lit(""))), V.OVERFLOWS)


def is_login_page(html: Column) -> Column:
    """Whether a page asks to sign in instead of showing its content."""
    low = F.lower(html)
    asks = F.contains(low, F.lit("sign in"))
    wall = any_of(low, ["idp.nature.com"]) | (F.contains(low, F.lit("springer nature")) & asks)
    return wall | (asks & any_of(low, ["password", "institutional access"]) & (F.length(html) < 80_000))


def table_blocks(text: Column) -> Column:
    """The table blocks of a text, tags included."""
    return every(text, V.TABLE_BLOCK)


def lacks_table(text: Column) -> Column:
    """Whether a text speaks of a table without a block that has six bars and a rule."""
    usable = F.exists(table_blocks(text), lambda b: (count(b, r"\|") >= 6) & F.contains(b, F.lit("---")))
    return has(text, bounded(V.TABLE_HINT)) & ~usable


def citation_coverage(answer: Column, sources: Column) -> Column:
    """Share of sentences that cite source numbers, all of them in range."""
    sentences = F.filter(F.transform(F.split(answer, r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    numbers = lambda s: F.transform(every(s, r"\[(\d+)\]", 1), lambda n: n.cast("int"))
    cited = F.filter(sentences, lambda s: (F.size(numbers(s)) > 0) & F.forall(numbers(s), lambda n: n.between(1, sources)))
    return F.when((F.size(sentences) == 0) | (sources <= 0), 0.0).otherwise(F.size(cited) / F.size(sentences))


def rescaled_confidence(score: Column) -> Column:
    """Similarities of 0.40 to 0.75 as confidences of 0.72 to 0.94, others as the nearer end."""
    return 0.72 + (F.greatest(F.lit(0.40), F.least(F.lit(0.75), score)) - 0.40) / 0.35 * 0.22


def hedges(answer: Column) -> Column:
    """Whether an answer says that the sources do not suffice."""
    return has(answer, "(?iu)" + "|".join(f"(?:{h})" for h in V.HEDGES))


def final_confidence(mean: Column, chunks: Column, method: str, answer: Column) -> Column:
    """A mean retrieval confidence with what chunks (three or more) and citations add, and 0.58 at most for an answer that hedges."""
    start = F.least(mean, F.lit(0.78)) if method == "keyword" else mean
    cited = count(answer, r"\[\d+\]")
    more = F.least(F.lit(1.0), start + F.when(chunks >= 3, 0.03).otherwise(0.0))
    boosted = F.least(F.lit(1.0), more + F.when(cited >= 3, 0.06).when(cited >= 1, 0.04).otherwise(0.0))
    return F.round(F.when(hedges(answer) & (boosted > 0), F.least(boosted, F.lit(0.58))).otherwise(boosted), 3)


def unique_names(names: Column) -> Column:
    """The first of names that differ by case or blanks only, in order."""
    clean = F.filter(F.transform(names, lambda n: regexp_clean(n)), lambda n: n != "")
    return bind(clean, lambda c: bind(F.transform(c, F.lower), lambda keys: F.filter(c, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)))


def regexp_clean(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def cell_text(cell: Column) -> Column:
    """Text of a table cell: entities (those of HTML's markup, and the soft hyphen) resolved twice, breaks and white space as one blank."""
    out = F.coalesce(cell, F.lit(""))
    for _ in range(2):
        for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&shy;", "\u00ad"), ("&amp;", "&")):
            out = F.replace(out, F.lit(mark), F.lit(sign))
    return regexp_clean(F.replace(F.regexp_replace(out, r"(?i)&(?:lt|gt|amp|#\d+|#x[0-9a-f]+);|<br\s*/?>", " "), F.lit("\u00ad"), F.lit("")))


def grid_rows(grid: Column) -> Column:
    """The rows of a grid of cells that have a text, cleaned."""
    return F.filter(F.transform(grid, lambda row: F.transform(row, cell_text)), lambda row: F.exists(row, lambda c: c != ""))


def grid_markdown(grid: Column) -> Column:
    """A grid as a Markdown table whose first row is the header; empty without rows."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = lambda head: line(F.transform(head, lambda _: F.lit("---")))
    whole = lambda r: F.concat(F.array(line(r[0]), rule(r[0])), F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1))), line))
    return bind(grid_rows(grid), lambda r: F.when(F.size(r) == 0, "").otherwise(F.array_join(whole(r), "\n")))


def grid_quality(grid: Column) -> Column:
    """0 to 1 for a table: filled cells, numbers and rows speak for it, leftovers of markup against it; 0 for less than two rows, two columns or four cells."""

    def score(rows: Column) -> Column:
        cells = F.flatten(rows)
        some = F.filter(cells, lambda c: c != "")
        bad = F.size(F.filter(some, lambda c: has(c, r"(?i)^col\d+$")))
        good = F.filter(some, lambda c: ~has(c, r"(?i)^col\d+$"))
        numbers = F.size(F.filter(good, lambda c: has(c, r"\d")))
        wide = F.array_max(F.transform(rows, F.size))
        waste = bad / F.greatest(F.lit(1), F.size(cells))
        value = F.size(good) / F.greatest(F.lit(1), F.size(cells)) * 0.72 + F.least(F.lit(0.12), F.size(rows) / 12 * 0.12) + F.least(F.lit(0.15), numbers / F.greatest(F.lit(1), F.size(good)) * 0.15) - waste * 0.65
        cut = F.when(waste > 0.35, value * 0.45).otherwise(value)
        return F.when((F.size(rows) < 2) | (wide < 2) | (F.size(good) < 4), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cut)))

    return bind(grid_rows(grid), score)
