"""Answers of a model as tables: the JSON object in them, and the materials, experiments and names that it lists."""

from __future__ import annotations

import json
import re
from itertools import chain, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from factweave.functions import classify as K
from factweave.functions import text as T
from factweave.functions import values as V
from factweave.operators.extraction import placeholder, template, unique_rows
from factweave.store import kept

_NAMES = {"None": "null", "True": "true", "False": "false"}


def _mended(text: str) -> str:
    plain = text.strip().replace("“", '"').replace("”", '"').replace("‘", "'").replace("’", "'")
    return re.sub(r"\b(None|True|False)\b", lambda m: _NAMES[m[1]], re.sub(r",\s*([}\]])", r"\1", plain))


def _object(text: str) -> dict | None:
    """A text as an object, as it is or with quotes, closing commas and names of another language put right."""
    for candidate in (str, _mended):
        try:
            found = json.loads(candidate(text))
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def _balanced(text: str):
    """Every part of a text from an opening brace to the one that closes it; braces in strings do not count."""
    marks = [(m.start(), m[0]) for m in re.finditer(r'\\.|["{}]', text, re.S)]
    for n, (start, sign) in enumerate(marks):
        # An escaped sign still opens an object if the scan begins at it.
        if sign[-1] != "{":
            continue
        depth, quoted = 0, False
        for at, mark in chain([(start, "{")], islice(marks, n + 1, None)):
            if len(mark) > 1 and quoted:
                continue
            kind = mark[-1]
            if kind == '"':
                quoted = not quoted
            elif kind in "{}" and not quoted:
                depth += 1 if kind == "{" else -1
                if not depth:
                    yield text[start + len(sign) - 1 : at + len(mark)]
                    break


def _largest(text: str | None) -> str | None:
    content = (text or "").strip()
    found = _object(content) if content else None
    if found is None:
        for fence in (r"```json\s*(.*?)\s*```", r"```\s*(.*?)\s*```"):
            inside = re.search(fence, content, re.S | re.I)
            found = found if found is not None or not inside else _object(inside[1].strip())
    if found is None:
        size = 0
        for candidate in _balanced(content):
            # What could not take its place is not read: the parts of an object that was.
            if len(candidate) > size and (other := _object(candidate)) is not None:
                found, size = other, len(json.dumps(other))
    if found is None and "{" in content and content.rfind("}") > content.find("{"):
        found = _object(content[content.find("{") : content.rfind("}") + 1])
    return None if found is None else json.dumps(found, ensure_ascii=False)


@pandas_udf(StringType())
def answer_object(text: pd.Series) -> pd.Series:
    """The JSON object of an answer as plain JSON: the whole answer, a fenced part, or the largest balanced part that can be read, mended where that helps; null if there is none."""
    return text.map(_largest)


_PROPERTY = "struct<value:string,unit:string,value_min:string,value_max:string,source_text:string>"
_PROPERTIES = f"map<string,{_PROPERTY}>"
_MATERIAL = f"struct<name:string,aliases:array<string>,material_class:string,state:string,properties:{_PROPERTIES},microstructure_features:array<string>>"
_EXPERIMENT = f"struct<material_name:string,regime:struct<regime_type:string,name:string,description:string,parameters:{_PROPERTIES}>,measured_properties:{_PROPERTIES},conclusions:array<string>>"


def listed(objects: DataFrame, key: str, kind: str) -> DataFrame:
    """The elements of a list of the objects (answer_id, object), in order: answer_id, place, item; what is no list, or cannot be read, has none.

    ``kind`` is the schema of an element, in DDL.
    """
    items = F.from_json(F.get_json_object("object", f"$.{key}"), "array<string>")
    return objects.select("answer_id", F.posexplode(items).alias("place", "raw")).where("raw IS NOT NULL").select("answer_id", "place", F.col("raw").alias("raw"), F.from_json("raw", kind).alias("item"))


def composition(value: Column) -> Column:
    """The parts of a composition ({"Ni": 1.2, "Cu": "3-5", "S": "<2"}) as a map of texts: numbers as such, ranges as low–high, other texts as they are; null parts go, and a value that is none gives null."""
    parts = F.from_json(F.when(F.startswith(T.strip(value), F.lit("{")), value), "map<string,string>")

    def one(text: Column) -> Column:
        return T.bind(T.value_range(text), lambda r: F.when(r["low"].isNotNull() & r["high"].isNotNull(), F.concat(r["low"].cast("string"), F.lit("–"), r["high"].cast("string"))).otherwise(F.coalesce(T.plain_number(text).cast("string"), T.strip(text))))

    return T.bind(F.map_filter(parts, lambda _, v: v.isNotNull()), lambda given: F.when(F.size(given) > 0, F.transform_values(given, lambda _, v: one(v))))


def property_values(properties: Column) -> Column:
    """Raw properties as structs of name, value, low, high, unit and composition; those without any value go."""

    def one(entry: Column) -> Column:
        raw = entry["value"]
        is_map = F.coalesce(F.startswith(T.strip(raw["value"]), F.lit("{")), F.lit(False))
        number = lambda c: T.plain_number(c)
        plain = T.property_value(F.when(~is_map, raw["value"]), number(raw["value_min"]), number(raw["value_max"]), F.nullif(raw["source_text"], F.lit("")))
        read = F.struct(plain.alias("p"), composition(raw["value"]).alias("parts"))
        return T.bind(read, lambda r: F.struct(entry["key"].alias("name"), F.when(is_map, F.to_json(r["parts"])).otherwise(r["p"]["value"]).alias("value"), r["p"]["low"].alias("low"), r["p"]["high"].alias("high"), raw["unit"].alias("unit"), r["parts"].alias("composition")))

    entries = F.filter(F.map_entries(F.coalesce(properties, F.create_map().cast(_PROPERTIES))), lambda e: e["value"].isNotNull())
    return F.filter(F.transform(entries, one), lambda p: p["value"].isNotNull())


def materials(objects: DataFrame, language: str = "en") -> DataFrame:
    """Materials of the objects: answer_id, place, part, name, aliases, material_class (null if the label names none), state, features, properties.

    A name that joins several stands for each of them; the first has the aliases, class, features and properties.
    Names in two languages show one; classes of matter, names of other things and leftovers of a prompt go.
    """
    rows = kept(listed(objects, "materials", _MATERIAL).select("answer_id", "place", "item", F.posexplode(T.compound_parts(F.col("item.name"))).alias("part", "raw_name")))
    first = F.col("part") == 0
    none = F.array().cast("array<string>")
    # Answers share names, so each different one is judged once; they are stored, as Spark would judge before it makes them distinct.
    names = kept(rows.select("raw_name").distinct()).withColumn("name", T.one_language(F.col("raw_name"), language))
    named = rows.join(kept(names.where(K.material_name(F.col("name")) & ~template(F.col("name")))), "raw_name")
    own = lambda c: F.when(first, F.coalesce(c, none)).otherwise(none)
    properties = property_values(F.when(first, F.col("item.properties")))
    return named.select("answer_id", "place", "part", "name", own(F.col("item.aliases")).alias("aliases"), F.when(first, T.material_class(F.col("item.material_class"))).alias("material_class"), T.material_state(F.col("item.state")).alias("state"), own(F.col("item.microstructure_features")).alias("features"), properties.alias("properties"))


def experiments(objects: DataFrame, language: str = "en") -> DataFrame:
    """Experiments of the objects that name a material: answer_id, place, material, regime_type, regime_name, description, parameters, measured, conclusions."""
    rows = listed(objects, "experiments", _EXPERIMENT).withColumn("material", T.one_language(T.strip(F.coalesce("item.material_name", F.lit(""))), language))
    regime = F.col("item.regime")
    return rows.where((F.col("material") != "") & ~template(F.col("material"))).select(
        "answer_id", "place", "material", T.regime_type(regime["regime_type"], regime["name"], regime["description"]).alias("regime_type"), regime["name"].alias("regime_name"), regime["description"].alias("description"),
        property_values(regime["parameters"]).alias("parameters"), property_values(F.col("item.measured_properties")).alias("measured"), F.coalesce("item.conclusions", F.array().cast("array<string>")).alias("conclusions"),
    )


def _names(objects: DataFrame, key: str, fields: str) -> DataFrame:
    """Names of a list whose elements are texts or objects with a name: answer_id, place, part, raw_name, item, is_object."""
    kind = f"struct<name:string{fields}>"
    rows = listed(objects, key, kind)
    text = F.when(F.startswith(T.strip(F.col("raw")), F.lit("{")), F.col("item.name")).otherwise(F.col("raw"))
    return rows.select("answer_id", "place", F.posexplode(T.compound_parts(text)).alias("part", "raw_name"), "item", F.startswith(T.strip(F.col("raw")), F.lit("{")).alias("is_object"))


def processes(objects: DataFrame, language: str = "en") -> DataFrame:
    """Processes of the objects, each key once, the first: answer_id, name, key, aliases, materials (names that are no leftovers of a prompt)."""
    none = F.array().cast("array<string>")
    rows = _names(objects, "processes", ",aliases:array<string>,materials:array<string>").withColumn("name", T.one_language(F.col("raw_name"), language))
    keyed = rows.withColumn("key", T.canonical_key(F.col("name"))).where((F.col("name") != "") & (F.col("key") != "") & ~template(F.col("name")) & ~placeholder(F.col("name"), "process"))
    first = unique_rows(keyed, {"answer": F.col("answer_id"), "key": F.col("key")}, ["place", "part"])
    given = lambda c: F.filter(F.coalesce(c, none), lambda x: x.isNotNull() & (x != ""))
    stated = F.filter(F.transform(given(F.col("item.materials")), T.strip), lambda x: (x != "") & ~template(x))
    return first.select("answer_id", "name", "key", given(F.col("item.aliases")).alias("aliases"), stated.alias("materials"))


def equipment(objects: DataFrame, key: str = "equipment") -> DataFrame:
    """Equipment of the objects, each name once whatever its case: answer_id, name."""
    rows = _names(objects, key, "").where((F.col("raw_name") != "") & ~template(F.col("raw_name")) & ~placeholder(F.col("raw_name"), "equipment"))
    return unique_rows(rows, {"answer": F.col("answer_id"), "key": F.lower("raw_name")}, ["place", "part"]).select("answer_id", F.col("raw_name").alias("name"))


def facilities(objects: DataFrame) -> DataFrame:
    """Facilities of the objects, each name once: answer_id, name, country, facility_type (of those known, else null)."""
    rows = _names(objects, "facilities", ",country:string,facility_type:string").where("is_object").where((F.col("raw_name") != "") & ~template(F.col("raw_name")))
    first = unique_rows(rows, {"answer": F.col("answer_id"), "key": F.lower("raw_name")}, ["place", "part"])
    country, kind = F.nullif(T.strip(F.coalesce("item.country", F.lit(""))), F.lit("")), F.lower(T.strip(F.col("item.facility_type")))
    return first.select("answer_id", F.col("raw_name").alias("name"), F.when(~template(country), country).alias("country"), F.when(kind.isin(*V.FACILITY_TYPES), kind).alias("facility_type"))


def experts(objects: DataFrame) -> DataFrame:
    """Experts of the objects whose names are shaped like a person's, each once: answer_id, name (first name first), field (null if a placeholder)."""
    rows = listed(objects, "experts", "struct<name:string,field:string>").where("item IS NOT NULL").withColumn("name", T.entity_name(T.person_name(F.col("item.name"))))
    good = rows.where((F.col("name") != "") & ~template(F.col("name")) & K.person(F.col("name")))
    field = F.nullif(T.entity_name(F.col("item.field")), F.lit(""))
    first = unique_rows(good, {"answer": F.col("answer_id"), "key": F.lower("name")}, ["place"])
    return first.select("answer_id", "name", F.when(~placeholder(field, "field"), field).alias("field"))
