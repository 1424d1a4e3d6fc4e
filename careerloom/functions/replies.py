"""JSON requests to and replies from a labeler."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions.text import strip

ITEM = "struct<company_name:string,label:string,confidence:double,reason:string>"


def json_list(names: Column | str) -> Column:
    """Array of names as JSON text."""
    return F.to_json(names)


def without_fences(reply: Column | str) -> Column:
    """Reply text without the code fence around it."""
    text = strip(reply)
    opened = F.regexp_replace(text, r"^```[^\n]*\n", "")
    opened = F.when(text.startswith("```") & ~text.contains("\n"), F.substr(text, F.lit(4))).otherwise(opened)
    return strip(F.regexp_replace(opened, r"```$", ""))


def reply_items(reply: Column | str, item: str = ITEM, name: str = "company_name") -> Column:
    """Label records of a reply as an array; broken text gives an empty one.

    Accepted: an array of objects, an object with an array somewhere among its
    values, a map from name to object, or one object.
    """
    text = without_fences(reply)
    array = F.from_json(text, f"array<{item}>")
    values = F.map_entries(F.from_json(text, "map<string,string>"))
    arrays = F.filter(
        F.transform(values, lambda e: F.when(e["value"].startswith("["), F.from_json(e["value"], f"array<{item}>"))),
        lambda a: a.isNotNull(),
    )
    objects = F.filter(values, lambda e: e["value"].startswith("{"))
    keyed = F.transform(objects, lambda e: _with_name(F.from_json(e["value"], item), e["key"], name))
    single = F.array(F.from_json(text, item))
    found = (
        F.when(text.startswith("["), array)
        .when(F.size(arrays) > 0, F.get(arrays, 0))
        .when(F.size(objects) > 0, keyed)
        .when(text.startswith("{") & values.isNotNull(), single)
    )
    empty = F.array().cast(f"array<{item}>")
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), empty)


def _with_name(record: Column, key: Column, name: str) -> Column:
    return record.withField(name, F.coalesce(record[name], key))


def known_label(label: Column | str, allowed: list[str] = fx.LABEL_ORDER, default: str | None = fx.DEFAULT_LABEL) -> Column:
    """Label in lower case; a label outside the list becomes the default."""
    text = F.lower(strip(label))
    return F.when(text.isin(*allowed), text).otherwise(F.lit(default))
