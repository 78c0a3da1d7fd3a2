"""Story labels: dict-like text, often broken, to a record of fixed fields.

One vectorised pass over the texts reads those that are complete literals, by the rules of Python literals: strings
side by side, escapes, tuples and nesting of any depth. What it returns per field is the raw text or list; for other
texts patterns find each field on its own. Cases, numbers and times are worked out afterwards, once per field,
whichever way the raw value came.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import dates
from tidemark.functions import text as tx

# Other names under which a field may stand, in the order in which they are tried.
_ALSO = {
    "short_description": ["short description"],
    "long_description": ["long description"],
    "virality_potential": ["viral_potential", "viralityPotential"],
}
_ALSO_BROKEN = {**_ALSO, "virality_potential": ["viralityPotential"]}


# --- complete literals --------------------------------------------------------------


def literal_dict(text: str) -> dict | None:
    """The dict that a text is a complete literal of, else None."""
    try:
        with warnings.catch_warnings():
            # An unknown escape stays as it is; no word about it per row.
            warnings.simplefilter("ignore")
            found = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _text(record: dict, name: str) -> str:
    value = next((v for k in (name, *_ALSO.get(name, ())) if (v := record.get(k))), "")
    return str(value)


def _number(record: dict, name: str) -> str:
    value = next((v for k in (name, *_ALSO.get(name, ())) if (v := record.get(k)) is not None), "")
    return str(value)


def _time(record: dict, name: str) -> str | None:
    value = record.get(name)
    return None if value is None else str(value)


def _list(record: dict, name: str) -> list[str]:
    value = record.get(name)
    if isinstance(value, str):
        value = value.split(",")
    items = [str(v).strip() for v in value] if isinstance(value, (list, tuple, set)) else []
    return [v for v in items if v]


def _readers(fields: Sequence[str]) -> dict[str, Callable[[dict, str], Any]]:
    kinds = [
        (fixed.LABEL_TEXT_FIELDS, _text),
        (fixed.LABEL_LIST_FIELDS, _list),
        (fixed.LABEL_ID_FIELDS, lambda record, name: _text(record, name).strip()),
        (fixed.LABEL_TIME_FIELDS, _time),
        (fixed.LABEL_NUMBER_FIELDS, _number),
    ]
    return {name: read for names, read in kinds for name in names if name in fields}


def _record(text: Column, fields: Sequence[str]) -> Column:
    """Raw values of the fields where the text is one complete literal; `whole` tells whether it is."""
    readers = _readers(fields)
    types = [f"`{n}` {'array<string>' if n in fixed.LABEL_LIST_FIELDS else 'string'}" for n in readers]

    @F.pandas_udf(", ".join(["whole boolean", *types]))
    def read(texts: pd.Series) -> pd.DataFrame:
        records = [literal_dict(t) if t else None for t in texts]
        columns: dict[str, list] = {"whole": [r is not None for r in records]}
        for name, reader in readers.items():
            columns[name] = [None if r is None else reader(r, name) for r in records]
        return pd.DataFrame(columns)

    return read(text)


# --- broken text ----------------------------------------------------------------------


def _key(name: str) -> str:
    return fixed.LABEL_KEY.format(key=name)


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _scalar(text: Column, name: str) -> Column:
    """Value after a key: Timestamp('...'), quoted, or a bare token; NULL when there is none."""
    pattern = _key(name) + fixed.LABEL_SCALAR
    found = [_filled(F.regexp_extract(text, pattern, group)) for group in (1, 2, 3)]
    return F.trim(F.coalesce(*found))


def _tokens_of(text: Column, name: str) -> Column:
    """Quoted tokens of a list, also of one that never closes; else comma-separated quoted text."""
    opened = _key(name) + fixed.LABEL_OPEN_LIST
    inside = F.regexp_extract(text, opened + fixed.LABEL_LIST_INSIDE, 1)
    listed = F.regexp_extract_all(inside, F.lit(fixed.LABEL_QUOTED_TOKEN), F.lit(1))
    plain = _filled(F.regexp_extract(text, _key(name) + fixed.LABEL_QUOTED_TOKEN, 1))
    tokens = F.when(text.rlike(opened), listed).when(plain.isNotNull(), F.split(plain, ","))
    return F.transform(tokens.otherwise(F.array().cast("array<string>")), lambda t: F.trim(t))


def _from_broken(text: Column, name: str) -> Column:
    """The raw value of a field, found by its patterns."""
    names = [name, *_ALSO_BROKEN.get(name, ())]
    if name in fixed.LABEL_LIST_FIELDS:
        return _tokens_of(text, name)
    if name in fixed.LABEL_NUMBER_FIELDS:
        return F.coalesce(*[_filled(F.regexp_extract(text, _key(n) + fixed.LABEL_NUMBER, 1)) for n in names])
    value = F.coalesce(*[_scalar(text, n) for n in names])
    if name in fixed.LABEL_ID_FIELDS:
        # A bare zero or False is no id.
        value = F.when(text.rlike(_key(name) + r"(?:-?0+(?:\.0*)?|False)\s*[,}]"), "").otherwise(value)
    return value


# --- the operator ------------------------------------------------------------------------


def _finished(raw: Column, name: str) -> Column:
    if name in fixed.LABEL_LIST_FIELDS:
        return F.coalesce(F.array_join(F.transform(raw, tx.title_case), ", "), F.lit(""))
    if name in fixed.LABEL_TIME_FIELDS:
        return dates.lenient_timestamp(raw)
    if name in fixed.LABEL_NUMBER_FIELDS:
        return tx.lenient_double(raw)
    return F.coalesce(raw, F.lit(""))


def parse(df: DataFrame, text: str, fields: Sequence[str] = tuple(fixed.LABEL_FIELDS)) -> DataFrame:
    """Add the asked-for label fields and parse_path: literal, pattern or empty.

    Never fails: what is not found keeps its default, '' or 0.0 or NULL for times.
    """
    unknown = set(fields) - set(fixed.LABEL_FIELDS)
    if unknown:
        raise ValueError(f"unknown label fields: {sorted(unknown)}")
    body = F.coalesce(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), F.lit(""))
    read = df.withColumn("_text", body).withColumn("_record", _record(F.col("_text"), fields))
    whole = F.col("_record.whole")
    path = F.when(F.col("_text") == "", "empty").when(whole, "literal").otherwise("pattern")
    # The path is chosen here; what follows works on one raw value per field.
    raw = {
        f"_raw_{name}": F.when(whole, F.col(f"_record.{name}")).otherwise(_from_broken(F.col("_text"), name))
        for name in fields
    }
    chosen = read.withColumns({**raw, "parse_path": path}).drop("_text", "_record", *fields)
    finished = {name: _finished(F.col(f"_raw_{name}"), name) for name in fields}
    kept = [c for c in chosen.columns if c != "parse_path" and c not in raw]
    return chosen.select(*kept, *[finished[name].alias(name) for name in fields], "parse_path")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
