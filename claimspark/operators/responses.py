"""Model responses to typed rows: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext, text
from ..schemas import CLASSIFICATION_FAILED, FIELDS_DEFAULTED

# The fields of an analysis with their types, and the two sets of defaults.
FIELDS = {
    "classification": "string",
    "confidence": "string",
    "key_themes": "array<string>",
    "analysis_notes": "string",
    "sentiment": "string",
    "credibility_score": "double",
}
MISSING_FIELD = {
    "classification": "Other",
    "confidence": "medium",
    "key_themes": [],
    "analysis_notes": FIELDS_DEFAULTED,
    "sentiment": "neutral",
    "credibility_score": 0.5,
}
FAILED = {
    "classification": "Other",
    "confidence": "low",
    "key_themes": [],
    "analysis_notes": CLASSIFICATION_FAILED,
    "sentiment": "neutral",
    "credibility_score": 0.3,
}


def _literal(value, dtype: str) -> Column:
    return (F.array() if value == [] else F.lit(value)).cast(dtype)


def parse_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``parsed_ok`` and the analysis fields.

    A response that is blank or is not exactly one JSON object gives the failure row. If a field
    is missing, missing and null fields get defaults; if all are there, a null stays null.
    """
    answer = F.col(response)
    body = F.when(~text.is_blank(answer), jsontext.extract_json(answer))
    variant = text.bind(body, jsontext.strict_variant)
    return text.add_columns_once(df, text.bind(variant, _fields))


def _fields(variant: Column) -> Column:
    members = F.try_variant_get(variant, "$[0]", "map<string,variant>")

    def read(keys: Column) -> Column:
        ok = keys.isNotNull()
        complete = F.size(F.array_intersect(keys, F.array(*map(F.lit, FIELDS)))) == len(FIELDS)
        values = [ok.alias("parsed_ok")]
        for name, dtype in FIELDS.items():
            given = F.try_variant_get(variant, f"$[0].{name}", dtype)
            value = (
                F.when(~ok, _literal(FAILED[name], dtype))
                .when(complete, given)
                .otherwise(F.coalesce(given, _literal(MISSING_FIELD[name], dtype)))
            )
            values.append(value.alias(name))
        return F.struct(*values)

    return text.bind(F.map_keys(members), read)
