"""The functions that SQL users may call: normalize_key, mask_value, shannon_entropy and aba_check.

They are SQL functions, so their bodies are part of a query's plan; tests hold them against the column expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import NUMERIC
from .dialect import WS

_DOTS = "•"
_DIGITS = "regexp_replace(value, '[^0-9]', '')"
_LAST = f"right({_DIGITS}, 4)"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


BODIES = {
    "normalize_key(type STRING, value STRING) RETURNS STRING": f"CASE WHEN type IN ({', '.join(repr(t) for t in NUMERIC)}) THEN {_DIGITS} ELSE regexp_replace(lower(value), '{_quoted(rf'\A[{WS}]+|[{WS}]+\z')}', '') END",
    "mask_value(type STRING, value STRING) RETURNS STRING": f"""CASE type
        WHEN 'EMAIL' THEN concat(substr(value, 1, 1), '{_DOTS * 6}@', substring_index(value, '@', -1))
        WHEN 'PHONE' THEN concat('{_DOTS * 3}-{_DOTS * 3}-', {_LAST})
        WHEN 'SSN' THEN concat('{_DOTS * 3}-{_DOTS * 2}-', {_LAST})
        WHEN 'CREDIT_CARD' THEN concat('{_DOTS * 4} ', {_LAST})
        WHEN 'BANK' THEN concat('{_DOTS * 5}', {_LAST})
        WHEN 'API_KEY' THEN if(char_length(value) > 7, concat(substr(value, 1, 3), '{_DOTS * 4}', right(value, 4)), '{_DOTS * 8}')
        WHEN 'PASSWORD' THEN '{_DOTS * 8}'
        WHEN 'ADDRESS' THEN trim(concat(regexp_extract(value, '^[0-9]+', 0), ' {_DOTS * 5}'))
        WHEN 'DATE_OF_BIRTH' THEN '{_DOTS * 2}/{_DOTS * 2}/{_DOTS * 4}'
        WHEN 'IP_ADDRESS' THEN concat('{_DOTS * 3}.{_DOTS * 3}.{_DOTS * 3}.', substring_index(value, '.', -1))
        ELSE concat(substr(value, 1, 1), '{_DOTS * 6}') END""",
    "shannon_entropy(value STRING) RETURNS DOUBLE": "aggregate(array_distinct(split(value, '')), cast(0 as double), (h, c) -> h - (size(filter(split(value, ''), x -> x = c)) / char_length(value)) * log2(size(filter(split(value, ''), x -> x = c)) / char_length(value)))",
    "aba_check(value STRING) RETURNS BOOLEAN": f"CASE WHEN value RLIKE '^[0-9]{{9}}$' AND value <> '000000000' THEN ({' + '.join(f'{w} * cast(substr(value, {i + 1}, 1) AS INT)' for i, w in enumerate((3, 7, 1) * 3))}) % 10 = 0 ELSE false END",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
