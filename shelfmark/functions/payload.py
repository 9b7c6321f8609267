"""Notification payload decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Malformed JSON lands in this field instead of becoming an all-NULL row.
CORRUPT = "_corrupt_record"
PARSED = T.StructType(S.PAYLOAD.fields + [T.StructField(CORRUPT, T.StringType())])


def decode_base64_json(data) -> Column:
    """base64 text → payload struct; NULL when the text is not base64.

    ``try_to_binary`` gives NULL on bad input where ``unbase64`` would give
    an empty string, so undecodable data stays distinguishable.
    """
    raw = F.try_to_binary(_c(data), F.lit("base64"))
    return F.from_json(F.decode(raw, "utf-8"), PARSED,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def parse_size(size) -> Column:
    """Decimal integer text → bigint; NULL for anything else (blanks,
    decimals, overflow), where the reference would stop its loop."""
    s = _c(size)
    return F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("bigint"))


def missing_required(payload) -> Column:
    """Name of the first required payload key that is absent, else NULL."""
    p = _c(payload)
    out = F.lit(None).cast("string")
    for key in reversed(S.PAYLOAD_REQUIRED):
        out = F.when(p[key].isNull(), F.lit(key)).otherwise(out)
    return out
