"""Display and naming expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(mapping: dict, key) -> Column:
    m = F.create_map(*[F.lit(x) for x in itertools.chain(*mapping.items())])
    return m[_c(key)]


def format_ext(fmt) -> Column:
    return _lookup(S.FORMAT_EXT, fmt)


def compression_ext(comp) -> Column:
    return _lookup(S.COMPRESSION_EXT, comp)


def expected_ext(fmt, comp) -> Column:
    """``csv`` + ``gzip`` → ``csv.tar.gz``; no trailing dot when uncompressed."""
    return F.concat_ws(".", format_ext(fmt), F.nullif(compression_ext(comp), F.lit("")))


def domain_value(domain: list[str], index) -> Column:
    """The ``index``-th value (0-based) of an enum domain."""
    return F.element_at(F.array(*[F.lit(v) for v in domain]), (_c(index) + 1).cast("int"))


def email_in_domain(email, domain: str | None) -> Column:
    """``'@' + domain`` occurs in the address (a substring test, as the
    reference does); no configured domain accepts every address."""
    if not domain:
        return F.lit(True)
    return _c(email).contains("@" + domain)


def human_size(size) -> Column:
    """Bytes as ``1.5KB``: powers of 1024, at most two decimals, trailing
    zeros dropped, half-up. Integer arithmetic only, so it is exact."""
    s = _c(size).cast("long")
    mag = F.abs(s)
    k = F.lit(0)
    for i in range(1, len(S.SIZE_UNITS)):
        k = F.when(mag >= F.lit(1024 ** i), F.lit(i)).otherwise(k)
    div = F.pow(F.lit(1024), k).cast("decimal(38,0)")
    # hundredths of the unit, rounded half-up; exact decimal arithmetic
    num = mag.cast("decimal(38,0)") * 100 + F.floor(div / 2)
    centi = ((num - num % div) / div).cast("long")
    whole = F.floor(centi / 100).cast("long")
    frac = centi % 100
    digits = (
        F.when(frac == 0, F.lit(""))
        .when(frac % 10 == 0, F.concat(F.lit("."), (frac / 10).cast("long").cast("string")))
        .otherwise(F.concat(F.lit("."), F.lpad(frac.cast("string"), 2, "0")))
    )
    unit = F.element_at(F.array(*[F.lit(u) for u in S.SIZE_UNITS]), (k + 1).cast("int"))
    sign = F.when(s < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole.cast("string"), digits, unit)


def display_ts(ts) -> Column:
    """UTC display timestamp ``MM/dd/yyyy HH:mm:ss UTC``."""
    return F.concat(F.date_format(_c(ts), "MM/dd/yyyy HH:mm:ss"), F.lit(" UTC"))


def generated_name(base, i, ts) -> Column:
    """``<base>_<i>_<timestamp>`` with ``:`` and ``-`` removed and ``.`` and
    blanks turned into ``_`` (the bulk generator's naming rule)."""
    stamp = F.translate(F.translate(F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS 'UTC'"),
                                    ":-", ""), ". ", "__")
    return F.concat_ws("_", _c(base), _c(i).cast("string"), stamp)
