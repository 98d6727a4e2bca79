"""Column -> Column helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions import constants as K



def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duck_round(c: str | Column, digits: int) -> Column:
    """``round(x, n)`` with half-away-from-zero on the scaled double.

    Spark's ``round`` rounds the exact decimal value of the double, so
    0.285 -> 0.29, while the SQL engine the outputs are checked against
    scales first (0.285 * 100 = 28.499.. -> 0.28). Scaling first in Spark
    gives the same answer.
    """
    scale = float(10 ** digits)
    return F.round(col(c) * F.lit(scale)) / F.lit(scale)


def safe_bigint(c: str | Column) -> Column:
    """Text -> BIGINT the lenient way: '12' -> 12, '12.0' -> 12, '12.5' -> 13,
    '1e3' -> 1000, '' / 'x7' -> NULL. Plain integers take the exact path so
    ids beyond 2^53 survive."""
    c = col(c)
    exact = c.try_cast(T.LongType())
    return F.coalesce(exact, F.round(c.try_cast(T.DoubleType())).try_cast(T.LongType()))


def truncated_bigint(c: str | Column) -> Column:
    """Text -> number -> integer truncating toward zero ('12.7' -> 12);
    NaN, infinities and junk become NULL."""
    d = col(c).try_cast(T.DoubleType())
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    exact = col(c).try_cast(T.LongType())
    return F.coalesce(exact, F.when(ok, d.try_cast(T.LongType())))


def ntz_epoch_seconds(c: str | Column) -> Column:
    """TIMESTAMP_NTZ -> whole epoch seconds (floor), independent of the session zone."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    micros = F.timestamp_diff("MICROSECOND", epoch, col(c))
    return F.floor(micros / F.lit(1_000_000)).cast("long")


def epoch_date(epoch_s: str | Column) -> Column:
    """DATE of an epoch-seconds value in UTC (no session time zone involved)."""
    return F.date_from_unix_date(F.floor(col(epoch_s) / F.lit(86400)).cast("int"))


def epoch_label(epoch_s: str | Column, with_date: str = "M/d") -> Column:
    """'M/d HH:mm' (or 'yyyy-MM-dd HH:mm:ss') text of an epoch-seconds
    value in UTC, built from date and clock parts so the session time zone
    does not enter."""
    s = col(epoch_s)
    d = epoch_date(s)
    sec = F.pmod(s, F.lit(86400))
    hh, mm, ss = F.floor(sec / 3600).cast("int"), F.floor(F.pmod(sec, F.lit(3600)) / 60).cast("int"), F.pmod(sec, F.lit(60)).cast("int")
    if with_date == "M/d":
        return F.format_string("%d/%d %02d:%02d", F.month(d), F.dayofmonth(d), hh, mm)
    return F.format_string("%s %02d:%02d:%02d", F.date_format(d, "yyyy-MM-dd"), hh, mm, ss)


def primary_category(tags_json: str | Column) -> Column:
    """Label of the first tag whose slug is allowed; NULL if that label is
    NULL, if no tag is allowed, if an element before it is no object, or if
    the text is not a JSON array."""
    j = col(tags_json)
    # element by element: the first one that is allowed or no object decides
    arr = F.from_json(j, "array<string>")
    decides = F.get(F.filter(arr, lambda t: t.isNull() | ~t.startswith("{")
                             | F.get_json_object(t, "$.slug").isin(*K.ALLOWED_SLUGS)), 0)
    return F.when(j.rlike(r"^\s*\[") & decides.startswith("{"), F.get_json_object(decides, "$.label"))


def certainty_score(p: str | Column) -> Column:
    """Distance from a coin flip, scaled to [0, 1] for p in [0, 1]."""
    return F.abs(col(p) - F.lit(0.5)) * F.lit(2.0)


def certainty_bucket(c: str | Column) -> Column:
    c = col(c)
    return (
        F.when(c.isNull(), F.lit("no data"))
        .when(c >= F.lit(K.CERTAINTY_DECIDED), F.lit("decided"))
        .when(c >= F.lit(K.CERTAINTY_CONTESTED), F.lit("contested"))
        .otherwise(F.lit("coin-flip"))
    )


def label_impact(label: str | Column) -> tuple[Column, Column]:
    """(baseline impact text, explanation) shown for a market type."""
    lab = col(label)
    val = F.lit(K.DEFAULT_LABEL_IMPACT[0])
    txt = F.lit(K.DEFAULT_LABEL_IMPACT[1])
    for name, (v, t) in K.LABEL_IMPACT.items():
        val = F.when(lab == F.lit(name), F.lit(v)).otherwise(val)
        txt = F.when(lab == F.lit(name), F.lit(t)).otherwise(txt)
    return val, txt


def dominant_side(yes: str | Column, no: str | Column) -> Column:
    y = F.coalesce(col(yes), F.lit(0.0))
    n = F.coalesce(col(no), F.lit(0.0))
    return F.when(y > n, F.lit("yes")).when(n > y, F.lit("no")).otherwise(F.lit("even"))


def capitalize_first(c: str | Column) -> Column:
    """Upper-case the first character only (not ``initcap``)."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def volume_band(v: str | Column) -> Column:
    """Band label of a traded volume; negative, NaN and NULL fall in none."""
    v = col(v)
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(K.VOLUME_BANDS):
        cond = v >= F.lit(float(lo))
        if hi is not None:
            cond = cond & (v < F.lit(float(hi)))
        out = F.when(cond & ~F.isnan(v), F.lit(name)).otherwise(out)
    return out


def band_order(v: str | Column) -> Column:
    """0-based position of the band (bottom -> top), NULL outside all bands."""
    v = col(v)
    out = F.lit(None).cast("int")
    for i, (lo, hi, _name) in reversed(list(enumerate(K.VOLUME_BANDS))):
        cond = v >= F.lit(float(lo))
        if hi is not None:
            cond = cond & (v < F.lit(float(hi)))
        out = F.when(cond & ~F.isnan(v), F.lit(i)).otherwise(out)
    return out


def finite_or_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def json_safe(df: DataFrame) -> DataFrame:
    """Every float/double column with NaN and +-inf replaced by NULL."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(finite_or_null(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def ar_damping(prev_trades: str | Column) -> Column:
    """AR(1) damping by the previous bin's trade count."""
    t = col(prev_trades)
    zero, few, many = K.AR_DAMPING
    return F.when(t == 0, F.lit(zero)).when(t <= 2, F.lit(few)).otherwise(F.lit(many))


def baseline_exog(label: str | Column) -> Column:
    lab = col(label)
    out = F.lit(K.DEFAULT_BASELINE_EXOG)
    for name, v in K.BASELINE_EXOG.items():
        out = F.when(lab == F.lit(name), F.lit(v)).otherwise(out)
    return out
