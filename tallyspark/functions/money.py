"""Integer minor-unit money: parsing, formatting and half-up ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 9223372036854775807


def parse_minor(text: Column) -> Column:
    """Decimal text to minor units; null for more than two decimals, overflow or non-numbers."""
    t = F.trim(text)
    too_fine = t.rlike(r"^[^eE]*\.\d{2}\d*[1-9]")
    numeric = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    cents = t.try_cast("decimal(38,10)") * F.lit(100).cast("decimal(3,0)")
    whole = F.floor(cents)
    ok = numeric & ~too_fine & (cents == whole) & (F.abs(cents) <= F.lit(MAX_LONG).cast("decimal(38,0)"))
    return F.when(ok, whole.cast("decimal(38,0)").try_cast("long"))


def format_minor(minor: Column, currency: str = "EGP") -> Column:
    """``-1,234.05 EGP``; cents are shown only when they are not zero."""
    size = F.abs(minor)
    whole = F.format_number(F.floor(size / F.lit(100).cast("decimal(3,0)")).cast("long"), 0)
    cents = F.pmod(size, F.lit(100))
    sign = F.when(minor < 0, F.lit("-")).otherwise(F.lit(""))
    tail = F.when(cents == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(cents.cast("string"), 2, "0"))
    )
    return F.concat(sign, whole, tail, F.lit(f" {currency}"))


def format_tenths(tenths: Column) -> Column:
    """Tenths of a percent: ``12%`` or ``12.3%``."""
    whole = F.floor(tenths / F.lit(10)).cast("long").cast("string")
    part = (tenths % 10).cast("string")
    return F.when(tenths % 10 == 0, F.concat(whole, F.lit("%"))).otherwise(
        F.concat(whole, F.lit("."), part, F.lit("%"))
    )


def _dec(c: Column) -> Column:
    return c.cast("decimal(28,0)")


def int_div(a: Column, b: Column) -> Column:
    """Exact integer quotient (truncated), computed in decimal to avoid overflow."""
    return F.call_function("div", a, b)


def share_tenths(amount: Column, total: Column) -> Column:
    """``(amount*1000 + total/2) / total`` in integers; 0 when total is not positive."""
    half = _dec(int_div(total, F.lit(2)))
    q = int_div(_dec(amount) * F.lit(1000).cast("decimal(4,0)") + half, _dec(total))
    return F.when(total > 0, q).otherwise(F.lit(0).cast("long"))


def average_minor(total: Column, n: Column) -> Column:
    """Half-up integer average, 0 for no rows."""
    return F.when(n > 0, int_div(total + int_div(n, F.lit(2)), n)).otherwise(F.lit(0).cast("long"))


def change_percent(current: Column, previous: Column) -> Column:
    """Half-up whole percent of |current - previous| against previous; null when not comparable."""
    diff = F.abs(_dec(current) - _dec(previous))
    q = int_div(
        diff * F.lit(100).cast("decimal(3,0)") + _dec(int_div(previous, F.lit(2))), _dec(previous)
    )
    return F.when((previous > 0) & (current != previous), F.least(q, F.lit(2147483647).cast("long")))


def half_up(x: Column) -> Column:
    """Round a decimal to whole minor units, HALF_UP, as long."""
    return F.round(x, 0).cast("long")


#: Compounding works on limbs of eight decimal digits; a product of a limb and two periods' growth fits a long.
LIMB = 100_000_000
#: Growth in ten-thousandths up to which two periods are taken in one step.
PAIRED_GROWTH = 200_000


def compound_charge(basis: Column, points: Column, periods: Column) -> Column:
    """``basis * ((1 + points/10000)^periods - 1)``, exact and HALF_UP to a minor unit; at most the largest long.

    The product basis * (10000 + points)^periods is an array of limbs, lowest first. Two periods take one step, so that a
    step divides by one limb, which costs nothing: the lowest ``steps`` limbs are the fraction. Each multiplication is
    followed by a pass that hands carries on to the next limb; carries through all limbs are settled once, at the end.
    Rates of up to some 46,000 % a period; no periods or a null give 0 or null.

    The limbs are only worked out where floating point leaves the minor unit open: the power and three roundings are off by
    (periods + 5) units of the last place at most, and nearly every amount is farther than that from a half.
    """
    long = lambda x: F.lit(x).cast("long")
    limb = long(LIMB)
    growth, n, size = points.cast("long") + 10000, periods.cast("int"), F.abs(basis.cast("long"))
    single, one = growth * 10000, long(1)
    pairs = F.concat(F.array_repeat(single, n % 2), F.array_repeat(growth * growth, int_div(n, F.lit(2)).cast("int")))
    steps = F.when(growth <= PAIRED_GROWTH, pairs).otherwise(F.array_repeat(single, n))
    passes = F.flatten(F.transform(steps, lambda m: F.array(m, one)))
    state = lambda k, limbs: F.struct(k.cast("int").alias("k"), limbs.alias("limbs"))
    start = state(F.lit(0), F.array(size % limb, int_div(size, limb) % limb, int_div(size, limb * limb)))

    def grown(acc: Column, m: Column) -> Column:
        x, k = acc["limbs"], acc["k"] + F.when(m == 1, 0).otherwise(1)
        room = F.when(F.element_at(x, -1) == 0, x).otherwise(F.concat(x, F.array(long(0))))
        carried = F.transform(room, lambda v, i: v * m % limb + F.when(i > 0, int_div(F.get(x, i - 1) * m, limb)).otherwise(long(0)))
        beyond = F.coalesce(F.get(x, acc["k"] + 3) > 0, F.lit(False)) | (F.element_at(x, 1) < 0)  # over LIMB^3: never comes back
        return F.when(beyond, state(k, F.array(long(-1)))).otherwise(state(k, carried))

    def settled(acc: Column) -> Column:
        x, k = acc["limbs"], acc["k"]
        below = F.aggregate(F.slice(x, 1, k - 1), long(0), lambda c, v: int_div(v + c, limb))
        carry = int_div(F.coalesce(F.get(x, k - 1), long(0)) + below + LIMB // 2, limb)
        whole = F.aggregate(F.reverse(F.slice(x, k + 1, 4)), F.lit(0).cast("decimal(38,0)"), lambda t, v: (t * F.lit(LIMB).cast("decimal(9,0)") + v).cast("decimal(38,0)"))
        gain = (whole + carry).cast("decimal(38,0)") - size
        return F.when(F.element_at(x, 1) < 0, long(MAX_LONG)).otherwise(F.least(gain, F.lit(MAX_LONG)).cast("long"))

    near = size.cast("double") * F.pow(growth.cast("double") / 10000, n)
    half, off = near + 0.5, near * (n + 8) * 4e-16  # more than three times what the roundings add up to
    is_sure = (growth >= 10000) & (near < 1e14) & (F.abs(half - F.rint(half)) > off)
    gain = F.when(is_sure, F.floor(half).cast("long") - size).otherwise(F.aggregate(passes, start, grown, settled))
    charge = F.when(basis < 0, long(-1)).otherwise(one) * gain
    known = basis.isNotNull() & points.isNotNull() & periods.isNotNull()
    return F.when(known & (n > 0), charge).when(known, long(0))
