"""Column expressions: normal distribution, odds, sizing, buckets, parsing and scoring. All run in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def fraction(value: Column) -> Column:
    """Shares stated as percentages become fractions; the result lies between 0 and 1."""
    return F.least(F.greatest(F.when(value > 1, value / 100).otherwise(value), F.lit(0.0)), F.lit(1.0))


def expected_score(a: Column, b: Column, bonus: Column | float = 0.0) -> Column:
    """Logistic expectation of rating a against b, with a bonus to a."""
    gap = b - a - (bonus if isinstance(bonus, Column) else F.lit(bonus))
    return 1 / (1 + F.pow(F.lit(10.0), gap / 400))


def margin_multiplier(margin: Column, winner_gap: Column, cap: float) -> Column:
    """Logarithm of the margin, damped where the favourite wins, capped."""
    return F.least(F.log(F.abs(margin) + 1) * 2.2 / (winner_gap * 0.001 + 2.2), F.lit(cap))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, within 1.5e-7 (a five-term rational fit of the error function)."""
    # The published coefficients of the fit.
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


# The published coefficients of the rational fit of the inverse normal distribution.
QUANTILE_TERMS = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572),
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416),
)


def normal_quantile(q: Column) -> Column:
    """Inverse of the standard normal distribution function, relative error below 1.2e-9; null outside (0, 1)."""
    a, b, c, d = QUANTILE_TERMS

    def horner(x: Column, terms: Sequence[float]) -> Column:
        out = F.lit(terms[0])
        for term in terms[1:]:
            out = out * x + term
        return out

    low = 0.02425
    tail = lambda p: horner(F.sqrt(-2 * F.log(p)), c) / horner(F.sqrt(-2 * F.log(p)), (*d, 1.0))
    r = (q - 0.5) * (q - 0.5)
    middle = (q - 0.5) * horner(r, a) / horner(r, (*b, 1.0))
    return F.when((q > 0) & (q < low), tail(q)).when((q >= low) & (q <= 1 - low), middle).when((q > 1 - low) & (q < 1), -tail(1 - q))


def _horner(x: str, terms: tuple[float, ...]) -> str:
    out = f"{terms[0]!r}::DOUBLE"
    for term in terms[1:]:
        out = f"({out}) * {x} + {term!r}::DOUBLE"
    return f"({out})"


def quantile_sql(p: str) -> str:
    """SQL of :func:`normal_quantile` for a probability expression."""
    a, b, c, d = QUANTILE_TERMS
    tail = lambda q: f"{_horner(f'sqrt(-2 * ln({q}))', c)} / {_horner(f'sqrt(-2 * ln({q}))', (*d, 1.0))}"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} <= 0.97575 THEN ({p} - 0.5) * {_horner(r, a)} / {_horner(r, (*b, 1.0))} ELSE -({tail(f'(1 - {p})')}) END"


def bucket(value: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first cut that the value is below; null stays null."""
    out = None
    for cut, name in cuts:
        out = F.when(value < cut, name) if out is None else out.when(value < cut, name)
    return F.when(value.isNotNull(), out.otherwise(last))


def height_inches(text: Column) -> Column:
    """``6-0`` and ``6'0`` as inches; plain numbers are inches already; anything else is null."""
    feet = F.regexp_extract(text, r"^\s*(\d+)\s*['-]\s*(\d+)", 1).try_cast("int")
    inches = F.regexp_extract(text, r"^\s*(\d+)\s*['-]\s*(\d+)", 2).try_cast("int")
    return F.coalesce(feet * 12 + inches, text.try_cast("double").cast("int"))


def inches_text(inches: Column) -> Column:
    return F.concat_ws("-", F.floor(inches / 12).cast("string"), (inches % 12).cast("string"))


def id_part(text: Column, place: int) -> Column:
    """The integer in this place of an underscore-separated id, or null."""
    return F.try_element_at(F.split(text, "_"), F.lit(place)).try_cast("int")


def american_to_probability(odds: Column) -> Column:
    return F.when(odds < 0, -odds / (-odds + 100)).when(odds > 0, F.lit(100.0) / (odds + 100))


def no_vig(over: Column, under: Column) -> Column:
    a, b = american_to_probability(over), american_to_probability(under)
    return safe_divide(a, a + b)


def profit_per_unit(odds: Column) -> Column:
    return F.when(odds > 0, odds / 100).when(odds < 0, F.lit(100.0) / -odds)


def kelly(p: Column, decimal_odds: Column, fraction_: float = 0.25, threshold: float = 0.0, cap: float = 0.05) -> Column:
    """Fractional Kelly stake, zero at or below the threshold, capped; zero without odds above one."""
    b = decimal_odds - 1
    full = F.when(b > 0, (b * p - (1 - p)) / b).otherwise(0.0)
    return F.when(full > threshold, F.least(full * fraction_, F.lit(cap))).otherwise(0.0)


def dot_score(weights: dict[str, float]) -> Column:
    """Sum of weight times value, nulls as zero."""
    terms = [F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()]
    return sum(terms[1:], terms[0])


def sum_non_null(*values: Column) -> Column:
    """Sum of the values that are there; null only if none is."""
    terms = [F.coalesce(v, F.lit(0.0)) for v in values]
    return F.when(F.coalesce(*values).isNotNull(), sum(terms[1:], terms[0]))


def return_curve(p: Column, n: int) -> Column:
    """Probability to be back after 1..n periods with rate p each."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: 1 - F.pow(1 - p, k))


def weighted_projection(stored: Column, parts: dict[str, Column], weights: dict[str, float], default: float, limits=(0.0, 2.0)) -> Column:
    """A stored value shifted by its parts' attributions times how far the user's weights leave the default."""
    out = stored
    for name, part in parts.items():
        ratio = min(max(weights[name] / default, limits[0]), limits[1])
        out = out + part * (ratio - 1)
    return F.greatest(out, F.lit(0.0))
