"""Column helpers built only from native Spark functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even on the decimal value.

    The first rounding at nine digits removes the noise left by summing doubles
    in a different order, so a tie is a tie whatever the partitioning was.
    """
    return F.bround(F.round(value, 9), digits)


def clamp(value: Column, low: float, high: float) -> Column:
    """Clamp that keeps NULL (greatest/least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def codes(*pairs: tuple[str | Column, Column]) -> Column:
    """array<string> of the codes whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(cond, F.lit(code) if isinstance(code, str) else code) for code, cond in pairs])
    )


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(values: Mapping, key: Column, default: Column | None = None) -> Column:
    """Constant-table lookup; unknown or NULL key gives the default (or NULL)."""
    found = F.when(key.isNotNull(), F.try_element_at(literal_map(values), key))
    return found if default is None else F.coalesce(found, default)


def index_z(confidence: float) -> float:
    return C.Z_INDEX.get(confidence, C.Z_INDEX[0.95])


def contains_any(text: Column, terms: Iterable[str], whole_words: bool = False) -> Column:
    """Case-insensitive test for any of the terms (substring by default)."""
    terms = list(terms)

    def test(low: Column) -> Column:
        result = F.lit(False)
        for term in terms:
            if whole_words:
                result = result | low.rlike(r"(^|[^\p{L}\p{N}])" + _quote(term) + r"($|[^\p{L}\p{N}])")
            else:
                result = result | low.contains(term.lower())
        return result

    return bind(F.lower(text), test)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    Filters are pushed below projections by copying expressions; a value bound to
    a lambda variable is not copied once per use.
    """
    return F.transform(F.array(value), use)[0]


def matched_terms(text: Column, terms: Iterable[str]) -> Column:
    terms = list(terms)
    return bind(F.lower(text), lambda low: codes(*[(t, low.contains(t.lower())) for t in terms]))


def _quote(term: str) -> str:
    return r"\Q" + term.lower() + r"\E"


def not_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def slug_ok(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9\-]+$") & F.length(text).between(2, 60)


def map_total(weights: Column) -> Column:
    return F.aggregate(F.map_values(weights), F.lit(0.0), lambda acc, x: acc + x)


def chi_square_tail(chi2: Column, dof: Column, terms: int = 400) -> Column:
    """Chance that a chi-square variable of ``dof`` degrees exceeds ``chi2``.

    The series of the lower incomplete gamma function, kept in logarithms; beyond
    chi2 = 2 ``terms`` / 2 it is below any double that matters and taken as 0.
    """
    a, x = dof / 2, chi2 / 2
    # ln gamma(a + 1): a (a - 1) ... down to gamma(1) = 1 or gamma(1 / 2) = sqrt(pi)
    steps = F.sequence(F.lit(0), F.ceil(a).cast("int") - 1)
    start = F.when(dof % 2 == 1, F.log(F.pi()) / 2).otherwise(0.0)
    ln_gamma = F.aggregate(steps, start, lambda s, k: s + F.log(a - k))
    first = F.exp(a * F.log(x) - x - ln_gamma)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.struct(first.alias("t"), first.alias("s")),
        lambda s, n: bind(s["t"] * x / (a + n), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s"))),
        lambda s: s["s"],
    )
    tail = F.when(x >= terms / 2, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - total))
    return F.when(dof > 0, F.when(chi2 <= 0, 1.0).otherwise(tail))


def prompt_hash(system: Column, user: Column) -> Column:
    return F.substring(F.sha2(F.concat(system, F.lit("\x00"), user), 256), 1, 16)


def natural_id(*parts: Column) -> Column:
    """Repeatable id from a natural key, so that a re-run writes the same id."""
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def stored_weight(weight: Column) -> Column:
    return F.bround(weight, 4).cast("decimal(8,4)")


def json_text(payload: Column, max_depth: int = C.MAX_PAYLOAD_DEPTH) -> Column:
    """String values of a JSON document (keys left out), joined by a space.

    Strings nested in more than ``max_depth`` containers are dropped. A payload
    that is not a JSON container is taken as plain text.
    """
    # escaped backslashes and quotes are masked by noncharacters, so that the token
    # pattern needs no alternation and cannot recurse on long strings
    slash, quote = "\ufdd0", "\ufdd1"
    masked = F.replace(F.replace(payload, F.lit("\\\\"), F.lit(slash)), F.lit('\\"'), F.lit(quote))
    tokens = F.regexp_extract_all(masked, F.lit(r'("[^"]*+"\s*+:?|[\[\]{}])'), F.lit(1))
    literals = F.array_join(bind(tokens, lambda t: _json_values(t, max_depth)), ",")
    plain = F.replace(F.replace(literals, F.lit(quote), F.lit('\\"')), F.lit(slash), F.lit("\\\\"))
    # decode escapes by reading the kept literals as one JSON array
    decoded = F.from_json(F.concat(F.lit("["), plain, F.lit("]")), "array<string>")
    is_container = F.ltrim(payload).rlike(r"^[\[{]")
    return F.when(is_container, F.array_join(decoded, " ")).otherwise(payload)


def json_too_deep(payload: Column, max_depth: int = C.MAX_PAYLOAD_DEPTH) -> Column:
    """Whether a JSON container nests more than ``max_depth`` containers, whose strings ``json_text`` leaves out."""
    plain = F.regexp_replace(payload, r'"(?:[^"\\\\]|\\\\.)*+"', "")
    brackets = F.regexp_extract_all(plain, F.lit(r"([\[\]{}])"), F.lit(1))
    depth = F.aggregate(
        brackets, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda s, t: bind(s["d"] + F.when(t.isin("[", "{"), 1).otherwise(-1), lambda d: F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))),
        lambda s: s["m"],
    )
    return F.coalesce(F.ltrim(payload).rlike(r"^[\[{]") & (depth > max_depth), F.lit(False))


def _json_values(tokens: Column, max_depth: int) -> Column:
    """String literals among JSON tokens that are values within the depth."""
    opens = lambda t: t.isin("[", "{")
    closes = lambda t: t.isin("]", "}")
    is_value = lambda t: t.startswith('"') & ~t.endswith(":")
    step = lambda t: F.when(opens(t), 1).when(closes(t), -1).otherwise(0)
    deepest = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda s, t: F.struct(
            (s["d"] + step(t)).alias("d"), F.greatest(s["m"], s["d"] + step(t)).alias("m")
        ),
        lambda s: s["m"],
    )
    shallow = F.filter(tokens, is_value)
    cut = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("v")),
        lambda s, t: F.struct(
            (s["d"] + step(t)).alias("d"),
            F.when(is_value(t) & (s["d"] <= max_depth), F.concat(s["v"], F.array(t)))
            .otherwise(s["v"]).alias("v"),
        ),
        lambda s: s["v"],
    )
    return F.when(deepest <= max_depth, shallow).otherwise(cut)
