"""Column expressions shared by the feature groups.  Missing is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """The first ten characters as an ISO date, or NULL."""
    return F.left(text, F.lit(10)).try_cast("date")


def numeric_map(json: Column) -> Column:
    """The numbers of a JSON object by name; malformed text gives an empty map."""
    raw = F.from_json(json, "map<string,string>")
    numbers = F.transform_values(raw, lambda _, v: v.try_cast("double"))
    return F.coalesce(F.map_filter(numbers, lambda _, v: v.isNotNull()), F.expr("cast(map() as map<string,double>)"))


def months_before(date: Column, months: int) -> Column:
    """Calendar months back, clamped to the month's end."""
    return F.add_months(date, -months)


def within(date: Column, start: Column, end: Column) -> Column:
    """Half-open: after ``start``, up to ``end``."""
    return (date > start) & (date <= end)


def window_sum(date: Column, start: Column, end: Column, value: Column | None = None) -> Column:
    """Aggregate: the sum of ``value`` (or the count) over (start, end]; 0 where nothing falls in."""
    return F.coalesce(F.sum(F.when(within(date, start, end), F.lit(1) if value is None else value)), F.lit(0))


def log_growth(recent: Column, previous: Column) -> Column:
    return F.log((recent + 1) / (previous + 1))


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def growth_plateau(mentions: Column, growth: Column) -> Column:
    """High where much is said and growth has stopped."""
    return (1 - F.least(F.lit(1.0), F.abs(growth))) * F.least(F.lit(1.0), F.log1p(mentions) / F.log1p(F.lit(100.0)))


def sigmoid(x: Column, bound: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))))


def stable_id(namespace: str, *parts: Column) -> Column:
    """Namespace and 24 hexadecimal digits of the parts' hash; NULL parts are skipped."""
    joined = F.concat_ws(chr(31), *(F.trim(p.cast("string")) for p in parts))
    return F.concat(F.lit(namespace + ":"), F.left(F.sha2(joined, 256), F.lit(24)))


def canonical_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def hash_fold(value: Column, folds: int) -> Column:
    """The first eight bytes of the value's sha256, as a number, modulo ``folds``."""
    number = F.conv(F.left(F.sha2(value, 256), F.lit(16)), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(folds)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors; clamped to [-1, 1]."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    value = F.try_divide(dot, norm(a) * norm(b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & value.isNotNull() & ~F.isnan(value)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).otherwise(F.lit(0.0))


def unit(vector: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def economic_class(status: Column, polarity: Column, modality: Column, factual: tuple = ("reported", "observed")) -> Column:
    """negated before forecast before reviewed; anything else is a candidate."""
    return (
        F.when(polarity == "negated", "negated")
        .when(~F.coalesce(modality, F.lit("reported")).isin(*factual), "forecast")
        .when((status == "accepted") & (polarity == "affirmed"), "reviewed")
        .otherwise("candidate")
    )


def parse_number(text: Column) -> Column:
    """The number that text denotes; NULL where it is none or its dots are ambiguous.

    Blanks group thousands and marks at the end are dropped.  With both marks
    commas group; commas alone group if three digits follow each, and else one is the
    decimal mark; several dots group in the same way.  A sign and an exponent may stand.
    """
    bare = F.regexp_replace(F.regexp_replace(text, "[\\s\u00a0\u202f]", ""), "[.,]+$", "")
    part = lambda k: F.regexp_extract(bare, r"^([+-]?)([0-9.,]+)([eE][+-]?[0-9]+)?$", k)
    digits, no_commas = part(2), F.translate(part(2), ",", "")
    grouped = lambda mark: digits.rlike(rf"^[0-9]{{1,3}}({mark}[0-9]{{3}})+$")
    commas, dots = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
    one = F.when((commas & dots) | grouped(","), no_commas).otherwise(F.translate(digits, ",", "."))
    several = F.regexp_count(one, F.lit("[.]")) > 1
    plain = F.when(~several, one).when(one.rlike(r"^[0-9]{1,3}([.][0-9]{3})+$"), F.translate(one, ".", ""))
    return F.concat(part(1), plain, part(3)).try_cast("decimal(38,10)")


def doi(text: Column) -> Column:
    found = F.regexp_extract(F.lower(F.trim(text)), r"(10\.\d{4,9}/\S+?)[.,;)]*$", 1)
    return F.when(found != "", found)


def arxiv(text: Column) -> Column:
    found = F.regexp_extract(F.lower(F.trim(text)), r"(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?$", 1)
    return F.when(found != "", found)


def package_name(text: Column) -> Column:
    """Lower case, runs of -, _ and . as one hyphen."""
    return F.lower(F.regexp_replace(F.trim(text), "[-_.]+", "-"))


def plain_title(text: Column) -> Column:
    """Without tags, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


# Words that tell a claim's polarity and modality.
NEGATED = r"\b(?:not|no|never|cannot|can't|doesn't|didn't|don't|не|нет|невозможно|нельзя|без)\b"
HYPOTHETICAL = r"\b(?:can|may|might|could|would|potentially|if|может|могут|могло|могли|способен|способна|способны|возможно|если|потенциально)\b"
PLANNED = r"\b(?:will|plans?|planned|intends?|aims?|будет|будут|планир\w*|намерен\w*)\b"


def claim_polarity(text: Column) -> Column:
    return F.when(text.rlike("(?iU)" + NEGATED), "negated").otherwise("affirmed")


def claim_modality(text: Column) -> Column:
    """hypothetical before planned before reported."""
    return F.when(text.rlike("(?iU)" + HYPOTHETICAL), "hypothetical").when(text.rlike("(?iU)" + PLANNED), "planned").otherwise("reported")


def claim_context(text: Column) -> Column:
    """struct<polarity, modality>, which are independent of each other."""
    return F.struct(claim_polarity(text).alias("polarity"), claim_modality(text).alias("modality"))


def section_role(heading: Column) -> Column:
    low = F.lower(heading)
    rules = (("references", r"\b(references|bibliography)\b"), ("acknowledgements", r"\backnowledge?ments?\b"), ("abstract", r"\babstract\b"), ("introduction", r"\bintroduction\b"), ("methods", r"\b(methods?|materials)\b"), ("results", r"\bresults?\b"), ("conclusion", r"\bconclusions?\b"))
    out = F.when(F.lit(False), F.lit(""))
    for role, pattern in rules:
        out = out.when(low.rlike(pattern), role)
    return out.otherwise("body")


def language_guess(text: Column, markers: tuple[str, ...] = ("the", "and", "of", "with", "for")) -> Column:
    """ru if three tenths of the letters are Cyrillic, en with two different marker words, else NULL."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    cyrillic = F.length(F.regexp_replace(text, "[^\u0400-\u04ff]", ""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))
    found = F.size(F.array_intersect(words, F.array(*map(F.lit, markers))))
    return F.when((letters > 0) & (cyrillic * 10 >= letters * 3), "ru").when(found >= 2, "en")


def word_match(query: Column, name: Column) -> Column:
    """Equal, or sharing a prefix of at least max(4, shorter length - 2) characters."""
    need = F.greatest(F.lit(4), F.least(F.length(query), F.length(name)) - 2)
    same = (F.length(query) >= need) & (F.length(name) >= need) & (F.substring(query, F.lit(1), need) == F.substring(name, F.lit(1), need))
    return (query == name) | same
