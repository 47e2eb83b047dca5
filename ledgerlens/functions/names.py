"""Name and text similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name the same concept.
SYNONYM_GROUPS = [
    ["id", "identifier", "uid", "uuid", "guid"],
    ["customer_id", "user_id", "client_id", "account_id", "person_id"],
    ["name", "full_name", "person_name", "display_name"],
    ["email", "email_address", "mail"],
    ["phone", "phone_number", "telephone", "tel", "mobile"],
    ["address", "street_address", "location", "physical_address"],
    ["amount", "value", "total", "sum", "price", "cost", "fee", "charge"],
    ["date", "timestamp", "created_at", "updated_at", "time", "datetime"],
    ["status", "state", "condition", "phase"],
    ["type", "category", "class", "kind", "group"],
    ["city", "city_name", "town", "municipality"],
    ["country", "country_name", "nation", "region"],
    ["age", "years", "year_old"],
    ["gender", "sex"],
    ["latitude", "lat", "y"],
    ["longitude", "lng", "lon", "x"],
    ["description", "desc", "notes", "comment", "details", "remarks"],
]


def normal_text(text: Column) -> Column:
    """Lower case, trimmed, inner white space collapsed."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")


def normal_name(name: Column) -> Column:
    """Lower case letters, digits and ideographs only."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9一-鿿]+", "")


def word_tokens(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9一-鿿]+"), lambda w: F.length(w) >= 2)


def _containment(a: Column, b: Column, otherwise: Column) -> Column:
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.5 + 0.5 * short / long)
        .otherwise(otherwise)
    )


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short texts.

    One table row is folded over the letters of ``a``: the last value of a row is what the next cell can't fall below.
    """
    letters = F.filter(F.split(b, ""), lambda c: c != "")

    def cell(above: Column, letter: Column):
        def step(row: Column, i: Column) -> Column:
            met = F.get(above, i - 1) + 1
            return F.array_append(row, F.when(F.get(letters, i - 1) == letter, met).otherwise(F.greatest(F.get(above, i), F.get(row, i - 1))))

        return step

    def next_row(above: Column, letter: Column) -> Column:
        places = F.slice(F.sequence(F.lit(0), F.size(letters)), F.lit(2), F.size(letters))
        return F.aggregate(places, F.array(F.lit(0)), cell(above, letter))

    first = F.array_repeat(F.lit(0), F.size(letters) + 1)
    return F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), first, next_row), -1)


def name_similarity(left: Column, right: Column) -> Column:
    """1 for equal names, 0.5 to 1 when one holds the other, else the longest common subsequence over the longer length."""
    a, b = normal_name(left), normal_name(right)
    return _containment(a, b, common_subsequence(a, b) / F.greatest(F.length(a), F.length(b)))


def label_similarity(left: Column, right: Column) -> Column:
    """As :func:`name_similarity`, but the rest is the better of character overlap and shared prefix."""
    a, b = F.replace(F.lower(left), F.lit("_"), F.lit("")), F.replace(F.lower(right), F.lit("_"), F.lit(""))
    ca, cb = F.split(a, ""), F.split(b, "")
    overlap = F.size(F.array_intersect(ca, cb)) / F.size(F.array_union(ca, cb))
    shorter = F.least(F.length(a), F.length(b))
    differing = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    prefix = F.when(F.size(differing) == 0, shorter).otherwise(F.array_min(differing) - 1)
    return _containment(a, b, F.greatest(overlap, prefix / F.greatest(F.length(a), F.length(b))))


def synonym_groups(name: Column) -> Column:
    """Numbers of the synonym groups a name stands in."""
    plain = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return F.array_compact(F.array(*[F.when(plain.isin(*group), F.lit(i)) for i, group in enumerate(SYNONYM_GROUPS)]))


def comments_agree(left: Column, right: Column, left_name: Column, right_name: Column) -> Column:
    """1 when a comment names the other column or both share a word, else 0."""
    a, b = F.trim(F.coalesce(left, F.lit(""))), F.trim(F.coalesce(right, F.lit("")))
    shared = F.arrays_overlap(word_tokens(a), word_tokens(b))
    agree = F.contains(a, right_name) | F.contains(b, left_name) | shared
    return F.when((a == "") | (b == ""), 0).when(agree, 1).otherwise(0)


def comments_contradict(left: Column, right: Column) -> Column:
    """Whether a comment declares the two columns unrelated."""
    a, b = F.trim(F.coalesce(left, F.lit(""))), F.trim(F.coalesce(right, F.lit("")))
    return (a != "") & (b != "") & F.concat_ws(" ", a, b).rlike("无关|unrelated|不同业务对象")


def fingerprint(*columns: Column) -> Column:
    """First 16 hex digits of the sha256 of a record's JSON text."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)
