"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstore.schema import THRESHOLD, THRESHOLDS

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
WORDS = r"[\p{L}\p{N}]+"
#: Dimensions of the built-in text embedding.
BUCKETS = 256


def sha256(text: Column) -> Column:
    """Hex digest of the UTF-8 text."""
    return F.sha2(text, 256)


def json_text(metadata: Column, key: str) -> Column:
    """The value under a top-level key as text; null where the metadata is no valid JSON or has none."""
    return F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "string")


def plain_name(name: Column) -> Column:
    """A name as names are compared: outer white space of any kind off, lower case."""
    return F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) == 0, F.lit(True))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def buckets(text: Column) -> Column:
    """The built-in embedding in sparse form: the bucket of every word, repeats included; empty for no words."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % BUCKETS))


def embedding(text: Column) -> Column:
    """The built-in embedding: counts of word buckets, of unit length; null for a text without words."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.size(F.filter(buckets(text), lambda x: x == b)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: (x / norm).cast("float")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a length is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def threshold(namespace: Column) -> Column:
    """The similarity from which an entry of the namespace counts as known."""
    pairs = [x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(namespace, F.lit(""))), F.lit(THRESHOLD))


def display_name(uid: Column) -> Column:
    return F.initcap(F.replace(uid, F.lit("_"), F.lit(" ")))


def as_metadata(text: Column) -> Column:
    """Metadata given as text: kept where it is a JSON object, else null."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def merge_metadata(old: Column, new: Column) -> Column:
    """Both JSON objects as one, the new one's keys replacing the old one's as a whole; null counts as empty.

    A key that the new one sets to null is null afterwards.  Values are variants, so numbers, booleans, lists and
    objects stay what they are; what is no JSON object counts as empty.
    """
    kind = "map<string,variant>"
    a, b = F.coalesce(F.from_json(old, kind), F.expr(f"cast(map() as {kind})")), F.coalesce(F.from_json(new, kind), F.expr(f"cast(map() as {kind})"))
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def json_pairs(metadata: Column) -> Column:
    """A JSON object as one text of its keys in order, each with its value's JSON; null for anything else."""
    pairs = F.transform(F.map_entries(F.from_json(metadata, "map<string,variant>")), lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"])))
    return F.array_join(F.array_sort(pairs), "&")


def importance_or_default(importance: Column) -> Column:
    """3 where the importance is null or 0."""
    return F.when(importance.isNull() | (importance == 0), 3).otherwise(importance)
