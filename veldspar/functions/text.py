"""Column expressions on text, delimited labels and JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalize(text: Column) -> Column:
    """One space between words, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def parse_labels(text: Column) -> Column:
    """Trimmed parts of a pipe-delimited text without the empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def strip_fence(text: Column) -> Column:
    """An answer without the Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def mentioned_ids(text: Column, pattern: str = r"\b(c_\d+)\b") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def unsupported_ids(text: Column, allowed: Column) -> Column:
    """Ids that a text mentions though they aren't among the evidence, sorted."""
    return F.array_sort(F.array_except(mentioned_ids(text), allowed))


def parse_rationale(text: Column) -> Column:
    """The one field ``rationale`` of a JSON answer; null for any other shape or a blank text."""
    body = strip_fence(text)
    value = F.from_json(body, "rationale string").getField("rationale")
    return F.when((F.json_object_keys(body) == F.array(F.lit("rationale"))) & (F.trim(value) != ""), F.trim(value))


def rationale(persona: Column, evidence: Column) -> Column:
    """A sentence on the strongest evidence, an array of (id, similarity, ...) in falling order."""
    best = F.get(evidence, F.lit(0))
    told = F.format_string("%s is suggested: %d similar items support it, %s the closest at %.2f.", persona, F.size(evidence), best["id"].cast("string"), best["similarity"])
    return F.when(F.size(evidence) > 0, told).otherwise(F.concat(F.lit("Evidence for "), persona, F.lit(" is limited.")))


def hash_embed(text: Column, dim: int = 32) -> Column:
    """A deterministic bag of hashed words as a unit vector; stands where no encoder is at hand."""
    words = F.filter(F.split(F.lower(normalize(text)), " "), lambda w: w != "")
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))
    return unit(counts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """``v`` over its length, which is worked out once; a zero vector stays zero."""
    length = F.array(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)))
    return F.transform(length, lambda n: F.transform(v, lambda x: x / n))[0]


def local_path(path: Column) -> Column:
    """A path without its scheme and host."""
    return F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?", "")


#: What an answer must hold to.
RULES = (
    "Explain in one or two sentences, from the evidence above alone.",
    "Name no item that isn't listed and no label but the predicted one and those listed.",
    "Add nothing about the item's content, product or audience.",
    "Call a similarity high only if its number is.",
    'Answer with JSON of this shape and nothing else: {"rationale": "..."}',
)


def prompt(persona: Column, score: Column, evidence: Column) -> Column:
    """The question put to a language model: label, score, evidence as JSON (all of the array's fields) and RULES."""
    told = F.format_string("A model has predicted a label for an item.\nLabel: %s\nScore: %.4f\nEvidence:\n", persona, score)
    return F.concat(told, F.to_json(evidence), F.lit("\nRules:\n" + "\n".join(f"- {rule}" for rule in RULES)))
