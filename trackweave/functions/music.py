"""Keys, tempi, embeddings and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave import constants as C


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def key_position(key: Column, strict: bool = False) -> Column:
    """Place of ``"<Pitch> <mode>"`` on the circle of fifths, 0 to 11.

    Pitches are case-sensitive sharps; ``minor`` in any case is its relative major,
    every other mode counts as major.  Anything else is null, or an error if strict.
    """
    parts = F.split(F.trim(key), r"\s+")
    semitone = F.try_element_at(_literal_map(C.SEMITONES), F.get(parts, F.lit(0)))
    shift = F.when(F.lower(F.get(parts, F.lit(1))) == "minor", 3).otherwise(0)
    place = F.when(F.size(parts) == 2, F.pmod(F.pmod(semitone + shift, F.lit(12)) * 7, F.lit(12)))
    if strict:
        return F.coalesce(place, F.raise_error(F.concat(F.lit("invalid key: "), F.coalesce(key, F.lit("null")))).cast("int"))
    return place


def sharp(key: Column) -> Column:
    """The key with a flat pitch written as its sharp."""
    parts = F.split(key, " ")
    return F.when(F.size(parts) == 2, F.concat(F.coalesce(F.try_element_at(_literal_map(C.FLATS), F.get(parts, F.lit(0))), F.get(parts, F.lit(0))), F.lit(" "), F.get(parts, F.lit(1)))).otherwise(key)


def harmonic_distance(p: Column, q: Column) -> Column:
    """Shorter arc between two places on the circle of fifths, as a share of half of it."""
    d = F.abs(p - q)
    return F.least(d, 12 - d) / F.lit(6.0)


def tempo_pct(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.least(a, b) * 100.0


def tempo_penalty(a: Column, b: Column, strict: bool = False) -> Column:
    """Difference in percent of the slower, over 8; infinite beyond 8 percent.

    Tempi not above zero give null, or an error if strict.
    """
    valid = (a > 0) & (b > 0)
    pct = tempo_pct(a, b)
    value = F.when(pct <= C.MAX_TEMPO_PCT, pct / C.MAX_TEMPO_PCT).otherwise(F.lit(float("inf")))
    out = F.when(valid, value)
    if strict:
        return F.coalesce(out, F.raise_error(F.lit("tempi must be positive")).cast("double"))
    return out


def is_compatible(a: Column, b: Column) -> Column:
    return F.coalesce((a > 0) & (b > 0) & (F.when((a > 0) & (b > 0), tempo_pct(a, b)) <= C.MAX_TEMPO_PCT), F.lit(False))


def dot(u: Column, v: Column) -> Column:
    product = F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length one, in doubles; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def semantic_distance(u: Column, v: Column, strict: bool = False) -> Column:
    """(1 - cosine) / 2 within 0 and 1; a zero or empty vector gives 0.5, or an error if strict."""
    n = norm(u) * norm(v)
    cosine = F.when(n > 0, dot(u, v) / n)
    if strict:
        cosine = F.coalesce(cosine, F.raise_error(F.lit("embeddings must not be empty or zero")).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.coalesce(cosine, F.lit(0.0))) / 2))


def composite(harmonic: Column, tempo: Column, semantic: Column, edge_type: Column | None = None, weights: dict | None = None, penalties: dict | None = None) -> Column:
    """Weighted sum of the three costs, and the edge type's penalty."""
    w = C.WEIGHTS | (weights or {})
    total = harmonic * w["harmonic"] + tempo * w["tempo"] + semantic * w["semantic"]
    p = {k: v for k, v in (C.PENALTIES | (penalties or {})).items() if v}
    if edge_type is None or not p:
        return total
    case = F.lit(0.0)
    for name, value in p.items():
        case = F.when(edge_type == name, F.lit(float(value))).otherwise(case)
    return total + case


def direct_weight(bpm_a: Column, bpm_b: Column, key_a: Column, key_b: Column, emb_a: Column, emb_b: Column, weights: dict | None = None) -> Column:
    """Cost of a pair by the direct tempo ratio alone; infinite where tempi are apart."""
    t = tempo_penalty(bpm_a, bpm_b)
    full = composite(harmonic_distance(key_position(key_a), key_position(key_b)), t, semantic_distance(emb_a, emb_b), weights=weights)
    return F.when(t == float("inf"), t).otherwise(full)


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits over the words both have; 0 if either has none."""
    n = F.least(F.size(a), F.size(b))
    low = F.lit(0xFFFFFFFF).cast("long")
    bits = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(1))), F.slice(b, 1, F.greatest(n, F.lit(1))), lambda x, y: 32 - F.bit_count(x.cast("long").bitwiseXOR(y.cast("long")).bitwiseAND(low)))
    same = F.aggregate(bits, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(n > 0, same / (32.0 * n)).otherwise(0.0)


def duration(d: Column) -> Column:
    return F.when(d > 0, d).otherwise(F.lit(C.DEFAULT_DURATION))
