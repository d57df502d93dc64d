"""Paths, labels and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave import constants as C


def canonical_path(path: Column) -> Column:
    """Forward slashes, ``/mnt/<drive>/`` as ``<DRIVE>:/``, no slash at the end."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    drive = F.regexp_extract(p, r"^/mnt/([A-Za-z])/", 1)
    p = F.when(drive != "", F.concat(F.upper(drive), F.lit(":/"), F.substring(p, 8, 1 << 30))).otherwise(p)
    return F.regexp_replace(p, "/+$", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def relative_dir(path: Column, base: str) -> Column:
    """Folder of a file below ``base``, ``"."`` at its top and outside it."""
    base = base.rstrip("/")
    parent = parent_dir(path)
    inside = F.substring(parent, len(base) + 2, 1 << 30)
    return F.when(parent.startswith(base + "/") & (inside != ""), inside).otherwise(F.lit("."))


def dir_excluded(relative: Column, excluded: list[str] | None) -> Column:
    """Whether a relative folder is one of ``excluded`` or below one; none excludes nothing."""
    out = F.lit(False)
    for e in excluded or []:
        out = out | (relative == e) | relative.startswith(e + "/")
    return out


def ancestors(relative: Column) -> Column:
    """The folder and all above it, ``"."`` apart: ``a/b`` gives ``[a, a/b]``."""
    parts = F.split(relative, "/")
    return F.when(relative == ".", F.array(F.lit("."))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )


def number(x: Column) -> Column:
    """A double as text, with at least one digit after the point."""
    return x.cast("string")


def label(filename: Column, bpm: Column, key: Column) -> Column:
    return F.concat(filename, F.lit("  ("), number(bpm), F.lit(" BPM, "), key, F.lit(")"))


def count_of(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def path_summary(tracks: Column, hops: Column) -> Column:
    return F.concat(count_of(tracks, "track"), F.lit(" · "), count_of(hops, "hop"))


def setlist_summary(tracks: Column, seconds: Column) -> Column:
    minutes = F.bround(seconds / 60.0, 0).cast("long").cast("string")
    return F.concat(count_of(tracks, "track"), F.lit(" · ~"), minutes, F.lit(" min"))


def header_stats(tracks: Column, counts: Column, edges: Column) -> Column:
    """``n tracks | a direct + b double transitions (m total)``; ``counts`` maps edge types."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at(counts, F.lit(t)), F.lit(0)) > 0, F.concat(F.try_element_at(counts, F.lit(t)).cast("string"), F.lit(f" {t}"))) for t in C.EDGE_TYPES]))
    total = edges.cast("string")
    by_type = F.concat(F.array_join(named, " + "), F.lit(" transitions ("), total, F.lit(" total)"))
    return F.concat(tracks.cast("string"), F.lit(" tracks | "), F.when(F.size(named) > 0, by_type).otherwise(F.concat(total, F.lit(" transitions"))))


def safe_name(name: Column) -> Column:
    """Letters, digits, space, ``_`` and ``-``; anything else ``_``; never empty."""
    out = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N} _-]", "_"))
    return F.when(out == "", "Setlist").otherwise(out)


def version_label(version: Column) -> Column:
    """``UMAP_<n>_<d>_<c>``, prefix or not, in words; any other name as it is."""
    parts = F.split(F.regexp_replace(version, "^UMAP_", ""), "_")
    return F.when(F.size(parts) == 3, F.concat(F.lit("UMAP ("), F.array_join(parts, ", "), F.lit(")"))).otherwise(version)


def clamp(x: Column, low: float, high: float, digits: int, before: Column) -> Column:
    """``x`` within bounds, rounded; null and NaN leave the value before."""
    ok = x.isNotNull() & ~F.isnan(x.cast("double"))
    return F.when(ok, F.round(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)), digits)).otherwise(before)
