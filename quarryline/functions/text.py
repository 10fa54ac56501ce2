"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split`` of Python sees it, for Java's regular expressions.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
MAX_LENGTH = 50_000

# Phrases that mark an attempt to override instructions, searched without case.
INJECTION_PATTERNS = (
    r"ignore (all )?(previous|prior|above) instructions",
    r"disregard (all )?(previous|prior|above) instructions",
    r"you are now",
    r"new instructions:",
    r"system prompt:",
    r"\bsystem:\s",
    r"forget (everything|all) (you|that)",
    r"reveal your (system prompt|instructions)",
    r"act as if",
    r"do not (follow|obey) (your|the) (previous|original) instructions",
)


def sanitize(text: Column) -> Column:
    """Drops control and format characters but line feed and tab."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def injection_risk(text: Column) -> Column:
    """First match, as written, of each pattern that occurs, in the order of the patterns."""
    return F.array_compact(F.array(*(F.nullif(F.regexp_extract(text, f"(?iu){p}", 0), F.lit("")) for p in INJECTION_PATTERNS)))


def words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.array_remove(F.split(text, SPACES), "")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def hash_vector(text: Column, dims: int = 8) -> Column:
    """Stand-in embedding: byte i of the SHA-256 of the text over 255; null for blank texts."""
    digest = F.sha2(text.cast("binary"), 256)
    parts = F.array(*(F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255 for i in range(dims)))
    return F.when(F.length(F.trim(text)) > 0, parts)


def composite_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; null parts are empty."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256)


def normalize_entity(name: Column) -> Column:
    """Collapsed white space, no outer punctuation; words capitalised unless all are capitals; empty if shorter than 3, at most 120 characters."""
    bare = F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" .,;:!?'\"()[]{}"))
    shaped = F.when(bare == F.upper(bare), bare).otherwise(F.initcap(bare))
    return F.when(F.length(bare) < 3, F.lit("")).otherwise(F.substring(shaped, 1, 120))


def subtitle_text(text: Column) -> Column:
    """Spoken lines of a VTT or SRT file: without blank lines, the WEBVTT line, cue numbers and times."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: F.regexp_replace(x, f"^{SPACES}|{SPACES}$", ""))
    kept = F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.rlike(r"^\p{Nd}+$") & ~x.contains("-->"))
    return F.array_join(kept, "\n")


def keyword_hits(text: Column, keywords: Column) -> Column:
    """Keywords that the text contains, without case, in their order."""
    return F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))


def title(text: Column) -> Column:
    """The first letter of each run of letters in capitals, the others small: runs end at any other sign, apostrophes too."""
    apart = F.regexp_replace(F.lower(text), r"([^\p{L}])", "$1\u0001 ")
    return F.replace(F.initcap(apart), F.lit("\u0001 "), F.lit(""))
