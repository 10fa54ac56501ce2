"""Small text rules as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of a refusal, looked for in the characters before a phrase.
NEGATION_MARKERS = (
    "cannot", "can't", "unable", "not able", "won't", "will not",
    "never", "unless", "whether", "don't", "do not", "doesn't",
    "does not", "no definitive", "not provide", "not give",
)
NEGATION_WINDOW = 80

# Words that make a role a sensitive one.
SENSITIVE_MARKERS = (
    "legal", "lawyer", "attorney", "law", "medical", "medicine", "health", "healthcare",
    "clinical", "doctor", "patient", "pharmacy", "veterinary", "immigration", "visa",
    "tax", "insurance", "compliance", "regulatory",
)

# Table and column names that are not shown to a model.
BLACKLISTED_TABLES = (
    "auth_", "django_", "api_key", "secret", "password", "token",
    "session", "payment", "credit_card", "billing_alert", "admin_",
    "oauth", "social_auth", "celery_",
)
SENSITIVE_COLUMNS = (
    "password", "secret", "token", "api_key", "private_key",
    "credit_card", "ssn", "social_security", "cvv", "pin",
    "encryption_key", "salt", "hash",
)

# Units in metres and grams.
# Words that call for a role that talks to customers, the role of last resort, and phrases that ask for a person.
INTENT_KEYWORDS = {
    "sales": ("price", "pricing", "buy", "purchase", "demo", "quote", "discount", "plan"),
    "marketing": ("campaign", "promotion", "newsletter", "partnership", "collaborate"),
}
DEFAULT_ROLE = "support"
ESCALATION_PHRASES = (
    "talk to a human", "speak to a human", "speak to someone",
    "talk to someone", "real person", "human agent", "human support",
    "this isn't helping", "this is not helping", "not what i need",
    "let me speak to a person", "connect me to a person",
)

METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}
GRAMS = {"mg": 0.001, "g": 1.0, "kg": 1000.0, "oz": 28.349523125, "lb": 453.59237}

# Regional codes that stand for a language.
LANGUAGE_ALIASES = {"zh-cn": "zh", "zh-tw": "zh", "zh-hk": "zh", "pt-br": "pt", "pt-pt": "pt"}


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text contains one of the parts, without case; null text: false."""
    return F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(text), p)), F.lit(False))


def table_blacklisted(name: Column) -> Column:
    return any_of(name, BLACKLISTED_TABLES)


def column_sensitive(name: Column) -> Column:
    return any_of(name, SENSITIVE_COLUMNS)


def forbidden(answer: Column, phrase: str) -> Column:
    """Whether the phrase occurs, without case, and no refusal marker stands in the ``NEGATION_WINDOW`` characters before its first occurrence."""
    low = F.lower(answer)
    at = F.instr(low, phrase.lower())
    begin = F.greatest(F.lit(1), at - NEGATION_WINDOW)
    window = F.substring(low, begin, at - begin)
    return F.coalesce((at > 0) & ~any_of(window, NEGATION_MARKERS), F.lit(False))


def language_code(code: Column) -> Column:
    """Lower case, ``_`` as ``-``, regional codes reduced to their language."""
    plain = F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-"))
    known = F.create_map(*(F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv))
    return F.coalesce(known[plain], F.split_part(plain, F.lit("-"), F.lit(1)))


def script_language(text: Column) -> Column:
    """ko, ja or zh where a text's script tells, else null."""

    def count(chars: str) -> Column:
        return F.regexp_count(text, F.lit(chars))

    cjk, kana, hangul, latin = count("[\\u4e00-\\u9fff]"), count("[\\u3040-\\u30ff]"), count("[\\uac00-\\ud7a3]"), count("[A-Za-z]")
    share = F.try_divide(cjk, cjk + latin)
    return F.when((hangul > 0) & (hangul > F.greatest(cjk, kana)), "ko").when((kana > 0) & (kana > cjk), "ja").when((cjk > 0) & (share > 0.25), "zh")


def cleaned_for_detection(text: Column) -> Column:
    """Without page numbers, codes, digits and punctuation, for language detection."""
    for pattern in (r"(?iu)page\s*\d+", r"\b[A-Z]{2,}\d+\b", r"[^\p{L}\p{M}\p{N}_\s]", r"\d+", "_+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def final_answer(text: Column) -> Column:
    """Struct (reasoning, answer): split at the last ``final answer:``; without one, or with nothing after it, the whole text is the answer."""
    mark = r"(?isu)^(.*)final\s*answer\s*:(.*)$"
    answer = F.btrim(F.regexp_extract(text, mark, 2), F.lit(" \t\r\n"))
    reasoning = F.btrim(F.regexp_replace(F.btrim(F.regexp_extract(text, mark, 1), F.lit(" \t\r\n")), r"(?i)^\s*reasoning\s*:", ""), F.lit(" \t\r\n"))
    split = text.rlike(mark) & (answer != "")
    return F.struct(F.when(split, F.nullif(reasoning, F.lit(""))).alias("reasoning"), F.when(split, answer).otherwise(text).alias("answer"))


def subtasks(text: Column, most: int = 5) -> Column:
    """Strings of the first JSON list in a text, trimmed, cut to 500 characters; anything else, numbers too, is left out."""
    items = F.try_parse_json(F.regexp_extract(text, r"(?s)\[.*\]", 0)).try_cast("array<variant>")
    strings = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    trimmed = F.transform(strings, lambda x: F.substring(F.btrim(x.cast("string"), F.lit(" \t\r\n")), 1, 500))
    return F.slice(F.filter(trimmed, lambda x: x != ""), 1, most)


def plan(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` if that is a JSON object, else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & found.startswith("{"), found)


def feedback(message: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """true, false, or null for what is no feedback command."""
    said = F.lower(F.btrim(message, F.lit(" \t\r\n")))
    return F.when(said.isin(*positive), True).when(said.isin(*negative), False)


def sensitive_role(name: Column, sensitive: tuple[str, ...] = (), safe: tuple[str, ...] = (), more: Column | None = None) -> Column:
    """Named roles first, then any marker among the words of the name (and of ``more``, a list of further texts)."""
    texts = F.array(name) if more is None else F.concat(F.array(name), F.coalesce(more, F.array().cast("array<string>")))
    tokens = F.flatten(F.transform(texts, lambda x: F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+")))
    by_word = F.arrays_overlap(tokens, F.array(*map(F.lit, SENSITIVE_MARKERS)))
    key = F.lower(F.trim(name))
    return F.when(F.coalesce(name, F.lit("")) == "", False).when(key.isin(*sensitive), True).when(key.isin(*safe), False).otherwise(by_word)


def keyword_role(text: Column, roles: dict[str, tuple[str, ...]], default: Column) -> Column:
    """The first role with a keyword in the text, else the default."""
    out = None
    for role, words in roles.items():
        out = F.when(any_of(text, words), role) if out is None else out.when(any_of(text, words), role)
    return default if out is None else out.otherwise(default)


def intent_role(message: Column) -> Column:
    """The role that a message's words call for, null where none does."""
    return keyword_role(message, INTENT_KEYWORDS, F.lit(None).cast("string"))


def wants_human(message: Column) -> Column:
    """Whether a message asks for a person in one of the fixed phrases."""
    return any_of(message, ESCALATION_PHRASES)


def _factor(unit: Column, table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[unit]


def convert(value: Column, given: Column, wanted: Column) -> Column:
    """Length or weight in another unit; null between kinds and for unknown units."""
    return F.coalesce(*(value * _factor(given, t) / _factor(wanted, t) for t in (METRES, GRAMS)))


def convert_temperature(value: Column, given: Column, wanted: Column) -> Column:
    """c, f or k in another of them; null for other units and for a kelvin value below 0."""
    given, wanted = F.lower(given), F.lower(wanted)
    celsius = F.when(given == "c", value).when(given == "f", (value - 32) * 5 / 9).when(given == "k", value - 273.15)
    kelvin = celsius + 273.15
    return F.when(wanted == "c", celsius).when(wanted == "f", celsius * 9 / 5 + 32).when((wanted == "k") & (kelvin >= 0), kelvin)


def variants(query: Column, answer: Column, most: int = 3) -> Column:
    """The query and the further phrasings in a model's answer, a line each: without list marks, blanks and repeats of the query."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(" -*\t"))), lambda x: x != "")
    return F.slice(F.concat(F.array(query), F.filter(lines, lambda x: F.lower(x) != F.lower(query))), 1, most)


def weekday_names(field: Column) -> Column:
    """A cron weekday field (0 and 7 are Sunday) as names; null where it has steps or is no list of days and ranges."""
    days = F.array(*map(F.lit, ("sun", "mon", "tue", "wed", "thu", "fri", "sat", "sun")))
    ends = F.transform(F.split(field, ","), lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int").alias("a"), F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2))).otherwise(p).try_cast("int").alias("b")))
    fine = field.rlike(r"^\d(-\d)?(,\d(-\d)?)*$") & ~F.exists(ends, lambda e: (e["a"] > e["b"]) | (e["b"] > 7))
    names = F.array_distinct(F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.least(e["a"], e["b"]), e["b"]), lambda d: F.element_at(days, d + 1)))))
    return F.when((field == "*") | field.rlike("[A-Za-z]"), field).when(fine, F.array_join(names, ","))


def _address(text: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("long"))
    fine = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    return F.when(fine, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p))


def in_networks(address: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address is one of the given ones or lies in one of the IPv4 networks (``10.0.0.0/8``); false for what is no address."""
    out = address.isin(*networks)
    for network in ipaddress.collapse_addresses(ipaddress.IPv4Network(n, strict=False) for n in networks if ":" not in n):
        out = out | _address(address).between(int(network.network_address), int(network.broadcast_address))
    return F.coalesce(out, F.lit(False))


def client_of(peer: Column, forwarded: Column, trusted: tuple[str, ...]) -> Column:
    """The last hop that is no trusted proxy (addresses or networks), for a peer that is one; the peer itself otherwise, or where all hops are trusted or that hop is no address."""
    peer = F.coalesce(F.nullif(F.trim(peer), F.lit("")), F.lit("unknown"))
    hops = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda h: F.trim(h)), lambda h: h != "")
    outer = F.filter(F.slice(F.reverse(hops), 1, 20), lambda h: ~in_networks(h, trusted))
    first = F.try_element_at(outer, F.lit(1))
    fine = first.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|[0-9a-fA-F:]*:[0-9a-fA-F:.]*)$")
    return F.substring(F.when(in_networks(peer, trusted) & fine, first).otherwise(peer), 1, 64)
