"""Full-text retrieval by a direct scan: web-style queries and BM25 with statistics over all rows.

Terms are runs of letters and digits in lower case, with their diacritics or
(``fold``) without.  The scan has no stemming and no stop words; ``textindex`` has
both, a postings table, and many queries in one plan.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BETWEEN = r"[^\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")
#: Latin and Greek letters with diacritics, and the letters they stand on.
_MARKED = [c for r in (range(0xC0, 0x250), range(0x370, 0x400), range(0x1E00, 0x2000)) for c in map(chr, r) if c.isalpha() and len(unicodedata.normalize("NFD", c)) > 1]
_BARE = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]


def lowered(text: Column, fold: bool = False) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.translate(low, "".join(_MARKED), "".join(_BARE)) if fold else low


def terms(text: Column, fold: bool = False) -> Column:
    """Terms in order.  Cut at what lies between them: ``regexp_extract_all`` copies the text for each match."""
    return F.array_remove(F.split(lowered(text, fold), BETWEEN, -1), "")


def query_words(text: str, fold: bool = True) -> list[str]:
    """Distinct terms of a query in order."""
    low = text.lower().translate(dict(zip(map(ord, _MARKED), _BARE, strict=True))) if fold else text.lower()
    return list(dict.fromkeys(_WORD.findall(low)))


@dataclass
class Group:
    """Phrases (of one term or more) that must occur, and that must not."""

    wanted: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def parse(text: str) -> list[Group]:
    """Alternatives of a web-style query: terms are joined by AND, ``or`` parts alternatives, ``"..."`` is a phrase, ``-`` excludes what follows."""
    groups = [Group()]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if word.lower() == "or" and not minus and not quoted:
            if groups[-1].wanted or groups[-1].excluded:
                groups.append(Group())
            continue
        found = " ".join(_WORD.findall((quoted or word.lstrip("-")).lower()))
        if found:
            (groups[-1].excluded if minus or word.startswith("-") else groups[-1].wanted).append(found)
    return [g for g in groups if g.wanted or g.excluded]


def matches(groups: list[Group], text: Column) -> Column:
    t = terms(text)
    line = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))

    def has(phrase: str) -> Column:
        return line.contains(f" {phrase} ") if " " in phrase else F.array_contains(t, phrase)

    out = F.lit(False)
    for g in groups:
        ok = F.lit(True)
        for phrase in g.wanted:
            ok = ok & has(phrase)
        for phrase in g.excluded:
            ok = ok & ~has(phrase)
        out = out | ok
    return out


def bm25(rows: DataFrame, query_terms: list[str], id_col: str = "doc_id", text_col: str = "text", fold: bool = False) -> DataFrame:
    """id, score of the rows with any of the terms; document frequencies and lengths are of all rows.

    One pass gives the statistics (a row), one the scores, and nothing else is shuffled.
    """
    wanted = sorted(set(query_terms))
    # Through an explode of one list, below which no filter is pushed: else each text would be cut once for each use.
    words = rows.select(F.col(id_col).alias("id"), F.explode(F.array(terms(F.col(text_col), fold))).alias("words"))
    tfs = [(F.size("words") - F.size(F.array_remove("words", t))).cast("long").alias(f"tf{i}") for i, t in enumerate(wanted)]
    per = words.select("id", F.size("words").cast("long").alias("n"), *tfs)
    stats = per.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("avg_len")))
    some = F.greatest(F.lit(0), F.lit(0), *(F.col(f"tf{i}") for i in range(len(wanted)))) > 0
    # One row of statistics for all.
    return per.filter(some).join(F.broadcast(stats)).select("id", score.alias("score"))


def search(rows: DataFrame, text: str, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rank, id, score: matching rows by BM25 of the query's terms, ties by id; a blank query finds nothing."""
    groups = parse(text)
    positive = [t for g in groups for p in g.wanted for t in p.split()]
    found = rows.filter(matches(groups, F.col(text_col)))
    scored = bm25(rows, positive, id_col, text_col) if positive else found.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"))
    top = scored.join(found.select(F.col(id_col).alias("id")), "id", "left_semi") if any(" " in p for g in groups for p in g.wanted) or len(groups) != 1 or len(groups[0].wanted) > 1 or groups[0].excluded else scored
    top = top.orderBy(F.desc("score"), "id").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "id", F.round("score", 4).alias("score"))
