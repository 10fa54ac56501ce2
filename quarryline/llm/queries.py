"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    rows = packing.pack_documents(common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end=0)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfiles

    folder = common.fresh_path(spark, "token-files")
    shards = tokenfiles.write(common.table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"), end=2, vocabulary=49_408)
    return tokenfiles.read(shards, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repetition

    rows = repetition.repetition(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op4_sql() -> str:
    """Every measure by its definition: n-grams as strings, counted within each row."""
    from . import repetition

    limits = repetition.Limits()
    parts, fine = [], [f"coalesce(l3.chars, 0) / c <= {limits.line_chars}::DOUBLE"]
    for n, most in (*limits.ngrams, *limits.tops):
        gram = " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, n))])
        chars = " + ".join(["len", *(f"lead(len, {j}) OVER o" for j in range(1, n))])
        parts.append(f"g{n} AS (SELECT r, i, len, {gram} AS g, {chars} AS chars FROM x WINDOW o AS (PARTITION BY r ORDER BY i)), k{n} AS (SELECT *, CASE WHEN g IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY r, g) END AS k FROM g{n})")
        if n < 5:
            parts.append(f"m{n} AS (SELECT r, max(k * chars) FILTER (WHERE k > 1) AS chars FROM k{n} GROUP BY r)")
        else:
            parts.append(f"m{n} AS (SELECT r, sum(len) FILTER (WHERE inside) AS chars, count(*) FILTER (WHERE inside) AS words FROM (SELECT r, len, bool_or(k > 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM k{n}) GROUP BY r)")
        fine.append(f"coalesce(m{n}.chars, 0) / c <= {most}::DOUBLE")
    joins = " ".join(f"LEFT JOIN m{n} ON m{n}.r = v.r" for n, _ in (*limits.ngrams, *limits.tops))
    word, space = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS ws FROM documents),
x AS (SELECT r, i, w, length(w) AS len FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d)),
{", ".join(parts)},
l1 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l2 AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l1 WHERE regexp_matches(line, '{word}')),
l3 AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '{space}', '', 'g')))::BIGINT AS chars FROM l2 WHERE k > 1 GROUP BY r),
v AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, greatest(coalesce(list_sum([length(x) FOR x IN ws]), 0), 1)::DOUBLE AS c FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(l3.n, 0)::BIGINT AS n_dup_lines, coalesce(m5.words, 0)::BIGINT AS n_repeat_words,
    n_words < {limits.min_words} OR 100 * coalesce(m5.words, 0) > {limits.repeat_percent} * n_words AS base_failed,
    NOT (n_words < {limits.min_words} OR 100 * coalesce(m5.words, 0) > {limits.repeat_percent} * n_words) AND {" AND ".join(fine)} AS kept
FROM v LEFT JOIN l3 ON l3.r = v.r {joins}"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    sizes = mixing.sized(common.table(spark, sf_dir, "documents"))
    goals = common.cut(mixing.targets(sizes))
    plan = mixing.draws(sizes, goals)
    taken = plan.groupBy("row_key", "nth").agg(F.sum("words").alias("taken"))
    rows = sizes.join(taken, ["row_key", "nth"], "left")
    rows = rows.join(goals, rows["source"].eqNullSafe(goals["source"]))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def _rolled(spark: SparkSession, sf_dir: str, counts: DataFrame, revised: str) -> DataFrame:
    """Totals after three batches, each sent twice, the first two summed into a base: all documents are inserted; those labelled 0 for quality are deleted; the counts of those labelled 1 that hold a digit are revised as if digits were no tokens of the version ``revised``."""
    from . import rollups

    store = rollups.Rollups(spark, common.fresh_path(spark, "rollups"))
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    facts = counts.join(labels, "doc_id")
    none = F.lit(None).cast("long")
    inserted = counts.withColumns({"op": F.lit(rollups.INSERT), "old_tokens": none})
    deleted = facts.filter("quality = 0").withColumns({"op": F.lit(rollups.DELETE), "old_tokens": F.col("tokens"), "tokens": none})
    changed = facts.filter((F.col("quality") == 1) & (F.col("digits") > 0) & (F.col("tokenizer") == revised))
    changed = changed.withColumns({"op": F.lit(rollups.REVISE), "old_tokens": F.col("tokens"), "tokens": F.col("tokens") - F.col("digits")})
    for batch, changes in (("0001", inserted), ("0002", deleted), ("0001", inserted)):
        store.commit(batch, changes)
    store.compact()
    for batch, changes in (("0003", changed), ("0002", deleted), ("0003", changed)):
        store.commit(batch, changes)
    return store.totals()


def op6_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of two public tokenizers, kept up to date by batches (see ``_rolled``)."""
    from . import rollups

    files = {name: tokenizer(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k")}
    digits = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[0-9]"))
    counts = common.stored(rollups.tokenized(common.table(spark, sf_dir, "documents"), files, keep={"digits": digits}))
    return _rolled(spark, sf_dir, counts, "word_bpe_49k")


def rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches over counts that SQL can make: words and pieces."""
    from . import rollups

    docs = common.table(spark, sf_dir, "documents")
    digits = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[0-9]"))
    return _rolled(spark, sf_dir, common.stored(rollups.counted(docs, keep={"digits": digits})), "pieces-1")


_OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT d.source, d.lang, q.quality,
        len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words,
        len(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z\x20\x09-\x0D]')) AS pieces,
        len(regexp_extract_all(t, '[0-9]')) AS digits
      FROM d LEFT JOIN labels q ON d.doc_id = q.doc_id),
k AS (SELECT * FROM c WHERE quality IS DISTINCT FROM 0)
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS docs, sum(words)::BIGINT AS tokens FROM k GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', count(*)::BIGINT, sum(CASE WHEN quality = 1 THEN pieces - digits ELSE pieces END)::BIGINT FROM k GROUP BY source, lang
"""


def op7_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hamming

    codes = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    found = hamming.top_k(codes, codes.filter("id % 50 = 0"), k=10)
    return found.select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "distance")


_OP7_SQL = """
WITH bits AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64),
c AS (SELECT vec_id, string_agg(CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS code FROM bits GROUP BY vec_id),
r AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::BIGINT AS distance,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id)::INTEGER AS rank
      FROM c q JOIN c ON q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"))


_OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM d)),
n AS (SELECT d.doc_id, count(s.s) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM n
"""


def _held_out(column: str = "doc_id", by: int = 3, rest: int = 1):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by == rest, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~_held_out()))
    return quality.score(docs, model).select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~_held_out()))
    return toxicity.score(docs, model).select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = common.table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~_held_out(by=5, rest=0)))
    return language.score(docs, model).select("doc_id", _held_out(by=5, rest=0).alias("held_out"), "lang_pred", "score")

def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` with nulls of role and text as one space and every fifth row damaged: dropped, emptied, without its sentence ends, repeated or set to user."""
    rows = common.table(spark, sf_dir, "conversations")
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("harm"))
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(harm == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(harm != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversation

    repair = conversation.repaired(damaged(spark, sf_dir))
    ids = common.table(spark, sf_dir, "conversations").select("conv_id").distinct().alias("i")
    whole, digests = repair.conversations.alias("w"), repair.digests().alias("d")
    rows = ids.join(whole, F.col("i.conv_id").eqNullSafe(F.col("w.conv_id")), "left").join(digests, F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    counts = (F.coalesce(F.col(f"w.{c}"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return rows.select("i.conv_id", *counts, F.coalesce("w.audit", F.lit("")).alias("audit"), F.coalesce("d.sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance

    rows = importance.resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linedup

    rows = linedup.deduplicated(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: CRC-32 by its definition: a table by the rule, then byte after byte.
_CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT] || [0::BIGINT for i in range(8)], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def _crc(text: str) -> str:
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(0, length({hexed}), 2), lambda i: (strpos('0123456789ABCDEF', {hexed}[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', {hexed}[i + 2]) - 1)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}::BIGINT[], lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


#: The cheapest (cost, audit) for what may be complete after each row, row by row.
_OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
codes AS (SELECT k, {_crc("k")} % 20 AS harm FROM (SELECT DISTINCT k FROM keyed), tab),
harmed AS (
    SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE harm WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM keyed JOIN codes USING (k) WHERE harm <> 0),
numbered AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harmed),
ended AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1] AS e, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS seen FROM numbered),
faulty AS (SELECT *, role[1] AS r, CASE WHEN e = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM ended),
follows(a, b, r, role) AS (VALUES ('N', 'S', 's', NULL), ('N', 'U', 'u', 'user'), ('S', 'U', 'u', 'user'), ('A', 'U', 'u', 'user'), ('U', 'A', 'a', 'assistant')),
inserts(a, b, n, lines) AS (VALUES ('N', 'N', 0, ''), ('S', 'S', 0, ''), ('U', 'U', 0, ''), ('A', 'A', 0, ''), ('N', 'U', 1, 'user:' || chr(10)), ('S', 'U', 1, 'user:' || chr(10)), ('A', 'U', 1, 'user:' || chr(10)),
    ('U', 'A', 1, 'assistant:' || chr(10)), ('N', 'A', 2, 'user:' || chr(10) || 'assistant:' || chr(10)), ('S', 'A', 2, 'user:' || chr(10) || 'assistant:' || chr(10))),
moves AS (
    SELECT c, i, a, a AS b, 4 AS price, 'D' AS edit, '' AS line FROM faulty, (VALUES ('N'), ('S'), ('U'), ('A')) x(a)
    UNION ALL SELECT c, i, a, b, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', faulty.role || ':' || text || chr(10) FROM faulty JOIN follows ON faulty.r = follows.r WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT c, i, a, b, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', follows.role || ':' || text || chr(10) FROM faulty, follows WHERE fault NOT IN ('blank', 'duplicate') AND follows.role IS NOT NULL),
steps AS (SELECT c, i, inserts.a, moves.b, 3 * n + price AS price, repeat('I', n) || edit AS edit, lines || line AS line FROM inserts JOIN moves ON inserts.b = moves.a),
parsed AS (
    SELECT DISTINCT c, 0::BIGINT AS i, 'N' AS a, 0::BIGINT AS cost, '' AS audit, '' AS body FROM numbered
    UNION ALL
    SELECT c, i, b, best.cost, best.audit, best.body FROM (
        SELECT p.c, p.i + 1 AS i, s.b, min({{'cost': p.cost + s.price, 'audit': p.audit || s.edit, 'body': p.body || s.line}}) AS best
        FROM parsed p JOIN steps s ON s.c = p.c AND s.i = p.i + 1 AND s.a = p.a GROUP BY ALL)),
ends AS (
    SELECT c, min({{'cost': cost + 3 * n, 'audit': audit || repeat('I', n), 'body': body || lines}}) AS best
    FROM parsed JOIN inserts USING (a) WHERE inserts.b IN ('N', 'A') AND i = (SELECT max(i) FROM numbered m WHERE m.c = parsed.c) GROUP BY c),
pairs AS (SELECT c, r || lead(r) OVER (PARTITION BY c ORDER BY i) AS two, length(r) AS one FROM faulty),
counts AS (
    SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
    FROM faulty GROUP BY c),
odd AS (SELECT c, count(*) FILTER (two NOT IN ('su', 'ua', 'au') OR (two IS NOT NULL AND one = 0)) AS illegal FROM pairs GROUP BY c),
whole AS (SELECT * FROM counts JOIN odd USING (c) JOIN ends USING (c))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.body[1 : length(best.body) - 1], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_OP12_SQL = rf"""
WITH {_CRC_TABLE},
texts AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', 0, NULL, text FROM benchmark),
words AS (SELECT kind, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
buckets AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), tab),
hits AS (SELECT kind, r, bucket FROM words JOIN buckets USING (w)),
sums AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM hits GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, totals),
docs AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM hits JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1 : 8] AS digits FROM texts LEFT JOIN docs USING (r) WHERE kind = 'd'),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || digits)::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, weight, n_features) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END::BIGINT AS rank FROM ranked
"""

_OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
    SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)),
often AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
k AS (SELECT r, count(*) AS n_lines, count(often.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL) AS kept FROM l LEFT JOIN often ON often.key = l.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM k JOIN d USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith(("op", "rollup_")) and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op4_repetition": _op4_sql(), "op8_jaccard": _OP8_SQL, "rollup_words": _OP6_SQL, "op7_hamming": _OP7_SQL, "op11_conversations": _OP11_SQL, "op12_resampling": _OP12_SQL, "op13_line_dedup": _OP13_SQL}
