"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (
    ann,
    chat,
    collocations,
    decontaminate,
    licences,
    lm,
    near_dedup,
    packing,
    quality,
    rules,
    search,
    sharding,
    toxicity,
)

TOKENIZER = "word_bpe_49k.json"
CONTROL_CASE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", F.lower(F.hex("class_key")).alias("class_key"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op10_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_CASE).alias("text"),
    )
    done = chat.format_chats(turns.unionByName(control))
    read = done.select(
        "conv_id",
        "formatted",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("spans")).alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    support, scale = collocations.SUPPORT, collocations.SCALE
    phrases = " UNION ALL ".join(
        f"SELECT lang, {n} AS size, array_to_string(list_slice(words, i, i + {n - 1}), ' ') AS phrase "
        f"FROM (SELECT lang, words, unnest(range(1, len(words) - {n - 2})) AS i FROM pieces WHERE len(words) >= {n}) x"
        for n in range(1, collocations.LONGEST + 1)
    )
    return rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) x
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM ({phrases}) p GROUP BY ALL HAVING count(*) >= {support}
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (CAST({scale} AS HUGEINT) * c.f) // (l.f + r.f) AS score
  FROM (SELECT lang, phrase, f, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.words, 1, c.k), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.words, c.k + 1, len(c.words)), ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(list_slice(words, i, i + n - 1), ' ') AS phrase, f FROM (
    SELECT lang, string_split(phrase, ' ') AS words, size, f, n, unnest(range(1, size - n + 2)) AS i
    FROM f, (VALUES (2), (3)) s(n) WHERE size > n) x
), free AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * CAST(i.f AS HUGEINT) >= {collocations.COVERED_PERCENT} * CAST(c.a AS HUGEINT))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM free JOIN totals USING (lang) QUALIFY rank <= {collocations.TOP}
"""


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(_table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op13_sql() -> str:
    upper, pattern = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(text: str) -> str:
        return f"unnest(regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '{pattern}'))"

    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), words AS (
  SELECT r, doc_id, {terms("text")} AS t FROM docs
), told AS (
  SELECT r, doc_id, t, count(*) AS tf FROM words GROUP BY ALL
), tf AS (
  SELECT *, CAST(sum(tf) OVER (PARTITION BY r) AS BIGINT) AS n FROM told
), size AS (
  SELECT count(DISTINCT r) AS docs, CAST(sum(tf) AS BIGINT) AS terms FROM tf
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY t
), impact AS (
  SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)) AS x FROM tf, size
), asked AS (
  SELECT item_id, t, count(*) AS c FROM (SELECT item_id, {terms("text")} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark) b) q GROUP BY ALL
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(c * w * x) AS BIGINT) AS score FROM asked JOIN weight USING (t) JOIN impact USING (t) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {search.K}
"""


def _op12_sql() -> str:
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), windows AS (
  SELECT r, i, list_slice(words, i + 1, i + 3) AS w FROM (SELECT r, words, unnest(range(greatest(len(words) - 2, 0))) AS i FROM cut) x
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) >= 2) y, (VALUES (0), (1), (2)) z(k) GROUP BY r
), counted AS (
  SELECT c.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{rules.SYMBOL}')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM cut c LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEATED_PERCENT} * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(lines)
    OR 10 * length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) > 3 * length(regexp_replace(text, '\P{{L}}+', '', 'g'))
    OR 5 * len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{{L}}'))) > len(words)
    OR 10 * len(regexp_extract_all(text, '[!?]{{2,}}')) > n_words
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 9 * len(lines)
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\r]*$'))) > 3 * len(lines)
    OR 20 * len(regexp_extract_all(text, '</?[A-Za-z][^<>]*>')) > n_words
    OR len(list_filter(words, lambda w: length(w) > {rules.LONGEST_WORD})) > 0) AS kept
FROM counted
"""


def _op10_sql() -> str:
    escape = r"regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]|SEP\]))', '\1\\\2\3', 'g')"
    return rf"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_CASE}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_CASE}'
), told AS (
  SELECT *, {escape} AS esc, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE WHEN before = role THEN 5
    WHEN role = 'user' THEN 20 WHEN role = 'assistant' THEN 7
    ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]|SEP\]))', '\1\\\2\3', 'g')) END) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""


def _op8_sql() -> str:
    def canonical(text: str) -> str:
        out = f"lower({text})"
        for pattern in licences.COPYRIGHT:
            out = f"regexp_replace({out}, '{pattern}', '', 'g')"
        plain = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
        spelled = plain
        for pattern, to in licences.SPELLINGS:
            spelled = f"regexp_replace({spelled}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        spelled = f"regexp_replace({spelled}, ' +', ' ', 'g')"
        return f"trim(CASE WHEN contains({plain}, 'licen') OR contains({plain}, 'permission') THEN {spelled} ELSE {plain} END)"

    known = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licences.known_texts())
    return f"""
WITH known AS (
  SELECT md5({canonical("text")}) AS digest, min(licence) AS licence FROM (VALUES {known}) k(licence, text) GROUP BY 1
), forms AS (
  SELECT doc_id, coalesce(text, '') AS text, {canonical("coalesce(text, '')")} AS form FROM documents
), lines AS (
  SELECT DISTINCT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS line FROM forms
), notices AS (
  SELECT doc_id, whole, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT doc_id, whole, {canonical("line")} AS form FROM lines) l JOIN known ON md5(form) = known.digest WHERE form <> '' GROUP BY 1, 2
)
SELECT f.doc_id, CASE WHEN f.form <> '' THEN md5(f.form) END AS digest, known.licence, notices.notices
FROM forms f LEFT JOIN known ON f.form <> '' AND md5(f.form) = known.digest
LEFT JOIN notices ON notices.doc_id = f.doc_id AND notices.whole = f.text
"""


def _op5_sql() -> str:
    mark_name, mark_number, mark_unit = decontaminate.NAME, decontaminate.NUMBER, decontaminate.UNIT
    n = decontaminate.WINDOW

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    def marked(text: str) -> str:
        out = f"regexp_replace({text}, '[{mark_name}{mark_number}{mark_unit}]', ' ', 'g')"
        for _ in range(2):
            out = rf"regexp_replace({out}, '{quoted(decontaminate.NAME_AT)}', '\1{mark_name}\2', 'g')"
        out = rf"regexp_replace({out}, '{quoted(decontaminate.NUMBER_AT)}', '\1{mark_number}\2 {mark_unit}\3 ', 'g')"
        return f"regexp_replace({out}, '{mark_unit} ', ' ', 'g')"

    def words(text: str) -> str:
        bare = rf"regexp_replace(lower({marked(text)}), '{quoted(decontaminate.VALUE)}', '\1 ', 'g')"
        return f"regexp_extract_all({bare}, '{quoted(decontaminate.TOKEN)}')"

    def valued(text: str) -> str:
        return f"regexp_extract_all(lower({marked(text)}), '{quoted(decontaminate.VALUED)}')"

    def windows(rel: str, keys: str) -> str:
        return (
            f"SELECT {keys}, len(words) - {n - 1} AS all_windows, pos, list_slice(words, pos + 1, pos + {n}) AS win "
            f"FROM (SELECT *, unnest(range(greatest(len(words) - {n - 1}, 0))) AS pos FROM {rel}) x"
        )

    slot = f"left(v, 1) IN ('{mark_name}', '{mark_number}', '{mark_unit}')"
    return f"""
WITH items AS (
  SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark
), iw AS (
  SELECT *, {words("text")} AS words, {valued("text")} AS vals FROM items
), docs AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
), dw AS (
  SELECT *, {words("text")} AS words FROM docs
), item_windows AS (
  SELECT * FROM ({windows("iw", "item_id, text, vals")}) y WHERE len(list_filter(win, lambda v: NOT ({slot}))) >= {decontaminate.LITERALS}
), doc_windows AS ({windows("dw", "doc_id, text")}), found AS (
  SELECT d.doc_id, d.text AS doc_text, i.item_id, i.vals AS item_vals, i.all_windows, d.pos - i.pos AS word_offset, count(DISTINCT i.pos) AS windows
  FROM doc_windows d JOIN item_windows i ON d.win = i.win GROUP BY ALL
  HAVING count(DISTINCT i.pos) >= least({decontaminate.WINDOWS_NEEDED}, i.all_windows)
), slots AS (
  SELECT doc_id, doc_text, item_id, item_vals, all_windows, word_offset, windows,
    list_distinct(list_filter(list_transform(range(len(item_vals)),
      lambda i: {{'v': item_vals[i + 1], 'd': CASE WHEN i + word_offset >= 0 THEN dv[i + word_offset + 1] END}}),
      lambda p: left(p.v, 1) IN ('{mark_name}', '{mark_number}', '{mark_unit}') AND coalesce(left(p.d, 1) = left(p.v, 1), false))) AS pairs
  FROM (SELECT *, {valued("doc_text")} AS dv FROM found) z
)
SELECT doc_id, item_id, word_offset, windows, all_windows AS item_windows,
  len(list_filter(pairs, lambda p: p.v <> p.d)) = 0 AS verbatim
FROM slots WHERE len(list_distinct(list_transform(pairs, lambda p: p.v))) = len(pairs)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_lm_scores,
        op3_packing,
        op4_near_duplicates,
        op5_decontamination,
        op6_quality,
        op7_neighbours,
        op8_licences,
        op9_shards,
        op10_chats,
        op11_collocations,
        op12_rules,
        op13_ranked_search,
    )
}
SQL: dict[str, str] = {
    "op5_decontamination": _op5_sql(),
    "op8_licences": _op8_sql(),
    "op10_chats": _op10_sql(),
    "op11_collocations": _op11_sql(),
    "op12_rules": _op12_sql(),
    "op13_ranked_search": _op13_sql(),
}
