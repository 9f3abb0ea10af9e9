"""Line-first quality rules, all in DataFrame expressions.

Every line with a word is judged first: navigation (lists of short links), boilerplate
(notices, prompts) and punctuation (no sentence mark of any script, or marks used as ornament:
hanging on three words or a third of them, or half of the line; emphasis and operators are none).
Failing lines are removed, and a document that loses too much of its text is rejected.
Before that, base rules reject very short and very repetitive documents. Nothing is
shuffled: each document is judged in its own row.

Defined results: a NULL or empty text has no words, hence ``base_failed``; blank lines are
never judged; repeated rows are judged alike; further columns pass through untouched, except
that columns with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.inputs import let, table, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30
WINDOW = 3

#: Fixed values of the line rules.
SYMBOLS = r"[^#*$%&|<>]+"
LINK_MARKS = "|»›•·"
#: Marks that end or part sentences in any script, as Unicode lists them.
SENTENCE_MARKS = (
    r"[.,;:!?…;·։׃،؛؞؟۔܀-܊܌߸߹।॥๚๛༈།-༒၊။፡-፨᙮។-៖៚᠂-᠅᠈᠉᥄᥅᪨-᪫᭚᭛᭝-᭟᰻-᰿᱾᱿‼-‽⁇-⁉⸮、。꓾꓿꘍-꘏꛳-꛷꡶꡷꣎꣏꤯꧇-꧉꩝-꩟꯫﹐-﹒﹔-﹗！，．：；？｡､]"
)
ORNAMENTS = r"(?:##|\*\*|\$\$|%%|&&|!!|\?\?|~~|==|__)"
NOTICES = (
    "all rights reserved", "licensed under", "general public license", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "accept cookies", "uses cookies", "enable javascript", "sign in", "log in", "sign up", "subscribe now", "click here", "read more", "back to top",
    "skip to content", "share this", "lorem ipsum",
)
NOTICE_LENGTH = 160
#: Notices as whole words; emphasis around words and names like __init__; marks hanging on the end of a word.
WHOLE_NOTICES = r"(?<![\p{L}\p{N}])(?:" + "|".join(NOTICES) + r")(?![\p{L}\p{N}])"
EMPHASIS = r"(?<![\p{L}\p{N}\p{P}&&[^(\[\"'.]])(\*\*|__|~~|==|\$\$)(?=[\p{L}\p{N}(\[\"'`])(?:(?!\1).)+?(?<=\S)\1"
HANGING = rf"(?<=\S){ORNAMENTS}[#*$%&!?~=_]*(?=\s|$)"
HAS_WORD = r"[^\x20\x09-\x0D]"


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the text."""
    size = F.size(tokens)
    keys = F.when(
        size >= WINDOW, F.transform(F.slice(tokens, F.lit(1), size - F.lit(WINDOW - 1)), lambda word, i: F.xxhash64(word, F.get(tokens, i + 1), F.get(tokens, i + 2))),
    )

    def starts(sorted_keys: Column) -> Column:
        def twin(entry: Column, i: Column) -> Column:
            before, after = F.get(sorted_keys, i - 1)["key"] == entry["key"], F.get(sorted_keys, i + 1)["key"] == entry["key"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(sorted_keys, twin), lambda entry: entry["place"]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda place, i: F.coalesce(F.least(F.get(places, i + 1) - place, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def count(hashes: Column) -> Column:
        entries = F.transform(hashes, lambda key, i: F.struct(key.alias("key"), i.alias("place")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(entries), lambda s: let(starts(s), covered)))

    return F.coalesce(let(keys, count), F.lit(0)).cast("long")


def line_passes(line: Column) -> Column:
    """A line without a word always passes."""
    size = F.length(line)
    links = size - F.length(F.translate(line, LINK_MARKS, ""))
    ornaments = F.regexp_count(line, F.lit(ORNAMENTS))
    hanging = F.regexp_count(F.regexp_replace(line, EMPHASIS, "x"), F.lit(HANGING))
    decorated = (hanging >= 3) | ((hanging >= 2) & (hanging * 3 >= F.size(words(line)))) | (ornaments * 4 >= size)
    navigation = (links >= 2) & (links * 40 >= size)
    boilerplate = (size <= NOTICE_LENGTH) & F.lower(line).rlike("|".join(NOTICES)) & F.lower(line).rlike(WHOLE_NOTICES)
    punctuation = ~line.rlike(SENTENCE_MARKS) | ((ornaments >= 2) & (ornaments * 40 >= size) & decorated)
    return ~line.rlike(HAS_WORD) | ~(navigation | boilerplate | punctuation)


def judge(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, ``kept`` and ``cleaned`` (the text without failing lines)."""
    results = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"}
    inner = {"__body", "__words", "__lines", "__wordy", "__left"}
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in results | inner]
    body = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias("__body"))
    split = body.select("*", words(F.col("__body")).alias("__words"), F.split("__body", "\n", -1).alias("__lines"))
    split = split.select(
        "*", F.filter("__lines", lambda line: line.rlike(HAS_WORD)).alias("__wordy"), F.filter("__lines", line_passes).alias("__left"),
    )
    measured = split.select(
        *others, "__wordy", "__left",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__body", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__wordy") - F.size(F.array_distinct("__wordy"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )
    before = F.length(F.array_join("__wordy", ""))
    after = F.length(F.array_join(F.filter("__left", lambda line: line.rlike(HAS_WORD)), ""))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    results = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * (before - after) <= max_lost_percent * before)).alias("kept"), F.array_join("__left", "\n").alias("cleaned"),
    )
    # generated columns: a filter on them stays above, instead of being pushed down and
    # evaluating the split texts again for every word
    return measured.select(*others, F.inline(F.array(results)))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_line_quality": op5_line_quality}

#: The twin has notices without word bounds, Latin sentence marks and any two ornaments; the tables hold no line that tells them apart.
JUDGED_SQL = r"""
body AS (
  SELECT *, coalesce(text, '') AS body FROM {source}
), split AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS tokens, string_split(body, chr(10)) AS all_lines FROM body
), lines AS (
  SELECT *, list_filter(all_lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS wordy,
    list_filter(all_lines, lambda l: NOT regexp_matches(l, '[^\x20\x09-\x0D]') OR NOT (
      (length(l) - length(translate(l, '|»›•·', '')) >= 2 AND (length(l) - length(translate(l, '|»›•·', ''))) * 40 >= length(l))
      OR (length(l) <= 160 AND regexp_matches(lower(l), '{notices}'))
      OR NOT regexp_matches(l, '[.,;:!?…]')
      OR (len(regexp_extract_all(l, '{ornaments}')) >= 2 AND len(regexp_extract_all(l, '{ornaments}')) * 40 >= length(l)))) AS lines_left
  FROM split
), windows AS (
  SELECT doc_id, place, tokens[place] AS a, tokens[place + 1] AS b, tokens[place + 2] AS c
  FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) - 1)) AS place FROM split)
), twins AS (
  SELECT doc_id, place FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([place, place + 1, place + 2]) AS p FROM twins) GROUP BY doc_id
), measured AS (
  SELECT lines.*, len(tokens)::BIGINT AS n_words, length(array_to_string(tokens, ''))::BIGINT AS word_chars,
    (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(wordy) - len(list_distinct(wordy)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    length(array_to_string(wordy, '')) AS chars_before,
    length(array_to_string(list_filter(lines_left, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')), '')) AS chars_after
  FROM lines LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (chars_before - chars_after) <= 30 * chars_before AS kept,
    array_to_string(lines_left, chr(10)) AS cleaned
  FROM measured
)""".replace("{notices}", "|".join(NOTICES)).replace("{ornaments}", ORNAMENTS)

SQL = {
    "op5_line_quality": "WITH " + JUDGED_SQL.replace("{source}", "documents")
    + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
}
