"""The same functions in the checking engine's SQL."""

from __future__ import annotations

from papersluice.sources import rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(text: str, kind: str) -> str:
    words = [f"(CASE WHEN contains(lower({text}), {quoted(k)}) THEN {rules.PHRASE_WEIGHT if ' ' in k else 1} ELSE 0 END)" for k in rules.KEYWORDS[kind]]
    shapes = [f"(CASE WHEN regexp_matches({text}, {quoted(p)}, 'i') THEN {rules.PATTERN_WEIGHT} ELSE 0 END)" for p in rules.PATTERNS[kind]]
    return "CAST(" + " + ".join(words + shapes) + " AS INT)"


def classified(source: str, text: str, keep: str = "doc_id") -> str:
    """keep, score_<type>, doc_type."""
    scores = ", ".join(f"{hits(text, k)} AS score_{k}" for k in rules.TYPES)
    best = "greatest(score_aadhaar, score_pan, score_vehicle_rc)"
    return f"""(SELECT *, CASE WHEN {best} = 0 THEN 'aadhaar' WHEN score_vehicle_rc = {best} THEN 'vehicle_rc' WHEN score_pan = {best} THEN 'pan' ELSE 'aadhaar' END AS doc_type
  FROM (SELECT {keep}, {scores} FROM {source} s0) s1)"""


def words(lines: str) -> str:
    """Words of lines, as papersluice.operators.words.line_words()."""
    return f"""(SELECT doc_id, CAST(line_num + 1 AS INT) AS line_num, CAST(i + 1 AS INT) AS word_num, tokens[i + 1] AS text, confidence,
    CAST(floor(x + coalesce(list_sum(list_transform(tokens[1:i], lambda v: floor(length(v) * pc))), 0) + i * pc) AS INT) AS x, y,
    CAST(floor(length(tokens[i + 1]) * pc) AS INT) AS w, h,
    CASE WHEN length(regexp_replace(tokens[i + 1], '[,.\\s$€£¥]', '', 'g')) = 0 THEN false
      ELSE length(regexp_replace(regexp_replace(tokens[i + 1], '[,.\\s$€£¥]', '', 'g'), '[^0-9]', '', 'g')) * 1.0 / length(regexp_replace(tokens[i + 1], '[,.\\s$€£¥]', '', 'g')) > 0.5 END AS is_numeric,
    lower(tokens[i + 1]) IN ({", ".join(quoted(s) for s in rules.STOPWORDS)}) AS is_stopword
  FROM (SELECT *, unnest(range(len(tokens))) AS i FROM
    (SELECT *, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS tokens, CAST(w AS DOUBLE) / length(trim(text)) AS pc FROM {lines} l0) l1) l2)"""


def stats(words_: str, key: str = "doc_id") -> str:
    w = "(CASE WHEN is_stopword THEN 0.3 WHEN is_numeric THEN 1.5 ELSE 1.0 END)::DOUBLE"
    return f"""(SELECT *, CASE WHEN total_words < {rules.LEAST_WORDS} OR low_confidence_words * 1.0 / total_words > 0.4 THEN 0.0
    ELSE least(1.0, mean_confidence / 100.0 + least(0.1, numeric_words::DOUBLE / total_words * 0.2)) END::DOUBLE AS ocr_score FROM
  (SELECT {key}, count(*) AS total_words, count(*) FILTER (confidence < {rules.LOW_CONFIDENCE}) AS low_confidence_words, count(*) FILTER (is_numeric) AS numeric_words,
    sum(confidence * {w}) / sum({w}) AS mean_confidence FROM {words_} w0 GROUP BY {key}) w1)"""
