"""Queries over fields of cards: merging, scoring, confidence, boxes; and decision rates over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.functions import sql
from papersluice.functions.dialect import DUCK
from papersluice.operators import classify, extract, fields, layout, words
from papersluice.plans.decision_queries import _WITH, triaged
from papersluice.plans.layout_queries import spatial_sql
from papersluice.session import read_table, written
from papersluice.sources import fixtures, rules
from papersluice.streaming.triage import decision_rate as rate

AS_OF = "2024-12-31"


def card_fields(spark: SparkSession, sf_dir: str, clean: bool = False) -> DataFrame:
    """The long table of the cards' fields. Typed cards are stored once and read by each type's branch."""
    typed = classify.classify(fixtures.cards(spark, sf_dir, clean), "full_text").select("doc_id", "doc_type", "full_text")
    return extract.extract_fields(written(typed, "typed_cards"))


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_fields(spark, sf_dir)


def schema_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tables = card_fields(spark, sf_dir), rules.rule_tables(spark)
    docs = classify.classify(fixtures.cards(spark, sf_dir), "full_text").select("doc_id", "doc_type")
    out = fields.schema_scores(docs, rows, tables["field_weights"], tables["required_fields"])
    return out.select("doc_id", "doc_type", F.round("schema_score", 9).alias("schema_score"), F.array_join("missing_critical", ", ").alias("missing_critical"), F.array_join("missing_required", ", ").alias("missing_required"))


def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of every field of the cards, from the words that it is made of."""
    w = written(words.plain_words(fixtures.card_lines(spark, sf_dir)).drop("line_num", "word_num"), "words")
    return fields.field_confidence(written(card_fields(spark, sf_dir), "fields"), w, words.ocr_stats(w))


def pattern_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.pattern_scores(card_fields(spark, sf_dir))


def consistency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.consistency(card_fields(spark, sf_dir), AS_OF)


def field_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.field_boxes(card_fields(spark, sf_dir), fixtures.card_lines(spark, sf_dir))


def field_spatial_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the fields' boxes, which are stored once: moments and hulls both read them."""
    return layout.spatial_scores(written(field_boxes(spark, sf_dir), "boxes"))


def anchor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each type over card texts."""
    out = classify.anchor_scores(fixtures.cards(spark, sf_dir), "full_text")
    names = [f"{k}_{n}" for k in rules.TYPES for n in ("required", "optional", "score")]
    return out.select("doc_id", *[F.round(n, 9).alias(n) if n.endswith("score") else F.col(n) for n in names])


def decision_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by five-minute windows; a card's event is the one of its number."""
    done = triaged(spark, sf_dir).select("doc_id", "doc_type", "decision")
    events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = rate(done.hint("merge").join(events, "doc_id"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {f.__name__: f for f in (extracted_fields, schema_score, field_confidence, pattern_score, consistency_rules, field_boxes, field_spatial_score, anchor_score, decision_rate)}


def _fields_sql(cards: str) -> str:
    """The long table of fields for the checking engine."""
    parts = []
    for k in rules.TYPES:
        names = list(extract.EXTRACTORS[k](DUCK, "_t", "_l", "_w"))
        pairs = [(n, n) for n in names] + list(extract.ALIASES[k].items())
        each = DUCK.array(*[DUCK.struct(n=f"'{n}'", v=c) for n, c in pairs])
        source = f"(SELECT * FROM {sql.classified(cards, 'full_text', 'doc_id, full_text')} c WHERE doc_type = '{k}')"
        parts.append(f"SELECT doc_id, '{k}' AS doc_type, e.n AS field_name, e.v AS value FROM (SELECT doc_id, unnest({each}) AS e FROM {extract.wide_sql(DUCK, source, k)} w) u WHERE e.v IS NOT NULL")
    return "(" + " UNION ALL ".join(parts) + ")"


_FIELDS = f"fields AS MATERIALIZED (SELECT * FROM {_fields_sql(fixtures.CARDS)} f)"
_DOCS = f"docs AS (SELECT doc_id, doc_type FROM {sql.classified(fixtures.CARDS, 'full_text')} c)"
_PRIORITY = " OR ".join(f"(doc_type = '{k}' AND field_name IN ({', '.join(repr(n) for n in ns)}))" for k, ns in rules.PRIORITY.items())
_values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
_BOXES = f"""SELECT doc_id, field_name, line_num, x, y, w, h FROM (SELECT f.doc_id, f.field_name, l.line_num, l.x, l.y, l.w, l.h, row_number() OVER (PARTITION BY f.doc_id, f.field_name ORDER BY l.line_num) AS rn
  FROM fields f JOIN {fixtures.CARD_LINES} l ON f.doc_id = l.doc_id AND (contains(lower(trim(l.text)), lower(trim(f.value))) OR contains(lower(trim(f.value)), lower(trim(l.text))))) b WHERE rn = 1"""
#: The rules of meaningful values, written apart from the operators.
MEANS = r"""CASE WHEN doc_type = 'aadhaar' AND field_name = 'aadhaar_number' THEN regexp_full_match(regexp_replace(value, '[\s.-]', '', 'g'), '[2-9]\d{11}')
  WHEN field_name = 'date_of_birth' AND doc_type <> 'vehicle_rc' OR field_name = 'registration_date' AND doc_type = 'vehicle_rc' THEN regexp_matches(value, '\d\d[/.-]\d\d[/.-]\d\d\d\d')
  WHEN doc_type = 'aadhaar' AND field_name = 'gender' THEN list_contains(['MALE', 'FEMALE', 'TRANSGENDER', 'पुरुष', 'महिला'], upper(value))
  WHEN doc_type = 'aadhaar' AND field_name = 'pin_code' THEN length(trim(value)) = 6 AND TRY_CAST(trim(value) AS INT) BETWEEN 0 AND 999999
  WHEN doc_type = 'aadhaar' AND field_name = 'vid' THEN regexp_full_match(regexp_replace(value, '\s', '', 'g'), '\d{16}')
  WHEN doc_type = 'aadhaar' AND field_name = 'address' THEN length(value) >= 20 AND length(regexp_replace(value, '[^\pL ,./-]', '', 'g')) / length(value) > 0.5
    AND NOT regexp_matches(upper(value), '\b(VID|MALE|FEMALE)\b|पुरुष|महिला') AND 2 * length(regexp_replace(value, '\D', '', 'g')) < length(value)
  WHEN doc_type = 'pan' AND field_name = 'pan_number' THEN regexp_full_match(upper(trim(value)), '[A-Z]{5}\d{4}[A-Z]')
  WHEN doc_type = 'vehicle_rc' AND field_name = 'registration_number' THEN regexp_full_match(upper(trim(value)), '[A-Z][A-Z]\s*\d\d?\s*[A-Z]{0,3}\s*\d{1,4}')
  WHEN doc_type = 'vehicle_rc' AND field_name IN ('engine_number', 'chassis_number') THEN length(trim(value)) > 4
  WHEN doc_type = 'vehicle_rc' AND field_name = 'fuel_type' THEN list_contains(['PETROL', 'DIESEL', 'CNG', 'LPG', 'ELECTRIC', 'HYBRID'], upper(value)) ELSE true END"""


def confidence_sql(values: str, words_: str, score: str) -> str:
    """field_confidence() by comparing every value with every word. values: doc_id, doc_type, field_name, value; score: doc_id, ocr_score."""
    return f"""SELECT doc_id, doc_type, field_name, n_words, round(ocr, 9) AS ocr, semantic, round(0.4 * ocr + 0.4 * semantic + 0.2, 9) AS confidence FROM
  (SELECT f.doc_id, f.doc_type, f.field_name, count(w.text) AS n_words, coalesce(avg(CASE WHEN w.confidence > 1 THEN w.confidence / 100 ELSE w.confidence END), max(s.ocr_score), 0) AS ocr, CAST({MEANS} AS INT) AS semantic
   FROM {values} f LEFT JOIN {score} s ON s.doc_id = f.doc_id LEFT JOIN {words_} w ON w.doc_id = f.doc_id AND trim(w.text) <> ''
     AND (contains(lower(replace(f.value, ' ', '')), lower(trim(w.text))) OR contains(lower(trim(w.text)), lower(replace(f.value, ' ', ''))))
   WHERE f.field_name <> 'signature_present' GROUP BY f.doc_id, f.doc_type, f.field_name, f.value) g"""


def _anchor_sql() -> str:
    """Every anchor against every window of as many words, all distances worked out."""
    rows = _values([(t, a, len(a.split()), " ".join(sorted(a.split())), part) for t, parts in rules.ANCHORS.items() for part, names in parts.items() for a in names])
    counts = ", ".join(f"CAST(count(*) FILTER (a.doc_type = '{t}' AND a.part = '{p}' AND hit) AS INT) AS {t}_{p}" for t in rules.TYPES for p in ("required", "optional"))
    scores = ", ".join(f"{t}_required, {t}_optional, round(least(1.0, {t}_required / {len(rules.ANCHORS[t]['required'])}::DOUBLE + least(0.2, {t}_optional * 0.05)), 9)::DOUBLE AS {t}_score" for t in rules.TYPES)
    return f"""WITH a(doc_type, anchor, n, wanted, part) AS (VALUES {rows}), c AS (SELECT doc_id, lower(full_text) AS t, string_split_regex(trim(lower(full_text)), '\\s+') AS ws FROM {fixtures.CARDS} k),
  w AS MATERIALIZED (SELECT DISTINCT doc_id, n, array_to_string(list_sort(ws[i + 1:i + n]), ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(greatest(len(ws) - n + 1, 1))) AS i FROM c, (SELECT DISTINCT n FROM a) l) x),
  s AS (SELECT w.doc_id, a.wanted, max(100.0::DOUBLE * (1 - levenshtein(win, wanted)::DOUBLE / greatest(length(win), length(wanted)))) AS sim FROM w JOIN (SELECT DISTINCT n, wanted FROM a) a ON a.n = w.n GROUP BY w.doc_id, a.wanted),
  h AS (SELECT c.doc_id, a.doc_type, a.part, contains(c.t, a.anchor) OR s.sim >= 80 AS hit FROM c JOIN s USING (doc_id) JOIN a USING (wanted))
SELECT doc_id, {scores} FROM (SELECT doc_id, {counts} FROM h a GROUP BY doc_id) z"""


_CARD_WORDS = f"card_words AS MATERIALIZED (SELECT * FROM {sql.words(fixtures.CARD_LINES)} w)"
SQL = {
    "field_confidence": f"WITH {_FIELDS}, {_CARD_WORDS} {confidence_sql('fields', 'card_words', sql.stats('card_words'))}",
    "anchor_score": _anchor_sql(),
    "consistency_rules": f"""WITH {_FIELDS}, v AS (SELECT doc_id, field_name, try_strptime(regexp_replace(value, '[.-]', '/', 'g'), '%d/%m/%Y')::DATE AS day, TRY_CAST(right(value, 4) AS INT) AS y FROM fields),
      d AS (SELECT doc_id, max(day) FILTER (field_name = 'date_of_birth') AS born, max(day) FILTER (field_name = 'registration_date') AS reg, max(day) FILTER (field_name = 'fitness_validity_date') AS fit, max(day) FILTER (field_name = 'insurance_validity_date') AS ins, max(y) FILTER (field_name = 'manufacturing_date') AS made FROM v GROUP BY doc_id)
      SELECT doc_id, born IS NULL OR (born <= DATE '{AS_OF}' AND year(DATE '{AS_OF}') - year(born) < 151) AS dob_ok, reg IS NULL OR made IS NULL OR year(reg) >= made AS registration_ok, fit IS NULL OR reg IS NULL OR NOT fit < reg AS fitness_ok, ins IS NULL OR reg IS NULL OR NOT ins < reg AS insurance_ok FROM d""",
    "extracted_fields": f"WITH {_FIELDS} SELECT * FROM fields",
    "schema_score": f"""WITH {_FIELDS}, {_DOCS}, wt(doc_type, field_name, weight) AS (VALUES {_values([(t, f, w) for t, ws in rules.FIELD_WEIGHTS.items() for f, w in ws.items()])}), rq(doc_type, field_name) AS (VALUES {_values([(t, f) for t, fs in rules.REQUIRED.items() for f in fs])}),
      s AS (SELECT d.doc_id, d.doc_type, round(sum(CASE WHEN f.value IS NOT NULL THEN weight ELSE 0 END)::DOUBLE / sum(weight)::DOUBLE, 9) AS schema_score, coalesce(string_agg(wt.field_name, ', ' ORDER BY wt.field_name) FILTER (f.value IS NULL AND weight >= {rules.CRITICAL_WEIGHT}), '') AS missing_critical
        FROM docs d JOIN wt USING (doc_type) LEFT JOIN fields f ON f.doc_id = d.doc_id AND f.field_name = wt.field_name GROUP BY ALL),
      m AS (SELECT d.doc_id, string_agg(rq.field_name, ', ' ORDER BY rq.field_name) AS missing_required FROM docs d JOIN rq USING (doc_type) LEFT JOIN fields f ON f.doc_id = d.doc_id AND f.field_name = rq.field_name WHERE f.value IS NULL GROUP BY d.doc_id)
      SELECT s.*, coalesce(m.missing_required, '') AS missing_required FROM s LEFT JOIN m USING (doc_id)""",
    "field_boxes": f"WITH {_FIELDS} {_BOXES}",
    "field_spatial_score": f"WITH {_FIELDS}, boxes AS ({_BOXES}) SELECT * FROM ({spatial_sql('boxes')}) s",
    "decision_rate": f"{_WITH} SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, doc_type, decision, count(*) AS n_docs FROM tri JOIN events ON tri.doc_id = events.event_id GROUP BY ALL",
    "pattern_score": f"""WITH {_FIELDS}, j AS (SELECT *, CASE {" ".join(f"WHEN doc_type = '{k}' AND field_name = '{f}' THEN regexp_full_match(value, {sql.quoted(p)})" for k, ps in rules.FIELD_PATTERNS.items() for f, p in ps.items())} END AS ok FROM fields)
      SELECT doc_id, doc_type, count(*) AS n_fields, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS pattern_score FROM j WHERE ok IS NOT NULL GROUP BY doc_id, doc_type""",
}
