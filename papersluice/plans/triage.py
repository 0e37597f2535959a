"""Full triage: from a document's recognised lines to a typed, scored and explained decision.

Everything about one document is computed from its own row (arrays of lines
and words, no join, no shuffle), so the same stages run over tables and over
streams. Documents are split by type into branches, each extracting only its
own fields.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersluice.functions.dialect import SPARK, Dialect, Stage
from papersluice.operators import extract
from papersluice.operators.classify import anchor_filter
from papersluice.session import written
from papersluice.sources import rules

#: What the stages start from. Metrics may be null: the image isn't judged then.
INPUT = "doc_id BIGINT, lines ARRAY<STRUCT<text STRING, confidence DOUBLE>>, blur_score DOUBLE, brightness_score DOUBLE, resolution_score DOUBLE, contrast_score DOUBLE, edge_density DOUBLE, glare_ratio DOUBLE"
#: Further columns of the input, and what they are where it has none: schemas that conflict, several documents in one image, failed business rules, compactness of the fields. plans/assess.py works them out.
FLAGS = {"conflicting_schemas": "false", "multi_document": "false", "rule_failures": "''", "spatial_score": "CAST(1 AS DOUBLE)"}
RESULT = [
    "doc_id", "doc_type", "decision", "final_score", "hard_rejection", "reasons", "fields", "image_quality_score", "ocr_confidence_score", "regex_score", "fuzzy_score", "layout_score", "kv_score",
    "consistency_score", "schema_score", "distribution_score", "spatial_score", "total_words", "mandatory_present", "quality_passed", "missing_critical",
]


#: What the branches need of the common stages.
BASE = ["doc_id", "doc_type", "full_text", "line_texts", "word_texts", "total_words", "quality_passed", "image_quality_score", "ocr_confidence_score", *FLAGS]


def quality_gate(d: Dialect) -> Stage:
    q, n = rules.QUALITY, d.number
    why = d.array(
        f"CASE WHEN blur_score < {q['min_blur_score']} THEN concat('Blur score ', {n('blur_score', 2)}, ' below threshold {q['min_blur_score']}') END",
        f"CASE WHEN brightness_score < {q['min_brightness']} OR brightness_score > {q['max_brightness']} THEN concat('Brightness ', {n('brightness_score', 2)}, ' outside range') END",
        f"CASE WHEN contrast_score < {q['min_contrast_ratio']} THEN concat('Contrast ratio ', {n('contrast_score', 2)}, ' below threshold {q['min_contrast_ratio']}') END",
        f"CASE WHEN edge_density < {q['min_edge_density']} THEN concat('Edge density ', {n('edge_density', 4)}, ' below threshold {q['min_edge_density']}') END",
        f"CASE WHEN glare_ratio > {q['max_glare_ratio']} THEN concat('Glare ratio ', {n('glare_ratio * 100', 1)}, '% exceeds threshold') END",
    )
    return {"quality_reasons": d.keep(why, lambda x: f"{x} IS NOT NULL")}


def quality_parts(d: Dialect) -> Stage:
    q, dbl = rules.QUALITY, d.double
    return {
        "quality_passed": f"{d.size('quality_reasons')} = 0",
        "q_blur": f"least({dbl('1')}, blur_score / {dbl('1000')})",
        "q_brightness": f"CASE WHEN brightness_score < {q['min_brightness']} OR brightness_score > {q['max_brightness']} THEN {dbl('0')} ELSE {dbl('1')} - abs(brightness_score - {dbl('127.5')}) / {dbl('127.5')} * {dbl('0.5')} END",
        "q_resolution": f"CASE WHEN resolution_score < 307200 THEN resolution_score / {dbl('307200')} WHEN resolution_score < 2073600 THEN {dbl('0.5')} + {dbl('0.5')} * (resolution_score - {dbl('307200')}) / {dbl('1766400')} ELSE {dbl('1')} END",
        "q_contrast": f"CASE WHEN contrast_score < 0.1 THEN {dbl('0')} WHEN contrast_score < 0.5 THEN contrast_score / {dbl('0.5')} ELSE {dbl('1')} END",
        "q_glare": f"CASE WHEN glare_ratio > {q['max_glare_ratio']} THEN greatest({dbl('0')}, {dbl('1')} - glare_ratio / {dbl('0.05')}) ELSE {dbl('1')} - glare_ratio / {dbl('0.05')} * {dbl('0.5')} END",
    }


def quality_score(d: Dialect) -> Stage:
    return {"image_quality_score": "coalesce(" + " + ".join(f"{d.double(v)} * q_{k}" for k, v in rules.QUALITY_WEIGHTS.items()) + f", {d.double('1')})"}


def texts(d: Dialect) -> Stage:
    return {"full_text": f"coalesce({d.join(d.map('lines', lambda x: f'{x}.text'), chr(10) if d.duck else chr(92) + 'n')}, '')", "line_texts": d.keep(d.map("lines", lambda x: f"trim({x}.text)"), lambda x: f"{x} <> ''")}


def tokens(d: Dialect) -> Stage:
    split = lambda x: d.keep(d.split(extract.collapsed(d, f"{x}.text"), "' '"), lambda w: f"{w} <> ''", "w")
    word = lambda w, x: d.struct(text=w, c=f"{x}.confidence", **({} if d.duck else {"numeric": _numeric(d, w)}))
    return {"words": f"flatten({d.map('lines', lambda x: d.map(split(x), lambda w: word(w, x), 'w'))})"}


def _numeric(d: Dialect, t: str) -> str:
    bare = d.sub(t, r"[,.\s$€£¥]", "")
    if not d.duck:  # the same without an expression for words that have no digit
        return f"({d.like(t, '[0-9]')} AND {d.double('length(' + d.sub(t, '[^0-9]+', '') + ')')} / length({bare}) > 0.5)"
    return f"(length({bare}) > 0 AND {d.double(d.chars(bare, '0-9'))} / greatest(length({bare}), 1) > 0.5)"


def counted(d: Dialect) -> Stage:
    stop = ", ".join(f"'{s}'" for s in rules.STOPWORDS)
    numeric = lambda x: _numeric(d, f"{x}.text") if d.duck else f"{x}.numeric"
    weight = lambda x: f"CASE WHEN lower({x}.text) IN ({stop}) THEN {d.double('0.3')} WHEN {numeric(x)} THEN {d.double('1.5')} ELSE {d.double('1.0')} END"
    return {
        "word_texts": d.map("words", lambda x: f"{x}.text"),
        "total_words": d.size("words"),
        "low_words": d.size(d.keep("words", lambda x: f"{x}.c < {rules.LOW_CONFIDENCE}")),
        "numeric_words": d.size(d.keep("words", numeric)),
        "weight_sum": d.total(d.map("words", weight)),
        "weighted_sum": d.total(d.map("words", lambda x: f"{x}.c * {weight(x)}")),
    }


def recognised(d: Dialect) -> Stage:
    mean = f"(CASE WHEN weight_sum > 0 THEN weighted_sum / weight_sum ELSE {d.double('0')} END)"
    good = f"least({d.double('1')}, {mean} / {d.double('100')} + least({d.double('0.1')}, {d.double('numeric_words')} / greatest(total_words, 1) * {d.double('0.2')}))"
    return {"ocr_confidence_score": f"CASE WHEN total_words < {rules.LEAST_WORDS} OR {d.double('low_words')} / greatest(total_words, 1) > 0.4 THEN {d.double('0')} ELSE {good} END"}


def typed(d: Dialect) -> Stage:
    def score(k: str) -> str:
        quoted = lambda s: "'" + s.replace("'", "''" if d.duck else "\\'") + "'"
        words = [f"(CASE WHEN contains(lower(full_text), {quoted(w)}) THEN {rules.PHRASE_WEIGHT if ' ' in w else 1} ELSE 0 END)" for w in rules.KEYWORDS[k]]
        return " + ".join(words + [f"(CASE WHEN {d.like('full_text', f'(?i){p}')} THEN {rules.PATTERN_WEIGHT} ELSE 0 END)" for p in rules.PATTERNS[k]])

    return {f"score_{k}": score(k) for k in rules.TYPES}


def chosen(d: Dialect) -> Stage:
    best = "greatest(score_aadhaar, score_pan, score_vehicle_rc)"
    return {"doc_type": f"CASE WHEN {best} = 0 THEN 'aadhaar' WHEN score_vehicle_rc = {best} THEN 'vehicle_rc' WHEN score_pan = {best} THEN 'pan' ELSE 'aadhaar' END"}


def unsorted(d: Dialect) -> list[Stage]:
    """Stages before the type is known."""
    return [quality_gate(d), quality_parts(d), quality_score(d), texts(d), tokens(d), counted(d), recognised(d)]


def common(d: Dialect) -> list[Stage]:
    """Stages before the branches."""
    return [*unsorted(d), typed(d), chosen(d)]


def _windows(d: Dialect, n: int) -> str:
    """Every n words in a row, sorted and joined."""
    return d.map(d.range("0", f"greatest({d.size('low_texts')} - {n - 1}, 1)"), lambda i: d.join(d.sort(d.slice("low_texts", i, n)), " "), "i")


def _anchor(d: Dialect, a: str) -> str:
    """1 if the text holds the anchor or a window is similar enough; distances only of windows that share a piece with it."""
    wanted, least, most, edits, pieces = anchor_filter(a)
    distance = f"levenshtein(w, '{wanted}')" if d.duck else f"levenshtein(w, '{wanted}', {edits})"
    shares = " OR ".join(f"contains(w, '{p}')" for p in pieces) or "true"
    similar = f"{distance} >= 0 AND {d.double(100)} * (1 - {d.double(distance)} / greatest(length(w), {len(wanted)})) >= {rules.ANCHOR_THRESHOLD}"
    near = d.keep(f"win_{len(a.split())}", lambda w: f"length({w}) BETWEEN {least} AND {most} AND ({shares}) AND {similar}", "w")
    return f"CASE WHEN contains(lower(full_text), '{a}') THEN 1 WHEN {d.size(near)} > 0 THEN 1 ELSE 0 END"


#: What decide() starts from.
SCORED = [*dict.fromkeys(["doc_id", "doc_type", "fields", "special_share", "missing_critical", "mandatory_present", "total_words", "quality_passed", "rule_failures", "conflicting_schemas", "multi_document", *[c for c in RESULT if c.endswith("_score") and c != "final_score"]])]


def branch(d: Dialect, kind: str) -> list[Stage]:
    """Stages of a type's own documents."""
    return [*score_stages(d, kind), final(d), *decided(d)]


def score_stages(d: Dialect, kind: str) -> list[Stage]:
    """Stages of a type's own documents up to their scores."""
    fields = extract.EXTRACTORS[kind](d, "full_text", "line_texts", "word_texts")
    weights, required, anchors = rules.FIELD_WEIGHTS[kind], rules.REQUIRED[kind], rules.ANCHORS[kind]
    least, most, _, _ = rules.PROFILES[kind]
    lengths = sorted({len(a.split()) for names in anchors.values() for a in names})
    dbl = d.double
    has = lambda f: f"f_{f} IS NOT NULL"
    each = d.array(*[d.struct(field_name=f"'{f}'", value=f"f_{f}") for f in fields])
    missing = d.array(*[f"CASE WHEN f_{f} IS NULL THEN '{f}' END" for f, w in weights.items() if w >= rules.CRITICAL_WEIGHT])
    special = f"length(full_text) - {d.chars('full_text', '\\pL\\pN\\s' if d.duck else '\\p{L}\\p{N}\\s')}"
    scored = {
        "fields": d.keep(each, lambda x: f"{x}.value IS NOT NULL"),
        "schema_score": "(" + " + ".join(f"CASE WHEN {has(f)} THEN {dbl(w)} ELSE {dbl(0)} END" for f, w in weights.items()) + f") / {dbl(sum(weights.values()))}",
        "missing_critical": d.join(d.keep(missing, lambda x: f"{x} IS NOT NULL"), ", "),
        "required_present": " AND ".join(has(f) for f in required),
        "fuzzy_required": " + ".join(f"({_anchor(d, a)})" for a in anchors["required"]),
        "fuzzy_optional": " + ".join(f"({_anchor(d, a)})" for a in anchors["optional"]),
        "digit_share": f"CASE WHEN length(full_text) > 0 THEN {dbl(d.chars('full_text', '0-9'))} / length(full_text) ELSE {dbl(0)} END",
        "special_share": f"CASE WHEN length(full_text) > 0 THEN {dbl(special)} / length(full_text) ELSE {dbl(0)} END",
    }
    scores = {
        "regex_score": "schema_score",
        "layout_score": "ocr_confidence_score",
        "kv_score": dbl(0.5),
        "consistency_score": f"CASE WHEN required_present THEN {dbl(1)} ELSE {dbl(0.5)} END",
        "fuzzy_score": f"least({dbl(1)}, {dbl('fuzzy_required')} / {len(anchors['required'])} + least({dbl(0.2)}, fuzzy_optional * {dbl(0.05)}))",
        "distribution_score": f"""CASE WHEN length(full_text) = 0 THEN {dbl(0)} ELSE greatest({dbl(0)}, {dbl(1)} - (CASE WHEN digit_share < {least} THEN ({dbl(least)} - digit_share) / {dbl(least)} * {dbl(0.5)} ELSE {dbl(0)} END)
          - (CASE WHEN special_share > {most} THEN (special_share - {dbl(most)}) / {dbl(1 - most)} * {dbl(0.8)} ELSE {dbl(0)} END)) END""",
        "mandatory_present": "required_present AND missing_critical = ''",
    }
    return [{f"f_{f}": v for f, v in fields.items()}, {"low_texts": d.map("word_texts", lambda x: f"lower({x})")}, {f"win_{n}": _windows(d, n) for n in lengths}, scored, scores]


def final(d: Dialect) -> Stage:
    names = {"image_quality": "image_quality_score", "ocr_confidence": "ocr_confidence_score"}
    total = " + ".join(f"{d.double(w)} * {names.get(k, f'{k}_score')}" for k, w in rules.SCORE_WEIGHTS.items())
    return {"weighted_score": f"greatest({d.double(0)}, least({d.double(1)}, ({total}) / {d.double(sum(rules.SCORE_WEIGHTS.values()))}))"}


def decided(d: Dialect) -> list[Stage]:
    """The chain of rules: each arm gives a decision and appends its reasons."""
    t, dbl = rules.THRESHOLDS, d.double
    arm = f"""CASE WHEN total_words = 0 THEN 'no_text' WHEN NOT quality_passed THEN 'quality' WHEN NOT mandatory_present THEN 'mandatory' WHEN special_share > {t['max_non_alphanumeric']} THEN 'special'
      WHEN conflicting_schemas THEN 'conflict' WHEN multi_document THEN 'several' WHEN weighted_score >= {t['accept']} AND (rule_failures <> '' OR missing_critical <> '') THEN 'lowered'
      WHEN weighted_score >= {t['accept']} THEN 'accept' WHEN weighted_score >= {t['review']} THEN 'review' ELSE 'low' END"""
    notes = {
        "accept": [("image_quality_score > 0.8", "High image quality"), ("schema_score > 0.9", "Strong schema completeness"), ("regex_score > 0.9", "Strong regex matches"), ("consistency_score > 0.9", "Excellent consistency checks")],
        "review": [("image_quality_score < 0.6", "Low image quality"), ("ocr_confidence_score < 0.7", "Low OCR confidence"), ("schema_score < 0.7", "Incomplete schema"), ("regex_score < 0.7", "Weak regex matches"), ("layout_score < 0.5", "Poor layout match"), ("consistency_score < 0.7", "Consistency issues detected")],
        "low": [("image_quality_score < 0.5", "Very poor image quality"), ("ocr_confidence_score < 0.5", "Very low OCR confidence"), ("schema_score < 0.5", "Failed schema validation"), ("regex_score < 0.5", "Failed regex validation"), ("layout_score < 0.3", "Layout does not match expected template"), ("consistency_score < 0.5", "Failed consistency checks")],
    }
    shown = f"concat('Confidence score ', {d.number('weighted_score', 2)}, "
    reasons = [
        "CASE WHEN rule_failures <> '' THEN rule_failures END",
        "CASE WHEN missing_critical <> '' THEN concat('Missing critical field(s): ', missing_critical) END",
        "CASE arm WHEN 'no_text' THEN 'No text detected in image' WHEN 'quality' THEN 'Image failed quality gate' WHEN 'mandatory' THEN 'Mandatory fields are missing' WHEN 'conflict' THEN 'Conflicting document schemas detected (multiple documents in image)' WHEN 'several' THEN 'Multiple documents detected without clear best candidate' WHEN 'lowered' THEN 'Downgraded to REVIEW due to business rule failures' END",
        f"CASE WHEN arm = 'special' THEN concat('Excessive non-alphanumeric content (', {d.number('special_share * 100', 1)}, '%)') END",
        f"""CASE arm WHEN 'accept' THEN {shown}' exceeds accept threshold {t['accept']}') WHEN 'review' THEN {shown}' in review range [{t['review']}, {t['accept']})')
          WHEN 'low' THEN {shown}' below review threshold {t['review']}') END""",
        *[f"CASE WHEN arm {'IN (' + repr(a) + ', ' + repr('lowered') + ')' if a == 'accept' else '= ' + repr(a)} AND {when} THEN '{said}' END" for a, pairs in notes.items() for when, said in pairs],
    ]
    return [
        {"arm": arm},
        {
            "decision": "CASE WHEN arm = 'accept' THEN 'accept' WHEN arm IN ('review', 'several', 'lowered') THEN 'review' ELSE 'reject' END",
            "hard_rejection": "arm IN ('no_text', 'quality', 'mandatory', 'special', 'conflict')",
            "final_score": f"CASE WHEN arm = 'no_text' THEN {dbl(0)} ELSE weighted_score END",
            "reasons": d.keep(d.array(*reasons), lambda x: f"{x} IS NOT NULL"),
        },
    ]


def run_stages(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for s in stages:
        df = df.withColumns({c: F.expr(v) for c, v in s.items()})
        if any("->" in v for v in s.values()):
            df = settled(df)
    return df


def settled(df: DataFrame) -> DataFrame:
    """df behind a generator of one row: filters above don't move below it and its columns aren't computed again inside lambdas."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _branches(docs: DataFrame, stages: Callable[[str], list[Stage]], columns: list[str]) -> DataFrame:
    docs = docs.withColumns({c: F.expr(v) for c, v in FLAGS.items() if c not in docs.columns})
    base = settled(run_stages(docs, common(SPARK)))
    if not docs.isStreaming:
        base = written(base.select(*BASE), "typed")
    return reduce(DataFrame.unionByName, [run_stages(base.where(F.col("doc_type") == k), stages(k)).select(*columns) for k in rules.TYPES])


def triage(docs: DataFrame) -> DataFrame:
    """docs with the columns of INPUT, and those of FLAGS where known, to RESULT; tables or streams.

    Of a table, what all types share is written once and read by the branches.
    """
    return _branches(docs, lambda k: branch(SPARK, k), RESULT)


def scored(docs: DataFrame) -> DataFrame:
    """docs as for triage() to SCORED: types, fields and scores, before what other tables know of them and the decision."""
    return _branches(docs, lambda k: score_stages(SPARK, k), SCORED)


def decide(documents: DataFrame) -> DataFrame:
    """SCORED to RESULT."""
    return run_stages(documents, [final(SPARK), *decided(SPARK)]).select(*RESULT)


def triage_sql(d: Dialect, source: str) -> str:
    from papersluice.functions.dialect import staged

    base = staged(d, source, common(d))
    return "(" + " UNION ALL ".join(f"SELECT {', '.join(RESULT)} FROM {staged(d, f'''(SELECT * FROM base WHERE doc_type = '{k}')''', branch(d, k))} r" for k in rules.TYPES) + ")", base
