"""Fields of identity-card texts: per document type one projection of native expressions, then the long table `fields`.

Each function returns SQL text per field for a dialect; t is the text, l the
array of its lines (trimmed, without empty ones), w the array of its words.
An absent value is null. The label patterns are fixed values: they, and the
order of their alternatives, equal those that results are compared with.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersluice.functions.dialect import SPARK, Dialect
from papersluice.sources import rules

DATE = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}"
FULL_DATE = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}"
MAX_YEAR = 2024


def collapsed(d: Dialect, t: str) -> str:
    return f"trim({d.sub(t, r'\s+', ' ')})"


def plausible(d: Dialect, t: str, least: int = 1900) -> str:
    p = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{1,4})$"
    n = lambda i: f"TRY_CAST(regexp_extract({t}, {d.lit(p)}, {i}) AS INT)"
    year = f"(CASE WHEN length(regexp_extract({t}, {d.lit(p)}, 3)) = 2 THEN (CASE WHEN {n(3)} > 50 THEN 1900 ELSE 2000 END) + {n(3)} ELSE {n(3)} END)"
    return f"({d.like(t, p)} AND {n(1)} BETWEEN 1 AND 31 AND {n(2)} BETWEEN 1 AND 12 AND {year} BETWEEN {least} AND {MAX_YEAR})"


def if_plausible(d: Dialect, t: str, least: int = 1900) -> str:
    return f"(CASE WHEN {plausible(d, t, least)} THEN {t} END)"


def _none_of(t: str, parts: list[str]) -> str:
    return "NOT (" + " OR ".join(f"contains(lower({t}), '{p}')" for p in parts) + ")"


def name_aadhaar(d: Dialect, t: str) -> str:
    bare = f"replace({t}, '.', '')"
    return f"({_none_of(t, rules.NOT_NAMES['aadhaar'])} AND length({t}) >= 3 AND {d.like(bare, r'^[\pL\s]*$')} AND {d.like(t, r'\S')} AND NOT ({d.like(f'trim({t})', r'^\S*$')} AND length(trim({bare})) < 2))"


def name_pan(d: Dialect, t: str) -> str:
    return f"({_none_of(t, rules.NOT_NAMES['pan'])} AND {d.like(f'trim({t})', r'^\pL{2,}(\s+\pL{2,})+$')} AND length({t}) <= 50)"


def name_rc(d: Dialect, t: str) -> str:
    return f"({_none_of(t, rules.NOT_NAMES['vehicle_rc'])} AND {d.like(f'trim({t})', r'^\pL{2,}(\s+\pL{2,})+$')})"


def arabic(t: str) -> str:
    """Devanagari digits as Arabic ones."""
    return f"translate({t}, '०१२३४५६७८९', '0123456789')"


def is_aadhaar(d: Dialect, t: str) -> str:
    return d.like(arabic(t), "^[2-9][0-9]{11}$")


def is_pan(d: Dialect, t: str) -> str:
    return d.like(t, "^[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]$")


def is_registration(d: Dialect, t: str) -> str:
    return f"({d.like(t, '^[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}$')} AND substring({t}, 1, 2) IN ({', '.join(repr(c) for c in rules.STATE_CODES)}) AND substring({t}, 3, 2) <> '00')"


def repaired_pan(d: Dialect, t: str) -> str:
    head, mid, last = f"translate(substring({t}, 1, 5), '015826', 'OISBZG')", f"translate(substring({t}, 6, 4), 'OQDILSBZA', '000115824')", f"translate(substring({t}, 10, 1), '015826', 'OISBZG')"
    return f"(CASE WHEN length({t}) = 10 AND {d.like(head, r'^\pL{5}$')} AND {d.like(mid, '^[0-9]{4}$')} THEN concat({head}, {mid}, {last}) END)"


def formatted_registration(d: Dialect, t: str) -> str:
    clean = d.sub(f"upper({t})", r"[\s-]+", "")
    p = "^(.{2})(.{2})([A-Z]*)(.*)$"
    return "concat(" + ", '-', ".join(f"regexp_extract({clean}, {d.lit(p)}, {i})" for i in (1, 2, 3, 4)) + ")"


def squeezed(d: Dialect, t: str) -> str:
    return d.sub(d.sub(d.sub(t, " {2,}", " "), r"\n+", "\n"), r"^\s+|\s+$", "")


def _valid(d: Dialect, candidates: str, test) -> str:
    return d.head(d.keep(candidates, lambda x: test(d, x)))


def aadhaar(d: Dialect, t: str, l: str, w: str) -> dict[str, str]:  # noqa: E741
    strip = lambda x: d.sub(x, r"[\s.-]+", "")
    fours = d.keep(d.map(w, lambda x: d.sub(arabic(x), "[^0-9]", "")), lambda x: f"length({x}) = 4")
    runs = d.map(d.range("0", f"{d.size(fours)} - 2"), lambda i: f"concat({d.at(fours, i)}, {d.at(fours, f'{i} + 1')}, {d.at(fours, f'{i} + 2')})", "i")
    near = strip(d.first(t, r"(?is)(?:aadhaar|आधार).*?([0-9]{4}[\s.-]*[0-9]{4}[\s.-]*[0-9]{4})"))
    number = f"""coalesce({_valid(d, d.map(d.all(t, r'\b([0-9]{4}[\s.-]+[0-9]{4}[\s.-]+[0-9]{4})\b'), strip), is_aadhaar)},
      {_valid(d, d.all(t, r'\b([0-9]{12})\b'), is_aadhaar)}, {_valid(d, runs, is_aadhaar)}, CASE WHEN {is_aadhaar(d, near)} THEN {near} END)"""
    clean = lambda x: collapsed(d, d.sub(x, "[@:.,]", " "))
    camel = lambda x: collapsed(d, d.sub(x, "([a-z])([A-Z])", r"\1 \2" if d.duck else "$1 $2"))
    named = lambda x: d.struct(c=camel(x), ok=f"coalesce({name_aadhaar(d, camel(x))}, false)", more=_none_of(x, ["dob", "address", "pata", "birth", "gender"]))
    shown = d.map(d.slice(l, "1", 5), named)
    four = d.map(d.range("0", f"least({d.size(l)} - 1, 4)"), lambda i: d.struct(a=d.at(shown, i), b=d.at(shown, f"{i} + 1")), "i")
    hit = d.map(d.keep(four, lambda x: f"{x}.a.ok"), lambda x: f"CASE WHEN coalesce({x}.b.ok AND {x}.b.more, false) THEN concat({x}.a.c, ' ', {x}.b.c) ELSE {x}.a.c END")
    by_line = d.head(hit)
    name = f"""coalesce({_valid(d, d.map(d.all(t, r'(?i)(?:name|नाम|नामा|नाभ)\s*[:.-]?\s*([A-Za-z \t]{3,50})'), clean), name_aadhaar)}, {by_line},
      {_valid(d, d.map(d.all(t, r'([A-Z][A-Za-z]{2,}(?:[ \t@:.,]+[A-Z][A-Za-z]+)*)'), clean), name_aadhaar)})"""
    label = r"(?i)(?:dob|d0b|date\s+of\s+birth|जन्म\s+तिथि|dop)[/\s\w]*\s*[:.-]?\s*"
    a = arabic(t)
    eight = d.first(a, label + r"([0-9]{8})")
    dob = f"coalesce({if_plausible(d, d.first(a, label + f'({DATE})'))}, {if_plausible(d, f'''concat(substring({eight}, 1, 2), '/', substring({eight}, 3, 2), '/', substring({eight}, 5))''')}, {if_plausible(d, d.first(a, f'({FULL_DATE})'))})"
    word = lambda k: d.like(t, rf"(?i)\b{k}\b")
    gender = f"CASE WHEN {word('MALE')} THEN 'Male' WHEN {word('FEMALE')} THEN 'Female' WHEN {word('TRANSGENDER')} THEN 'Other' WHEN contains({t}, 'पुरुष') THEN 'Male' WHEN contains({t}, 'महिला') THEN 'Female' END"
    after_label = d.first(t, r"(?is)(?:address|पता)\s*:?\s*(.{20,200})")
    not_address = r"(?i)\b(VID|MALE|FEMALE|TRANSGENDER|aadhaar)\b|आधार|पुरुष|महिला|[0-9]{4}\s*[0-9]{4}\s*[0-9]{4}|[0-9]{16}"
    half = d.map(d.range(f"CAST(floor({d.size(l)} / 2) AS INT)", d.size(l)), lambda i: d.at(l, i), "i")
    lower_lines = d.keep(half, lambda x: f"(length({x}) > 10 AND NOT {d.like(x, '^[0-9]+$')} AND NOT {d.like(x, not_address)})")
    address = f"coalesce(substring({collapsed(d, after_label)}, 1, 200), CASE WHEN {d.size(l)} > 5 THEN nullif({d.join(d.slice(lower_lines, '0', 3), ' ')}, '') END)"
    return {
        "aadhaar_number": number,
        "vid": d.sub(d.first(t, r"(?is)(?:vid|virtual\s+id).*?([0-9]{4}\s*[0-9]{4}\s*[0-9]{4}\s*[0-9]{4})"), r"\s+", ""),
        "name": name,
        "date_of_birth": dob,
        "gender": gender,
        "address": address,
        "pin_code": d.head(d.keep(d.all(a, r"\b([0-9]{6})\b"), lambda x: f"substring({x}, 1, 1) <> '0'")),
        "enrollment_id": d.first(a, r"\b([0-9]{4}/[0-9]{5}/[0-9]{5})\b"),
    }


def pan(d: Dialect, t: str, l: str, w: str) -> dict[str, str]:  # noqa: E741
    up = f"upper({t})"
    strict = d.distinct(d.keep(d.all(up, r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), lambda x: is_pan(d, x)))
    tokens = d.all(up, r"([^\s.,:;-]+)")
    pairs = d.map(d.range("0", f"{d.size(w)} - 1"), lambda i: d.sub(f"upper(concat({d.at(w, i)}, {d.at(w, f'{i} + 1')}))", "[^A-Z0-9]", ""), "i")
    tens = d.keep(d.concat_lists(tokens, pairs), lambda x: f"length({x}) = 10")
    fixed = lambda a: d.head(d.keep(d.map(a, lambda x: repaired_pan(d, x)), lambda x: f"({x} IS NOT NULL AND {is_pan(d, x)})"))
    loose = d.all(up, r"([A-Z]{5}[0-9IOZS]{4}[A-Z0-9])")
    number = f"CASE WHEN {d.size(strict)} > 1 THEN NULL WHEN {d.size(strict)} = 1 THEN {d.head(strict)} ELSE coalesce({fixed(tens)}, {fixed(loose)}) END"
    if_name = lambda x: f"(CASE WHEN {name_pan(d, x)} THEN {x} END)"
    caps = d.head(d.keep(l, lambda x: f"({d.like(x, r'^[A-Z][A-Z\s]{5,}$')} AND {name_pan(d, x)})"))
    name = f"""coalesce({if_name(collapsed(d, d.first(t, r'(?:name|नाम)\s*:?\s*([A-Z][A-Z\s]{3,50})')))}, {if_name(collapsed(d, d.first(t, r'([A-Z][A-Z\s]+(?:[A-Z][A-Z\s]+)+)')))},
      CASE WHEN {d.size(l)} > 2 THEN {caps} END)"""
    return {
        "pan_number": number,
        "name": name,
        "father_name": if_name(collapsed(d, d.first(t, r"(?i)(?:father'?s?\s+name|पिता का नाम)\s*:?\s*([A-Z][A-Z\s]{3,50})"))),
        "date_of_birth": f"coalesce({if_plausible(d, d.first(t, rf'(?i)(?:dob|date\s+of\s+birth|जन्म\s+तिथि)\s*:?\s*({DATE})'))}, {if_plausible(d, d.first(t, f'({FULL_DATE})'))})",
        "signature_present": f"CASE WHEN {d.like(t, '(?i)(?:signature|sign|hastakshar|हस्ताक्षर)')} THEN 'true' END",
    }


def vehicle_rc(d: Dialect, t: str, l: str, w: str) -> dict[str, str]:  # noqa: E741
    n = squeezed(d, t)
    bare = lambda x: d.sub(f"upper({x})", r"[\s-]+", "")
    labelled = d.map(d.all(n, r"(?i)(?:reg(?:istration)?|regn)\.?\s*(?:no|number|#)?[:\s.-]*([A-Z]{2}[\s-]*[0-9]{2}[\s-]*[A-Z]{1,2}[\s-]*[0-9]{4})"), bare)
    spaced = d.map(d.all(n, r"\b([A-Z]{2}\s*-?\s*[0-9]{2}\s*-?\s*[A-Z]{1,2}\s*-?\s*[0-9]{4})\b"), bare)
    run = d.all(n, r"\b([A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4})\b")
    apart = f"CASE WHEN {d.like(n, r'[A-Z]\s+[A-Z]\s+[0-9]\s+[0-9]\s+[A-Z](?:\s+[A-Z])?\s+[0-9]\s+[0-9]\s+[0-9]\s+[0-9]')} THEN {d.sub(d.first(n, r'([A-Z](?:\s+[A-Z0-9]){8,12})'), r'\s+', '')} END"
    every = d.distinct(d.map(d.keep(d.concat_lists(labelled, spaced, run, d.array(apart)), lambda x: f"coalesce({is_registration(d, x)}, false)"), lambda x: formatted_registration(d, x)))
    if_name = lambda x: f"(CASE WHEN {name_rc(d, x)} THEN {x} END)"
    upper_if = lambda x, test: f"(CASE WHEN {test(x)} THEN upper({x}) END)"
    make = lambda p: upper_if(d.sub(collapsed(d, d.first(n, p)), r"[:\s.-]+$", ""), lambda x: f"(length({x}) >= 3 AND {d.like(x, '[A-Za-z]')})")
    chain = lambda ps, f: "coalesce(" + ", ".join(f(p) for p in ps) + ")"
    value = lambda p: f"upper({d.first(n, p)})"
    generic = lambda kws, p: d.first(t, rf"(?i)(?:{'|'.join(kws)})\s*[:.-]?\s*{p}")
    fuel = f"upper({d.first(t, r'(?i)(?:fuel|propulsion)\s*:?\s*([A-Za-z]+)')})"
    known_fuel = " OR ".join(f"contains({fuel}, '{f}')" for f in rules.FUELS)
    fuel_words = "CASE " + " ".join(f"WHEN {d.like(f'upper({t})', rf'\b{f}\b')} THEN '{f}'" for f in rules.FUELS) + " END"
    kind = f"upper({d.first(t, r'(?i)(?:vehicle\s+class|class)\s*:?\s*([A-Z-]{2,10})')})"
    kinds = "CASE " + " ".join(f"WHEN {d.like(f'upper({t})', rf'\b{c}\b')} THEN '{c}'" for c in rules.VEHICLE_CLASSES) + " END"
    hyp = lambda p: upper_if(d.sub(f"trim({d.sub(d.first(n, p), r'(?is)(insurance|fitness|owner|validity).*$', '')})", r"[:\s.,&-]+$", ""), lambda x: f"(length({x}) > 3 AND {d.like(x, '[A-Za-z]')})")
    until = lambda p: d.sub(d.first(t, rf"(?i)(?:{p})\s*(?:valid|upto)?\s*[:.-]?\s*([0-9]{{2}}[/.-][0-9]{{2}}[/.-][0-9]{{4}})"), "[.-]", "/")
    bank = r"([A-Z0-9\s.,&]{3,80})"
    owner = [r"(?i)(?:owner|owner'?s?\s+name|registered\s+owner)\s*:?\s*([A-Z][A-Za-z\s]{3,50})", r"(?i)(?:name|नाम)\s*:?\s*([A-Z][A-Za-z\s]{3,50})"]
    return {
        "registration_number": f"CASE WHEN {d.size(every)} = 1 THEN {d.head(every)} END",
        "owner_name": chain(owner, lambda p: if_name(collapsed(d, d.first(t, p)))),
        "vehicle_make_model": chain([rf"(?i){k}[:\s.-]*([A-Za-z0-9\s]{{3,50}})" for k in ("(?:make|maker|manufacturer)", "(?:model)", "(?:M/M|MV|make/model)", "(?:vehicle.*?model)")], make),
        "engine_number": chain([r"(?i)(?:engine\s+(?:no|number)|e\s*no|eng\s*no)[:\s.-]*([A-Z0-9]{6,25})", r"(?i)engine[:\s.-]*([A-Z0-9]{6,25})", r"(?i)\bE\s*(?:NO)?[:\s.-]+([A-Z0-9]{6,25})"], value),
        "chassis_number": chain([r"(?i)(?:chassis\s+(?:no|number)|c\s*no|vin|ch\s*no)[:\s.-]*([A-Z0-9]{10,25})", r"(?i)(?:chassis|vin)[:\s.-]*([A-Z0-9]{10,25})", r"(?i)\bC\s*(?:NO)?[:\s.-]+([A-Z0-9]{10,25})", r"(?i)(?:ch\.?\s*no\.?)[:\s.-]*([A-Z0-9]{10,25})"], value),
        "registration_date": f"coalesce({if_plausible(d, d.first(t, rf'(?i)(?:registration\s+date|reg\s*date|date\s+of\s+registration)\s*:?\s*({DATE})'), 1950)}, {if_plausible(d, d.first(t, f'({FULL_DATE})'), 1950)})",
        "vehicle_class": f"coalesce(CASE WHEN {kind} IN ({', '.join(repr(c) for c in rules.VEHICLE_CLASSES)}) THEN {kind} END, {kinds})",
        "fuel_type": f"coalesce(CASE WHEN {known_fuel} THEN {fuel} END, {fuel_words})",
        "seating_capacity": d.first(t, r"(?i)(?:seating|cap|seat)\s*(?:cap)?\s*[:.]?\s*([0-9]{1,2})"),
        "wheelbase": generic(["wheel", "base", "wb"], "([0-9]{4})"),
        "unladen_weight": generic(["unladen", "ulw", "wt"], "([0-9]{3,5})"),
        "vehicle_color": generic(["colour", "color"], "([A-Z]{3,10})"),
        "hypothecation": chain([rf"(?i)(?:hypothecation|hypothecated|financed)[:\s.-]*(?:to|by|with)?\s*{bank}", rf"(?i)(?:hpa|hp|fin)[:\s.-]*(?:to|by|with)?\s*{bank}", rf"(?i)(?:financier)[:\s.-]*{bank}"], hyp),
        "fitness_validity_date": until("fitness|fit"),
        "insurance_validity_date": until("insurance|ins"),
        "manufacturing_date": d.first(t, r"(?i)(?:mfg|manufacturing)\s*(?:date)?\s*[:.-]?\s*([0-9]{2}[/.-][0-9]{4}|[0-9]{4})"),
    }


EXTRACTORS = {"aadhaar": aadhaar, "pan": pan, "vehicle_rc": vehicle_rc}
#: Fields that are also stored under another name.
ALIASES = {"pan": {"id_number": "pan_number"}, "vehicle_rc": {"name": "owner_name"}, "aadhaar": {}}


def line_array(d: Dialect, t: str) -> str:
    return d.keep(d.map(d.split(t, r"'\n'" if not d.duck else "chr(10)"), lambda x: f"trim({x})"), lambda x: f"{x} <> ''")


def word_array(d: Dialect, t: str) -> str:
    return d.keep(d.split(collapsed(d, t), "' '"), lambda x: f"{x} <> ''")


def wide(docs: DataFrame, kind: str, text: str = "full_text", lines: str | None = None) -> DataFrame:
    """docs with a column for each field of the type; lines: a column of lines, else the text's own. Forms of the text that many expressions begin with are columns, worked out once a row."""
    base = docs.withColumns({"_t": F.coalesce(F.col(text), F.lit("")), "_l": F.coalesce(F.col(lines), F.array().cast("array<string>")) if lines else F.expr(line_array(SPARK, f"coalesce({text}, '')")), "_w": F.expr(word_array(SPARK, f"coalesce({text}, '')"))})
    forms = {"_n": squeezed(SPARK, "_t"), "_a": arabic("_t"), "_u": "upper(_t)"}
    found = {k: reduce(lambda s, f: s.replace(forms[f], f), forms, v) for k, v in EXTRACTORS[kind](SPARK, "_t", "_l", "_w").items()}
    base = base.withColumns({f: F.expr(v) for f, v in forms.items() if any(re.search(rf"\b{f}\b", x) for x in found.values())})
    return base.select(*docs.columns, *[F.expr(v).alias(k) for k, v in found.items()])


def wide_sql(d: Dialect, source: str, kind: str, keep: str = "doc_id", text: str = "full_text") -> str:
    fields = ", ".join(f"{v} AS {k}" for k, v in EXTRACTORS[kind](d, "_t", "_l", "_w").items())
    return f"(SELECT {keep}, {fields} FROM (SELECT *, coalesce({text}, '') AS _t, {line_array(d, f'''coalesce({text}, '')''')} AS _l, {word_array(d, f'''coalesce({text}, '')''')} AS _w FROM {source} e0) e1)"


def fields_of(docs: DataFrame, kind: str, text: str = "full_text") -> DataFrame:
    """The long table of one type: doc_id, doc_type, field_name, value; absent fields have no row."""
    w = wide(docs.select("doc_id", text), kind, text)
    names = list(EXTRACTORS[kind](SPARK, "_t", "_l", "_w"))
    pairs = [(n, n) for n in names] + list(ALIASES[kind].items())
    each = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(c).alias("value")) for n, c in pairs])
    return w.select("doc_id", F.lit(kind).alias("doc_type"), F.inline(each)).where("value IS NOT NULL")


def extract_fields(classified: DataFrame, text: str = "full_text") -> DataFrame:
    """fields of documents with a doc_type: one projection per type over its own documents."""
    parts = [fields_of(classified.where(F.col("doc_type") == k), k, text) for k in EXTRACTORS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
