"""Operator 5: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. It is
rendered for each prefix of the turns; where an output begins with the one
before, the rest is the new turn's span. Two probes in place of the turn's text
show where in its span the text stands. A template whose output for a longer
prefix does not begin with the shorter one's rewrites history; such
conversations are marked and have no spans from that turn on.

Rendering every prefix takes a conversation's length times its turns. Where
that exceeds PREFIX_CHARS (one conversation of thousands of turns), a template
that can say how one more turn changes its output (`extend`) is rendered step
by step; that the steps are right is proved by comparing their outcome with the
rendering of the whole conversation, and where they aren't, or the template has
no steps, prefixes are rendered all the same. Both ways give the same spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm.text import whole
from papersluice.session import read_table

Turns = list[tuple[str, str]]
#: From the length of the output so far and a turn: how much of the output stays, and what follows it.
Extend = Callable[[int, tuple[str, str]], tuple[int, str]]
#: Control strings of the template below.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>")
PROBES = ("\ue000", "\ue001")
#: Most characters that a conversation's prefixes may have together before steps are tried.
PREFIX_CHARS = 20_000_000
SPAN = "struct<turn:int,role:string,start:int,end:int,text_start:int,text_end:int>"


def escape(text: str) -> str:
    """No control string stays, and unescape() undoes it."""
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def instruct_turn(role: str, text: str) -> str:
    if role == "assistant":
        return f"<s>{escape(text)}</s>"
    return "[INST]" + escape(role).replace("\n", "\\\n") + f"\n{escape(text)}[/INST]"


def instruct_template(turns: Turns) -> str:
    """Assistant turns between <s> and </s>; other turns between [INST] and [/INST], role first. Roles are escaped too, with their line ends."""
    return "".join(instruct_turn(role, text) for role, text in turns)


def instruct_extend(length: int, turn: tuple[str, str]) -> tuple[int, str]:
    return length, instruct_turn(*turn)


def read_instruct(formatted: str) -> Turns:
    """The turns back from instruct_template()'s output."""
    found = re.finditer(r"<s>(.*?)</s>|\[INST\]((?:\\.|[^\\\n])*)\n(.*?)\[/INST\]", formatted, flags=re.DOTALL)
    return [("assistant", unescape(m[1])) if m[1] is not None else (unescape(m[2]), unescape(m[3])) for m in found]


Span = tuple[int, int, int | None, int | None]


def _text_span(start: int, end: int, one: str, two: str) -> Span:
    """The span of a turn that ends at `end`, and of its text, from the spans of two probes in its place."""
    at = next((i for i in range(min(len(one), len(two))) if one[i] != two[i]), None)
    if at is None or one[at] != PROBES[0] or one[at + 1 :] != two[at + 1 :]:
        return start, end, None, None
    last = end - (len(one) - at - 1)
    return (start, end, start + at, last) if last >= start + at else (start, end, None, None)


def spans_by_step(turns: Turns, template: Callable[[Turns], str], extend: Extend) -> tuple[str, list[Span], bool] | None:
    """turn_spans() by steps; None where the steps and the whole rendering differ."""
    done, length, spans, rewrites = [template([])], len(template([])), [], False
    for role, text in turns:
        stays, added = extend(length, (role, text))
        if stays < length or rewrites:
            rewrites = True
            whole_text = "".join(done)[:stays]
            done, length = [whole_text, added], len(whole_text) + len(added)
            continue
        one, two = (extend(length, (role, p))[1] for p in PROBES)
        spans.append(_text_span(length, length + len(added), one, two))
        done.append(added)
        length += len(added)
    out = "".join(done)
    return (out, spans, rewrites) if out == template(turns) else None


def turn_spans(turns: Turns, template: Callable[[Turns], str], extend: Extend | None = None, most: int | None = None) -> tuple[str, list[Span], bool]:
    """Output for all turns; per turn its start and end and those of its text; whether the template rewrote history.

    extend is used only where the prefixes have over `most` characters.

    The start and end of a text are None where the template doesn't show the
    probe once in the turn's own span.
    """
    size = len(turns) * sum(len(role) + len(text) for role, text in turns) / 2
    if extend and size > (PREFIX_CHARS if most is None else most) and (found := spans_by_step(turns, template, extend)):
        return found
    before, spans = template([]), []
    for k, (role, _) in enumerate(turns):
        after = template(turns[: k + 1])
        if not after.startswith(before):
            return template(turns), spans, True
        one, two = (template([*turns[:k], (role, p)]) for p in PROBES)
        both = one.startswith(before) and two.startswith(before)
        spans.append(_text_span(len(before), len(after), one[len(before) :], two[len(before) :]) if both else (len(before), len(after), None, None))
        before = after
    return before, spans, False


def _formatted(rows: Iterator[pd.DataFrame], template: Callable[[Turns], str], extend: Extend | None) -> Iterator[pd.DataFrame]:
    for batch in rows:
        out = {"conv_id": [], "formatted": [], "spans": [], "rewrites": []}
        for conv, turns in zip(batch["conv_id"], batch["turns"], strict=True):
            pairs = [(t["role"], t["text"]) for t in turns]
            text, spans, rewrites = turn_spans(pairs, template, extend)
            out["conv_id"].append(conv)
            out["formatted"].append(text)
            out["spans"].append([{"turn": k, "role": pairs[k][0], "start": a, "end": b, "text_start": c, "text_end": d} for k, (a, b, c, d) in enumerate(spans)])
            out["rewrites"].append(rewrites)
        yield pd.DataFrame(out).astype({"conv_id": batch["conv_id"].dtype})


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = instruct_template, extend: Extend | None = instruct_extend) -> DataFrame:
    """Per conversation: conv_id, formatted, spans (turns and texts, in code points), rewrites.

    rows: conv_id, turn, role, text; other columns don't matter, whatever their
    names. Turns go by turn (null first), ties by role and text; repeated rows
    are turns each; null roles and texts are empty; a null conv_id is one
    conversation. A conversation is one row of the result, so it has to fit
    into one: memory follows the longest conversation, time its length times
    its turns, or beyond PREFIX_CHARS its length (for a template without
    `extend`, which must be given as None then, still times its turns). An
    empty table gives an empty result.
    """
    turn = F.struct(F.col("turn"), whole("role").alias("role"), whole("text").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    kind = dict(rows.dtypes)["conv_id"]
    return grouped.mapInPandas(lambda b: _formatted(b, template, extend), f"conv_id {kind}, formatted string, spans array<{SPAN}>, rewrites boolean")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _read_back(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        out = []
        for conv, text, spans in zip(batch["conv_id"], batch["formatted"], batch["spans"], strict=True):
            turns = read_instruct(text)
            loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
            out.append((conv, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text)))
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op5_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from their output; nulls and ties as in format_conversations()."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    done = format_conversations(rows.unionByName(more))
    return done.mapInPandas(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _escaped(text: str) -> str:
    out = rf"replace({text}, '\', '\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("text")}) + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(replace({_escaped("role")}, chr(10), chr(92) || chr(10))) END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
