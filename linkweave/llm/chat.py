"""Chat formatting by incremental black-box rendering.

A template is any callable render(messages, opened=None) -> str over (role, text) pairs; opened is a role whose turn
is begun but has no text yet. Successive prefixes of a conversation are rendered and consecutive outputs compared:
where the longer one continues the shorter one, what it adds is the span of the new turn; where it does not, the
template rewrites history, and the conversation is reported as such, without spans. Inside a turn's span the text is
found by rendering the same prefix with that turn opened, and with an empty text.

Defined cases: a null text or role is as an empty one; turns are ordered by turn (null first), then role, then text, so
ties and repeated rows keep one order; rows with a null conv_id make one conversation; texts are never cut; other
columns are ignored; an empty table gives an empty result. One conversation is read by one task, since a template may
look at all of it and the digests are sequential; its rows are streamed in order, one conversation at a time."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import frugal, partitions

#: Strings that chat templates use to steer a model.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: Breaks a control string after its first character; doubled where a text has it itself.
ESCAPE = "␛"
_BREAK = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_JOIN = re.compile(f"{ESCAPE}(.?)", re.S)
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def _broken(text: str) -> str:
    return _BREAK.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


#: Prefixes of a conversation are rendered again and again: short texts are remembered, 32 MB of them at most.
_remembered = functools.lru_cache(1 << 14)(_broken)


def escape(text: str) -> str:
    """text with no control string left; unescape() gives it back. One character is added for each match."""
    return _remembered(text) if len(text) <= 512 else _broken(text)


def unescape(text: str) -> str:
    return _JOIN.sub(lambda m: ESCAPE if m[1] == ESCAPE else m[1], text)


Messages = list[tuple[str, str]]


def turns_template(messages: Messages, opened: str | None = None) -> str:
    """The library's own template: <|turn|>role<|text|>text<|end|> and a line end, for each turn."""
    out = "".join(f"<|turn|>{escape(role)}<|text|>{escape(text)}<|end|>\n" for role, text in messages)
    return out if opened is None else f"{out}<|turn|>{escape(opened)}<|text|>"


def parse(formatted: str) -> Messages:
    """The turns of turns_template()'s output."""
    return [(unescape(a), unescape(b)) for a, b in _TURNS.findall(formatted)]


@dataclass
class Rendered:
    text: str
    rewrites: bool
    #: For each turn: where its span begins and ends, and where its text does.
    spans: list[tuple[int, int, int, int]]


def render(messages: Messages, template: Callable[..., str] = turns_template) -> Rendered:
    before, spans = template([]), []
    for k, (role, text) in enumerate(messages):
        now = template(messages[: k + 1])
        if not now.startswith(before):
            return Rendered(template(messages), True, [])
        opened, empty = template(messages[:k], role), template([*messages[:k], (role, "")])
        if not (opened.startswith(before) and empty.startswith(opened) and now.startswith(opened) and now.endswith(empty[len(opened) :])):
            # the text's place can't be told apart; only the turn's span is known
            spans.append((len(before), len(now), -1, -1))
        else:
            spans.append((len(before), len(now), len(opened), len(now) - (len(empty) - len(opened))))
        before = now
    return Rendered(before, False, spans)


def loss_spans(messages: Messages, rendered: Rendered, role: str = "assistant") -> list[tuple[int, int]]:
    """Half-open ranges of the output that are trained on: the texts of the role's turns."""
    return [(a, b) for (_, _, a, b), (r, _) in zip(rendered.spans, messages, strict=True) if r == role and a >= 0] if rendered.spans else []


FORMATTED = "conv_id long, formatted string, rewrites_history boolean, turn_spans array<struct<start:int,end:int,text_start:int,text_end:int>>, loss_spans array<struct<start:int,end:int>>"


def format_conversations(turns: DataFrame, template: Callable[..., str] = turns_template, trained: str = "assistant") -> DataFrame:
    """FORMATTED for each conversation; positions count code points of formatted."""
    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("rewrites_history", pa.bool_()), ("turn_spans", pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "text_start", "text_end")]))), ("loss_spans", pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end")])))])
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        def close(conv: int | None, messages: Messages) -> None:
            done = render(messages, template)
            spans = [dict(zip(("start", "end", "text_start", "text_end"), x, strict=True)) for x in done.spans]
            rows.append((conv, done.text, done.rewrites, spans, [{"start": a, "end": b} for a, b in loss_spans(messages, done, trained)]))

        conv, messages, begun = None, [], False
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if begun and c != conv:
                    close(conv, messages)
                    size += len(rows[-1][1])
                    messages = []
                    if size > 4_000_000 or len(rows) > 5000:
                        yield flush()
                        rows, size = [], 0
                conv, begun = c, True
                messages.append((role, text))
        if begun:
            close(conv, messages)
        if rows:
            yield flush()

    return ordered.mapInArrow(frugal(of), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def digests(formatted: DataFrame) -> DataFrame:
    """What the outputs of turns_template say, read back from them alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, rewrites, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                messages = parse(text)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
                whole = "".join(f"{a}\n{b}\n" for a, b in messages)
                rows.append((conv, len(messages), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), rewrites))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"])

    return formatted.select("conv_id", "formatted", "rewrites_history", "loss_spans").mapInArrow(frugal(of), DIGEST)


#: The same by SQL, for conversations and conversation -7.
ORACLE = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(role) + length(text) + 24
    + len(regexp_extract_all(role, '␛|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|(?:turn|text|end|im_start|im_end|endoftext)\|>'))
    + len(regexp_extract_all(text, '␛|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|(?:turn|text|end|im_start|im_end|endoftext)\|>')) AS chars FROM every)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, false AS rewrites_history
FROM sized GROUP BY conv_id
"""
