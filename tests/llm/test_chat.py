from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from linkweave.llm import chat
from tests.llm.conftest import table

PIECES = st.lists(st.sampled_from([*chat.CONTROL, chat.ESCAPE, "<", "[", "/INST]", "|", "a", "\n", " ", "é", "n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>"]), PIECES), max_size=5))
def test_round_trip_and_spans(messages):
    done = chat.render(messages)
    assert not done.rewrites and chat.parse(done.text) == messages
    assert [done.text[c:d] for _, _, c, d in done.spans] == [chat.escape(t) for _, t in messages]
    assert "".join(done.text[a:b] for a, b, *_ in done.spans) == done.text
    assert [chat.unescape(done.text[a:b]) for a, b in chat.loss_spans(messages, done)] == [t for r, t in messages if r == "assistant"]


def test_templates_that_rewrite_history():
    def forgetful(messages, opened=None):
        """Drops earlier assistants' notes in brackets."""
        kept = [(r, t if k == len(messages) - 1 else t.replace("(note)", "")) for k, (r, t) in enumerate(messages)]
        return chat.turns_template(kept, opened)

    plain, noted = [("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a"), ("assistant", "(note)b"), ("user", "c")]
    assert not chat.render(plain, forgetful).rewrites
    done = chat.render(noted, forgetful)
    assert done.rewrites and done.spans == [] and chat.loss_spans(noted, done) == []


def test_template_with_an_end_of_text_only_after_assistants():
    def other(messages, opened=None):
        out = "".join(f"[{r}] {t}" + ("</s>" if r == "assistant" else "\n") for r, t in messages)
        return out if opened is None else out + f"[{opened}] "

    messages = [("user", "hi"), ("assistant", "yo"), ("user", ""), ("assistant", "[user]")]
    done = chat.render(messages, other)
    assert [done.text[a:b] for a, b in chat.loss_spans(messages, done)] == ["yo", "[user]"]


def test_query_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "assistant", "tie"), (2, None, "system", "first"), (3, 0, None, "x"), (3, 0, None, "x"), (None, 0, "user", "no id"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (4, 0, "assistant", "long " * 40_000)]
    turns = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert len(got) == 6
    for conv, r in got.items():
        mine = sorted(((t is not None, t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in mine)
        loss = "".join(text for *_, role, text in mine if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.turns_template([(a, b) for *_, a, b in mine])) and not r["rewrites_history"]
    assert table(chat.digests(chat.format_conversations(turns.where("false")))) == []


def test_conversation_of_many_turns(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} </s>") for k in range(3000)]
    got = chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()[0]
    assert got["n_turns"] == 3000 and got["loss_chars"] == sum(len(r[3]) for r in rows if r[2] == "assistant") and not got["rewrites_history"]
