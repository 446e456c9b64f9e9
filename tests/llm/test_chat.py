import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajlake.llm import chat

LOG = "conv_id long, seq long, kind string, message long, role string, text string"
HARD = ["", "\\", "</turn>", "<turn user>\n", "\\</turn>\n<turn assistant>\n", "\\### Assistant: </turn> ok", "a<b>c</turn", "<", "\n", "é\\\\<turn "]


def folded(events):
    """Plain loops: the messages left of each conversation's events, in order."""
    logs, out = defaultdict(list), {}
    for e in events:
        if e[2] in chat.KINDS and e[1] is not None:
            logs[e[0]].append(e)
    for conv, log in logs.items():
        log.sort(key=lambda e: (e[1], chat.KINDS.index(e[2]), e[5] or ""))
        begun, text, role, gone = {}, defaultdict(str), defaultdict(str), set()
        taken = set()
        for _, seq, _, message, _, _ in log:
            begun.setdefault(message, seq)
        again = {m: max([s for _, s, k, n, _, _ in log if k == "regenerate" and n == m], default=None) for m in begun}
        for m, s in again.items():
            if s is not None:
                taken |= {x for x, at in begun.items() if begun[m] < at < s}
        for _, _, kind, message, r, t in log:
            text[message] = (text[message] if kind == "delta" else "") + (t or "")
            if kind == "delete":
                gone.add(message)
            elif kind != "delta":
                gone.discard(message)
            role[message] = r if r is not None else role[message]
        left = [(begun[m], role[m], text[m], m) for m in begun if m not in gone and m not in taken]
        out[conv] = [(r, t) for _, r, t, _ in sorted(left, key=lambda x: (x[0], x[1], x[2], -1 if x[3] is None else x[3]))]
    return {k: v for k, v in out.items() if v}


def told(turns):
    whole, spans = chat.render(turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>\\\nb", ""]), st.lists(st.sampled_from(HARD)).map("".join)), max_size=5))
def test_template_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.read(text) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_other_text_is_refused():
    for text in ("x", "<turn user>\n", chat.render([("user", "a")])[0] + "b"):
        with pytest.raises(ValueError):
            chat.read(text)


def random_log(seed, conversations=12):
    r = random.Random(seed)
    out = []
    for conv in range(conversations):
        seq = 0
        for _ in range(r.randrange(1, 40)):
            seq += r.choice([0, 1, 1, 5])
            kind = r.choice(["start", "start", "delta", "delta", "delta", "edit", "regenerate", "delete", "other"])
            role = r.choice(["user", "assistant", "system"]) if kind == "start" else None
            out.append((conv if conv else None, seq, kind, r.randrange(8), role, r.choice([*HARD, None])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "part"), [(1, 4096), (2, 3), (3, 1)])
def test_log_is_folded(spark, monkeypatch, seed, part):
    monkeypatch.setattr(chat, "PART", part)  # conversations in several parts
    events = random_log(seed)
    want = folded(events)
    parts = chat.formatted(chat.messages(spark.createDataFrame(events, LOG).withColumns({"at": F.lit("x"), "events": F.lit(1)}).repartition(3)))
    rows = {r.conv_id: tuple(r)[1:] for r in chat.digests(parts).collect()}
    assert rows == {k: told(v) for k, v in want.items()}


def test_odd_rows(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, None, "x"), (2, 5, "assistant", "long </turn> \\" * 200_000), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"), (4, None, "user", "no turn"), (4, 9, "assistant", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"message": F.lit("m"), "kind": F.lit("k"), "seq": F.lit(0)}).repartition(2)
    rows = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.formatted(chat.messages(chat.log_of(df)))).collect()}
    assert rows == {k: told(v) for k, v in {1: [("user", ""), ("assistant", "")], None: [("", "x")], 2: [("assistant", turns[3][3])], 3: [("assistant", "tie"), ("user", "same"), ("user", "same")], 4: [("assistant", "first"), ("user", "no turn")]}.items()}
    assert chat.digests(chat.formatted(chat.messages(chat.log_of(df.limit(0))))).count() == 0
