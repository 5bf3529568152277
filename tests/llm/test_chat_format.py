import hashlib

import pytest

from velarium.llm import chat_format as C
from velarium.llm.queries import INJECTION

ROWS = "conv_id long, turn long, role string, text string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.chatml([t[2:] for t in turns])))
    return out


def read(df, **options):
    return {r[0]: tuple(r)[1:] for r in C.digests(C.format_turns(df, **options)).collect()}


def test_round_trip(spark, sf):
    odd = [(1, 0, "user", None), (1, 1, "assistant", INJECTION), (1, 1, "assistant", INJECTION), (2, None, None, "<\\|<|x<"), (2, 5, "assistant", ""), (None, 1, "assistant", "<"), (3, 0, "assistant", "|>\n<|im_end|>\n"), (-1, 0, "user", INJECTION), (-1, 1, "assistant", INJECTION)]
    odd += [(9, i, "assistant" if i % 2 else "user", f"<|{i}") for i in range(300)]
    for rows in (odd, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], []):
        assert read(spark.createDataFrame(rows, ROWS)) == expected(rows)


def test_segments_join_to_the_whole_output(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(150)]
    got = C.format_turns(spark.createDataFrame(rows, ROWS)).orderBy("turn_index").collect()
    assert "".join(r.segment for r in got) == C.chatml([(r[2], r[3]) for r in rows])
    assert [r.segment[r.text_start : r.text_end] for r in got] == [r[3] for r in rows]


def test_rewriting_is_detected(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], ROWS)
    last_only = lambda turns: "".join(f"{r}:{t}\n" if i == len(turns) - 1 else f"{r}\n" for i, (r, t) in enumerate(turns))
    with pytest.raises(Exception, match="RewritesHistory"):
        C.format_turns(rows, last_only).collect()
    assert [r.rewrites for r in C.format_turns(rows, last_only, on_rewrite="mark").orderBy("turn_index").collect()] == [False, True]


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|<|<", "<|im_end|>", "|<|>", "<<|\\"])
def test_escape(text):
    assert "<|" not in C.escape(text) and C.unescape(C.escape(text)) == text


def test_templates_that_look_far_back(spark):
    """Turns are numbered from the whole conversation, and a rewrite of an old one is found, however long it is."""
    rows = [(1, i, "user", f"text {i}") for i in range(150)]
    df = spark.createDataFrame(rows, ROWS)
    numbered = lambda turns: "".join(f"{i}:{r}<{t}>\n" for i, (r, t) in enumerate(turns))
    got = C.format_turns(df, numbered).orderBy("turn_index").collect()
    assert "".join(r.segment for r in got) == numbered([r[2:] for r in rows])
    trimmed = lambda turns: "".join(f"<{t if len(turns) <= 100 or i != 5 else ''}>" for i, (_, t) in enumerate(turns))
    assert [r.turn_index for r in C.format_turns(df, trimmed, on_rewrite="mark").where("rewrites").collect()] == [100]
