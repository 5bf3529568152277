import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from velarium.llm import fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s:.)"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text, rate=100, spm=50, unit="line", seed=7):
    """The contract, by regular expressions and slices."""
    text = text or ""
    h1, h2, h3, h4 = (int(sha(f"{seed}:{doc_id if doc_id is not None else ''}")[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(UNITS[unit], text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n\r\x0b\x85 é東😀 <PSM>", max_size=60), st.integers(0, 10**6))
def test_cuts_like_regular_expressions(text, doc_id):
    data = text.encode()
    for unit, rule in UNITS.items():
        bits, found = fim.ends(data, unit), re.findall(rule, text)
        places = [fim.after(bits, k) for k in range(bits.bit_count() + 1)]
        assert places == [len("".join(found[:k]).encode()) for k in range(len(found) + 1)]
        n, form, a, b = fim.split(data, str(doc_id), 7, 100, 50, unit)
        want = plainly(doc_id, text, unit=unit)
        out = fim.join(data, form, a, b)
        assert (n, form, out.decode()) == (want[0], want[1], want[4]) and fim.rebuild(out, form) == data


def test_words_take_the_space_before_them():
    for text in ("one two\tthree", "  one two  ", " ", "one", "a b \n", "é 東京 x"):
        bits = fim.ends(text.encode(), "word")
        at = [fim.after(bits, k) for k in range(bits.bit_count() + 1)]
        pieces = [text.encode()[a:b].decode() for a, b in zip(at, at[1:])]
        assert "".join(pieces) == text
        assert [p.strip() for p in pieces] == (text.split() or [""])
    with pytest.raises(ValueError):
        fim.ends(b"x", "page")


def test_selects_each_bit():
    rng = random.Random(5)
    for width in (1, 2, 63, 64, 65, 1000):
        bits = rng.getrandbits(width) | 1 << (width - 1)
        want = [k for k in range(width) if bits >> k & 1]
        assert [fim.select(bits, k + 1) for k in range(len(want))] == want


def test_markers_at_the_seams():
    for text in ("<P", "<\n<\nS>", "P>\nS>\nM>\n", "a<\nb<S\n>"):
        for doc_id in range(40):
            n, form, a, b = fim.split(text.encode(), str(doc_id), 7, 100, 50, "line")
            assert form != "plain" and fim.rebuild(fim.join(text.encode(), form, a, b), form).decode() == text


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_documents(docs, rate, spm):
    rows = fim.restore(fim.transform(docs, rate=rate, spm=spm)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, texts[r.doc_id], rate, spm)
        assert r.restored == (texts[r.doc_id] or "")
    forms = {r.form for r in rows}
    assert forms == {(100, 50): {"psm", "spm"}, (40, 0): {"plain", "psm"}, (0, 50): {"plain"}, (100, 100): {"spm"}}[rate, spm] | ({"plain"} if any(not t for t in texts.values()) else set()) or rate == 100


def test_odd_rows(spark, odd, none):
    rows = fim.digests(fim.transform(odd)).collect()
    given = odd.collect()
    assert len(rows) == len(given)
    for r, g in zip(rows, given, strict=True):
        want = plainly(g.doc_id, g.text)
        assert tuple(r) == (g.doc_id, *want[:4], sha(want[4]), sha(g.text or ""))
    assert fim.digests(fim.transform(none)).count() == 0
    long = spark.createDataFrame([(1, "line\n" * 400_000), (2, "x" * 2_000_000), (3, "say <M> here\nand on")], "doc_id long, text string")
    for r, text in zip(fim.restore(fim.transform(long)).orderBy("doc_id").collect(), ("line\n" * 400_000, "x" * 2_000_000, "say <M> here\nand on")):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, text) and r.restored == text
