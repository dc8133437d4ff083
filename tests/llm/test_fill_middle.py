"""Fill-in-the-middle against regular expressions, over texts with every awkward border."""

import hashlib
import random
import re

import pytest

from docloom.llm import fill_middle as M

from . import helpers


def by_hand(doc_id, text, seed=7, rate=100, spm_share=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in M.SENTINELS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_share:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(3)
    made = ["", "\n", "\n\n\n", "a", "a\n", "\nb", "<", "<P", "<<P>", "<P<S", "x<S>y", "<M>", "<p>", "\r\n\x0b line", "é\n😀\n漢字", "<\nP>\nS>", "\x00\n\xff"]
    for n in (509, 510, 511, 512, 513, 1023, 1024, 1025):
        made += ["a" * n + "<P>", "a" * n + "\n" + "b" * n, "é" * n + "\n", "\n" * n, "<P" * n]
    for _ in range(150):
        made.append("".join(rng.choice(["a", "<", "P", "S", "M", ">", "\n", "é", "😀", "word ", "line\n"]) for _ in range(rng.randrange(0, 700))))
        made.append("".join(rng.choice(["P>", "<é", "\n", "x", "S", "😀"]) for _ in range(rng.randrange(0, 700))))
    return made


def found(spark, frame, **how):
    rows = M.restore(spark, M.fill_in_middle(spark, frame, **how)).collect()
    return [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in rows]


@pytest.mark.parametrize("how", [{}, {"rate": 40, "spm_share": 10, "seed": 1}])
def test_outputs_equal_regular_expressions_and_restore(spark, how):
    given = list(enumerate([*texts(), *texts()]))
    got = {r[0]: r[1:] for r in found(spark, helpers.plain(spark, given).repartition(3), **how)}
    assert len(got) == len(given)
    forms = set()
    for i, text in given:
        assert got[i] == (*by_hand(i, text, **how), text)
        forms.add(got[i][1])
    assert forms == {"plain", "psm", "spm"}


def test_awkward_rows(spark):
    got = sorted(found(spark, helpers.docs(spark)), key=repr)
    want = sorted(((r[0], *by_hand(r[0], r[1]), r[1] or "") for r in helpers.AWKWARD), key=repr)
    assert got == want
    assert found(spark, helpers.empty(spark)) == []


def test_a_very_long_text_beside_short_ones(spark, monkeypatch):
    long = "".join(f"line {i} ü\n" for i in range(400_000))
    given = [(1, "a\nb"), (2, long), (3, "c\n\nd")]
    got = {r[0]: r[1:] for r in found(spark, helpers.plain(spark, given).coalesce(1))}
    assert all(got[i] == (*by_hand(i, t), t) for i, t in given)


def test_other_sentinels_and_wrong_ones(spark):
    marks = ("\x01pre", "\x02suffix", "\x03m")
    own = M.Automaton(marks)
    import numpy as np

    raw = "a\n\x01pr\n\x02suffi\nx".encode()
    ((n, form, prefix, middle, output),) = own.rearranged(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.array([[1, 2, 0, 99]]), 100, 50)
    assert (n, form, prefix, middle) == (4, "psm", 2, 4) and output == b"\x01prea\n\x02suffix\x02suffi\nx\x03m\x01pr\n"
    assert list(own.restored(np.frombuffer(output, np.uint8), np.array([0, len(output)]), ["psm"])) == [raw]
    with pytest.raises(ValueError):
        list(own.restored(np.frombuffer(output, np.uint8), np.array([0, len(output)]), ["spm"]))
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("", "a", "b"), ("a\n", "b", "c")):
        with pytest.raises(ValueError):
            M.Automaton(bad)


def test_restored_keeps_other_columns(spark):
    rows = M.fill_in_middle(spark, helpers.plain(spark, [(1, "a\nb\nc")])).selectExpr("*", "array(1, null) AS restored", "1.5D AS `odd name`")
    got = M.restore(spark, rows).first()
    assert got["_restored"] == "a\nb\nc" and got["restored"] == [1, None] and got["odd name"] == 1.5
