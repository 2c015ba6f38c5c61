"""Cut texts, by example and by cutting whole ones."""

from __future__ import annotations

import random

import pytest

from corpusmith.llm.truncation import examine, find_truncated, open_at_end, truncation_rates, visible_end


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("It ends here.", "whole"), ("Ends 。", "whole"), ("See ```js\nx = 1", "cut"), ("```\nx\n```", "whole"), ("Set `name", "cut"), ("He said \"no", "cut"), ("call (this", "cut"), ("one, two,", "cut"), ("| a | b |\n|---|---|\n| 1 |", "cut"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "whole"), ("broken \ufffd", "cut"), ("done 🚀", "whole"), ("", "whole"), (" \n\u200b", "whole"), ("link <a href", "cut"), ("words of a sen", None), ("words of a sen…", None), ('"Quoted end."', "whole"),
    ],
)
def test_ends(text, verdict):
    assert examine(text)["verdict"] == verdict


def test_visible():
    assert visible_end("a \u200b\n") == "a" and open_at_end("a (b) \"c\"") is None


def test_corpus(spark):
    r = random.Random(4)
    nouns = ["lease", "worker", "cursor", "window", "token", "ledger"]
    w = lambda: r.choice(nouns)
    forms = [lambda: f"The {w()} holds one {w()} for every {w()} of the queue.", lambda: f"We saw {r.randint(1, 99)} records after the last {w()} change.", lambda: f"Before you move the {w()}, check that every {w()} has a fresh {w()}."]
    rows, cut, whole = [], set(), set()
    for i in range(400):
        text = " ".join(r.choice(forms)() for _ in range(r.randint(3, 9)))
        if i % 8 == 0:
            at = r.randint(len(text) // 2, len(text) - 15)
            while text[at - 1] in ".! " or text[:at].rstrip()[-1] == ".":
                at -= 1
            text = text[:at] + r.choice(["", "", "…", " [truncated]"])
            cut.add(i)
        elif i % 8 == 1:
            text += "\n\n" + r.choice(["Cheers", "Thanks in advance"])
            whole.add(i)
        elif i % 8 == 2:
            text = text[:-1].lower()
            whole.add(i)
        rows.append((i, text, f"s{i % 3}", "x"))
    rows += [(1000, None, "s0", "x"), (1001, "", None, "x"), (1002, "  ", "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, final string")
    got = {x.doc_id: x.truncated for x in find_truncated(df).collect()}
    assert len(got) == len(rows) and not any(got[i] for i in (1000, 1001, 1002))
    found = {i for i, t in got.items() if t}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.02 * len(rows)
    rates = truncation_rates(find_truncated(df)).collect()
    assert sum(x.n_docs for x in rates) == len(rows) and all(0 <= x.share <= 1 for x in rates)
    assert find_truncated(df.limit(0)).count() == 0
