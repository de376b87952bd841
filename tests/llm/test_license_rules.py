"""All labels of the license scan against a plain loop over rules and pairs of matches."""

import re

import pytest

pytest.importorskip("seqsieve.llm")

from seqsieve.llm import licenses as L  # noqa: E402


def python_regex(rx):
    return re.compile(rx.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), re.A)


RULES = [(label, priority, weight, python_regex(rx)) for label, _, _, forms in L.rules() for rx, priority, weight in forms]


def brute(text):
    """(labels, score) by every rule on every text, and every pair of matches."""
    t = "".join(c.lower() if c.isascii() else c for c in text).replace("\x01", " ").replace("\x02", " ")
    found = {(m.start(), m.end(), p, label): 0.0 for label, p, w, rx in RULES for m in rx.finditer(t)}
    for label, p, w, rx in RULES:
        for m in rx.finditer(t):
            key = (m.start(), m.end(), p, label)
            found[key] = max(found[key], w)
    kept = [(k, w) for k, w in found.items() if not any(o[0] <= k[0] and o[1] >= k[1] and (o[2] > k[2] or (o[2] == k[2] and (o[1] - o[0] > k[1] - k[0] or (o[:2] == k[:2] and o[3] < k[3])))) for o in found if o != k)]
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    base = {label for phrase, label in L.BASE_PHRASES.items() if any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))}
    return ",".join(sorted({k[3] for k, _ in kept} | base)), max([w for _, w in kept] + [0.8] * bool(base), default=0.0)


def sample(rx):
    """A text that a signature matches."""
    rx = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)*\)\??", r"\1", rx)
    rx = rx.replace(",?\\s+", ", ").replace("\\s+", " ").replace("(?:19|20)[0-9]{2}", "2001").replace("[0-9]{2}", "01").replace("[0-9.]+", "4.0").replace("[0-9]", "3").replace("\\w+", "oo").replace(".{1,80}?", "acme").replace("-[abc]", "-b")
    return re.sub(r"\[[^\]]*\]\??", lambda m: "" if m[0].endswith("?") else m[0][1], rx).replace(".?", "").replace("-?", "-").replace("s?", "s").replace("\\", "").replace("?", "")


def test_labels_against_loop(spark):
    made = [(label, sample(rx)) for label, _, _, rx in L.signatures()]
    texts = [t for _, t in made] + [t.replace(" ", "\n") for _, t in made[::3]] + [f"{made[i][1]}. {made[-i][1]}; Licensed under the MIT License, version 2.0 and CC BY-SA 4.0. Copyright (c) 2004" for i in range(1, 40, 3)]
    texts += ["", "plain text of no license at all", "Do not permit", "SPDX-License-Identifier: GPL-2.0-only", "gnu general public licence v3 and gnu lesser general public license", "İ license ſ MIT License"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wrong = [(texts[i], got[i], brute(texts[i])) for i in range(len(texts)) if got[i] != brute(texts[i])]
    assert not wrong, (len(wrong), wrong[:3])
    matched = [label in got[i][0].split(",") or not python_regex(L.signatures()[i][3]).search(made[i][1].lower()) for i, (label, _) in enumerate(made)]
    assert sum(python_regex(x[3]).search(made[i][1].lower()) is not None for i, x in enumerate(L.signatures())) > 0.9 * len(made) and sum(matched) > 0.8 * len(made)
