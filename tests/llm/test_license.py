import random
import re

from priorframe.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in L.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = L.scan(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def labels(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.scan(rows, **options).collect()}


def test_labels_beyond_the_base(spark):
    notice = next(t[1] for t in L.TEMPLATES if t[0] == "bsd")
    rows = [
        (1, "x y Licensed under CC BY-NC 4.0. z"),
        (2, "Redistribution and use, in source and (binary) forms, with or without extra modification are permitted provided that the following conditions are met"),
        (3, None), (4, ""), (5, "MIT license MIT License"), (6, "the mitlicense and a license"), (7, "mİt license, GENERAL public\nlicense"), (8, notice[: len(notice) // 3]),
        (None, "Released under the MIT License."), (5, "other text"), (1, "x y Licensed under CC BY-NC 4.0. z"),
    ]
    out = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    of = lambda k: sorted(r.labels for r in out if r.doc_id == k)
    assert of(1) == ["cc-by-nc"] * 2
    assert of(2) == ["bsd"] and of(3) == of(4) == of(6) == of(8) == [""] and of(7) == ["gpl"] and of(None) == ["mit"] and of(5) == ["", "mit"]
    five = next(r for r in out if r.doc_id == 5 and r.n_base)
    assert (five.n_base, five.first_word, five.last_word, five.score) == (2, 0, 2, 1.0)
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def base_labels(text):
    return {label for phrase, label in L.PHRASES if f" {phrase} " in f" {text} "}


def test_every_notice_has_its_label_alone(spark):
    """Each template's words between other words: its label and those of the base phrases in it, none of its relatives."""
    out = labels(spark, [f"alpha beta {text} gamma delta" for _, text, _ in L.TEMPLATES])
    for k, (label, text, _) in enumerate(L.TEMPLATES):
        assert set(out[k].labels.split(",")) == {label} | base_labels(text), (label, text)
        assert [(s.label, s.first) for s in out[k].spans if s.label == label] == [(label, 2)] and len(out[k].spans) == 1, text


def test_relatives(spark):
    texts = {
        "It is covered under the terms of the GNU General Public License.": "gpl",
        "It is covered under the terms of the GNU Lesser General Public License.": "gpl,lgpl",
        "It is covered under the terms of the GNU Affero General Public License.": "agpl,gpl",
        "Licensed under CC BY NC SA 4 0": "cc-by-nc-sa", "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY SA 4.0, and so on": "cc-by-sa",
        "Licensed under CC BY-NC 4.0. Released under the MIT License. All rights reserved no part of this publication may be reproduced": "cc-by-nc,mit,proprietary",
        "under the terms of the public license of the city": "", "licensed under cc by": "",
    }
    out = labels(spark, list(texts))
    assert {t: out[k].labels for k, t in enumerate(texts)} == texts


def test_whole_notices_bear_small_edits(spark):
    rng = random.Random(3)
    whole = [(label, text.split()) for label, text, _ in L.TEMPLATES if len(text.split()) > 40]
    texts, want = [], []
    for label, words in whole:
        for _ in range(4):
            w = list(words)
            for _ in range(3):
                at = rng.randrange(3, len(w) - 1)
                if w[at] not in " ".join(t[2] for t in L.TEMPLATES).split() + ["general", "public", "license", "apache", "mit", "2", "3"]:
                    w[at : at + 1] = rng.choice([[], ["changed"], [w[at], "more"]])
            texts.append("start " + " ".join(w) + " end")
            want.append(label)
    out = labels(spark, texts)
    for k, label in enumerate(want):
        assert {s.label for s in out[k].spans} == {label}, (label, out[k].spans, texts[k])


def test_a_stray_window_inside_a_notice(spark):
    notice = next(t[1] for t in L.TEMPLATES if t[0] == "bsd").split()
    put = lambda extra: " ".join([*notice[:12], *extra.split(), *notice[12:]])
    out = labels(spark, [put("foo bar baz"), put("redistribution and use"), put("conditions are met"), put("x " * 60)])
    assert [out[k].labels for k in range(4)] == ["bsd", "bsd", "bsd", ""]
    assert out[0].score == out[1].score == 1 - 3 / len(notice)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_scores_against_brute_force(spark):
    """A span's score is that of its own words; no window of the text is better, and planted notices of few edits are found."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(14)]
    texts = []
    for k in range(60):
        text = list(words)
        for _ in range(k % 4):
            at = rng.randrange(1, len(text) - 1)
            text[at : at + rng.randint(0, 1)] = rng.choice([["x"], [], ["y", "z"]])
        texts.append(["a", "b", *text, "c"])
    out = labels(spark, [" ".join(t) for t in texts], templates=(("own", " ".join(words), "w0"),), coverage=0.5)
    for k, t in enumerate(texts):
        best = max(1 - edits(t[i:j], words) / 14 for i in range(len(t)) for j in range(i + 1, len(t) + 1))
        for s in out[k].spans:
            assert abs(s.score - (1 - edits(t[s.first : s.last + 1], words) / 14)) < 1e-9 and s.score <= best + 1e-9
        assert out[k].spans or best < 0.8, t


def test_a_very_long_text_of_notices(spark):
    notice = next(t[1] for t in L.TEMPLATES if t[0] == "bsd")
    row = labels(spark, [(f"{notice} " + "filler " * 50) * 300])[0]
    assert row.labels == "bsd" and len(row.spans) == 300 and row.n_words == 300 * (len(notice.split()) + 50)
