import random
import re
import time

from quarry.llm import op9_license as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """Places of the phrases, word by word; labels by comparing every block with every template."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    places, base = [], set()
    for phrase, label in op.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    labels = {}
    for line in text.split("\n"):
        own = WORD.findall(line)
        half = op.BLOCK_WORDS // 2
        blocks = [own] if len(own) <= op.BLOCK_WORDS else [own[a:a + op.BLOCK_WORDS] for a in range(0, len(own) - half, half)]
        for block in blocks:
            for label, words in op.TEMPLATES:
                t = set(words.split())
                share = len(t & set(block)) / len(t)
                if share >= op.CONTAINMENT - 1e-9:
                    labels[label] = max(share, labels.get(label, 0))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | set(labels))), 1.0 if base else max(labels.values(), default=0.0))


def cases():
    r = random.Random(6)
    words = " ".join(t for _, t in op.TEMPLATES).split() + ["die", "été", "x", "Under", "THE", "\n", "(c)", "2.0"]
    out = [" ".join(r.choices(words, k=r.randint(0, 150))) for _ in range(300)]
    for _, t in op.TEMPLATES:
        own = t.split()
        for drop in range(4):
            left = own[:]
            for _ in range(drop):
                left.pop(r.randrange(len(left)))
            out.append("Some words before. " + " ".join(left).upper() + ", and after\nmore " * 30)
    return out + [None, "", "cc by nc cc by nc", "CC-BY-NC 4.0", "under the mit license under the MIT License.",
                  "Released under the MIT License.", "éunder the mit license", "cc by ncé", "K"]


def test_scan_equals_the_definition():
    m = op.Matcher({}, containment=op.CONTAINMENT)
    for text in cases():
        r = m.scan(text)
        got = tuple(r[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
        assert got == plain(text), text


def test_any_order_of_words_finds_the_same():
    r = random.Random(1)
    words = {w for _, t in op.template_sets() for w in t}
    for _ in range(3):
        m = op.Matcher({w: r.randint(0, 5) for w in words})
        assert [m.scan(t) for t in cases()[:80]] == [op.Matcher({}).scan(t) for t in cases()[:80]]


def test_query_on_odd_rows(spark, odd, odd_docs):
    got = sorted((tuple(r) for r in op.op9_license_scan(spark, odd).collect()), key=str)
    assert got == sorted(((d, *plain(t)) for d, t in odd_docs), key=str)


def test_blocks(spark):
    df = spark.createDataFrame([(1, "one two\nReleased under the MIT License."), (2, None), (3, "nothing")], "doc_id long, text string")
    assert [tuple(r) for r in op.matching_blocks(df).collect()] == [(1, 2, 5, "mit", 1.0)]
    assert op.corpus_counts(df)[b"mit"] == 1


def test_planted_lines(spark):
    lines = {1: "Licensed under CC BY-NC 4.0.", 2: "This work is licensed under the GNU General Public License, version 3.",
             3: "Licensed under the Apache License, Version 2.0.", 4: "Released under the MIT License.",
             5: "Licensed under CC BY-SA 4.0.", 6: "The license of the general public is under version control."}
    df = spark.createDataFrame(list(lines.items()), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in op.scan_licenses(df).collect()}
    assert got == {1: "cc-by-nc", 2: "gpl", 3: "apache-2", 4: "mit", 5: "", 6: ""}


def test_empty_table(spark, none):
    assert op.op9_license_scan(spark, none).count() == 0


def plain_across(text):
    """label -> largest share over lines and over windows of the whole text, by a block definition of its own:
    64 words from every 32nd word on, as long as words are left that no window before holds."""
    blocks = []
    for part in [text] + text.split("\n"):
        w = WORD.findall(part.lower())
        at = 0
        while True:
            blocks.append(set(w[at:at + 64]))
            if at + 64 >= len(w):
                break
            at += 32
    out = {}
    for block in blocks:
        for label, words in op.TEMPLATES:
            t = set(words.split())
            if 10 * len(t & block) >= 9 * len(t):
                out[label] = max(out.get(label, 0), len(t & block) / len(t))
    return out


def wrapped():
    """(label, text): copies of every template, wrapped at many widths, among other words and behind comment signs."""
    r = random.Random(3)
    for label, t in op.TEMPLATES:
        own = t.split()
        for width in (1, 2, 3, 5, 8, 13, 21):
            for sign in ("", " * ", "# ", "// "):
                lines = [sign + " ".join(own[a:a + width]) for a in range(0, len(own), width)]
                before = [" ".join(f"a{r.randint(0, 99)}" for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 20))]
                yield label, "\n".join(before + lines + ["other words"] * r.randint(0, 40))


def test_wrapped_copies_of_every_template(spark):
    rows = list(wrapped())
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.scan_licenses(docs).collect()}
    places = {}
    for r in op.matching_blocks(docs).collect():
        places.setdefault(r.doc_id, set()).add(r.label)
    for i, (label, text) in enumerate(rows):
        want = plain_across(text)
        assert label in want and label in got[i].labels.split(","), text
        assert set(got[i].labels.split(",")) == set(want) | set(filter(None, got[i].base_labels.split(","))), text
        assert got[i].score == (1.0 if got[i].base_labels else max(want.values())) and places[i] == set(want)


def test_notice_of_three_lines():
    text = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
            "documentation files (the \"Software\"), to deal\nin the Software without restriction")
    assert op.Matcher({}, across_lines=True).scan(text)["labels"] == "mit"


def test_lines_and_windows_equal_their_definition():
    m = op.Matcher({}, across_lines=True)
    for text in filter(None, cases()):
        r = m.scan(text)
        want = plain_across("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        assert set(filter(None, r["labels"].split(","))) == set(want) | set(filter(None, r["base_labels"].split(","))), text


def test_time_is_linear_in_places():
    matcher = op.Matcher({}, across_lines=True)

    def seconds(n):
        text = "under the mit license " * n
        start = time.perf_counter()
        assert matcher.scan(text)["n_base"] == n
        return time.perf_counter() - start

    small = min(seconds(10_000) for _ in range(3))
    assert seconds(40_000) < 8 * small + 0.3


def test_longer_templates_are_found_across_lines():
    """The window grows with the longest template."""
    words = [f"word{i}" for i in range(150)]
    matcher = op.Matcher({}, templates=[("long", " ".join(words))], across_lines=True)
    for lead in (0, 1, 63, 148, 149, 150, 299):
        text = "\n".join(["other"] * lead + words + ["end"] * 40)
        assert matcher.scan(text)["labels"] == "long"
