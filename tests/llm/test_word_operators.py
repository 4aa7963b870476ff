"""Collocations, spelling variants and license rules against brute force, with odd inputs."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations, license_rules, spelling_variants

LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " \t\n", "...", "!?;", "x", "\x00 \x01\x0e a b", "É é É"]
NAMES = "doc_id long, text string, lang string, phrase string, word string, n int, labels string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", "w", 7, "z") for i, (t, lang) in enumerate(rows)] + [(None, "no key", "en", "p", "w", 7, "z")], NAMES).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], NAMES)


# Collocations


def phrase_rows():
    rng = random.Random(11)
    words = ["of", "the", "sea", "Sea", "wind", "river", "\x01odd", "été", "b\x02", "a"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(1, 12))) + rng.choice([".", "\n", ";", " , "]) + " ".join(rng.choices(words, k=3)), rng.choice(["en", "fr", None, "x\ny"])) for _ in range(300)]
    rows += [("New York City is big", "en")] * 60 + [("the the the the the the the", "en")] * 30 + [(t, "en") for t in ODD]
    return rows + [("one two three four five six seven. " * 2000, "und"), ("word " * 5000, "long")]


def brute_collocations(rows, least, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {g: a for g, a in found.items() if len(g) > 1 and a >= least}
        inside = {g[i:j] for g, a in candidates.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and candidates.get(g[i:j]) is not None and 100 * a >= 100 * candidates[g[i:j]]}
        scored = []
        for g, a in candidates.items():
            if g not in inside:
                score, k = min((1000 * a * total[lang] // (found[g[:k]] * found[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), found[g[:k]], found[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "chunk"), [(3, 40, 4_000_000), (20, 2000, 400)])
def test_collocations(spark, monkeypatch, least, top, chunk):
    monkeypatch.setattr(collocations, "_CHUNK_BYTES", chunk)
    rows = phrase_rows()
    got = collocations.collocations(table(spark, rows), least, top)
    assert sorted(map(tuple, got.collect())) == brute_collocations([*rows, ("no key", "en")], least, top)


def test_counts_need_no_border_sample(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_SAMPLE_SHARE", 1)
    monkeypatch.setattr(collocations, "_BATCH_ROWS", 50)
    rows = phrase_rows()
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), 5, 100).collect())) == brute_collocations([*rows, ("no key", "en")], 5, 100)


def test_collocations_of_nothing(nothing):
    assert collocations.collocations(nothing).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(nothing).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 4_000_000_000
    counted = spark.createDataFrame([("en", "", 0, 5 * big), ("en", "a", 1, 2 * big), ("en", "b", 1, 3 * big), ("en", "a b", 2, big + 7)], "lang string, phrase string, size int, n long")
    monkeypatch.setattr(collocations, "flows", lambda docs, least: counted)
    row = collocations.collocations(counted).head()
    assert row.score == 1000 * (big + 7) * 5 * big // (6 * big * big)


# Spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(rows):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    partners = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in partners.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(partners[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variant_rows():
    rng = random.Random(5)
    seeds = ["harbour", "colour", "élégant", "straße", "Ángström", "mississippi", "aaaaaa", "x" * 300]
    letters = "abcdefgàÿ×"
    words = []
    for word in seeds:
        words += [word] * rng.choice([6, 40, 300])
        for _ in range(12):
            i, how = rng.randrange(len(word)), rng.random()
            changed = word[:i] + (rng.choice(letters) + word[i + 1 :] if how < 0.4 else word[i + 1 :] if how < 0.7 else rng.choice(letters) + word[i:])
            words += [changed] * rng.choice([4, 5, 7, 30])
    # A common half: many words with one ending and one beginning.
    words += [f"{a}{b}{c}ation" for a in "abcdef" for b in "ghij" for c in "klm" for _ in range(5)] + [f"inter{a}{b}{c}" for a in "abcdef" for b in "ghij" for c in "klm" for _ in range(6)]
    rng.shuffle(words)
    return [(i, rng.choice([" ", "-", "1"]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]


@pytest.mark.parametrize("pairs", [4096, 4])
def test_spelling_variants(spark, monkeypatch, pairs):
    monkeypatch.setattr(spelling_variants, "PAIRS", pairs)
    rows = variant_rows()
    rows += [(len(rows) + i, t) for i, t in enumerate(ODD)]
    docs = table(spark, [(t, "en") for _, t in rows])
    got = spelling_variants.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_variants([*rows, (None, "no key")])


def test_a_crowded_half_is_cut_until_few_words_meet(spark):
    # Two thousand words with one ending: pairs compared stay far below their square.
    words = spark.range(2000).select(F.concat(F.translate(F.lpad(F.col("id").cast("string"), 4, "0"), "0123456789", "abcdefghij"), F.lit("ation")).alias("word"))
    got = spelling_variants.near_pairs(words)
    listed = [r.word for r in words.collect()]
    have = set(listed)
    want = sum(1 for w in listed for i in range(4) for c in "abcdefghij" if w[:i] + c + w[i + 1 :] in have and c != w[i])
    assert got.count() == want


def test_spelling_variants_of_nothing(nothing):
    assert spelling_variants.spelling_variants(nothing).count() == 0


# License rules


def brute_licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    spaced = "".join(f" {w} " for w in words)
    places = [(i, label) for phrase, label in license_rules.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for rule in license_rules.rules():
        for m in re.finditer(rule.pattern, spaced):
            start = spaced[: m.start()].count(" ") // 2
            found.append((start, start + m[0].count(" ") // 2, rule))
    kept = [
        (a, b, r)
        for a, b, r in found
        if not any(c <= a and d >= b and (s.priority < r.priority or (s.priority == r.priority and (d - c > b - a or (d - c == b - a and s.rule < r.rule)))) for c, d, s in found)
    ]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(r.label for _, _, r in kept)})
    score = max([0.0, *(r.weight for _, _, r in kept), *([license_rules.BASE_WEIGHT] if places else [])])
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score), sorted((a, b - a, r.rule) for a, b, r in kept)


def license_texts():
    rng = random.Random(9)
    terms = sorted({t for r in license_rules.rules() for t in re.findall("[a-z0-9]+", re.sub(r"\[cs\]", "s", r.pattern))})
    texts = [
        "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0. SPDX-License-Identifier: MIT",
        "under the MIT license " * 700,
        "submitted mité license under the mits license Kernel",
        "word " * 3000 + "http://creativecommons.org/licenses/by-nc/4.0 " + "word " * 90 + "cc0",
    ]
    # Soups of words of the rules, also across the borders of blocks.
    return texts + [" ".join(rng.choices(terms, k=rng.randint(1, 400))) for _ in range(60)] + [("x " * k) + "under the terms of the GNU General Public License version 3" for k in range(50, 80)] + ODD


def test_license_rules(spark):
    texts = license_texts()
    rows = license_rules.scan_licenses(table(spark, [(t, "en") for t in texts])).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        want, kept = brute_licenses("no key" if row.doc_id is None else texts[row.doc_id])
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.labels, row.score) == want
        assert sorted((d.start, d.words, d.rule) for d in row.detections) == kept


def test_rules_are_hundreds_and_hold_their_keyword():
    rules = license_rules.rules()
    assert len(rules) > 300 and all(f" {r.keyword} " in r.pattern for r in rules)
    assert brute_licenses("Released under the MIT License.")[0][5] == "mit"
    assert brute_licenses("under the GNU General Public License, version 3")[0][5] == "gpl-3"
    assert brute_licenses("Licensed under CC BY-NC-SA 4.0")[0][5] == "cc-by-nc,cc-by-nc-sa"


def test_license_rules_of_nothing(nothing):
    assert license_rules.scan_licenses(nothing).count() == 0
