"""License statements in texts by ordered signature rules, with DataFrame operations only.

A text becomes its words, each between two spaces, so that a rule is a regular expression over whole words.  Every rule
names a keyword without which it cannot match: texts without any keyword stop there, and so do blocks of words.  Rules
are tried on blocks that reach further than the longest rule on both sides of the words they decide, so that the work
of a text grows with its length and no list of matches of a whole text is ever compared with itself.  Of overlapping
matches one that lies inside another of a higher priority (or of the same priority and longer) is suppressed.

Inputs: null texts have no words; repeated rows are judged each; an empty table gives no rows; null keys stay null;
other columns are ignored.  Words are runs of digits, letters a-z (A-Z are lowered) and characters beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_WEIGHT = 0.9
# Words a block decides, and words it reads on either side of them.
CORE = 64
SPAN = 24

# Label, keyword and written forms of each license; a form is words, "x?" an optional word, "a|b" one of several.
FORMS = [
    ("mit", "mit", "mit licen[cs]e", "mit", "opensource org licenses mit"),
    ("mit", "expat", "expat licen[cs]e", "expat", "directory fsf org wiki license expat"),
    ("mit-0", "mit", "mit no attribution", "mit 0", "opensource org licenses mit 0"),
    ("x11", "x11", "x11 licen[cs]e", "x11", "spdx org licenses x11"),
    ("apache-1.1", "apache", "apache software? licen[cs]e version? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2", "apache", "apache software? licen[cs]e version|v? 2 0?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-2", "asl2", "asl2", "asl2", "asl2 0"),
    ("gpl-1", "gnu", "gnu general public licen[cs]e version|v 1", "gnu gpl 1", "gnu org licenses gpl 1 0"),
    ("gpl-2", "gnu", "gnu general public licen[cs]e version|v 2", "gnu gpl 2", "gnu org licenses gpl 2 0"),
    ("gpl-3", "gnu", "gnu general public licen[cs]e version|v 3", "gnu gpl 3", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu", "gnu general public licen[cs]e", "gnu gpl", "gnu org copyleft gpl"),
    ("gpl-2", "gpl", "gpl version|v? 2", "gpl 2 0", "opensource org licenses gpl 2 0"),
    ("gpl-3", "gpl", "gpl version|v? 3", "gpl 3 0", "opensource org licenses gpl 3 0"),
    ("gpl-2", "gplv2", "gplv2", "gplv2", "opensource org licenses gplv2"),
    ("gpl-3", "gplv3", "gplv3", "gplv3", "opensource org licenses gplv3"),
    ("lgpl-2.1", "lesser", "lesser general public licen[cs]e version|v? 2 1", "lesser gpl 2 1", "lesser gpl license 2 1"),
    ("lgpl-3", "lesser", "lesser general public licen[cs]e version|v? 3", "lesser gpl 3", "lesser gpl license 3"),
    ("lgpl", "lesser", "lesser general public licen[cs]e", "lesser gpl", "lesser gpl license"),
    ("lgpl-2.1", "lgpl", "lgpl version|v? 2 1", "lgpl 2 1", "gnu org licenses lgpl 2 1"),
    ("lgpl-3", "lgpl", "lgpl version|v? 3", "lgpl 3 0", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "affero", "affero general public licen[cs]e version|v? 3?", "affero gpl", "affero gpl license"),
    ("agpl-3", "agpl", "agpl version|v? 3", "agpl 3 0", "gnu org licenses agpl 3 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e version|v? 1 1", "mozilla 1 1", "mozilla org mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e version|v? 2 0?", "mozilla 2 0", "mozilla org mpl 2 0"),
    ("mpl-2", "mpl", "mpl version|v? 2 0?", "mpl 2 0", "mozilla org en us mpl"),
    ("epl-1", "eclipse", "eclipse public licen[cs]e version|v? 1 0?", "eclipse 1 0", "eclipse org legal epl v10"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e version|v? 2 0?", "eclipse 2 0", "eclipse org legal epl 2 0"),
    ("epl-1", "epl", "epl version|v? 1 0?", "epl 1 0", "opensource org licenses epl 1 0"),
    ("epl-2", "epl", "epl version|v? 2 0?", "epl 2 0", "opensource org licenses epl 2 0"),
    ("cddl-1", "cddl", "cddl version|v? 1", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("bsd-2", "bsd", "simplified|freebsd bsd licen[cs]e", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd", "new|revised|modified bsd licen[cs]e", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4", "bsd", "original|old bsd licen[cs]e", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "0bsd", "0bsd", "0bsd", "opensource org licenses 0bsd"),
    ("isc", "isc", "isc licen[cs]e", "isc", "opensource org licenses isc"),
    ("zlib", "zlib", "zlib licen[cs]e", "zlib", "opensource org licenses zlib"),
    ("artistic-1", "artistic", "artistic licen[cs]e version|v? 1 0?", "artistic 1 0", "opensource org licenses artistic 1 0"),
    ("artistic-2", "artistic", "artistic licen[cs]e version|v? 2 0?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("cc0", "cc0", "cc0 1? 0? universal?", "cc0 1 0", "cc0 public domain dedication"),
    ("cc0", "creativecommons", "creativecommons publicdomain zero", "creativecommons zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "cc", "cc by", "cc by 4 0", "cc by 3 0"),
    ("cc-by-sa", "cc", "cc by sa", "cc by sa 4 0", "cc by sa 3 0"),
    ("cc-by-nc", "cc", "cc by nc", "cc by nc 4 0", "cc by nc 3 0"),
    ("cc-by-nd", "cc", "cc by nd", "cc by nd 4 0", "cc by nd 3 0"),
    ("cc-by-nc-sa", "cc", "cc by nc sa", "cc by nc sa 4 0", "cc by nc sa 3 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd", "cc by nc nd 4 0", "cc by nc nd 3 0"),
    ("cc-by", "creative", "creative commons attribution", "creative commons by", "creative commons attribution 4 0"),
    ("cc-by-sa", "creative", "creative commons attribution sharealike|share alike?", "creative commons by sa", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc", "creative", "creative commons attribution noncommercial|non commercial?", "creative commons by nc", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nd", "creative", "creative commons attribution noderivatives|no derivatives?", "creative commons by nd", "creative commons attribution noderivatives 4 0"),
    ("cc-by", "creativecommons", "creativecommons by", "creativecommons by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-sa", "creativecommons", "creativecommons by sa", "creativecommons by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc", "creativecommons", "creativecommons by nc", "creativecommons by nc 4 0", "creativecommons org licenses by nc 4 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense org", "opensource org licenses unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl 2 0", "wtfpl net"),
    ("bsl-1", "boost", "boost software licen[cs]e version|v? 1? 0?", "boost 1 0", "boost org license 1 0 txt"),
    ("eupl-1.1", "eupl", "eupl version|v? 1 1", "eupl 1 1", "opensource org licenses eupl 1 1"),
    ("eupl-1.2", "eupl", "eupl version|v? 1 2", "eupl 1 2", "opensource org licenses eupl 1 2"),
    ("osl-3", "osl", "osl version|v? 3", "osl 3 0", "opensource org licenses osl 3 0"),
    ("afl-3", "afl", "afl version|v? 3", "afl 3 0", "opensource org licenses afl 3 0"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "microsoft ms pl", "microsoft public license ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "microsoft ms rl", "microsoft reciprocal license ms rl"),
    ("psf-2", "psf", "psf licen[cs]e version|v? 2?", "psf 2 0", "docs python org license psf"),
    ("ofl-1.1", "ofl", "ofl version|v? 1 1", "ofl 1 1", "scripts sil org ofl"),
    ("ofl-1.1", "sil", "sil open font licen[cs]e", "sil ofl 1 1", "sil org ofl 1 1"),
    ("gfdl-1.3", "gfdl", "gfdl version|v? 1 3", "gfdl 1 3", "gfdl 1 3 or later"),
    ("gfdl-1.3", "documentation", "free documentation licen[cs]e version|v? 1? 3?", "documentation license fdl", "free documentation license fdl"),
    ("odbl-1", "odbl", "odbl version|v? 1? 0?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("pddl-1", "pddl", "pddl version|v? 1? 0?", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("upl-1", "upl", "upl version|v? 1 0?", "upl 1 0", "opensource org licenses upl"),
    ("ncsa", "ncsa", "ncsa open source licen[cs]e", "ncsa", "opensource org licenses ncsa"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql licence", "opensource org licenses postgresql"),
    ("zpl-2.1", "zpl", "zpl version|v? 2 1?", "zpl 2 1", "opensource org licenses zpl 2 1"),
    ("public-domain", "domain", "released|dedicated|placed into|in|to the public domain", "public domain work", "public domain dedication"),
    ("proprietary", "reserved", "all rights reserved", "rights reserved worldwide", "all rights reserved worldwide"),
]
# Priority (lower wins) and weight of what stands before a name; the first matches the identifier, the last the address.
_VERBS = "licen[cs]ed|released|distributed|published|provided|available|use"
TEMPLATES = [
    (1, 1.0, "spdx license identifier {id}"),
    (2, 0.95, _VERBS + " under the? terms? of? the? {name}"),
    (2, 0.95, _VERBS + " under an?|the? {id} licen[cs]e?"),
    (2, 0.9, "{url}"),
    (3, 0.85, "under the {name}"),
    (3, 0.8, "{name}"),
    (4, 0.6, "{id} licen[cs]e"),
]


class Rule(NamedTuple):
    rule: int
    priority: int
    weight: float
    label: str
    keyword: str
    pattern: str


def word_pattern(form: str) -> str:
    """Regular expression of a form over a text whose words each stand between two spaces."""
    parts = []
    for word in form.split():
        optional = word.endswith("?")
        word = word.rstrip("?")
        one = f" (?:{word}) " if "|" in word else f" {word} "
        parts.append(f"(?:{one})?" if optional else one)
    return "".join(parts)


@cache
def rules() -> tuple[Rule, ...]:
    """Every template with every written form, numbered; a form that several templates give is kept once."""
    found: dict[tuple[str, str], Rule] = {}
    for label, keyword, name, spdx, url in FORMS:
        for priority, weight, template in TEMPLATES:
            form = template.format(name=name, id=spdx, url=url)
            # A match holds the keyword itself and is shorter than what a block reads beside its own words.
            if keyword not in form.split() or len(form.split()) >= SPAN:
                raise ValueError(form)
            found.setdefault((label, word_pattern(form)), Rule(len(found), priority, weight, label, keyword, word_pattern(form)))
    return tuple(found.values())


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _count(spaced: Column) -> Column:
    """Number of words in a text whose words each stand between two spaces."""
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2


def marked_words(text: Column) -> Column:
    """The lowered text with two spaces for whatever stands between its words."""
    return F.regexp_replace(_lowered(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "  ")


def spaced_words(marked: Column) -> Column:
    """The words of a marked text, each between two spaces."""
    return F.when(F.trim(marked) != "", F.concat(F.lit(" "), F.trim(marked), F.lit(" "))).otherwise(F.lit(""))


def base_places(t: Column) -> Column:
    """One struct per phrase that occurs: label, number of places, first and last start in words."""
    found = []
    for phrase, label in BASE.items():
        spaced = "".join(f" {word} " for word in phrase.split())
        n = ((F.length(t) - F.length(F.replace(t, F.lit(spaced), F.lit("")))) / len(spaced)).cast("long")
        first = _count(F.substring_index(t, spaced, 1)).cast("long")
        last = (_count(t) - _count(F.substring_index(t, spaced, -1)) - len(phrase.split())).cast("long")
        found.append(F.when(F.contains(t, F.lit(spaced)), F.struct(F.lit(label).alias("label"), n.alias("n"), first.alias("first"), last.alias("last"))))
    return F.array_compact(F.array(*found))


def _gate(keywords: Sequence[str]) -> str:
    """Pattern of a word that is one of the keywords, tried letter by letter."""
    by_letter: dict[str, list[str]] = {}
    for keyword in keywords:
        by_letter.setdefault(keyword[0], []).append(keyword[1:])
    return " (?:" + "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in sorted(by_letter.items())) + ") "


def _blocks(words: Column, keywords: Column) -> Column:
    """Overlapping blocks of a word array that hold a keyword: first decided word, first word read, and the words."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(CORE))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("core"), F.greatest(i - SPAN, F.lit(0)).alias("from"), F.slice(words, F.greatest(i - SPAN, F.lit(0)) + 1, F.least(i, F.lit(SPAN)) + CORE + SPAN).alias("words")))
    return F.filter(cut, lambda b: F.arrays_overlap(b["words"], keywords))


def _rule_column(rule: Rule) -> Column:
    return F.struct(*(F.lit(value).alias(name) for name, value in zip(Rule._fields, rule, strict=True)))


def detections(t: Column) -> dict[str, Column]:
    """Columns to be added one after the other, from the words of a text in ``t`` to the matches that stay.

    Each is a named column because the next uses it more than once.
    """
    by_keyword: dict[str, list[Rule]] = {}
    for rule in rules():
        by_keyword.setdefault(rule.keyword, []).append(rule)
    keywords = F.array(*map(F.lit, by_keyword))
    table = F.create_map(*(part for keyword, listed in by_keyword.items() for part in (F.lit(keyword), F.array(*map(_rule_column, listed)))))
    words = F.when(t.rlike(_gate(list(by_keyword))), F.split(F.trim(t), " +")).otherwise(F.array().cast("array<string>"))
    blocks = _blocks(F.col("_words"), keywords)
    # Only rules whose keyword stands in the block are tried on it.
    chosen = F.transform(
        F.col("_blocks"),
        lambda b: F.struct(
            b["core"].alias("core"),
            b["from"].alias("from"),
            F.concat(F.lit(" "), F.array_join(b["words"], "  "), F.lit(" ")).alias("text"),
            F.flatten(F.transform(F.array_intersect(b["words"], keywords), lambda k: F.element_at(table, k))).alias("rules"),
        ),
    )
    found = F.transform(
        F.col("_chosen"),
        lambda b: F.struct(
            b["core"].alias("core"),
            b["from"].alias("from"),
            F.filter(
                F.transform(b["rules"], lambda r: F.struct(r.alias("r"), F.regexp_extract_all(b["text"], r["pattern"], F.lit(0)).alias("matches"), F.split(b["text"], r["pattern"], -1).alias("pieces"))),
                lambda x: F.size(x["matches"]) > 0,
            ).alias("tried"),
        ),
    )
    zero = F.lit(0.0)
    placed = F.transform(
        F.col("_found"),
        lambda b: F.struct(
            b["core"].alias("core"),
            F.flatten(
                F.transform(
                    b["tried"],
                    lambda x: F.transform(
                        x["matches"],
                        lambda m, i: F.struct(
                            x["r"]["rule"].alias("rule"),
                            x["r"]["priority"].alias("priority"),
                            x["r"]["weight"].alias("weight"),
                            x["r"]["label"].alias("label"),
                            (b["from"] + F.aggregate(F.slice(x["pieces"], 1, i + 1), zero, lambda s, p: s + _count(p)) + F.aggregate(F.slice(x["matches"], 1, i), zero, lambda s, p: s + _count(p))).cast("long").alias("start"),
                            _count(m).cast("long").alias("words"),
                        ),
                    ),
                )
            ).alias("found"),
        ),
    )

    def hides(y: Column, x: Column) -> Column:
        inside = (y["start"] <= x["start"]) & (y["start"] + y["words"] >= x["start"] + x["words"])
        same = y["priority"] == x["priority"]
        longer = (y["words"] > x["words"]) | ((y["words"] == x["words"]) & (y["rule"] < x["rule"]))
        return inside & ((y["priority"] < x["priority"]) | (same & longer))

    kept = F.flatten(
        F.transform(
            F.col("_placed"),
            lambda b: F.filter(b["found"], lambda x: (x["start"] >= b["core"]) & (x["start"] < b["core"] + CORE) & ~F.exists(b["found"], lambda y: hides(y, x))),
        )
    )
    return {"_words": words, "_blocks": blocks, "_chosen": chosen, "_found": found, "_placed": placed, "detections": kept}


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` (doc_id and a text column) with its license labels.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections: the matches that
    stay, as structs of rule, priority, weight, label, start and words.
    """
    t = F.col("_t")
    places = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked_words(F.col(text)).alias("_t"))
    for name, column in {"_t": spaced_words(t), "_base": base_places(t), **detections(t)}.items():
        places = places.withColumn(name, column)
    counted = places.select(
        "doc_id",
        _count(t).cast("long").alias("n_words"),
        F.aggregate("_base", F.lit(0).cast("long"), lambda total, p: total + p["n"]).alias("n_base"),
        F.array_min("_base.first").alias("first_word"),
        F.array_max("_base.last").alias("last_word"),
        F.sort_array(F.array_distinct("_base.label")).alias("_base"),
        "detections",
    )
    score = F.greatest(F.coalesce(F.array_max(F.col("detections.weight")), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0)))
    return counted.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", F.col("detections.label"))), ",").alias("labels"),
        score.alias("score"),
        "detections",
    )


def _sql() -> str:
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    listed = ",\n".join(f"({r.rule}, {r.priority}, {r.weight}, {quoted(r.label)}, {quoted(r.keyword)}, {quoted(r.pattern)})" for r in rules())
    gate = " (?:" + "|".join(sorted({r.keyword for r in rules()})) + ") "
    phrases = ", ".join(f"({quoted(''.join(f' {w} ' for w in phrase.split()))}, {len(phrase.split())}, {quoted(label)})" for phrase, label in BASE.items())
    words = "(len({0}) - len(replace({0}, ' ', ''))) // 2"
    return rf"""
WITH rules(rule, priority, weight, label, keyword, pattern) AS (VALUES {listed}),
phrases(phrase, size, label) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT r, doc_id, len(words)::BIGINT AS n_words, CASE WHEN len(words) > 0 THEN ' ' || array_to_string(words, '  ') || ' ' ELSE '' END AS t FROM d),
b AS (SELECT r, size, label, unnest(range(1, len(string_split(t, phrase)))) AS i, string_split(t, phrase) AS pieces FROM t, phrases WHERE contains(t, phrase)),
p AS (SELECT r, label, list_sum(list_transform(pieces[:i], lambda x: {words.format('x')})) + (i - 1) * size AS start FROM b),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
g AS (SELECT r, t FROM t WHERE regexp_matches(t, '{gate}')),
m AS (SELECT r, rule, priority, weight, label, string_split_regex(t, pattern) AS pieces, regexp_extract_all(t, pattern) AS matches FROM g JOIN rules ON contains(t, ' ' || keyword || ' ') AND regexp_matches(t, pattern)),
u AS (SELECT r, rule, priority, weight, label, pieces, matches, unnest(range(1, len(matches) + 1)) AS i FROM m),
f AS (SELECT r, rule, priority, weight, label, list_sum(list_transform(pieces[:i], lambda x: {words.format('x')})) + coalesce(list_sum(list_transform(matches[:i - 1], lambda x: {words.format('x')})), 0) AS start,
  {words.format('matches[i]')} AS size FROM u),
k AS (SELECT * FROM f AS x WHERE NOT EXISTS (SELECT 1 FROM f AS y WHERE y.r = x.r AND y.start <= x.start AND y.start + y.size >= x.start + x.size
  AND (y.priority < x.priority OR y.priority = x.priority AND (y.size > x.size OR y.size = x.size AND y.rule < x.rule)))),
s AS (SELECT r, max(weight) AS weight FROM k GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM k UNION SELECT r, label FROM p) GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(weight, 0), CASE WHEN n_base > 0 THEN {BASE_WEIGHT} ELSE 0 END)::DOUBLE AS score
FROM t LEFT JOIN base ON base.r = t.r LEFT JOIN s ON s.r = t.r LEFT JOIN l ON l.r = t.r
"""


SQL = _sql()
