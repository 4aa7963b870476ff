"""Duplicate and rule operators against brute force, with odd inputs, and the pipeline."""

import collections
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import components, exact_dedup, harmonic_packing, host_rules, jaccard_forest, quality_model, queries, repeat_index, storage

WORDS = "river stone bridge meadow night water morning valley road hill house tree cloud rain wind".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def corpus():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    texts = base + [base[0], base[1].replace(" ", "\n  "), base[2] + " tail", base[3], "", None, " \n", prose(rng, 3000)]
    long = next(t for t in base if len(t.split()) > 100)
    near = [" ".join(w if rng.random() > 0.01 else "changed" for w in long.split()) for _ in range(30)]
    shared = prose(rng, 60)
    texts += near + [prose(rng, 20) + " " + shared + " " + prose(rng, 30) for _ in range(6)] + ["ing " * 300, "é" * 150, "short one"]
    return [(i, t, "k", "s") for i, t in enumerate(texts)] + [(3, "repeated key", None, None), (4, base[4], None, None), (None, base[5], "x", None)]


ROWS = corpus()
SCHEMA = "doc_id long, text string, norm string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(text):
    return re.sub(r"[ \t-\r]+", "", text or "")


def test_exact_duplicates(docs):
    groups = collections.defaultdict(list)
    for key, text, *_ in ROWS:
        groups[squeezed(text)].append((-len(text or ""), key is None, key or 0))
    rows = exact_dedup.exact_duplicates(docs).collect()
    want = []
    for norm, members in groups.items():
        members.sort()
        for place, (_, null, key) in enumerate(members):
            want.append((None if null else key, None if members[0][1] else members[0][2], len(members), place == 0, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows))) == sorted(map(repr, want))
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_exact_duplicates_split_one_text_over_ranges(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text").otherwise(F.concat(F.lit("other"), F.col("id"))).alias("text"))
    rows = exact_dedup.exact_duplicates(docs, salts=16)
    hot = rows.filter("group_size > 1")
    assert hot.select("group_size", "keep_id").distinct().collect() == [(1667, 0)] and hot.filter("kept").count() == 1 and rows.count() == 5000


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^ \t-\r]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_host_measures(spark, docs):
    extra = spark.createDataFrame([(900, "a b c a b c\na b c\n\na b c\n##|<"), (901, "x x x x")], "doc_id long, text string")
    rows = host_rules.host_quality(docs.select("doc_id", "text", F.col("norm").alias("source"), F.lit(1).alias("n")).unionByName(extra.withColumns({"source": F.lit(None).cast("string"), "n": F.lit(1)}))).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    want = collections.Counter((k, *brute_measures(t)) for k, t, *_ in [*ROWS, (900, "a b c a b c\na b c\n\na b c\n##|<"), (901, "x x x x")])
    assert got == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_hosts_are_judged_by_shrunk_rates(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, f"host{i % 10}") for i in range(500)] + [(1000 + i, "bad", "mill") for i in range(200)] + [(2000, good, "mill"), (3000, "bad", "tiny"), (3001, good, "tiny"), (3002, good, "tiny"), (3003, good, None)]
    kept = {r.doc_id: r.kept for r in host_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not kept[2000] and kept[3001] and kept[3002] and not kept[3000] and kept[3003] and all(kept[i] for i in range(500))


def gram_set(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_classes(rows):
    sets = [gram_set(t) for _, t, *_ in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root, out = list(range(len(rows))), []
    for _ in rows:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(rows))]
    for i, (key, *_) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((key, min(keys) if keys else None, len(linked[i])))
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_classes(docs, block):
    rows = jaccard_forest.jaccard_classes(docs, block=block).collect()
    assert sorted(map(repr, ((r.doc_id, r.class_id, r.n_links) for r in rows))) == sorted(map(repr, brute_classes(ROWS)))


def test_prefix_is_shortened_to_the_recall():
    assert jaccard_forest.prefix_length(24, 6, 0.8, 0.9999) == 5
    assert jaccard_forest.prefix_length(200, 6, 0.8, 0.9999) == 6
    with pytest.raises(ValueError):
        jaccard_forest.prefix_length(1, 6, 0.3, 0.9999)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {n: n for link in links for n in link}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    assert len(got) == len(rows) and all(root[n] == r for n, r in got.items())
    assert all(n in got or root[n] == n for n in root)


def brute_repeats(rows, length=200):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (key, *_), d in zip(rows, data, strict=True):
        mark = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = True
        kept = bytes(b for b, m in zip(d, mark, strict=True) if not m)
        out.append((key, len(d), int(mark.sum()), int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [8192, 2])
def test_repeated_bytes(docs, group):
    rows = repeat_index.repeated_bytes(docs, group=group).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, brute_repeats(ROWS)))


def test_repeats_in_long_texts_and_hot_keys(spark, monkeypatch):
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 15) + passage + prose(rng, 15)) for i in range(60)] + [(100, "".join(prose(rng, 300) + passage for _ in range(5)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute_repeats(rows))
    monkeypatch.setattr(repeat_index, "_PIECE", 3000)
    assert sorted(map(tuple, repeat_index.repeated_bytes(docs).collect())) == want
    typed = docs.select("doc_id", repeat_index._version().alias("version"), "text")
    found = typed.mapInArrow(repeat_index._fragment_rows(200, 50), "doc_id long, version long, key long, frag long, n int, lo int, hi int, w int").cache()
    none, some = found.select("key").limit(0), found.groupBy("key").count().filter("count > 20").select("key")
    assert some.count() > 0
    assert repeat_index._counted(found, none, 4).exceptAll(repeat_index._counted(found, some, 4)).count() == 0
    found.unpersist()


def test_index_matches_counting():
    random.seed(5)
    for trial in range(60):
        length, alphabet = random.choice([3, 5, 9]), random.choice(["ab", "abc", "abcdefgh"])
        strings = ["".join(random.choices(alphabet, k=random.randint(0, 40))).encode() for _ in range(random.randint(1, 12))]
        strings += [strings[0][:20] + strings[-1], strings[0]] if trial % 3 == 0 else []
        count = collections.Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, runs in zip(strings, repeat_index.index_repeats(strings, length), strict=True):
            assert {i for a, b in runs for i in range(a, b + 1)} == {i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1}


def test_index_has_few_runs_on_repetitive_strings():
    text = prose(random.Random(1), 40).encode()
    index = repeat_index.RunIndex(np.frombuffer(text * 50, np.uint8), np.cumsum([len(text)] * 50))
    assert len(index.run_starts) < 4 * (len(text) + 50)


def test_without_repeats_keeps_rows_and_columns(docs):
    cut = repeat_index.without_repeats(docs.withColumn("n_chars", F.length("text").cast("long")))
    assert cut.columns == [*docs.columns, "n_chars"] and cut.count() == len(ROWS)
    assert cut.filter("n_chars <> length(text)").count() == 0 and cut.filter("doc_id = 7").head().text == ROWS[7][1]


def test_empty_tables(nothing):
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0
    assert host_rules.host_quality(nothing.withColumnRenamed("norm", "source")).count() == 0
    assert jaccard_forest.jaccard_classes(nothing).count() == 0 and jaccard_forest.drop_near_duplicates(nothing).count() == 0
    assert repeat_index.repeated_bytes(nothing).count() == 0 and repeat_index.without_repeats(nothing).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what the one before kept: classifier scores as given, everything after by brute force."""
    folder = Path("/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in quality_model.quality_scores(docs, labels).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    best = {}
    for key, text in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0])):
        best.setdefault(squeezed(text), (key, text))
    rows = sorted(best.values())
    rows = [(key, text) for (key, text), (_, root, _) in zip(rows, brute_classes(rows), strict=True) if key == root]
    repeats = {key: (n, removed, sha) for key, n, removed, _, sha in brute_repeats(rows)}
    stage = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = storage.stored(function(spark, stage, str(folder)), name)
        assert stage.columns == docs.columns
    got = {r.doc_id: r.text for r in stage.collect()}
    assert set(got) == set(repeats)
    assert all(len(got[k].encode()) <= n - removed for k, (n, removed, _) in repeats.items())
    assert all(hashlib.sha256(got[k].encode()).hexdigest() == sha for k, (n, removed, sha) in repeats.items() if removed == 0)
    pieces = corpus_pipeline.run(spark, str(folder))
    want = harmonic_packing.pack_documents(stage)
    total = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert pieces.select("doc_id", "doc_tokens").distinct().exceptAll(want.select("doc_id", "doc_tokens").distinct()).count() == 0
    assert pieces.agg(F.sum("length")).head()[0] == want.agg(F.sum("length")).head()[0] and set(total) <= set(pieces.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    rows = queries.QUERIES[name](spark, folder)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in rows.collect()))) == sorted(map(repr, result.fetchall()))


def test_pipeline_with_odd_inputs(spark, tmp_path):
    """Null, empty and long texts, repeated rows and keys, columns that clash with the stages' own, and an empty table."""
    rng = random.Random(8)
    good = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    junk = ["## %% && ** ## %%" * rng.randint(1, 9) for _ in range(60)]
    texts = good + junk + [None, "", " \n\t", good[0], good[1].replace(" ", "\n"), good[2] + " end", prose(rng, 9000)]
    rows = [(i, t, "en", "s", len(t or ""), "norm", 0.5, True, 7) for i, t in enumerate(texts)] + [(3, good[3], None, None, None, None, None, None, None), (None, good[4], "en", "s", 1, "x", 1.0, False, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, norm string, score double, kept boolean, part int"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    kept = {r.doc_id for r in pieces}
    # Junk goes, one of each group of copies stays, and every kept document is packed once and whole.
    assert not kept & set(range(60, 120)) and len(kept & {1, 124}) == 1 and len(kept & {2, 125}) == 1 and set(range(5, 60)) <= kept
    assert len(kept & {0, 123}) == 1 and len(kept & {4, None}) == 1
    tokens = collections.defaultdict(set)
    for r in pieces:
        assert 0 < r.length <= 4096
        tokens[r.doc_id].add(r.doc_tokens)
    assert all(len(sizes) == 1 for sizes in tokens.values())
    assert sum(r.length for r in pieces) == sum(size for sizes in tokens.values() for size in sizes)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
