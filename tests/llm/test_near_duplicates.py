"""Jaccard join, repeated passages, components and the pipeline against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import jaccard, passages
from cloakframe.llm.components import components


def words_of(rng, n):
    return [f"w{x}" for x in rng.integers(0, 100_000, n)]


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(words), n, replace=False):
        out[at] = f"e{rng.integers(0, 1_000_000)}"
    return out


def test_words_are_hashed_as_they_are_read():
    import re

    rng = np.random.default_rng(8)
    seen = {}
    for _ in range(400):
        text = "".join(rng.choice(list("abAB01 .,\n_é😀ß\x00-"), int(rng.integers(0, 60))))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hashes = jaccard.word_hashes(text).tolist()
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(jaccard.word_hashes(None)) == len(jaccard.word_hashes(" .")) == 0


def corpus():
    rng = np.random.default_rng(9)
    texts = [" ".join(words_of(rng, int(rng.integers(20, 200)))) for _ in range(40)]
    for base in range(6):
        own = words_of(rng, 150)
        texts += [" ".join(edited(rng, own, k)) for k in (0, 1, 2, 3, 4, 5, 8, 12)]
    texts += [texts[0]] * 5 + [texts[0].upper()] + ["one two", "one two", "ONE, two!", None, "", "...", "a b c d e", "a b c d e a b c d e"]
    shared = " ".join(words_of(rng, 70))
    texts += [" ".join(words_of(rng, 60)) + " " + shared + " " + " ".join(words_of(rng, 40)) for _ in range(6)]
    return texts


def plain_jaccard(texts):
    sets = [frozenset(jaccard.shingle_set(t).tolist()) for t in texts]
    links = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[j] < label[i]:
                label[i], changed = label[j], True
    n = collections.Counter(i for i, _ in links)
    return [(i, label[i], n[i]) for i in range(len(texts))]


def test_jaccard(spark):
    texts = corpus()
    df = spark.createDataFrame([*enumerate(texts), (None, "x y z")], "doc_id long, text string").withColumns({"id": F.lit(0), "key": F.lit("clash"), "size": F.lit(1)})
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.ngram_jaccard(df).collect())
    assert got == plain_jaccard(texts)
    assert jaccard.ngram_jaccard(df.limit(0)).count() == 0


def test_large_groups_are_split_and_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPLIT_ROWS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK_ROWS", 3)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.ngram_jaccard(df).collect()) == plain_jaccard(texts)


def test_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{n}" for n in range(30_000))
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, long), (3, long + " more")], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.ngram_jaccard(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 2, 1)]


def test_one_id_over_different_texts(spark):
    rng = np.random.default_rng(41)
    a, b = words_of(rng, 60), words_of(rng, 60)
    rows = [(1, a), (1, b), (2, [*a, "x"]), (3, [*b, "y"]), (4, [*b, "z"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.ngram_jaccard(df).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 1, 2)]
    got = sorted((r.doc_id, r.class_id, r.n_repeated) for r in passages.repeated_passages(df).collect())
    assert got == [(1, 1, 60), (1, 1, 60), (2, 1, 61), (3, 1, 61), (4, 1, 61)]


def test_compact_windows_partition_all_subsequences():
    values = np.random.default_rng(0).integers(0, 50, 60).astype(np.uint64)
    windows = passages.compact_windows(values, 7)
    for i in range(60):
        for j in range(i + 6, 60):
            inside = [c for low, c, high in windows if low <= i <= c <= j <= high]
            assert len(inside) == 1 and values[inside[0]] == values[i : j + 1].min()


def test_runs_are_compared_as_sets():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 12, 80).astype(np.uint64)
    got = passages.Sequence(values, 7).different
    assert got.tolist() == [len(set(values[i : i + 7].tolist())) for i in range(74)]
    line, rest = rng.integers(100, 10**9, 12).astype(np.uint64), rng.integers(100, 10**9, 100).astype(np.uint64)
    often, once = np.concatenate([np.tile(line, 8), rest[:20]]), np.concatenate([line, rest])
    often, once, n = passages.Sequence(often, 46), passages.Sequence(once, 46), len(often)
    assert passages.repeated_in(often, once, 0.8) == [] == passages.repeated_in(once, often, 0.8)
    assert passages.repeated_in(often, often, 0.8) == [(0, n)]


def plain_spans(own, other, width, threshold):
    """Runs of own against all runs of other of `width` or more."""
    own, other = own.tolist(), other.tolist()
    theirs = {frozenset(other[i:j]) for i in range(len(other) - width + 1) for j in range(i + width, len(other) + 1)}
    out = []
    for i in range(len(own) - width + 1):
        run = set(own[i : i + width])
        if any(len(run & t) >= threshold * len(run | t) - 1e-9 for t in theirs):
            out.append((i, i + width))
    return passages.merged(out)


def test_runs_are_found_wherever_they_stand():
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(10**6, 10**9, n).astype(np.uint64)
    run = new(50)
    stray = np.concatenate([run[20:21], new(100), run, new(100), run[30:31]])
    other = np.concatenate([new(30), run, new(30)])
    own, leader = passages.Sequence(other, 46), passages.Sequence(stray, 46)
    covered = lambda spans, low, high: any(s <= low and high <= e for s, e in spans)
    assert covered(passages.repeated_in(own, leader, 0.8), 30, 80)
    assert covered(passages.repeated_in(leader, own, 0.8), 101, 151)
    near = run.copy()
    near[[10, 25]] = new(2)
    far = np.concatenate([run[10:11], new(100), near, new(100), run[25:26]])
    assert covered(passages.repeated_in(own, passages.Sequence(far, 46), 0.8), 30, 80)
    differs = 0
    for n in range(300):
        width, kinds = int(rng.integers(4, 9)), int(rng.integers(3, 40))
        base = rng.integers(0, kinds, int(rng.integers(width, 40))).astype(np.uint64)
        a, b = base.copy(), np.concatenate([rng.integers(0, kinds, int(rng.integers(0, 8))).astype(np.uint64), base])
        for x in (a, b):
            x[rng.integers(0, len(x), len(x) // 6)] = rng.integers(0, kinds, len(x) // 6)
        for x, y in ((a, b), (b, a)):
            want = plain_spans(x, y, width, 0.8)
            differs += bool(want)
            assert passages.merged(passages.repeated_in(passages.Sequence(x, width), passages.Sequence(y, width), 0.8)) == want, n
    assert differs > 100


def test_runs_suffice_for_the_longest_path():
    shared = 1.0
    for _ in range(jaccard.MOST_STEPS):
        shared = 1 - np.exp(-shared)
    assert (1 - shared) ** jaccard.runs(0.8, 0.9999) <= 1e-4
    assert jaccard.first_keys(np.arange(1, 2000, dtype=np.uint64), jaccard.runs(0.8, 0.9999), 0.8).size


def test_runs_suffice_for_sketches_of_any_share():
    n = jaccard.runs(0.8, 0.9999)
    assert jaccard.missed(0.8, n) <= 1e-4 < jaccard.missed(0.8, n - 1)


def test_splits_follow_equal_slots(spark):
    rng = np.random.default_rng(50)
    one, far = (rng.integers(0, 256, jaccard.SLOTS).astype(np.uint8) for _ in range(2))
    near = one.copy()
    near[rng.choice(jaccard.SLOTS, jaccard.SLOTS // 5, False)] ^= 1
    reps = spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in enumerate((one, one, near, far))], "node long, sketch binary")
    paths = spark.range(2000).select(F.xxhash64("id").alias("key"))
    children = jaccard._split(reps.select("node").crossJoin(paths), reps, 0.8, 1).toPandas()
    keys = [set(children.key[children.node == n]) for n in range(4)]
    assert keys[0] == keys[1] and abs(len(keys[0]) / 2000 - 1.25) < 0.1
    assert abs(len(keys[0] & keys[2]) / len(keys[0]) - 77 / 96) < 0.05
    assert len(keys[0] & keys[3]) < 60


def test_pairs_of_two_collisions_are_compared(spark):
    """Near copies at the threshold under exactly two of the hash functions; four of five shingles are common."""
    rng = np.random.default_rng(12)
    texts: list[str] = []
    while len(texts) < 24:
        one = words_of(rng, 50)
        other = [f"x{len(texts)}", *one[1:-4], *words_of(rng, 4)]
        a, b = passages.shingles(" ".join(one)), passages.shingles(" ".join(other))
        least = [jaccard.mixes(x, range(512, 512 + passages.FUNCTIONS)).min(1) for x in (a, b)]
        if (least[0] == least[1]).sum() == 2:
            texts += [" ".join(one), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()} == {n: n - n % 2 for n in range(24)}


def test_passages_of_members_that_do_not_lead(spark):
    """A sentence common to many documents; pairs in the middle of the ids share a longer passage around it."""
    rng = np.random.default_rng(21)
    common, texts = words_of(rng, 40), []
    for _ in range(40):
        texts.append([*words_of(rng, 60), *common, *words_of(rng, 60)])
    for n in range(10, 30, 2):
        passage = [*words_of(rng, 5), *common, *words_of(rng, 5)]
        for m in (n, n + 1):
            texts[m] = [*words_of(rng, 60), *passage, *words_of(rng, 60)]
    df = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert {n: r.class_id for n, r in got.items()} == {n: n - n % 2 if 10 <= n < 30 else n for n in range(40)}
    sequences = [passages.Sequence(passages.shingles(" ".join(t)), 46) for t in texts]
    for n, r in got.items():
        want = passages.merged([s for m in range(40) if m != n for s in passages.repeated_in(sequences[n], sequences[m], 0.8)])
        assert [(s.start, s.end) for s in r.spans] == [(a, b + 4) for a, b in want]


def test_repeated_passages(spark):
    texts = corpus()
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").withColumns({"id": F.lit(0), "key": F.lit("clash"), "leader": F.lit(1)})
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in passages.repeated_passages(df).collect()}
    assert len(got) == len(texts)
    sequences = [passages.Sequence(passages.shingles(t), 46) for t in texts]
    for i in range(len(texts)):
        want = passages.merged([s for j in range(len(texts)) if i != j for s in passages.repeated_in(sequences[i], sequences[j], 0.8)])
        assert bool(want) == bool(got[i]), i
    shared = [got[i] for i in range(len(texts) - 6, len(texts))]
    # runs of 50 words of which four fifths match reach up to five words over the passage at either side
    assert shared == [[(55, 135)]] * 6
    assert passages.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(n, n + 1) for n in range(40)], [(5, n) for n in range(30)] + [(100, 101), (102, 101), (7, 7)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(df).collect()}
    assert {n: got.get(n, n) for n in label} == label


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p
    from cloakframe.llm.queries import bpe_digests

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = p.run(spark, sf_dir).collect()
    kept = p.language(spark, docs, sf_dir)
    kept = p.near_duplicates(spark, kept, sf_dir)
    assert tuple(kept.columns) == p.COLUMNS
    rows = kept.collect()
    label = plain_jaccard([r.text for r in docs.orderBy("doc_id").collect()])
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    groups = {ids[i]: ids[c] for i, c, _ in label}
    assert {r.doc_id for r in rows} == set(groups.values())
    rest = p.secret_spans(spark, p.benchmark_leaks(spark, kept, sf_dir), sf_dir)
    want = {tuple(r) for r in bpe_digests(rest).collect()}
    assert {tuple(r) for r in out} == want and len(out) == len(want)


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline as p

    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "secret=abcdefghijklmnop here", "en", "s", 27), (3, "secret=abcdefghijklmnop here", "en", "s", 27), (None, "the of and", "en", "s", 10), (4, "the and of " * 20_000, None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            got = stage(spark, df, sf_dir)
            assert name == "token_ids" or tuple(got.columns) == p.COLUMNS
            got.collect()
    clean = {r.doc_id: r for r in p.secret_spans(spark, docs, sf_dir).collect()}
    assert clean[3].text == "[SECRET] here" and clean[3].n_chars == 13


def test_rows_of_one_id_or_none_are_kept(spark, sf_dir):
    import corpus_pipeline as p

    rng = np.random.default_rng(31)
    one, two, three, four = (" ".join(words_of(rng, 40)) for _ in range(4))
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(1, one), (1, two), (1, two), (2, two), (None, three), (None, four), (None, four), (None, one), (3, leak), (3, "a b c d e f g"), (None, leak + " more words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.near_duplicates(spark, docs, sf_dir)
    assert {(r.doc_id, r.text) for r in kept.collect()} >= {(1, one), (1, two), (None, three), (None, four), (3, "a b c d e f g")}
    assert sum(r.text in (one, two, three, four) for r in kept.collect()) == 4
    assert {(r.doc_id, r.text) for r in p.benchmark_leaks(spark, docs, sf_dir).collect()} == {r for r in rows if leak not in r[1]}


def sent_to_all(plan):
    """The parts of a plan, as text, that are broadcast."""
    parts, lines = [], plan.splitlines()
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = lines[n + 1 :]
            end = next((k for k, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))
            parts.append("\n".join(below[:end]))
    return parts


def test_bucket_rows_are_never_broadcast(spark, monkeypatch):
    """Their size is taken for that of the column of keys before explode, so a small estimate may stand for any number."""
    plans = []

    def written(df, label, write=jaccard.written):
        if label == "buckets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(jaccard, "written", written)
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    jaccard.ngram_jaccard(docs)
    assert plans and "explode(keys" in plans[0]
    above = [part.split("explode(keys")[0] for part in sent_to_all(plans[0]) if "explode(keys" in part]
    assert all("HashAggregate" in x for x in above)  # sums of large buckets may be: they are few


def test_near_duplicate_stage_broadcasts_no_bucket_rows(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    plans = []

    def written(df, label, write=jaccard.written):
        if label == "buckets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(jaccard, "written", written)
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    above = [part.split("explode(keys")[0] for part in sent_to_all(plans[0]) if "explode(keys" in part]
    assert all("HashAggregate" in x for x in above)


def test_late_comparisons_are_with_members_that_can_hold_the_run(spark, monkeypatch):
    """Documents that share a passage, and behind it words in common with one other alone: such runs ask that one, not all."""
    rng = np.random.default_rng(31)
    shared, texts = words_of(rng, 44), []
    for _ in range(30):
        tail = words_of(rng, 3)
        for _ in range(2):
            texts.append(" ".join(words_of(rng, 30) + shared + tail + words_of(rng, 30)))
    compared = []

    def written(df, label, write=passages.written):
        out = write(df, label)
        if label == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(passages, "written", written)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeated for r in passages.repeated_passages(df).collect()}
    assert all(got[n] >= 50 for n in range(60))
    assert sum(compared[2:]) < 200, compared


def passages_in_groups():
    """Documents that share a passage, pairs of them some words more behind it, and near copies of one; their runs differ."""
    rng = np.random.default_rng(32)
    shared, texts = words_of(rng, 44), []
    for _ in range(12):
        tail = words_of(rng, 3)
        for _ in range(2):
            texts.append(words_of(rng, 30) + shared + tail + words_of(rng, 30))
    copy = words_of(rng, 120)
    for n in range(20):
        texts.append([*copy[:n], f"y{n}", *copy[n:60], f"z{n}", *copy[60 + n % 3 :]])
    texts.append(words_of(rng, 10) + ["again"] * 80 + copy[:55])
    return [" ".join(t) for t in texts]


def test_members_of_a_leader_are_compared_in_one_cell(spark, monkeypatch):
    """No table has a row for each shingle by key; passages are those of a comparison of all pairs."""
    labels = []

    def written(df, label, write=passages.written):
        labels.append(label)
        return write(df, label)

    monkeypatch.setattr(passages, "written", written)
    texts = passages_in_groups()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in passages.repeated_passages(df).collect()}
    assert not {"values", "holders", "open"} & set(labels)
    own = [passages.Sequence(passages.shingles(t), 46) for t in texts]
    for n, spans in got.items():
        want = passages.merged([s for m in range(len(texts)) if m != n for s in passages.repeated_in(own[n], own[m], 0.8)])
        assert spans == [(a, b + 4) for a, b in want], n


def test_large_cells_are_compared_in_rounds(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(passages_in_groups())), "doc_id long, text string")
    rows = lambda: sorted((r.doc_id, r.class_id, r.n_repeated) for r in passages.repeated_passages(df).collect())
    in_cells = rows()
    monkeypatch.setattr(passages, "CELL_SHINGLES", 0)
    assert rows() == in_cells


def test_shared_keys_are_found_in_parts(spark, monkeypatch):
    """Each part of the keys is written before the next one is shuffled; together they are the rows of all."""
    rows = spark.range(4000).selectExpr("id % 37 node", "xxhash64(id % 700) key", "cast(id as int) first", "1 runs")
    parts = passages._in_parts(rows, "part", lambda kept: kept)
    assert len(parts) == passages.PARTS and all(0 < part.count() < 2400 for part in parts)
    listed = lambda df: sorted(tuple(r) for r in df.select("node", "key", "first", "runs", "low").collect())
    assert sorted(x for part in parts for x in listed(part)) == listed(passages._shared(rows))
