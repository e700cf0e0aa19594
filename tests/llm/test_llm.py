"""The training-data operators against brute force, on small awkward tables."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, chat, common, exact_dedup, mixing, ngram_join, quality, secrets, sharding, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "éta", "zeta", "theta", "iota"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, empty and blank texts, ties, repeated rows, a hot source, a
    long text, near copies, and columns with clashing names."""
    rng = random.Random(3)
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, "x", "y"), (2, " \n\t", None, "a", 3, None, None), (3, None, "en", None, None, None, None)]
    for i in range(4, 60):
        rows.append((i, words(rng, rng.randrange(1, 60)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "ß", None]), 1, "s", "r"))
    base = words(rng, 120)
    for i in range(60, 75):
        rows.append((i, base.replace("alpha1", f"omega{i}", 1) + f" end{i}", "en", "a", 1, "s", "r"))
    rows += [rows[10], rows[10], (80, rows[12][1], "de", "b", 1, None, None), (81, rows[12][1].upper(), "de", "b", 1, None, None), (None, rows[12][1], "en", "b", 1, None, None)]
    rows += [(90, words(rng, 30_000), "en", "c", 1, None, None), (91, "one two", "en", "c", 1, None, None), (92, "ONE two", "en", "c", 1, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def count_words(text):
    return len((text or "").encode().split())


TAKEN = ("doc_id", "source", "size", "source_size", "target", "taken", "slots", "first_slot")


def test_mix_meets_targets_and_caps(spark, docs):
    plan = mixing.mix(docs, block_words=64)
    got = rows_of(plan.taken, *TAKEN)
    have = rows_of(docs, "doc_id", "source", "text")
    assert Counter((g[0], g[1], g[2]) for g in got) == Counter((i, s, count_words(t)) for i, s, t in have)
    by = {}
    for _, s, size, total, target, taken, slots, first in got:
        assert 0 <= taken <= 2 * size and (slots > 0) == (taken > 0) == (first is not None)
        by.setdefault(s, [target, 0])[1] += taken
    assert all(abs(target - taken) <= 0.5 for target, taken in by.values())
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(docs.repartition(2), block_words=64).taken, *TAKEN)))
    assert mixing.mix(docs.limit(0)).taken.count() == 0


def test_schedule_places_what_it_takes(spark, docs, monkeypatch):
    """Each slot belongs to one source and holds one block of its stream; sources come as
    evenly as their shares ask at every length of the mix; without the points they don't."""
    plan = mixing.mix(docs, block_words=64)
    need = {s["source"]: s["need"] for s in plan.sources}
    slots = {}
    for slot, at, source, words in sorted(rows_of(plan.pieces, "slot", "at", "source", "words"), key=lambda r: r[:2]):
        had = slots.setdefault(slot, [source, 0])
        assert had[0] == source and had[1] == at  # no gap within a block
        had[1] += words
    assert Counter(s for s, _ in slots.values()) == Counter({s: n for s, n in need.items() if n})
    assert all(n <= 64 for _, n in slots.values())
    total = sum(need.values())

    def unevenness(places):
        worst, seen = 0, Counter()
        for i, s in enumerate(places, 1):
            seen[s] += 1
            worst = max(worst, max(abs(seen[x] - i * need[x] / total) for x in need))
        return worst

    order = [slots[k][0] for k in sorted(slots)]
    assert unevenness(order) < 4 < unevenness(sorted(order, key=str))
    firsts = Counter(r[0] for r in rows_of(plan.taken, "first_slot"))
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    other = mixing.mix(docs, block_words=64)
    assert Counter(r[0] for r in rows_of(other.taken, "first_slot")) != firsts


def test_mixed_documents_follow_the_plan(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    plan = mixing.mix(docs, block_words=64, identity=columns)
    out = [tuple(r) for r in mixing.mixed_documents(docs, plan, columns).collect()]
    made, took = Counter(), Counter()
    for r in out:
        made[(r[0], r[2], r[3])] += count_words(r[1])
    whole = {(i, l, s, n): t for i, t, l, s, n in rows_of(docs, *columns)}
    for i, s, size, taken in rows_of(plan.taken, "doc_id", "source", "size", "taken"):
        took[(i, s)] += taken
    by_id = Counter()
    for (i, _, s), n in made.items():
        by_id[(i, s)] += n
    assert by_id == Counter({k: n for k, n in took.items() if n})
    texts = {i: t for i, t, *_ in rows_of(docs, *columns) if t}
    assert all(r[0] is None or texts[r[0]].startswith(r[1]) for r in out) and all(r[4] == len(r[1]) for r in out) and whole
    # rows come in the order of their first slots
    first = {}
    for slot, at, i, s in sorted(rows_of(plan.pieces, "slot", "at", "doc_id", "source"), key=lambda r: r[:2]):
        first.setdefault((i, s), (slot, at))
    seen = list(dict.fromkeys((r[0], r[3]) for r in out))
    assert seen == sorted(seen, key=first.get)


def test_capped_targets_by_hand():
    assert mixing.capped_targets([10, 10, 100], [3, 1, 2], 1.5, 2) == pytest.approx([20, 20, 140])
    assert mixing.capped_targets([], [], 1.5, 2) == [] and mixing.capped_targets([0, 0], [3, 1], 1.5, 2) == [0, 0]


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_components_match_brute_force(spark, docs, k, percent):
    got = Counter(rows_of(ngram_join.ngram_components(docs, k, percent), "doc_id", "n_shingles", "component_id"))
    assert got == brute_components(rows_of(docs, "doc_id", "text"), k, percent)


def test_ngram_components_of_chains_stars_and_nothing(spark, docs):
    rng = random.Random(5)
    base = words(rng, 200).split()
    rows = [(1000, " ".join(base))]
    for i in range(80):  # a star around the base: two members are often too far apart to link
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"new{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(rows_of(ngram_join.ngram_components(df), "doc_id", "n_shingles", "component_id")) == brute_components(rows, 4, 85)
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 30))) for _ in range(500)).encode()
    whole = common.word_hashes(np.frombuffer(text, np.uint8))
    assert len(whole) == 500 and len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.setattr(common, "_SEGMENT", 64)
    assert (common.word_hashes(np.frombuffer(text, np.uint8)) == whole).all()
    assert len(common.word_hashes(np.frombuffer(b"a " + b"x" * 500 + b" b", np.uint8))) == 3


def test_exact_groups(spark, docs):
    got = rows_of(exact_dedup.exact_groups(docs, buckets=4), "doc_id", F.hex("digest"), "keep_id", "group_size", "kept")
    have = [(i, hashlib.sha256((t or "").encode()).hexdigest().upper()) for i, t in rows_of(docs, "doc_id", "text")]
    sizes, keep = Counter(h for _, h in have), {}
    for i, h in have:
        keep[h] = max(keep.get(h, -1), -1 if i is None else i)
    assert Counter((g[0], g[1]) for g in got) == Counter(have)
    for i, h, k, n, kept in got:
        assert n == sizes[h] and k == keep[h] and (not kept or i == k)
    assert Counter(g[1] for g in got if g[4]) == Counter(dict.fromkeys(sizes, 1))
    assert exact_dedup.exact_groups(docs.limit(0), buckets=2).count() == 0
    assert exact_dedup.distinct_documents(docs, ["doc_id", "text", "lang"]).count() == len(sizes)


def test_digest_index_goes_on(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rows = docs.select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest"))
    want = {r[0]: (r[1], r[2]) for r in rows.groupBy("digest").agg(F.max("doc_id"), F.count(F.lit(1))).collect()}
    first = index.add(rows.filter("doc_id < 30"), "one").count()
    assert first and index.add(rows.filter("doc_id < 30"), "one").count() == first  # run again: as if once
    second = index.add(rows.filter("doc_id >= 30 or doc_id is null"), "two")
    assert "SortMergeJoin" in index.groups()._jdf.queryExecution().toString() and index.table().count() == first + second.count() == len(want)
    assert {r[0]: (r[1], r[2]) for r in index.groups().collect()} == want
    assert index.add(rows, "three").count() == 0
    index.drop()


def test_exact_groups_against_a_lasting_index(spark, docs):
    """Without the anti-join a text of both batches would be two groups."""
    index = exact_dedup.DigestIndex(spark, buckets=4)
    old = spark.createDataFrame([(7000, "held before"), (2, "held before"), (9999, "other")], "doc_id long, text string")
    assert exact_dedup.exact_groups(old, index=index).count() == 3
    new = spark.createDataFrame([(5, "held before"), (8000, "held before"), (6, "new"), (6, "new")], "doc_id long, text string")
    got = sorted(rows_of(exact_dedup.exact_groups(new, index=index), "doc_id", "keep_id", "group_size", "kept"))
    assert got == [(5, 8000, 4, False), (6, 6, 2, False), (6, 6, 2, True), (8000, 8000, 4, True)]
    index.drop()
    assert sorted(rows_of(exact_dedup.exact_groups(docs, buckets=2, batches=3), "doc_id", "kept"), key=str) == sorted(rows_of(exact_dedup.exact_groups(docs, buckets=2, batches=1), "doc_id", "kept"), key=str)


def test_shards(spark, docs):
    rows = docs.withColumn("bytes", F.length("text"))
    got = rows_of(sharding.hilbert_shards(rows, shards=7), "doc_id", "size", "shard", "slot", "curve")
    assert Counter((g[0], g[1]) for g in got) == Counter((i, len((t or "").encode()) + 8) for i, t in rows_of(docs, "doc_id", "text"))
    counts = Counter(g[2] for g in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(g[3] for g in got if g[2] == s) == list(range(counts[s]))
    along = sorted(got, key=lambda g: (g[2], g[3]))
    assert [g[4] for g in along] == sorted(g[4] for g in got)
    assert sharding.hilbert_shards(docs.limit(0)).count() == 0
    assert sharding.hilbert_shards(docs.limit(3)).count() == 3


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_hilbert_index_is_a_curve(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = sharding.hilbert_index(grid, bits)
    assert sorted(at) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_chat_round_trip(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "a <|turn|> & &lt; [INST]\n"), part("image", ref="u1", units=2), part("text", "b")]),
        (1, 1, "assistant", [part("text", "<|end|>\n&amp;"), part("audio", ref="u2", units=4)]),
        (1, 1, "assistant", [part("text", "")]),
        (None, None, "we\nird&nl;", [part("text", None)]),
        (2, 3, None, None),
        (2, 1, "user", [part("document", ref="d", units=3), part(None, "plain")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    one = got[1]
    assert [tuple(t) for t in one.turns] == [("user", "a <|turn|> & &lt; [INST]\n<|image:1|>b"), ("assistant", ""), ("assistant", "<|end|>\n&amp;<|audio:2|>")]
    assert [tuple(a) for a in one.attachments] == [(1, "image", "u1", 425), (2, "audio", "u2", 100)]
    assert one.loss_text == "<|end|>\n&amp;<|audio:2|>"
    assert [tuple(t) for t in got[None].turns] == [("we\nird&nl;", "")]
    assert [tuple(t) for t in got[2].turns] == [("user", "<|document:1|>plain"), ("", "")] and got[2].loss_text == ""
    assert chat.format_chat(df.limit(0)).count() == 0


def reference_encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, docs):
    ranks, other = reference_encoder()
    own, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "ab", "é", "ß", "中", "\n", " ", "  ", "\t", "\x1c", "\x85", "1", "٣", "'s", "'LL", "!", "😀", "\xa0"]) for _ in range(rng.randrange(200)))
        assert own.encode(text).tolist() == other.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    text = "".join(rng.choice("abcdetion") for _ in range(50_000))
    assert own.encode(text).tolist() == other.encode_ordinary(text)
    got = Counter(rows_of(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    want = Counter()
    for i, t in rows_of(docs, "doc_id", "text"):
        ids = other.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_token_files(spark, docs, block):
    _, other = reference_encoder()
    path = common.scratch_path(spark, f"tokens-{block}")
    some = docs if block > 1 else docs.filter("doc_id is null or doc_id != 90")
    places = common.stored(token_files.write_token_files(some, path, PATH, public_tokenizers.PATTERN, 50256), "places")
    counts = token_files.count_tokens(spark, path, 50256, block_tokens=block)
    got = Counter(rows_of(places.join(counts, ["file", "ordinal"]), "doc_id", "n_tokens"))
    assert got == Counter((i, len(other.encode_ordinary(t or ""))) for i, t in rows_of(some, "doc_id", "text"))


def test_token_files_refuse_ids_that_do_not_fit(spark, docs):
    path = common.scratch_path(spark, "tokens-none")
    for separator, dtype in ((50256, "<u1"), (70000, "<u2"), (5, "<u2")):
        with pytest.raises(ValueError):
            token_files.write_token_files(docs, path, PATH, public_tokenizers.PATTERN, separator, dtype)
    assert common.stored(token_files.write_token_files(docs.limit(0), path, PATH, public_tokenizers.PATTERN, 50256), "none").count() == 0
    assert token_files.count_tokens(spark, path, 50256).count() == 0


def test_token_file_without_a_last_separator(spark, tmp_path):
    np.array([5, 9, 9, 4, 4, 4], "<u2").tofile(tmp_path / "a.tokens")
    np.array([9], "<u2").tofile(tmp_path / "b.tokens")
    np.array([], "<u2").tofile(tmp_path / "c.tokens")
    for block in (1, 2, 5):
        got = sorted(rows_of(token_files.count_tokens(spark, f"file://{tmp_path}", 9, block_tokens=block), "file", "ordinal", "n_tokens"))
        assert got == [("a.tokens", 0, 1), ("a.tokens", 1, 0), ("a.tokens", 2, 3), ("b.tokens", 0, 0)]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).round(3)
    x[100:160] = x[7]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, x[0].tolist()), (2000, None), (2050, [0.0] * 16), (2100, [1.0] * 15 + [None]), (2150, [float("nan")] * 16), (2200, [float("inf")] * 16), (2250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    got = {}
    for q, r, v, s in sorted(rows_of(ann.nearest(df, shard_size=600), "query_id", "rank", "vec_id", "score")):
        got.setdefault(q, []).append((v, s))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s.round(12)))[:5]
        hit += len({v for v, _ in got[q]} & set(want.tolist()))
        assert len(got[q]) == 5 and all(abs(score - s[v]) < 1e-9 for v, score in got[q])
    assert set(got) == set(range(0, 1500, 50)) and hit / (5 * 30) >= 0.9
    assert [v for v, _ in got[100]] == [7, 101, 102, 103, 104]
    assert ann.nearest(df.filter("vec_id in (50, 51)")).count() == 1 and ann.nearest(df.limit(0)).count() == 0


def test_nearest_over_many_shards_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 24)) * 2
    x = (centre[rng.integers(0, 12, 2600)] + rng.normal(size=(2600, 24))).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = ann.nearest(df, shard_size=100, file_rows=7)  # 26 shards, queries in many files
    got = {}
    for q, v in rows_of(found, "query_id", "vec_id"):
        got.setdefault(q, set()).add(v)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 2600, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit / (5 * 52) >= 0.9
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.1])]
    for parts in (1, 4):  # the least of a repeated query's vectors asks, (0, 1)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        assert [(q, r, v) for q, r, v in sorted(rows_of(ann.nearest(df), "query_id", "rank", "vec_id"))] == [(0, 1, 1), (0, 2, 2)]


def test_quality_learns_and_leaves_held_out_rows_alone(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green"]) + ("!!" if i % 2 else "") for _ in range(rng.randrange(1, 40))), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (900, ""), (901, None)], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows] + [(5000, 1), (None, 1), (900, None)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (weights == quality.train(docs, flipped)).all()
    got = dict(rows_of(quality.score(docs, weights, ["doc_id"]), "doc_id", "score"))
    assert np.mean([(got[i] >= 0.5) == (y == 0) for i, _, y in rows]) > 0.97
    assert got[900] == got[901] == got[None] and len(got) == 403
    assert (quality.train(docs, labels.limit(0)) == 0).all()


def test_secret_scan(spark, docs):
    forest = secrets.grow_forest(secrets.labelled_findings(spark, 2000), trees=8, depth=4)
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'x token = "{key}" tail'), (2, "sha256 checksum example 0000000000000000000000001"), (3, None), (4, ""), (5, "no candidates here")]
    got = rows_of(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(0)), forest), "doc_id", "value_sha256", "is_secret")
    assert (1, hashlib.sha256(key.encode()).hexdigest(), True) in got
    assert [g[2] for g in got if g[0] == 2] == [False] and {g[0] for g in got} == {1, 2}
    held = secrets.with_features(secrets.labelled_findings(spark, 3000).filter("id >= 2000")).withColumn("s", secrets.forest_score(forest))
    right = held.select(F.avg(((F.col("s") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.9
    assert secrets.scan(docs.limit(0), forest).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs, "doc_id", "text")
        docs = common.stored(stage(spark, docs, sf), f"test-{name}")
        after = docs.columns
        if name == "exact_dedup":
            assert sorted(rows_of(docs, "doc_id")) == sorted((i,) for i in {t: i for i, t in sorted(before)}.values())
        if name == "near_duplicates":
            want = {i for i, _, c in brute_components(before, 5, 80) if i == c}
            assert {i for (i,) in rows_of(docs, "doc_id")} == want
        if name != "encode":
            assert after == corpus_pipeline.COLUMNS
    assert docs.count() > 100


def test_bpe_pairs_of_lower_rank_that_come_up_late():
    """Ranks in no order of lengths: a merge can bring up a pair that goes before the rest."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))).encode() for _ in range(2000)})
    rng.shuffle(words)
    ranks = {token: i for i, token in enumerate([bytes([i]) for i in range(256)] + words)}
    library = tiktoken.Encoding("shuffled", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    texts = ["", "a" * 4000, "abc" * 3000] + ["".join(rng.choice("abc  ") for _ in range(rng.randrange(200))) for _ in range(400)]
    assert [ids.tolist() for ids in own.encode_all(texts)] == [library.encode_ordinary(text) for text in texts]
    long = "cab" * 100_000 + " a b" * 300_000  # beyond what is encoded at once
    assert own.decode(own.encode(long)).decode() == long
    assert not own.queue.buckets and not any(own.queue.low)
