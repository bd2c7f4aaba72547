"""Operators on small tables with nulls, copies, ties, odd columns, and brute-force results."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import html, jaccard, language, mixing, neardup_vectors, pieces, quality, sharding, toxicity, transport

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rid string, `key` int, h double"


def docs(spark, rows):
    full = [(i, t, lang, src, None if t is None else len(t), "s", "r", 1, 0.5) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


WORDS = "on the other hand a small stone fell into deep water and nobody saw where it went after that day of rain".split()


def sentence(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near copies, nulls, empty and very short texts, a repeated row, a null id."""
    base = sentence(1, 120).split()
    near = base[:60] + ["other"] + base[61:]
    rows = [
        (5, " ".join(base), "en", "a"), (3, " ".join(near), "en", "a"), (9, " ".join(base).upper(), "en", None), (1, None, None, "b"), (2, "", "en", "b"),
        (4, "one two", "en", "b"), (6, "ONE\ttwo", None, "b"), (7, "one two three", "en", "b"), (8, sentence(2, 300), "de", "c"), (8, sentence(2, 300), "de", "c"),
        (None, " ".join(base), "en", "a"), (10, "12 !! 34", "en", "c"),
    ]
    return docs(spark, rows)


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted(((i, len(sets[k]), names.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_jaccard_against_brute_force(spark, odd):
    rng = np.random.default_rng(11)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for k in range(60):  # chains of edits, short and long
        base = rng.choice(WORDS, int(rng.integers(3, 60))).tolist()
        for j in range(int(rng.integers(1, 5))):
            rows.append((100 + 10 * k + j, " ".join(base)))
            base[int(rng.integers(len(base)))] = f"w{k}{j}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (48, 1):
        jaccard.HOT, was = hot, jaccard.HOT
        try:
            got = jaccard.jaccard_classes(spark, df)
            assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_classes(rows)
        finally:
            jaccard.HOT = was


def test_copies_of_a_row_without_id_stay_together(spark):
    near = sentence(3, 80).split()
    rows = [(None, sentence(2, 80)), (5, sentence(2, 80)), (7, sentence(2, 80)), (None, " ".join(near)), (9, " ".join(near)), (8, " ".join(near[:79] + ["x"])), (None, "no id at all here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_classes(spark, df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_classes(rows)
    assert sorted(r.component_id for r in got if r.doc_id in (5, 7, 8, 9)) == [5, 5, 8, 8]
    assert sorted(r.doc_id for r in jaccard.one_of_each(spark, df).collect() if r.doc_id is not None) == [5, 8]


@pytest.mark.parametrize("shared", [None, 7])
def test_many_rows_without_an_id_or_with_one_id(spark, shared):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(2500):  # pairs of near copies; one side has no id of its own
        base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        rows += [(1000 + k, " ".join(base)), (shared, " ".join([*base[:59], "x"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(spark, df).collect()]
    named = Counter(c for _, _, c in got)
    assert len(got) == 5000 and all(n == 56 for _, n, _ in got)
    # a missing id takes its partner's; a shared one is the smaller id of all pairs
    assert named == ({1000 + k: 2 for k in range(2500)} if shared is None else {7: 5000})
    alone = spark.createDataFrame([(shared, t) for i, t in rows if i == shared], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_classes(spark, alone).collect()} == {shared}
    left = jaccard.one_of_each(spark, df)
    assert left.count() == (5000 if shared is None else 2500) and left.filter("doc_id >= 1000").count() == (2500 if shared is None else 0)


def test_a_slice_without_wanted_sets_is_an_empty_list_of_sets():
    import pandas as pd
    import pyarrow as pa

    (none,) = jaccard._whole(5)(iter([pd.DataFrame({"text": ["a b c", None, ""], "sid": [1, 2, 3], "second": [4, 5, 6]})]))
    assert len(none) == 0 and pa.Array.from_pandas(none["h"], type=pa.list_(pa.int64())).type == pa.list_(pa.int64())


def test_one_of_each_group_stays(spark, odd):
    left = jaccard.one_of_each(spark, odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 4, 7, 8, 10]


def test_clashing_ids_lose_only_the_row_with_a_smaller_copy(spark):
    a, b = sentence(4, 60), sentence(5, 60)
    df = docs(spark, [(i, t, "en", "a") for i, t in ((5, a), (5, b), (3, b), (8, a), (5, None), (6, sentence(6, 60)), (6, sentence(6, 60)))])
    left = jaccard.one_of_each(spark, df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(3, b), (5, a), (5, None), (6, sentence(6, 60))], key=str)


def test_overlap_bounds():
    for s in range(1, 40):
        for t in jaccard.partner_sizes(s):
            c = jaccard.overlap_needed(s, t)
            assert 100 * c >= 80 * (s + t - c) and 100 * (c - 1) < 80 * (s + t - c + 1)


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    learn = F.lit(True)
    assert jaccard.jaccard_classes(spark, none).count() == 0
    assert mixing.mix(spark, none).count() == 0 and mixing.in_mixed_order(spark, none).count() == 0
    assert sharding.shard(spark, none).count() == 0
    assert transport.media_column(spark, none).count() == 0
    assert pieces.segment(spark, none).count() == 0
    assert language.identify(spark, none, learn).count() == 0
    assert toxicity.toxicity(spark, none, labels, learn).count() == 0
    assert quality.quality(spark, none, labels, learn).count() == 0
    assert html.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert neardup_vectors.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((40, 16))
    x = np.concatenate([c + 0.15 * rng.standard_normal((int(n), 16)) for c, n in zip(centre, rng.integers(1, 30, 40))])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (0, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rid", F.lit("clash"))
    for block in (1024, 32):  # the second makes components wider than a block
        got = neardup_vectors.near_duplicates(spark, df, block=block).collect()
        f32 = np.array([r[1] for r in rows if r[1] is not None and len(r[1]) == 16], np.float32).astype(float)
        ids = [r[0] for r in rows if r[1] is not None and len(r[1]) == 16]
        with np.errstate(all="ignore"):
            unit = f32 / np.linalg.norm(f32, axis=1, keepdims=True)
        hit = np.nan_to_num(unit @ unit.T) >= 0.95
        np.fill_diagonal(hit, False)
        links = sorted((i, int(n)) for i, n in zip(ids, hit.sum(1)) if i is not None and i < 9000)
        found = sorted((r.vec_id, r.n_links) for r in got if r.vec_id is not None and r.vec_id < 9000)
        assert len(got) == len(rows)
        exact = np.mean([a == b for a, b in zip(links, found)])
        assert exact == 1.0 if block == 1024 else exact > 0.98
        reach = np.linalg.matrix_power(np.eye(len(ids)) + hit, 8) > 0
        for r in got:
            if r.vec_id is not None and r.vec_id < 9000 and block == 1024:
                assert r.component_id == min(ids[k] for k in np.flatnonzero(reach[ids.index(r.vec_id)]) if ids[k] is not None)
        assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id is not None and r.vec_id > 9000)


def test_copies_and_lengths_of_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(i, base.tolist()) for i in range(100, 700)]  # far more copies than a block
    rows += [(1000 + i, (base + 0.02 * rng.standard_normal(8)).tolist()) for i in range(60)]
    rows += [(2000 + i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0]), (9, [3.0]), (10, [-1.0]), (11, []), (12, [float("inf"), 1.0]), (13, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (32, 1024):
        got = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark, df, block=block).collect()}
        x = np.array([v for _, v in rows if len(v) == 8])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hit = (x @ x.T >= 0.95).sum(1) - 1
        assert all(got[i].n_links == n for (i, _), n in zip(rows, hit))
        assert {got[i].component_id for i in (*range(100, 700), *range(1000, 1060))} == {100}
        assert [(got[i].n_links, got[i].component_id) for i in range(5, 14)] == [(1, 5), (1, 5), (0, 7), (1, 8), (1, 8), (0, 10), (0, 11), (0, 12), (0, 13)]


@pytest.mark.parametrize("dim, n", [(16, 3000), (64, 6000), (256, 4000)])
def test_recall_of_passes(spark, dim, n):
    x = skewed(0.3, n, 100, dim)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neardup_vectors.near_duplicates(spark, df, block=64).collect()}
    hit = (x @ x.T >= 0.95).sum(1) - 1
    assert sum(got.values()) >= 0.99 * hit.sum() and all(got[i] <= k for i, k in enumerate(hit))


def skewed(background, n, pairs, dim=64, seed=5):
    """Vectors with a common direction, and pairs of them at cosine 0.955."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(background) * unit(rng.standard_normal(dim)) + np.sqrt(1 - background) * unit(rng.standard_normal((n, dim))))
    w = rng.standard_normal((pairs, dim))
    w = unit(w - (w * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    return np.concatenate([x, 0.955 * x[:pairs] + np.sqrt(1 - 0.955**2) * w])


def test_skewed_vectors_keep_their_pairs(spark):
    for background, block in ((0.9, 16), (0.5, 64)):  # all pairs; passes
        x = skewed(background, 5000, 150)
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in neardup_vectors.near_duplicates(spark, df, block=block).collect()}
        hit = (x @ x.T >= 0.95).sum(1) - 1
        assert hit.sum() >= 300 and sum(got.values()) >= 0.99 * hit.sum() and all(got[i] <= n for i, n in enumerate(hit))


def test_passes_follow_from_density():
    n, block = 1_000_000, 1024
    radius = lambda background: np.full(8, np.sqrt(1 - background))
    even, dense = np.full((8, 4), 10), np.full((8, 4), 14)
    few = neardup_vectors.passes_for(even, radius(0.0), n, block=block)
    assert few < neardup_vectors.passes_for(dense, radius(0.0), n, block=block) < neardup_vectors.passes_for(dense, radius(0.5), n, block=block)
    assert neardup_vectors.passes_for(even, radius(0.8), n, block=block) > 24  # no cap below what is needed
    assert neardup_vectors.passes_for(np.full((8, 4), 48), radius(0.8), n, block=block) is None


def test_shards_are_near_equal_and_gapless(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), sentence(i, int(rng.integers(1, 60))), "en", "a") for i in range(1500)] + [(7, "x" * 500, "en", "a")] * 400 + [(None, None, None, None)] * 5
    out = sharding.shard(spark, docs(spark, rows), n_shards=8).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"}
    size, slots = {}, {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(size) == list(range(8)) and max(size.values()) - min(size.values()) <= 2 * 520
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {(i, t) for i, t, _, _ in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}


def test_mixture_keeps_windows_and_all_rows(spark, odd, tmp_path):
    rows = [(i, "t", "en", "abcd"[min(3, i % 7)]) for i in range(3000)] + [(None, None, None, None)] * 3
    out = mixing.mix(spark, docs(spark, rows), block_rows=4).collect()
    assert len(out) == 3003 and len({r.position for r in out}) == 3003
    assert all(r.release <= r.slot < r.deadline for r in out)
    slots = {(r.source, r.block): r.slot for r in out}
    assert len(set(slots.values())) == len(slots)
    order = sorted({(r.position // 4, r.slot) for r in out})
    assert [p for p, _ in order] == list(range(len(slots))) and sorted(s for _, s in order) == [s for _, s in order]
    some = {"a": 0, "b": 1e-6, "c": 3, "d": 1, None: 2}
    last = [r.source for r in sorted(mixing.mix(spark, docs(spark, rows), weights=some).collect(), key=lambda r: r.position)]
    assert last.index("a") == 3003 - last.count("a")
    with pytest.raises(ValueError):
        mixing.mix(spark, odd, weights={"a": 1.0}).count()
    ordered = mixing.in_mixed_order(spark, docs(spark, rows))
    assert ordered.columns == docs(spark, rows).columns and ordered.count() == 3003
    place = {r.doc_id: r.position for r in mixing.mix(spark, docs(spark, rows)).collect()}
    path = f"{tmp_path}/mixed"
    ordered.write.parquet(path)
    back = mixing.stored_place(spark.read.parquet(path)).collect()
    back = [r.doc_id for r in sorted(back, key=lambda r: (r.mix_part, r.mix_row))]
    assert [place[i] for i in back if i is not None] == sorted(place[i] for i in back if i is not None)
    assert mixing.stored_place(docs(spark, rows)).filter("mix_part is not null").count() == 0


def test_rows_that_share_an_id_are_mixed_one_by_one(spark, tmp_path):
    rows = [(None, "t", "en", "a")] * 900 + [(7, f"t{i}", "en", "b") for i in range(900)] + [(i, "t", "en", "c") for i in range(900)]
    df = docs(spark, rows).repartition(3)
    ordered = mixing.in_mixed_order(spark, df, weights={"a": 1, "b": 1, "c": 1})
    assert ordered.columns == df.columns
    ordered.write.parquet(f"{tmp_path}/mixed")
    back = mixing.stored_place(spark.read.parquet(f"{tmp_path}/mixed")).collect()
    order = [r.source for r in sorted(back, key=lambda r: (r.mix_part, r.mix_row))]
    assert Counter(order) == {"a": 900, "b": 900, "c": 900}
    # any stretch holds each source within two blocks of its third
    for at in range(0, 2700, 90):
        assert all(abs(order[: at + 90].count(s) - (at + 90) / 3) <= 16 for s in "abc")


def test_media_keep_texts(spark, odd):
    out = {r.doc_id: r for r in transport.media_column(spark, odd).collect()}
    assert out[1].n_bytes == 0 and out[1].payload_bytes == 64 and out[2].payload_sha256 == out[1].payload_sha256
    data = odd.filter("doc_id = 8").first().text.encode()
    data += bytes(-len(data) % 64)
    assert out[8].payload_bytes == len(data) and out[8].tail_crc32 == zlib.crc32(data[-64:])


def test_language_of_whole_texts(spark, odd):
    rows = [(i, sentence(i), "en", "a") for i in range(40)]
    rows += [(100 + i, sentence(i).replace("th", "ç").replace("o", "é"), "fr", "a") for i in range(40)] + [(500, None, "en", "a"), (501, "12 !", "en", "a"), (502, "", None, "a")]
    out = {r.doc_id: r for r in language.identify(spark, docs(spark, rows), F.col("doc_id") % 4 != 2).collect()}
    assert all(out[i].lang_pred == ("en" if i < 100 else "fr") for i in out if i < 500)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (500, 501, 502))


def test_language_is_learned_from_all_of_a_text(spark):
    head = sentence(0, 2000)  # a header in another language, longer than what is learned of a text
    french = lambda i, n: sentence(i, n).replace("th", "ç").replace("o", "é")
    rows = [(i, sentence(i, 200), "en", "a") for i in range(20)] + [(100 + i, head + " " + french(i, 8000), "fr", "a") for i in range(20)]
    model = language.fit(docs(spark, rows), F.lit(True))
    out = {r.doc_id: r for r in language.predict(docs(spark, [(1, sentence(77), None, "a"), (2, french(78, 40), None, "a")]), model).collect()}
    assert (out[1].lang_pred, out[2].lang_pred) == ("en", "fr") and ord("ç") in model.alphabet


def test_too_many_languages_are_refused(spark):
    with pytest.raises(ValueError):
        language.fit(docs(spark, [(i, "text", f"l{i}", "a") for i in range(201)]), F.lit(True))


def labelled(spark, bad):
    rows = [(i, bad(i) if i % 3 == 0 else sentence(i, 60), "en", f"src{i % 3}") for i in range(300)] + [(900, None, None, None), (901, "", "en", "x")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    return docs(spark, rows), labels


def test_toxic_passages_are_found(spark):
    def bad(i):
        w = sentence(i, 60).split()
        w[20:20] = ["vile", f"scum{i % 5}", "filth"]
        return " ".join(w)

    d, labels = labelled(spark, bad)
    out = {r.doc_id: r for r in toxicity.toxicity(spark, d, labels, F.col("doc_id") % 5 != 0).collect()}
    assert len(out) == 302 and all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].predicted == int(i % 3 == 0) for i in range(300))
    first = out[3].passages[0]
    assert 19 <= first["first"] <= 21 and first["last"] <= 23
    assert out[900].predicted == out[901].predicted == 0
    model = toxicity.fit(d, labels, F.lit(True))
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and kept.count() == 202


def test_poor_documents_are_found(spark):
    d, labels = labelled(spark, lambda i: " ".join(f"{w.upper()}!!" for w in sentence(i, 30).split()) if i % 2 else "spam spam " * 20)
    out = {r.doc_id: r for r in quality.quality(spark, d, labels, F.col("doc_id") % 5 != 0).collect()}
    assert len(out) == 302 and np.mean([out[i].predicted == int(i % 3 != 0) for i in range(300)]) > 0.99
    kept = quality.keep_good(d, quality.fit(d, labels, F.lit(True)))
    assert kept.columns == d.columns and kept.filter("doc_id < 300").count() >= 198


def test_many_languages_are_learned_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(8)
    alphabets = [rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9, replace=False) for _ in range(7)]
    text = lambda k, n=30: " ".join("".join(rng.choice(alphabets[k], int(rng.integers(2, 7)))) for _ in range(n))
    rows = [(i, text(i % 7), f"l{i % 7}", "a") for i in range(70)] + [(100 + i, text(i % 7, 6), None, "a") for i in range(28)] + [(200, None, "l1", "a"), (201, "12", None, "a"), (202, "", "l2", "a")]
    df = docs(spark, rows)
    whole = sorted(map(tuple, language.predict(df, language.fit(df, F.lit(True))).collect()))
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    models = language.fit_groups(df, F.lit(True))
    assert [len(m.langs) for m in models] == [2, 2, 2, 1]
    parts = sorted(map(tuple, language.predict(df, models).collect()))
    assert [(r[0], r[1], r[3], r[4]) for r in parts] == [(r[0], r[1], r[3], r[4]) for r in whole]
    np.testing.assert_allclose([r[2] for r in parts], [r[2] for r in whole])


def test_letters_and_marks_lie_where_they_are_looked_for():
    import unicodedata

    assert not any(unicodedata.category(chr(c))[0] in "LM" for c in (*range(0x32400, 0xE0000), *range(0xE0200, 0x110000)))


def test_co_training_takes_all_documents_that_a_view_is_sure_of(spark, monkeypatch):
    monkeypatch.setattr(quality, "HANDED", 10**6)
    d, labels = labelled(spark, lambda i: " ".join(f"{w.upper()}!!" for w in sentence(i, 30).split()) if i % 2 else "spam spam " * 20)
    labels = labels.filter("doc_id < 150")
    model = quality.fit(d.repartition(5), labels, F.lit(True))
    rows = d.select(*quality._columns(d)).toPandas().sort_values("doc_id")
    y = {r.doc_id: r.quality for r in labels.collect()}
    known = rows[rows["doc_id"].isin(y)].assign(y=lambda x: [y[i] for i in x["doc_id"]]).sort_values(["y", "doc_id"], kind="stable")
    pool = rows[~rows["doc_id"].isin(y)].reset_index(drop=True)
    feats = [x.astype(np.float32).astype(float) for x in quality.view_features(pool)]

    def every(views, given, share):
        out = {}
        for to, (v, x) in {"m": ("t", feats[0]), "t": ("m", feats[1])}.items():
            p = 1 / (1 + np.exp(-views[v].logit(x)))
            take = [i for i in np.flatnonzero(np.maximum(p, 1 - p) >= quality.SURE) if i not in given[to]]
            out[to] = take, feats[{"t": 0, "m": 1}[to]][take], (p[take] >= 0.5).astype(float)
        return out

    xt, xm = (x.astype(np.float32).astype(float) for x in quality.view_features(known))
    plain = quality.co_train(xt, xm, known["y"].to_numpy(float), every)
    assert model.handed == plain.handed and sum(map(sum, plain.handed)) > 50
    for v in ("text", "meta"):
        np.testing.assert_allclose(getattr(model, v).weight, getattr(plain, v).weight, atol=1e-6)
    np.testing.assert_allclose(model.blend, plain.blend, atol=1e-6)


def test_pages_lose_what_recurs_on_their_host(spark):
    own = lambda i: f"<p>Story {i} begins {sentence(i, 12)}</p>"
    rows = [(i, "http://a.example/x", f"<body><div>Join the club</div>{own(i)}<footer>f</footer></body>") for i in range(20)]
    rows += [(100 + i, "http://b.example/x", f"<body><div>Club {i}</div>{own(i)}</body>") for i in range(20)] + [(200, None, None), (201, "", "")]
    out = {r.page_id: r for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i].text == f"Story {i} begins {sentence(i, 12)}" for i in range(20))
    assert out[105].text.startswith("Club 5\n\nStory 5") and out[105].n_chars == len(out[105].text)
    assert out[200].text == out[201].text == ""


def test_pieces_of_odd_rows(spark, odd):
    out = pieces.segment(spark, odd, n_best=3)
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.roundtrip for r in rows.values()) and rows[1].n_tokens == 0 and len(rows[8].nbest) == 3
    back = {r.doc_id: r.text for r in pieces.decode_ids(spark, out).collect()}
    assert back[7] == "one two three" and back[1] == ""
    every = out.withColumn("x", F.explode("nbest")).select("doc_id", pieces.detoured("ids", "x.detours").alias("ids"), "x.n_tokens")
    assert every.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.text == texts[r.doc_id] for r in pieces.decode_ids(spark, every).collect())


def test_sets_that_share_a_digest_stay_apart(spark):
    class Same(jaccard.Join):
        def told_apart(self, rows):  # as if all sets had one first digest
            return super().told_apart(rows.withColumn("sid", F.lit(7).cast("long")))

    near = sentence(1, 120).split()
    texts = [sentence(i, 120) for i in (1, 1, 2, 3)] + [" ".join(near[:60] + ["other"] + near[61:])]
    out = Same(spark, docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), "doc_id", "text", 5, 80).run()
    # unequal sets get names of their own, equal texts still share one
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].component_id for i in range(5)] == [0, 0, 2, 3, 0]
