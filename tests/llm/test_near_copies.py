"""Near copies of the pipeline against brute-force Jaccard similarity."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cohortline.llm import minhash, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def near_copies(count=12, copies=6):
    """Texts of 100 to 400 words with copies that have one to nine words changed."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(count):
        words = [f"w{n}" for n in rng.integers(0, 900, rng.integers(100, 400))]
        rows.append((1000 + 20 * k, " ".join(words), "a"))
        for copy in range(1, copies + 1):
            changed = list(words)
            for at in rng.integers(0, len(words), rng.integers(1, 10)):
                changed[at] = f"edit{at}"
            rows.append((1000 + 20 * k + copy, " ".join(changed), "b"))
    return rows


def test_near_copy_groups_match_brute_force(documents, odd_rows):
    rows = odd_rows + near_copies() + [(3000, "ONE two\nthree  four", "a")]
    got = minhash.near_copy_groups(documents(rows)).collect()
    assert len(got) == len(rows)
    sets = {i: shingle_set(t) for i, t, _ in rows if i is not None}
    names = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    assert sum(similarity(sets[a], sets[b]) < 1 for a, b in pairs) > 50
    for _ in names:
        for a, b in pairs:
            names[a] = names[b] = min(names[a], names[b])
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == names


def large_group(count=400, changed=12):
    """Copies of one text with as many words changed that two of them are mostly, but not always, less alike than 0.8."""
    rng = np.random.default_rng(5)
    base = [f"w{n}" for n in rng.integers(0, 5000, 500)]
    rows = []
    for i in range(count):
        words = list(base)
        for at in rng.choice(500, int(rng.integers(2, changed)), replace=False):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words), "a"))
    return rows


def test_a_large_group_of_unlike_copies(documents):
    rows = large_group()
    got = {r["id"]: r["component_id"] for r in minhash.near_copy_groups(documents(rows)).collect()}
    sets = {i: shingle_set(t) for i, t, _ in rows}
    names = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    assert 0.3 < len(pairs) / (400 * 399 / 2) < 0.99
    for _ in names:
        before = dict(names)
        for a, b in pairs:
            names[a] = names[b] = min(names[a], names[b])
        if names == before:
            break
    assert got == names


@pytest.mark.parametrize("block", [4, 1000])
def test_blocks_connect_what_similar_pairs_connect(shipped, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 40), 1 << 40, 9000)
    sets = {}
    for v in range(60):  # the last few are long
        own = base[: 120 if v < 55 else 9000]
        sets[v - 30] = set(own[rng.random(len(own)) < rng.uniform(0.75, 1)].tolist()) | set(rng.integers(0, 1 << 40, 8).tolist())
    members = [(key, v, v // 4) for v in sets for key in (1, 2) if key == 1 or v % 3 == 0] + [(3, 500, 1), (3, 501, 2)]
    sets |= {500: {1}, 501: {2}}
    frame = shipped.createDataFrame([(v, sorted(s)) for v, s in sets.items()], "value long, shingles array<long>")
    found = minhash._blockwise(shipped.createDataFrame(members, "key long, value long, group long"), frame, 0.8).collect()
    across = [(a, b) for a in sets for b in sets if a < b and a // 4 != b // 4 and similarity(sets[a], sets[b]) >= 0.8]
    assert len(across) > 20

    def named(edges):
        names = {v: v for v in sets}
        for _ in names:
            for a, b in edges:
                names[a] = names[b] = min(names[a], names[b])
        return names

    assert named([(r["a"], r["b"]) for r in found]) == named(across)


def test_fingerprints_find_what_no_band_finds(documents, shipped):
    """Equal fingerprints are candidates; which of them are near copies, the exact similarity says."""
    rng = np.random.default_rng(480)
    words = [f"w{n}" for n in rng.integers(0, 10**6, 44)]
    edited = [*words[:20], "edit", *words[21:]]
    other = [f"v{n}" for n in rng.integers(0, 10**6, 44)]
    texts = [" ".join(["all day long we sing"] * 200 + tail) for tail in (words, edited, other)]
    assert len({simhash.simhash(text, minhash.SHINGLE_WORDS) for text in texts}) == 1
    assert similarity(*map(shingle_set, texts[:2])) >= 0.8 > similarity(*map(shingle_set, texts[1:]))
    counts = np.array([len(text.split()) for text in texts])
    keys = minhash.band_keys(*minhash.shingle_runs([text.encode() for text in texts], counts))
    assert not set(keys[0]) & set(keys[1])
    rows = [(i, text, "a") for i, text in enumerate(texts)] + [(3, "all day", "a"), (4, "all night", "a")]
    kept = corpus_pipeline.without_near_copies(shipped, documents(rows), "").collect()
    assert {r["doc_id"] for r in kept} == {0, 2, 3, 4}


def test_pipeline_drops_edited_copies(documents, odd_rows, shipped):
    rows = odd_rows + near_copies()
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(shipped, documents(rows), "").collect()}
    sets = {i: shingle_set(t) for i, t, _ in rows}
    assert kept >= {1, 2, 4, None}
    assert not [1 for a in kept for b in kept if None not in (a, b) and a < b and similarity(sets[a], sets[b]) >= 0.8]


def test_another_text_of_a_dropped_id_stays(documents, shipped):
    rows = [(1, "the same few words here", "a"), (5, "the same few words here", "a"), (5, "quite other words stand here", "a")]
    kept = corpus_pipeline.without_near_copies(shipped, documents(rows), "").collect()
    assert sorted((r["doc_id"], r["text"][:3]) for r in kept) == [(1, "the"), (5, "qui")]


def test_stages_keep_columns_whose_names_they_use(shipped):
    """Columns with the names of helper columns come back as they are."""
    helpers = ["_nth", "_id", "_size", "_taken", "_copy", "_words", "_key", "_hashed", "_spans", "_value", "a.b"]
    texts = ["password = hunter2secret one", "a few plain words of no weight at all", "a few plain words of no weight at all", None, ""]
    rows = [(i, t, "en", "s", len(t or ""), *range(10 * i, 10 * i + len(helpers))) for i, t in enumerate(texts)]
    kinds = ", ".join(f"`{h}` long" for h in helpers)
    docs = shipped.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")
    for stage, ids in (
        (corpus_pipeline.without_near_copies, {0, 1, 3}),
        (corpus_pipeline.without_secrets, {0, 1, 2, 3, 4}),
        (corpus_pipeline.mixed, {0, 1, 2}),
    ):
        got = stage(shipped, docs, "").collect()
        assert {r["doc_id"] for r in got} == ids, stage
        for r in got:
            assert r.asDict().keys() == set(docs.columns)
            assert [r[h] for h in helpers] == list(range(10 * r["doc_id"], 10 * r["doc_id"] + len(helpers)))


@pytest.mark.parametrize("stage", ["without_toxic", "without_near_copies", "tokens"])
def test_batches_of_stages_with_python_are_bounded(documents, shipped, tmp_path, stage):
    """A task's long texts do not reach Python in one batch."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    shipped.conf.unset(setting)
    docs = documents([(i, "some words " * 50_000, "a") for i in range(24)]).coalesce(1)
    shipped.createDataFrame([(0, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    getattr(corpus_pipeline, stage)(shipped, docs, str(tmp_path))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 16
    shipped.conf.set(setting, "64m")
    getattr(corpus_pipeline, stage)(shipped, docs, str(tmp_path))
    assert shipped.conf.get(setting) == "64m"
    shipped.conf.unset(setting)
