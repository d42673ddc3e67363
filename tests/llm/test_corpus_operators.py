"""Toxicity, passages, licenses and embeddings on small fixtures."""

import numpy as np
import pytest

import __spark_entry__ as contract
from cohortline.llm import bpe, embeddings, licenses, passages, toxicity
from cohortline.llm.components import components

SMALL = "/root/testdata/sf0.001"


def prose(rng, count, size=500):
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(size)]
    return " ".join(rng.choice(words, count))


def test_toxicity_on_held_out_documents(documents, shipped):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        text, toxic = prose(rng, 60), int(i % 4 == 0)
        if toxic:
            text += " you " + " ".join(rng.choice(["zqxworthless", "zqxidiot", "zqxscum"], 3))
        rows.append((i, text, "a"))
        labels.append((i, 1, toxic))
    rows += [(900, None, "a"), (901, "", "a"), (902, "long " * 40_000, "a")]
    labels += [(900, 1, 0), (None, 1, 1), (903, 1, None), (3, 1, 0)]
    docs = documents(rows)
    model = toxicity.trained(docs, shipped.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = docs.select("doc_id", toxicity.held_out(docs["doc_id"]).alias("out"), toxicity.toxicity(docs["text"], model).alias("s"))
    found = {r["doc_id"]: r for r in scored.collect()}
    assert len(found) == len(rows) and all(0 <= r["s"] <= 1 for r in found.values())
    right = [(found[i]["s"] >= 0.5) == bool(t) for i, _, t in labels[:400] if found[i]["out"]]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert found[900]["s"] == found[901]["s"]


@pytest.mark.parametrize(("labels", "score"), [([], 0), ([(1, 1, 1)], 1), ([(1, 1, 0)], 0)])
def test_toxicity_without_both_classes(documents, shipped, labels, score):
    docs = documents([(1, "some text", "a")])
    model = toxicity.trained(docs, shipped.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert round(docs.select(toxicity.toxicity(docs["text"], model)).first()[0]) == score


def test_repeated_passages(documents, odd_rows):
    rng = np.random.default_rng(2)
    shared, line = prose(rng, 52), prose(rng, 60)
    edited = line.replace(line.split()[30], "changed", 1)
    rows = [(100, prose(rng, 200) + " " + shared + " " + prose(rng, 77), "a"), (101, prose(rng, 33) + " " + shared, "b")]
    rows += [(102, prose(rng, 40) + "\n" + line, "a"), (103, edited + "\n" + prose(rng, 50), "a")]
    rows += [(110 + i, prose(rng, 300), "a") for i in range(5)]
    got = passages.repeated_passages(documents(odd_rows + rows)).collect()
    assert {r["id"] for r in got} == {100, 101, 102, 103}
    assert {r["id"] for r in got if r["kept"]} == {100, 102}
    assert len({r["cluster_id"] for r in got}) == 2
    assert passages.repeated_passages(documents([])).count() == 0


def test_similar_paragraphs_match_brute_force(shipped, rows):
    rng = np.random.default_rng(6)
    base = [prose(rng, 60) for _ in range(6)]
    texts = list(base)
    for text in base:
        for _ in range(8):
            words = text.split()
            for at in rng.integers(0, 60, rng.integers(1, 4)):
                words[at] = "edit"
            texts.append(" ".join(words))
    parsed, _ = passages._parsed(texts, 25)
    values = np.array(parsed["whole"].tolist(), np.uint64).view(np.int64).tolist()
    sets = {v: set(s.tolist()) for v, s in zip(values, parsed["shingles"])}
    frame = shipped.createDataFrame(
        [(v, k.tolist(), s.tolist()) for v, k, s in zip(values, parsed["keys"], parsed["shingles"])],
        "value long, keys array<long>, shingles array<long>",
    ).dropDuplicates(["value"])
    found = dict(rows(components(passages.similar_paragraphs(frame))))
    names = {v: v for v in sets}
    for _ in names:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    names[a] = names[b] = min(names[a], names[b])
    assert all(found.get(v, v) == name for v, name in names.items())


def test_licenses_and_inheritance(shipped):
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/code.py", "plain text without one"),
        (3, "a/b/c/own.py", "# Released under the MIT License.\nmore words here and there"),
        (4, "z/code.py", None),
        (5, None, ""),
        (6, "a/b/c/d/deep.py", "words " * 20_000),
        (7, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (7, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ]
    frame = shipped.createDataFrame(files, "row long, path string, text string")
    got = licenses.scan_licenses(frame).collect()
    assert len(got) == len({f[0] for f in files}) + 1 or len(got) >= len(files)
    by_row = {r["row"]: (r["license"], r["effective"], r["inherited_from"]) for r in got}
    assert by_row[1] == ("Apache-2.0", "Apache-2.0", None)
    assert by_row[2] == (None, "Apache-2.0", "a")
    assert by_row[3] == ("MIT", "MIT", None)
    assert by_row[4] == by_row[5] == (None, None, None)
    assert by_row[6] == (None, "GPL-3.0", "a/b/c")
    assert licenses.scan_licenses(frame.limit(0)).count() == 0


def test_embedding_groups_match_brute_force(shipped):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(300, 16))
    data[200:260] = data[:60] + rng.normal(scale=0.12, size=(60, 16))
    data[260:290] = data[5] + rng.normal(scale=0.1, size=(30, 16))
    data[290:] = data[7]
    vectors = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 3, [None] * 16]
    vectors += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    frame = shipped.createDataFrame(vectors, "vec_id long, embedding array<double>, id int")
    got = {r["id"]: r for r in embeddings.near_duplicate_vectors(frame).collect()}
    assert len(got) == len(vectors)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    counted = np.array([got[i]["n_links"] for i in range(300)])
    assert (counted <= links.sum(1)).all() and counted.sum() >= 0.99 * links.sum()
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["component_id"] == 1000 + i for i in range(len(odd)))
    assert got[295]["component_id"] == got[7]["component_id"]
    assert embeddings.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_components_of_a_long_path(shipped, rows):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000), (5, None)]
    found = dict(rows(components(shipped.createDataFrame(edges, "a long, b long"))))
    assert found == {i: 0 for i in range(201)} | {1000: 1000}


NATIVE = ("op6_license_scan", "op8_secret_scan")


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(shipped, name):
    plan = contract.queries()[name](shipped, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_pipeline(shipped):
    result = contract.queries()["pipeline"](shipped, SMALL).toPandas()
    texts = [bpe.encoder(bpe.public_tokenizers.path(bpe.RANKS_FILE), bpe.public_tokenizers.PATTERN).decode(x) for x in result["ids"]]
    assert 0 < len(result) and all(len(x) == 4 * n for x, n in zip(result["ids"], result["n_tokens"]))
    assert all(t.decode() for t in texts)


def test_every_operator_is_registered():
    names = contract.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)) and "pipeline" in names
