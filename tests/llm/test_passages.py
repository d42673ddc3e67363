"""Passages that stand next to each other, short ones and wrapped ones."""

import numpy as np
import pyarrow as pa
import xxhash

from cohortline.llm import components, minhash, passages
from cohortline.llm.common import SliceHash


def prose(rng, count):
    return " ".join("".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9))) for _ in range(count))


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_every_neighbouring_passage_keeps_a_copy(documents):
    rng = np.random.default_rng(21)
    parts = {i: [prose(rng, 90)] for i in range(4)}
    a, b, c, d = (parts[i][0] for i in range(4))
    held = {1: [a], 2: [a, b], 3: [b, c], 4: [c, d], 5: [d], 6: [b]}
    rows = [(i, " ".join([prose(rng, 40), *texts, prose(rng, 40)]), "a") for i, texts in held.items()]
    rows.append((7, " ".join([a, prose(rng, 200), a]), "a"))
    words = {i: t.split() for i, t, _ in rows}
    got = passages.repeated_passages(documents(rows)).where("cluster_id is not null").collect()
    spans = {(r["id"], r["kept"]): [] for r in got}
    for r in got:
        spans[r["id"], r["kept"]].append(" ".join(words[r["id"]][r["first_word"] : r["end_word"]]))
        assert r["end_word"] - r["first_word"] <= 90  # nothing but one passage
    for text, keeper, others in ((a, 1, [2, 7]), (b, 2, [3, 6]), (c, 3, [4]), (d, 4, [5])):
        inner = " ".join(text.split()[20:70])
        assert [i for (i, kept), found in spans.items() if kept and any(inner in s for s in found)] == [keeper]
        dropped = {i for (i, kept), found in spans.items() if not kept and any(inner in s for s in found)}
        assert dropped == set(others)
    assert sum(" ".join(a.split()[20:70]) in s for s in spans[7, False]) == 2


def test_short_and_wrapped_paragraphs_match_brute_force(documents):
    rng = np.random.default_rng(22)
    short = prose(rng, 24)
    long = prose(rng, 150).split()
    edited = list(long)
    for at in (37, 75, 112):
        edited[at] = "changed"
    texts = {
        1: prose(rng, 30) + ".\n" + short + ".\n" + prose(rng, 30) + ".",
        2: prose(rng, 30) + ".\n" + short.replace(short.split()[0], "changed") + ".\n" + prose(rng, 30) + ".",
        3: prose(rng, 30) + "\n\n" + wrapped(" ".join(long), 12) + "\n\n" + prose(rng, 20),
        4: prose(rng, 10) + "\n\n" + wrapped(" ".join(edited), 10) + "\n\n" + prose(rng, 25),
        5: "Six words that stand alone here.\n" + prose(rng, 40),
        6: prose(rng, 40) + ".\nSix words that stand alone here.",
        7: "Two words.\n" + prose(rng, 30) + ".",
        8: prose(rng, 30) + ".\nTwo words.",
    }
    rows = [(i, t, "a") for i, t in texts.items()]
    sets = {}
    for i, text in texts.items():
        words, places = passages.paragraphs_of(text)
        for low, high in places:
            some = words[low:high]
            sets[i, low, high] = {tuple(some[k : k + 5]) for k in range(len(some) - 4)} or {tuple(some)}
    wanted = {
        place for place, own in sets.items() for other, theirs in sets.items()
        if place[0] != other[0] and len(own & theirs) >= 0.8 * len(own | theirs)
    }
    assert {i for i, _, _ in wanted} == set(range(1, 9))
    for least in (1, 5):
        got = passages.repeated_passages(documents(rows), least_words=least).collect()
        places = {p for p in wanted if p[2] - p[1] >= least}
        found = {(r["id"], r["first_word"], r["end_word"]) for r in got}
        assert places <= found
        # a run between two edits may hold a window
        assert all(any(i == p[0] and p[1] <= low < high <= p[2] for p in places) for i, low, high in found - places)
        assert {r["id"] for r in got if r["kept"]} == ({1, 3, 5, 7} if least == 1 else {1, 3, 5})


def test_texts_of_a_slab_are_hashed_at_once(monkeypatch):
    """Paragraphs and windows are those of each text by itself, from one buffer of hashes."""
    rng = np.random.default_rng(23)
    texts = [" ".join(rng.choice(["a", "b", "c\n", "d.\n", "e.*\n\n", "f"], n)) for n in (0, 3, 31, 32, 33, 60, 400)]
    made = []

    class Counted(SliceHash):
        def __init__(self, data):
            made.append(len(data))
            super().__init__(data)

    monkeypatch.setattr(passages, "SliceHash", Counted)
    monkeypatch.setattr(minhash, "SliceHash", Counted)
    lines, windows = passages._parsed(texts, 1)
    assert len(made) == 1
    paragraphs, anchors = [], []
    for number, text in enumerate(texts):
        words, places = passages.paragraphs_of(text)
        for low, high in places:
            part = b" ".join(words[low:high])
            hashes, at = minhash.shingle_runs([part], np.array([high - low]))
            keys = minhash.band_keys(hashes, at, passages.BAND_ROWS)[0].tolist() if len(hashes) else []
            paragraphs.append((number, low, high, xxhash.xxh64_intdigest(part), keys, np.unique(hashes).view(np.int64).tolist()))

        def gram(at, size):
            part = b" ".join(words[at : at + size])
            return int(SliceHash(np.frombuffer(part, np.uint8))(np.array([0]), np.array([len(part)]))[0])

        spans = range(len(words) - 20 if len(words) >= 32 else 0)
        found = sorted({min(range(i, i + 18), key=lambda at: gram(at, 4)) for i in spans})
        anchors += [(number, at, gram(at, 32)) for at in found if at + 32 <= len(words)]
    assert len(anchors) > 20 and len(paragraphs) > 50
    got = zip(lines["row"], lines["first"], lines["end"], lines["whole"], map(list, lines["keys"]), map(list, lines["shingles"]))
    assert list(got) == paragraphs
    assert list(zip(windows["row"], windows["first"], windows["value"].to_numpy().view(np.uint64))) == anchors


def test_windows_of_a_long_passage_are_connected_without_rounds(documents, monkeypatch):
    """one chain of windows took a round of shuffles for every doubling of its length."""
    rng = np.random.default_rng(24)
    shared = prose(rng, 3000)
    rows = [(i, f"{prose(rng, 600)} {shared} {prose(rng, 600)}", "a") for i in (1, 2)] + [(3, prose(rng, 400), "a")]
    rounds = []
    rewritten = components._rewritten

    def counted(links, path):
        out = rewritten(links, path)
        rounds.append(out.count())
        return out

    monkeypatch.setattr(components, "_rewritten", counted)
    got = passages.repeated_passages(documents(rows)).collect()
    assert sorted((r["id"], r["kept"]) for r in got) == [(1, True), (2, False)]
    assert all(600 <= r["first_word"] <= 620 and 3580 <= r["end_word"] <= 3600 for r in got)
    assert not any(rounds)


def test_neighbouring_windows_match_brute_force_in_any_batches():
    rng = np.random.default_rng(25)
    rows = sorted({(int(i), int(b), int(f)) for i, b, f in zip(*(rng.integers(0, n, 400) for n in (3, 2, 150)))})
    rows = [(*place, int(rng.integers(0, 30)), int(rng.integers(0, 2))) for place in rows]
    wanted = sorted(
        (one[3], two[3], two[2] - one[2], one[4], one[0]) for one in rows for two in rows
        if one[:2] == two[:2] and 0 < two[2] - one[2] <= 32 and one[4] == two[4] and one[3] != two[3]
    )
    for size in (1, 7, 400):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        names, kinds = ["id", "body", "first", "value", "keeper"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names) for part in parts]
        found = [tuple(r.values()) for batch in passages._neighbours(iter(batches)) for r in batch.to_pylist()]
        assert sorted(found) == wanted and len(wanted) > 300


def test_clusters_match_reachability_also_where_a_keeper_is_cut(monkeypatch):
    rng = np.random.default_rng(26)
    edges = sorted((int(k), 100 * int(k) + int(a), 100 * int(k) + int(b)) for k, a, b in zip(np.sort(rng.integers(0, 5, 90)) // 2, *rng.integers(0, 60, (2, 90))))
    least = {n: n for e in edges for n in e[1:]}
    for _ in least:
        for _, a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    for most in (5, 25, 1000):
        monkeypatch.setattr(passages, "MOST_EDGES", most)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges[i : i + 4])], names=["keeper", "a", "b"]) for i in range(0, len(edges), 4)]
        found = [r for batch in passages._clusters(iter(batches)) for r in batch.to_pylist()]
        assert most == 1000 or any(r["open"] for r in found)
        reached = {n: n for n in least}
        for _ in least:
            for r in found:
                reached[r["node"]] = reached[r["component"]] = min(reached[r["node"]], reached[r["component"]])
        assert reached == least
        assert {r["node"] for r in found if not r["open"]}.isdisjoint(n for r in found if r["open"] for n in (r["node"], r["component"]))
        assert all(r["component"] == least[r["node"]] for r in found if not r["open"])


def test_screened_rows_are_those_of_texts_parsed_by_themselves(monkeypatch):
    rng = np.random.default_rng(27)
    texts = [" ".join(rng.choice(["a", "b", "c\n", "d.\n", "e", "f"], n)) for n in (0, 3, 40, 60, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["id", "text"])
    kept = next(passages._parse(1)(iter([batch])))
    odd = lambda hashes: hashes[:, 0] % np.uint64(2) == 1
    wanted = []
    for i, text in enumerate(texts):
        lines, windows = passages._parsed([text], 1, shingles=False)
        body = int(np.uint64(xxhash.xxh64_intdigest(text)).view(np.int64))
        for first, end, value, keys in zip(lines["first"], lines["end"], lines["whole"].to_numpy().view(np.int64), lines["keys"]):
            wanted.append((i, body, "paragraph", first, end, int(value), [k for k in keys.tolist() if k % 2 == 0]))
        for first, value in zip(windows["first"], windows["value"].to_numpy().view(np.int64)):
            if value % 2 == 0:
                wanted.append((i, body, "window", first, first + 32, int(value), None))
    for part in (1, passages.PART):
        monkeypatch.setattr(passages, "PART", part)
        found = [tuple(r.values()) for rows in passages._screen(odd)(iter([kept])) for r in rows.to_pylist()]
        assert sorted(found, key=repr) == sorted(wanted, key=repr) and len(found) > 60
