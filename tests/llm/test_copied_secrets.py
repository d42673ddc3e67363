"""Values copied widely within one owner's documents."""

from cohortline.llm import secret_scan

COPIED, OWN = "Qq1" + "xY7" * 10, "Rr2" + "zW8" * 10
ROWS = [(i, f"number {i} has {COPIED} here", "hot") for i in range(30)]
ROWS += [(100, f"only {OWN} here", "hot"), (101, f"and {OWN} there", "hot"), (102, f"API_KEY: {COPIED}", "hot")]


def test_value_copied_within_one_owner_is_an_example(documents):
    got = {r["id"]: r["spans"] for r in secret_scan.secret_spans(documents(ROWS)).collect()}
    assert not any(got[i] for i in range(30))
    for i in (100, 101):
        assert [(s["owners"], s["repositories"], s["live"]) for s in got[i]] == [(1, 2, True)]
    assert [(s["kind"], s["repositories"], s["live"]) for s in got[102]] == [(0, 31, False)]


def test_redaction_leaves_copied_examples(documents):
    got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(documents(ROWS)).collect()}
    assert all(COPIED in got[i] for i in range(30))
    assert got[100] == "only <secret> here" and got[102] == "API_KEY: <secret>"
