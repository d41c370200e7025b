"""The manifest against a plain tree, by small superblocks so that rounds repeat."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairlocus.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))


def levels(nodes, fanout):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def climbed(tree, i, fanout, digest):
    """Siblings by level and the root that ``digest`` leads to from leaf i."""
    siblings = []
    for nodes in tree[:-1]:
        start = i - i % fanout
        run = nodes[start : start + fanout]
        siblings += run[: i % fanout] + run[i % fanout + 1 :]
        digest = h([*run[: i % fanout], digest, *run[i % fanout + 1 :]])
        i //= fanout
    return siblings, digest


def plain(rows, fanout, shown):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((own, levels([leaf(r, r["text"]) for r in own], fanout)))
    over = levels([t[-1][0] for _, t in trees], fanout)
    out = []
    for k, (own, tree) in enumerate(trees):
        for i, r in enumerate(own):
            low, end = climbed(tree, i, fanout, leaf(r, shown(r)))
            high, end = climbed(over, k, fanout, end)
            root = over[-1][0]
            out.append((r["doc_id"], leaf(r, r["text"]), tree[-1][0], root, h(low + high), end, end == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fanout", "deep"), [(2, 2), (3, 1), (16, 3)])
def test_equals_a_plain_tree(make_docs, odd_rows, fanout, deep):
    docs = make_docs(odd_rows + [(100 + n, f"Text {n}", "hot" if n % 3 else f"s{n % 40}") for n in range(200)])
    shown = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    got = merkle.Manifest(docs, shown, merkle.Shape(fanout, deep)).verified().collect()
    want = plain(docs.collect(), fanout, lambda r: r["text"].lower() if r["text"] and r["doc_id"] and r["doc_id"] % 3 == 0 else r["text"])
    assert sorted(map(tuple, got), key=repr) == want
    assert {r["verified"] for r in got} == {True, False}


def test_proofs_lead_to_the_root(make_docs):
    manifest = merkle.Manifest(make_docs([(n, f"t{n}", f"s{n % 7}") for n in range(90)]), shape=merkle.Shape(3, 2))
    rows = manifest.proofs().collect()
    assert len(rows) == 90
    assert {merkle.folded(bytes(r["digest"]), bytes(r["proof"])) for r in rows} == {manifest.root()}
    assert len({bytes(r["proof"]) for r in rows}) == 90


def test_a_change_anywhere_changes_the_root(make_docs):
    rows = [(n, f"t{n}", f"s{n % 3}") for n in range(40)]
    root = merkle.Manifest(make_docs(rows)).root()
    assert merkle.Manifest(make_docs(rows[::-1])).root() == root
    assert merkle.Manifest(make_docs([*rows[:20], (20, "other", "s2"), *rows[21:]])).root() != root


def test_one_row_and_no_row(make_docs):
    (row,) = merkle.Manifest(make_docs([(1, "a", None)])).verified().collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"]
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert merkle.Manifest(make_docs([])).verified().collect() == []
