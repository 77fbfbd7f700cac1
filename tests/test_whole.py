"""Operators do the whole job: every pair, every row, every part of a text."""

from pyspark.sql import functions as F

from tallyframe.operators import matching
from tallyframe.plans import catalog

SF = "/root/testdata/sf0.001"


def expanded(got):
    """All pairs of rows behind the pairs of classes and the rows of each class."""
    members = {}
    for a, b, same in got:
        if same:
            members.setdefault(a, {a}).add(b)
    pairs = {(min(x, y), max(x, y)) for m in members.values() for x in m for y in m if x != y}
    for a, b, same in got:
        if not same:
            pairs |= {(min(x, y), max(x, y)) for x in members.get(a, {a}) for y in members.get(b, {b})}
    return pairs


def test_clones_find_every_pair(spark):
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one, two = run("p", 12), run("q", 12)
    texts = [one + " alone", two + " apart", one + " x " + two, one + " y " + two, one + " y " + two, "z " * 30 + "end", "z " * 26 + "other", run("k", 40), run("k", 40), run("k", 39)]
    docs = dict(enumerate(texts, 1))
    got = matching.clones(spark.createDataFrame(list(docs.items()), "id long, text string"), "id", F.split("text", " "), 24, 12)

    def cuts(text, n):
        t = text.split(" ")
        return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}

    want = {(a, b) for a in docs for b in docs if a < b and (len(cuts(docs[a], 12) & cuts(docs[b], 12)) >= 2 or cuts(docs[a], 24) & cuts(docs[b], 24))}
    assert {(3, 4), (3, 5), (4, 5), (6, 7), (8, 10)} <= want
    assert expanded([(r.a, r.b, r.same) for r in got.collect()]) == want


def test_positional_join_takes_every_document(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("doc_id", "text").collect():
        for pos, line in enumerate(r.text.split("\n")):
            want[r.doc_id, (pos * 7 + r.doc_id) % 5] = (len(line), pos)
    got = {(r.doc_id, r.id): (r.chars, r.pos) for r in catalog.QUERIES["positional_join_last_all"](spark, SF).collect()}
    assert got == want and any(doc % 20 for doc, _ in got)
