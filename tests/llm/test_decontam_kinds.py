"""Copies and re-parameterised items that the template kind alone misses."""

import string

import pytest

from tessera.llm import decontam as dc

PLAIN = [
    (1, "Which rivers, if any, cross the old border near Vienna? List them in order. Then say why."),
    (2, "What is the capital of the big country?"),
    (3, "Sort these: 12 34 56 78 90 11 22 33"),
]


def found(spark, docs, items, **how):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: list(r.item_ids) for r in dc.contamination(d, b, both=True, **how).collect()}
    return [rows[i] for i in range(len(docs))]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_copies_in_any_case_and_without_marks(spark, limit):
    bare = lambda t: t.translate({ord(c): None for c in string.punctuation})
    docs, want = [], []
    for i, text in PLAIN:
        for copy in (text, bare(text), text.title(), text.upper(), text.lower(), "So he asked\n" + text, "note: " + bare(text).title() + " end"):
            docs.append(copy)
            want.append([i])
    docs += ["Nothing of the kind is said in this text about any river or any border at all.", ""]
    assert found(spark, docs, PLAIN, literal_limit=limit) == want + [[], []]


def test_other_names_and_numbers_at_any_place(spark):
    items = [(1, "Alice has $5 and buys 3 apples at $2 each. How much does she have left?"),
             (2, "What is twenty-five plus forty-two when both are written out as digits?"),
             (3, "Add -3 to the number that was named before and tell me the sum of it.")]
    docs = ["Karim has $9 and buys 4 apples at $1 each. How much does she have left?",
            "What is ninety-one plus sixty-three when both are written out as digits?",
            "Add -8 to the number that was named before and tell me the sum of it."]
    # words that open sentences here are common in lower case elsewhere
    docs += ["so how and what to add is not said"] * 3
    assert found(spark, docs, items) == [[1], [2], [3], [], [], []]


def test_items_of_numbers_and_hits_that_do_not_add_up(spark):
    generic = "the answer is the sum of all the"
    items = [(1, "12 34 56 78 90 11 22 33"),
             (2, generic + " 1 kg 2 kg 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg 9 kg 10 kg 11 kg 12 kg")]
    words = "one river runs past every old mill and then turns west below some quiet hills near our town".replace("one ", "a ")
    items.append((3, words))
    w = words.split()
    shifted = " ".join(" ".join(w[i:i + 8]) + " x y z" * 9 for i in (0, 5, 2, 9, 7, 4, 1))
    docs = ["see 12 34 56 78 90 11 22 33 there", "see 99 34 56 78 90 11 22 33 there", generic + " others", items[1][1], shifted, "so: " + words]
    got = found(spark, docs, items)
    assert got == [[1], [], [], [2], [], [3]]
