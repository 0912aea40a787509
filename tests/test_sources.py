"""Reader fixtures: fastText text vectors (with and without consuming the
header), inlinks JSON lines to long form."""

import json

from tessera.sources import readers as rd


def test_word_vectors_header_and_last_wins(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("3 2\ncat 1.0 2.0\ndog 0.5 -1.5\ncat 3.0 4.0\n")
    got = {r.word: list(r.vec) for r in rd.read_word_vectors(spark, str(p)).collect()}
    assert got == {"cat": [3.0, 4.0], "dog": [0.5, -1.5]}
    got2 = {r.word for r in rd.read_word_vectors(spark, str(p), has_header=False).collect()}
    assert got2 == {"cat", "dog"}  # the header has the wrong length and is dropped


def test_inlinks_long_form(spark, tmp_path):
    p = tmp_path / "in.json"
    p.write_text(json.dumps({"qid": "Q1", "entitle": "T", "rid": 1, "pid": 9,
                             "inlinks": [[5, 0], [6, 1], [7, 0]], "mid_level_categories": ["A"]}) + "\n")
    rows = sorted((r.pos, r.pid, r.ns) for r in rd.read_inlinks(spark, str(p)).collect())
    assert rows == [(0, 5, 0), (1, 6, 1), (2, 7, 0)]
