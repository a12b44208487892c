"""License scans."""

from tests.llm.conftest import collected
from wattline.llm import licenses


def test_places_labels_and_score(docs):
    rows = [
        (1, "Licensed under the APACHE-License. And apache license"),
        (2, "GNU general\npublic License; the MIT License CC-BY cc by"),
        (3, None), (4, ""), (5, "mit"), (6, "MIT ä License"), (7, "mitä license"), (8, "..."),
        (9, "Licensed, under the brand new Apache License (Version 2.0)"),
        (10, "permission is hereby granted free of charge"),
        (11, "apache license " * 40_000),
        (None, "cc by"), (12, "cc by"), (12, "cc by"), (13, "K cc by"),
    ]
    got = collected(licenses.scan(docs(rows)))
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (8, 2, 3, 6, "apache")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (4, 0, 9, "cc-by,gpl,mit")
    for i, words in ((3, 0), (4, 0), (5, 1), (6, 3), (7, 2), (8, 0)):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (words, 0, None, "", 0.0)
    assert got[9].labels == "apache,apache-2.0" and got[9].score == 1.0
    assert got[10].labels == "" and got[10].score == 0.0
    assert (got[11].n_base, got[11].last_word) == (40_000, 79_998)
    assert got[None].base_labels == "cc-by" and got[12].n_base == 1 and got[13].first_word == 1
    assert licenses.scan(docs(rows)).count() == len(rows) - 1
    assert licenses.scan(docs(rows).where("false")).count() == 0


def test_merged_diagonals_bridge_gaps(docs):
    words = "this program is free software you can redistribute it and or modify it".split()
    changed = words[:5] + ["indeed"] + words[5:]
    got = collected(licenses.scan(docs([(1, " ".join(changed)), (2, " ".join(words[:4])), (3, " ".join(reversed(words)))])))
    assert got[1].labels == "gpl-notice" and 0.9 < got[1].score < 1
    assert got[2].labels == "" and got[3].labels == ""
