"""Licence scan of texts with long runs without a plain letter or digit."""

from auditlake.llm import licences


def test_long_runs_do_not_overflow_the_stack(spark):
    notice = "Released under the MIT License."
    texts = {
        1: "The" + " èèéé," * 8000 + f" end\nand on. {notice}",
        2: "a\nb." + " \n" * 30_000 + f"It is\nreleased under the\nMIT License. It ends",
        3: "слово слова словом\n" * 3000 + notice,
        4: notice + "\n" * 30_000 + "-" * 50_000 + "\nabc." + ")" * 50_000 + "\nDéf",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = sorted((r.doc_id, r.paragraph, r.family) for r in licences.licence_scan(rows).collect())
    assert found == [(1, 1, "MIT"), (2, 30_003, "MIT"), (3, 3000, "MIT"), (4, 0, "MIT")]


def test_sentences_end_where_they_did(spark):
    texts = {
        1: 'One two\nthree.)" \n (Four\nfive',
        2: "one two\nthree. èé È four\nfive. six",
        3: "one\ntwo.\n \n--\nthree\nfour 7",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = sorted((r.doc_id, r.paragraph, r["last"], " ".join(r.words)) for r in licences.sentences(rows).collect())
    assert got == [(1, 0, 1, "one two three"), (1, 2, 3, "four five"), (2, 0, 1, "one two three"), (2, 1, 2, "four five six"), (3, 0, 1, "one two"), (3, 4, 5, "three four 7")]
