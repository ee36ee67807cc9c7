"""Very long texts, ties, and the pipeline stage by stage against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from auditlake.llm import chat, collocations, common, exact_dedup, language, licences, manifest, near_dedup, packing, pii, scoring, substring_dedup, suffix_dedup
from tests.llm.test_operators import ROWS, SCHEMA, lowered

LONG = " ".join(f"w{i}" for i in range(100_000))


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """Two texts of about 690,000 characters, one of them with a tail, a word of 300,000 letters, and a short text."""
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    rows = [(1, LONG, "aa"), (2, LONG + "\nReleased under the MIT License. me@example.com", "aa"), (3, "é" * 300_000, "zz"), (4, "short and plain", "zz")]
    spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def test_long_texts_are_read_to_their_end(spark, long_docs):
    by = lambda df: {r.doc_id: r for r in df.collect()}
    assert {i: r.n_removed for i, r in by(substring_dedup.remove_repeats(long_docs)).items()} == {1: 0, 2: 100_000, 3: 0, 4: 0}
    # A run of one letter repeats within its own document alone.
    assert {i: r.n_removed for i, r in by(suffix_dedup.remove_repeats(long_docs)).items()} == {1: 0, 2: len(LONG), 3: 0, 4: 0}
    near = by(near_dedup.near_duplicates(long_docs))
    assert near[2].component_id == near[1].component_id == 1 and near[1].n_shingles == 99_997
    assert exact_dedup.exact_dedup(long_docs).where("kept").count() == 4
    found = by(pii.personal_data(long_docs))[2]
    assert [(s.kind, s.start) for s in found.base] == [(0, len(LONG) + 33)]
    assert [(r.doc_id, r.paragraph, r.family) for r in licences.licence_scan(long_docs).collect()] == [(2, 1, "MIT")]
    assert {i: r.n_tokens for i, r in by(scoring.scores(long_docs)).items()} == {1: 100_001, 2: 100_007, 3: 2, 4: 4}
    assert all(r.lang_pred in ("aa", "zz") for r in language.identify(long_docs, language.trained(long_docs), ["doc_id"]).collect())
    pieces = defaultdict(int)
    for r in packing.pack(common.written(packing.tokenised(long_docs), "pieces")).collect():
        pieces[(r.doc_id, r.doc_tokens)] += r.length
    assert all(n == whole for (_, whole), n in pieces.items()) and len(pieces) == 4
    assert all(r.verified for r in manifest.manifest(long_docs).collect())
    counts = {r.phrase: r.a for r in collocations.collocations(long_docs, least=2, top=10**6).collect()}
    assert "w99995 w99996 w99997 w99998 w99999" in counts and set(counts.values()) == {2}


def test_a_long_turn_round_trips(spark):
    text = LONG + " </turn>" + "x" * 200_000
    rows = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", "\\" * 5000)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: (r.role, r.text, r.loss) for r in chat.read_back(chat.format_turns(rows)).collect()}
    assert got == {0: ("assistant", text, text), 1: ("user", "\\" * 5000, "")}


def test_ties_have_a_defined_result(spark):
    """Languages taught with the same text, pieces of one length, phrases of one score, and two licences in one line."""
    model = {"bb": b" the cat sat ", "aa": b" the cat sat "}
    rows = spark.createDataFrame([(i, "the cat sat") for i in range(5)], "doc_id bigint, text string")
    assert {(r.lang_pred, r.score) for r in language.identify(rows, model, ["doc_id"]).collect()} == {("aa", 0.0)}
    place = lambda: sorted((r.doc_id, r.sequence_id, r.offset) for r in packing.pack(common.written(packing.tokenised(rows), "pieces")).collect())
    once = place()
    assert once == place() and len({x[1:] for x in once}) == 5
    docs = spark.createDataFrame([("x y. p q",)] * 9, "text string").selectExpr("text", "'aa' AS lang")
    assert [(r.rank, r.phrase) for r in collocations.collocations(docs, least=2).orderBy("rank").collect()] == [(1, "p q"), (2, "x y")]
    named = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT OR Apache-2.0"), (1, "SPDX-License-Identifier: MIT OR Apache-2.0")], "doc_id bigint, text string")
    assert Counter(r.family for r in licences.licence_scan(named).collect()) == {"MIT": 2, "Apache-2.0": 2}


def components(texts):
    """Smallest id reachable over pairs of sets of 4-word shingles that are similar to 0.8."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    pick = random.Random(9)
    say = lambda n: " ".join("".join(pick.choices("klmnop", k=5)) for _ in range(n))
    base, item = say(80), say(40)
    rows = [*((r[0], r[1]) for r in ROWS[:16] if r[0] != 15), (50, base), (51, base.upper()), (52, base + " " + say(3)), (53, say(10) + " " + item), (54, item), (55, say(9)), (56, "123 456"), (57, None)]
    sf = str(tmp_path)
    spark.createDataFrame([(*r, "aa", *([None] * (len(ROWS[0]) - 3))) for r in rows], SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")

    kept = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    last = {}
    for i, t in kept.items():
        last[lowered(t)] = max(i, last.get(lowered(t), i))
    kept = {i: t for i, t in kept.items() if last[lowered(t)] == i}
    label = components(kept)
    kept = {i: t for i, t in kept.items() if label[i] == i}
    # Nothing but the item's own copies shares words with it.
    kept = {i for i, t in kept.items() if item not in t}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == kept
    assert {r.doc_id: r.doc_tokens for r in got} == {i: sum(r.length for r in got if r.doc_id == i) for i in kept}
