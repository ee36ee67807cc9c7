"""Trigrams and longer in the back-off model, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import scoring

END = b"\0end"


def corpus(n=160, vocabulary=14, seed=3):
    pick = random.Random(seed)
    rows = [(i, " ".join(pick.choices("abcdefghijklmnop"[:vocabulary], weights=range(1, vocabulary + 1), k=pick.randint(0, 14)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "only here as it is"), (n + 3, "only here as it was"), (n + 4, "only here as it is"), (n + 5, rows[7][1]), (n + 6, "A b C"), (n + 7, "p p " * 30)]
    return rows


def katz(rows, order):
    """log10 probability of each text, and the model's distributions summed over all words for every history that occurs."""
    texts = [(i, [*(t or "").lower().encode().split(), END]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts}
    counts = [Counter() for _ in range(order + 1)]
    for i, tokens in texts:
        padded = [END] * (order - 1) + tokens
        for k in range(1, order + 1):
            if not held[i]:
                counts[k].update(tuple(padded[at - k + 1 : at + 1]) for at in range(order - 1, len(padded)))

    def cut(c):
        n, d = Counter(c.values()), [1.0] * 7
        rest = 6 * n[6] / n[1] if n[1] else 1.0
        for r in range(1, 6):
            good = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest != 1 else 0.0
            d[r] = good if 0 < good < 1 else (r - 0.5) / r
        return d

    d = [None, *(cut(c) for c in counts[1:])]
    total = sum(counts[1].values())
    first = {g[0]: d[1][min(c, 6)] * c / total for g, c in counts[1].items()}
    unseen = 1 - sum(first.values())
    followers = [None, None, *(defaultdict(dict) for _ in range(2, order + 1))]
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            followers[k][g[:-1]][g[-1]] = c
    made = {}

    def p(word, history):
        if not history:
            return first.get(word, unseen)
        if (history, word) not in made:
            own = followers[len(history) + 1].get(history)
            dk = d[len(history) + 1]
            if not own:
                made[history, word] = p(word, history[1:])
            else:
                kept, n = sum(dk[min(c, 6)] * c for c in own.values()), sum(own.values())
                n += kept >= n - 1e-9
                if word in own:
                    made[history, word] = dk[min(own[word], 6)] * own[word] / n
                else:
                    made[history, word] = (1 - kept / n) / (1 - sum(p(w, history[1:]) for w in own)) * p(word, history[1:])
        return made[history, word]

    for h in list(followers[order])[:40]:
        assert abs(sum(p(g[0], h) for g in counts[1]) + p(b"never seen", h) - 1) < 1e-9
    scores = {}
    for i, tokens in texts:
        padded = [END] * (order - 1) + tokens
        scores[i] = sum(np.log10(p(padded[at], tuple(padded[at - order + 1 : at]))) for at in range(order - 1, len(padded)))
    return scores


def grouped(tables, key):
    whole = pa.concat_tables(tables)
    return {k: whole.filter(pa.array([x == k for x in whole.column(key).to_pylist()])) for k in sorted(set(whole.column(key).to_pylist()))}


def in_one_process(rows, order, parts, buckets):
    """scores() without Spark, so that constants can be set."""
    made = []
    for chunk in range(parts):
        own = [r for r in rows if r[0] % parts == chunk]
        batch = pa.record_batch([pa.array([r[0] for r in own], pa.int64()), pa.array([True] * len(own)), pa.array([r[1] or "" for r in own]), pa.array([chunk] * len(own), pa.int32())], names=["doc_id", "known", "text", "chunk"])
        taken = []
        scoring._packed(type("Rows", (), {"mapInArrow": lambda self, f, schema, batch=batch, taken=taken: taken.extend(f(iter([batch])))})())
        made.append(pa.Table.from_batches(taken))
    sent = [scoring._send_words(t, buckets) for t in made]
    answers = [scoring._count_words(t, buckets) for t in grouped(sent, "bucket").values()]
    for kind in range(2, order + 1):
        by = grouped(answers, "chunk")
        sent = [scoring._send_grams(t, by[i], kind, buckets) for i, t in enumerate(made)]
        answers += [scoring._count_grams(t, kind, kind < order, buckets) for t in grouped(sent, "bucket").values()]
    by = grouped(answers, "chunk")
    out = [scoring._score(t, by[i], order, buckets) for i, t in enumerate(made)]
    return {r["doc_id"]: r["score"] for t in out for r in t.to_pylist()}


@pytest.mark.parametrize("order, hot, parts, buckets", [(2, 100_000, 5, 3), (3, 100_000, 1, 1), (3, 100_000, 7, 4), (3, 3, 7, 4), (4, 100_000, 5, 3), (4, 2, 5, 6)])
def test_orders_in_one_process(monkeypatch, order, hot, parts, buckets):
    monkeypatch.setattr(scoring, "HOT", hot)
    rows = corpus()
    got, want = in_one_process(rows, order, parts, buckets), katz(rows, order)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_the_query_scores_trigrams(spark, tmp_path, monkeypatch):
    from auditlake.llm import chunks

    monkeypatch.setattr(chunks, "BUCKET_HASHES", 40)
    rows = corpus(60)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in scoring.op3_katz_scoring(spark, str(tmp_path)).collect()}
    want = katz(rows, 3)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
