"""The training-data operators against brute force, on rows with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import common, decontamination, exact_dedup, language, licences, near_dedup, packing, pii, scoring, substring_dedup, suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, node string, key string, score double, locator string, label string"


def make_rows():
    pick = random.Random(3)
    vocabulary = ["".join(pick.choices("abcdefghij", k=pick.randint(2, 9))) for _ in range(300)]
    other = ["".join(pick.choices("qrstuvwxyzé", k=pick.randint(2, 9))) for _ in range(300)]
    say = lambda n, words=vocabulary: " ".join(pick.choices(words, k=n))
    base, passage = say(120), say(40)
    texts = [None, "", " \n\t ", "one", "two words", "A b C", base, base, base.upper(), base.replace(" ", "  ", 1), passage, say(30) + " " + passage + " " + say(30), say(10) + "\n" + passage, "x" * 5000, say(3000), "Émile à Zürich\nReleased under the MIT License.", "mail a.b@example.com or 10.0.0.1 or +1 (152) 555-8590, card 4111 1111 1111 1111", "1234567890", "<|endoftext|> it's 12ab"]
    texts += [base.rsplit(" ", k)[0] + " " + say(k) for k in (1, 2, 3, 10, 30)]
    texts += [say(60), say(60, other), say(80, other), say(5, other), say(200)]
    rows = [(i, t, ("aa" if t and set(t) & set("abcdefghij") and not set(t) & set("qrstuvwxyz") else "zz") if i % 7 else None, "s", 0, "c", "n", "k", 0.5, "l", "b") for i, t in enumerate(texts)]
    return rows + [rows[6], rows[14]]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_are_ascii_split():
    import pyarrow as pa

    h, doc, first, last = common.words(pa.array(["a b", None, "", " a\x0bb\x85c ", "A"]), lower=True)
    assert doc.tolist() == [0, 0, 3, 3, 4] and h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(common.written(packing.tokenised(docs), "pieces")).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(n for _, n in own) <= 4096
    want = Counter()
    for r in ROWS:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.update((r[0], a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 4096))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want


def test_packing_plan_covers_with_little_padding():
    lengths = np.minimum(np.random.default_rng(0).lognormal(5, 1, 20_000).astype(int) + 1, 512)
    demand = np.bincount(lengths - 1, minlength=512)
    patterns, times = packing.plan(demand)
    assert (times @ patterns >= demand).all() and (patterns @ np.arange(1, 513) <= 512).all()
    assert times.sum() <= 1.02 * lengths.sum() / 512


def test_personal_data(docs):
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    text = ROWS[16][1]
    assert [(pii.KINDS[s.kind], text[s.start : s.stop]) for s in found[16].base] == [("email", "a.b@example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (152) 555-8590")]
    assert all(not r.base for k, r in found.items() if k != 16)
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in found.values())


@pytest.mark.parametrize("text", ["a@b.c_x@y.zz", "a@@b.cc x@y", "%@a.b", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.256", "0001.2.3.4", "4111-1111-1111-1111 4111  1111", "+1 2 (3) 4.5-6 78 +", "++49 30 1234567", "a.b@c.d@e.f"])
def test_base_patterns(text):
    import re

    want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    assert pii.base_spans(text) == want


def test_trees_add_loose_spans(spark):
    rows = [(i, f"call me at phone +1 ({200 + i}) 555-{1000 + i} today, or write {'x' * (i % 5 + 1)}@mail.example.com about the thing that we saw") for i in range(300)]
    rows += [(1000 + i, f"order 4111 1111 1111 {2000 + i} was shipped as part 9999.{i}.3.1") for i in range(300)]
    right = ["call me at phone <1-212-555-1234> today", "tel <(212) 555-0199> please", "my mobile: <212-555-0134>, thanks", "reach <bob at mail dot example dot com> any day", "write <ann [at] corp [dot] org> now", "paid by card <4111.1111.1111.1111> twice", "visa <3782 822463 10005> used"]
    wrong = ["invoice 20240131 123456 is due", "a population of 12 345 678 people", "ISBN 978-3-16-148410-0 in print", "stamped 1700000000 by the clock", "rows 10 20 30 40 50 60 of it", "we met at noon. Then it rained", "seen on 2024-01-31 12:30 again", "total 1.234.567 in all", "his SSN 078-05-1120 leaked", "serial 123-456-7890 of the unit", "card 4111 1111 1111 1112 is none", "build 20231105 of the tool"]
    rows += [(5000 + i, t.replace("<", "").replace(">", "")) for i, t in enumerate(right)] + [(6000 + i, t) for i, t in enumerate(wrong)]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    got = [[(s.start, s.stop) for s in found[5000 + i].spans] == [(t.index("<"), t.index(">") - 1)] for i, t in enumerate(right)]
    assert sum(got) >= len(right) - 1, got
    assert [wrong[i] for i in range(len(wrong)) if found[6000 + i].spans] == []
    added = sum(len(r.spans) > len(r.base) for k, r in found.items() if 1000 <= k < 1300)
    assert added <= 3


@pytest.mark.parametrize("hot, bucket", [(100_000, 2_000_000), (3, 40)])
def test_katz_scores(docs, monkeypatch, hot, bucket):
    from auditlake.llm import chunks

    monkeypatch.setattr(chunks, "BUCKET_HASHES", bucket)
    monkeypatch.setattr(scoring, "HOT", hot)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in scoring.scores(docs).collect())
    words, pairs, lines = Counter(), Counter(), []
    for r in ROWS:
        tokens = [*lowered(r[1]).encode().split(), b"\0end"]
        lines.append((r[0], tokens))
        if zlib.crc32(str(r[0]).encode()) % 5 != 1:
            words.update(tokens)
            pairs.update(zip([b"\0end", *tokens[:-1]], tokens, strict=True))
    total = sum(words.values())

    def cut(counts):
        """Good-Turing by the book: counts of one to five are discounted, with half a count where the estimate is none."""
        n, d = Counter(counts.values()), [1.0] * 7
        rest = 6 * n[6] / n[1] if n[1] else 1.0
        for r in range(1, 6):
            good = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest != 1 else 0.0
            d[r] = good if 0 < good < 1 else (r - 0.5) / r
        return d

    d1, d2 = cut(words), cut(pairs)
    p1 = {w: d1[min(c, 6)] * c / total for w, c in words.items()}
    unseen = 1 - sum(p1.values())
    model = {}
    for v in {a for a, _ in pairs}:
        own = {w: c for (a, w), c in pairs.items() if a == v}
        kept, n = sum(d2[min(c, 6)] * c for c in own.values()), sum(own.values())
        n = n if kept < n - 1e-9 else n + 1
        weight = (1 - kept / n) / (1 - sum(p1[w] for w in own))
        model[v] = ({w: d2[min(c, 6)] * c / n for w, c in own.items()}, weight)
        assert abs(sum(model[v][0].values()) + weight * (unseen + sum(p for w, p in p1.items() if w not in own)) - 1) < 1e-9
    want = []
    for doc, tokens in lines:
        score = sum(np.log10(model[a][0][b] if a in model and b in model[a][0] else model.get(a, (0, 1.0))[1] * p1.get(b, unseen)) for a, b in zip([b"\0end", *tokens[:-1]], tokens, strict=True))
        base = sum(np.log10((words[t] + 0.5) / (total + 0.5 * (len(words) + 1))) for t in tokens)
        want.append((doc, len(tokens), sum(words[t] > 0 for t in tokens), zlib.crc32(str(doc).encode()) % 5 == 1, total, round(base, 6), round(score, 6)))
    assert got == sorted(want)


def removed(units, size, rows):
    """Brute force: for each row the mask of what goes."""
    first = {}
    for doc, u in sorted(rows, key=lambda x: x[0]):
        for i in range(len(u) - size + 1):
            first.setdefault(units(u[i : i + size]), doc)
    out = Counter()
    for doc, u in rows:
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if first[units(u[i : i + size])] < doc:
                gone[i : i + size] = [True] * size
        out[doc, tuple(x for x, g in zip(u, gone, strict=True) if not g), sum(gone), len(u)] += 1
    return out


@pytest.mark.parametrize("bucket", [50, 2_000_000])
def test_word_windows(docs, monkeypatch, bucket):
    from auditlake.llm import chunks

    monkeypatch.setattr(chunks, "BUCKET_HASHES", bucket)
    got = Counter((r.doc_id, tuple(r.kept_text.encode().split()), r.n_removed, r.n_words) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == removed(tuple, 13, [(r[0], (r[1] or "").encode().split()) for r in ROWS])


def test_values_with_one_hash_stay_apart():
    from auditlake.llm import chunks

    h, x = np.array([5, 3, 5, 5, 3, 5], np.uint64), np.array([1, 7, 2, 1, 7, 2], np.uint32)
    order, begins, place = chunks.group(h, x)
    assert place.tolist() == [1, 0, 2, 1, 0, 2] and order.tolist() == [1, 4, 0, 3, 2, 5] and begins.tolist() == [0, 2, 4]


@pytest.mark.parametrize("bucket", [50, 2_000_000])
def test_byte_strings(docs, monkeypatch, bucket):
    from auditlake.llm import chunks

    monkeypatch.setattr(chunks, "BUCKET_HASHES", bucket)
    got = Counter((r.doc_id, tuple(r.kept), r.n_removed, r.n_bytes) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == removed(bytes, 50, [(r[0], (r[1] or "").encode()) for r in ROWS])


def test_loser_tree_merges_sorted_runs():
    pick = random.Random(5)
    runs = [sorted({bytes(pick.choices(b"ab", k=pick.randint(0, 12))) for _ in range(pick.randint(0, 40))}) for _ in range(7)]
    coded = [suffix_dedup.front_decode(suffix_dedup.front_code([(x, x[:3]) for x in r])) for r in runs]
    assert [c[0] for c in coded] == runs and [c[2] for c in coded] == [[x[:3] for x in r] for r in runs]
    out = [(coded[r][0][i], share) for r, i, share in suffix_dedup.merge([c[:2] for c in coded])]
    every = sorted(s for r in runs for s in r)
    assert [s for s, _ in out] == every
    assert [share for _, share in out] == suffix_dedup.common_prefixes(every).tolist()


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_super_suffixes_hold_every_window_once(letters):
    pick = random.Random(9)
    texts = [bytes(pick.choices(letters.encode(), k=n)) for n in (0, 49, 50, 51, 300, 20, 200)]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc, begin, many, ahead, least = suffix_dedup.super_suffixes(data, at)
    windows = sorted((int(d), int(b) + i) for d, b, m in zip(doc, begin, many, strict=True) for i in range(m))
    assert windows == [(d, int(at[d]) + i) for d, t in enumerate(texts) for i in range(len(t) - 49)]
    seen = {}
    for b, m, a, h in zip(begin, many, ahead, least, strict=True):
        for i in range(m):
            assert 0 <= a - i <= suffix_dedup.SIZE - suffix_dedup.GRAM
            assert seen.setdefault(data[b + i : b + i + 50].tobytes(), (a - i, h)) == (a - i, h)


def test_near_duplicates(docs):
    sets = []
    for r in ROWS:
        w = lowered(r[1]).encode().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    label = [r[0] for r in ROWS]
    for _ in ROWS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter((r[0], len(s), c, c == r[0]) for r, s, c in zip(ROWS, sets, label, strict=True))


def test_exact_copies(docs):
    groups = {}
    for r in ROWS:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    for text, ids in groups.items():
        own = [r for r in rows if r.digest == hashlib.sha256(text.encode()).hexdigest()]
        assert Counter(r.doc_id for r in own) == Counter(ids) and {(r.keep_id, r.group_size) for r in own} == {(max(ids), len(ids))} and sum(r.kept for r in own) == 1
    assert exact_dedup.drop_copies(docs).count() == len(groups)


def test_exact_copies_over_several_calls(spark, tmp_path):
    state, out = str(tmp_path / "state"), []
    for n, rows in enumerate([[(1, "a"), (2, "b"), (3, "A")], [(4, "b"), (5, "c"), (0, "a")], [(6, "d")]]):
        path = str(tmp_path / f"day{n}")
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
        out.append(sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.read.parquet(path), state_dir=state).collect()))
    assert out == [[(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)], [(0, 3, 3, False), (4, 4, 2, True), (5, 5, 1, True)], [(6, 6, 1, True)]]


def test_exact_copies_of_a_repeated_call(spark, tmp_path, monkeypatch):
    """A call that is repeated, one that was cut off before its rows were counted, and one that overlaps others."""
    state, paths = str(tmp_path / "state"), [str(tmp_path / f"day{n}") for n in range(2)]
    for path, rows in zip(paths, [[(1, "a"), (2, "b"), (3, "A")], [(4, "b"), (5, "c"), (0, "a")]], strict=True):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(path)
    call = lambda *p: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.read.parquet(*p), state_dir=state).collect())
    first = [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]
    assert call(paths[0]) == first and call(paths[0]) == first
    fold = exact_dedup._fold

    def cut(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(exact_dedup, "_fold", cut)
    with pytest.raises(RuntimeError):
        call(paths[1])
    monkeypatch.setattr(exact_dedup, "_fold", fold)
    second = [(0, 3, 3, False), (4, 4, 2, True), (5, 5, 1, True)]
    assert call(paths[1]) == second and call(paths[1]) == second
    assert call(*paths) == sorted([(1, 3, 3, False), (2, 4, 2, False), (3, 3, 3, True), *second])


def test_columns_with_clashing_names(spark, tmp_path):
    names = ["found", "gone", "mark", "most", "kept", "node", "label", "row", "_row", "_hash", "_gone", "_found", "_locator", "_metadata", "_text", "text_", "h", "n", "rank", "size", "far", "key", "locator", "chunk", "bucket"]
    frame = spark.createDataFrame([(r[0], r[1], r[2], *names) for r in ROWS], "doc_id bigint, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    frame.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    items = spark.createDataFrame([(1, ROWS[10][1])], "item_id bigint, text string")
    for f in (language.keep_identified, exact_dedup.drop_copies, near_dedup.one_of_each, lambda d: decontamination.drop_contaminated(d, items)):
        for source in (docs, docs.where("doc_id >= 0")):
            out = f(source)
            assert out.columns == docs.columns
            assert 0 < out.count() < len(ROWS) and set(out.select(*names).distinct().collect()) == {tuple(names)}
    for f in (pii.personal_data, scoring.scores, substring_dedup.remove_repeats, suffix_dedup.remove_repeats, packing.tokenised):
        assert f(docs).count() >= len(ROWS)
    assert licences.licence_scan(docs).count() == 1


def test_language(docs):
    rows = {r.doc_id: r for r in language.identify(docs, language.trained(docs), ["doc_id"]).collect()}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {i for i, r in enumerate(ROWS[:-2]) if not any(c.isalpha() for c in r[1] or "")}
    assert rows[24].lang_pred == "aa" and rows[25].lang_pred == "zz" and all(0 <= r.score <= 1 for r in rows.values())
    assert language.keep_identified(docs).columns == docs.columns
    assert {r.lang_pred for r in language.identify(docs, {}, ["doc_id"]).collect()} == {"und"}


def longest_matches(probe, text):
    n = i = 0
    while i < len(probe):
        k = 1
        while i + k < len(probe) and probe[i : i + k + 1] in text:
            k += 1
        i, n = i + k, n + 1
    return n


@pytest.mark.parametrize("lanes", [2, 100])
def test_phrases_are_longest_matches(monkeypatch, lanes):
    monkeypatch.setattr(language, "LANES", lanes)
    pick = random.Random(1)
    for _ in range(20):
        model = {"a": "".join(pick.choices("abc ", k=40)).encode(), "b": "".join(pick.choices("abcdé", k=30)).encode(), "z": b"x"}
        probes = ["".join(pick.choices("abcdexyé", k=pick.choice([0, 1, 5, 30]))).encode() for _ in range(30)]
        assert language._Parser(model).phrases(probes).tolist() == [[longest_matches(p, model[x]) for p in probes] for x in "abz"]


def test_language_predictions_equal_brute_force(docs):
    model = language.trained(docs)
    want = {}
    for r in ROWS[:-2]:
        plain = language.running(r[1])
        bits = {x: longest_matches(plain, model[x]) * np.log2(len(model[x]) + 1) for x in sorted(model)}
        has = any(c.isalpha() for c in r[1] or "")
        want[r[0]] = (min(bits, key=bits.get), round(1 - min(bits.values()) / sorted(bits.values())[1], 9)) if has else ("und", 0.0)
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.identify(docs, model, ["doc_id"]).collect()} == want


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, ROWS[10][1]), (2, " ".join(f"q{i}" for i in range(30))), (3, None), (4, "too short"), (5, "")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(10, 1), (11, 1), (12, 1)}
    assert decontamination.drop_contaminated(docs, items).count() == len(ROWS) - 3
    assert decontamination.contaminated(docs, items.where("item_id > 9")).count() == 0


def test_decontamination_finds_edited_copies(spark):
    pick = random.Random(5)
    say = lambda n: ["".join(pick.choices("abcdefghij", k=pick.randint(1, 4))) for _ in range(n)]
    items = [say(n) for n in (39, 39, 22, 5, 60)]
    texts = [[], items[0][:]]
    for item in items:
        for every in (2, 3, 4, 5, 6, 7, 8):
            kinds = (lambda w, i: ["new" + w], lambda w, i: [w, "more"], lambda w, i: [])
            for kind in kinds:
                copy = [x for i, w in enumerate(item) for x in (kind(w, i) if i % every == every - 1 else [w])]
                texts.append(say(30) + copy + say(30))
        texts.append(say(20) + [x for w in item for x in (w, "odd")] + say(20))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    code = {w: k for k, w in enumerate({w for t in texts + items for w in t})}
    coded = lambda t: np.array([code[w] for w in t], np.uint64)
    best = {(d, i): decontamination.align(coded(item), coded(t)) / (2 * len(item)) for d, t in enumerate(texts) for i, item in enumerate(items)}
    want = {k: s for k, s in best.items() if s >= 0.5}
    assert len(want) > 90
    assert {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, bench).collect()} == want


def test_decontamination_with_common_words_only(spark):
    """Items of words that every text has, a hot pair, items that share a beginning, repeated and null ids, one long text."""
    pick = random.Random(6)
    say = lambda n: [pick.choice("abcdefgh") for _ in range(n)]
    head = ["which", "of", "the", "following"]
    items = [head + say(20), head + say(20), say(6), ["a"] * 12, head + say(20)]
    texts = [say(200) for _ in range(20)] + [["a", "b"] * 40, head + say(30), items[0][:14], say(15) + items[1][5:] + say(15), say(3000) + items[4] + say(3000)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[20:23] + [(None, rows[22][1])], "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(0, " ".join(items[0])), (None, " ".join(items[1]))], "item_id bigint, text string")
    code = {w: k for k, w in enumerate({w for t in texts + items for w in t})}
    coded = lambda t: np.array([code[w] for w in t], np.uint64)
    best = {(d, i): decontamination.align(coded(item), coded(t)) / (2 * len(item)) for d, t in enumerate(texts) for i, item in enumerate(items)}
    best |= {(d, None): s for (d, i), s in best.items() if i == 1}
    best |= {(None, i): s for (d, i), s in best.items() if d == 22}
    want = {k: s for k, s in best.items() if s >= 0.5}
    assert len(want) > 20
    found = [((r.doc_id, r.item_id), r.score) for r in decontamination.contaminated(docs, bench).collect()]
    assert len(found) == len(want) and dict(found) == want


def test_alignment_scores():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    assert decontamination.align(a, a) == 10
    assert decontamination.align(a, np.array([9, 1, 2, 8, 4, 5, 9], np.uint64)) == 7
    assert decontamination.align(a, np.array([1, 2, 4, 5], np.uint64)) == 7
    assert decontamination.align(a, np.array([7, 8], np.uint64)) == 0


def test_licences(docs):
    found = [(r.doc_id, r.paragraph, r.family) for r in licences.licence_scan(docs).collect()]
    assert found == [(15, 1, "MIT")]


def test_whatever_can_be_confirmed_has_a_clue(spark):
    """Every share of a notice that is large enough, with the marks of its family, has a clue."""
    import re

    texts = set()
    for family, notices in licences.NOTICES.items():
        for notice in notices:
            w = [x for x in re.split("[^a-z0-9]+", notice.lower()) if x]
            for a in range(len(w)):
                for b in range(a + 2, len(w) + 1):
                    if (b - a - 1) / max(len(w) - 1, 1) >= licences.CONFIRM and re.search(licences.MARKS[family], " ".join(w[a:b])):
                        texts |= {" ".join(w[a:b]), "_".join(w[a:b])}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.count() > 300 and rows.where(~licences._clue(F.col("t"))).count() == 0


def test_licence_headers_outside_the_test_tables(spark, docs):
    gpl3 = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    texts = {
        100: ("GPL-3.0", gpl3),
        101: ("GPL-2.0", gpl3.replace("version 3", "version 2")),
        102: ("AGPL-3.0", gpl3.replace("GNU General", "GNU Affero General")),
        103: ("LGPL", gpl3.replace("program", "library").replace("GNU General", "GNU Lesser General")),
        104: ("GPL-3.0", "Licensed under GPL-3.0-or-later"),
        105: ("GPL-3.0", "Licensed under the GPL v3"),
        106: ("Apache-2.0", '/*\n * Licensed under the Apache License, Version\n * 2.0 (the "License"); you may not use this file\n * except in compliance with the License.\n */'),
        107: ("MIT", "Permission is hereby granted, free\nof charge, to any person obtaining\na copy of this software"),
        108: ("GPL-3.0", gpl3.replace("\n#", "").removeprefix("# ")),
        110: ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
        111: ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone may copy"),
        112: ("MIT", "This project is MIT licensed."),
        113: (None, "Wir kamen mit dem Zug.\nThe terms of the deal were free of charge."),
        109: (None, "The general public has a license to be wrong.\nThe gnu is free"),
        114: ("LGPL", "distributed under the terms of the Lesser GPL v2.1"),
        115: ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
        116: ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
        117: ("Unlicense", "This is free and unencumbered software released into the public domain."),
        118: ("MIT", 'license = "MIT"'),
        119: ("MIT", "Dieses Paket steht unter der MIT-Lizenz."),
        120: ("Apache-2.0 MIT", "SPDX-License-Identifier: MIT OR Apache-2.0"),
        121: ("Apache-2.0 MIT", "Use it under Apache 2 or MIT, as you like."),
    }
    rows = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id bigint, text string")
    found = [(r.doc_id, r.family) for r in licences.licence_scan(docs.select("doc_id", "text").unionByName(rows)).collect()]
    assert sorted(found) == [(15, "MIT"), *((i, f) for i, (names, _) in texts.items() if names for f in names.split(" "))]


def test_empty_tables(spark, empty):
    assert packing.pack(common.written(packing.tokenised(empty), "pieces")).count() == 0
    for f in (pii.personal_data, scoring.scores, substring_dedup.remove_repeats, suffix_dedup.remove_repeats, near_dedup.near_duplicates, exact_dedup.exact_dedup, language.keep_identified, licences.licence_scan):
        assert f(empty).count() == 0, f.__name__
    assert decontamination.contaminated(empty, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0


def test_one_id_for_most_rows(spark):
    """Rows of an id that fills many chunks don't remove each other's text, and no chunk holds them all."""
    from auditlake.llm import chunks

    pick = random.Random(2)
    say = lambda: " ".join("".join(pick.choices("abcdefghij", k=4)) for _ in range(20))
    shared = say()
    for hot in (None, 7, chunks.LEAST_ID):
        rows = [(hot, f"{say()} {shared}") for _ in range(200)] + [(i, f"{say()} {shared}") for i in (1, 9, 10)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        sizes = [r["count"] for r in chunks.cut(docs).rows.groupBy("chunk").count().collect()]
        assert sum(sizes) == 203 and max(sizes) < 100
        code = lambda i: -(1 << 63) if i is None else i
        real = lambda i: None if hot is None and i == -(1 << 63) else i
        want = removed(tuple, 13, [(code(i), t.encode().split()) for i, t in rows])
        got = Counter((r.doc_id, tuple(r.kept_text.encode().split()), r.n_removed, r.n_words) for r in substring_dedup.remove_repeats(docs).collect())
        assert got == Counter({(real(k[0]), *k[1:]): n for k, n in want.items()})
        want = removed(bytes, 50, [(code(i), t.encode()) for i, t in rows])
        got = Counter((r.doc_id, tuple(r.kept), r.n_removed, r.n_bytes) for r in suffix_dedup.remove_repeats(docs).collect())
        assert got == Counter({(real(k[0]), *k[1:]): n for k, n in want.items()})
        assert Counter(r.doc_id for r in scoring.scores(docs).collect()) == Counter(i for i, _ in rows)


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f")], "doc_id bigint, text string")
    assert {r.doc_id for r in substring_dedup.remove_repeats(rows).collect()} == {None, 1}
    assert {r.doc_id for r in scoring.scores(rows).collect()} == {None, 1}
    assert exact_dedup.exact_dedup(rows).where("kept").count() == 2
    assert near_dedup.near_duplicates(rows).count() == 3
    assert packing.tokenised(rows).count() == 3
    assert suffix_dedup.remove_repeats(rows).count() == 3
    assert pii.personal_data(rows).where("doc_id is null").count() == 2
    assert decontamination.contaminated(rows, spark.createDataFrame([(5, "a b c d e f")], "item_id bigint, text string")).where("doc_id is null").count() == 1
    assert language.identify(rows, {"x": b" a b "}, ["doc_id"]).where("doc_id is null").count() == 2
    named = spark.createDataFrame([(None, "Released under the MIT License."), (None, None)], "doc_id bigint, text string")
    assert [(r.doc_id, r.family) for r in licences.licence_scan(named).collect()] == [(None, "MIT")]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, ROWS[10][1])], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert not kept & {0, 1, 2, 10, 11, 12, 17} and {3, 4, 13, 14, 16, 24, 25} <= kept
    assert len(kept & {6, 7, 8, 9}) == 1


def test_trees_learn_from_all_labelled_rows(spark, monkeypatch):
    """about 20,000 rows were drawn by hash."""
    odd = F.col("id") % 2
    rows = spark.range(30_000).select(F.col("id").alias("rid"), F.lit(3).alias("kind"), F.lit(-1).alias("start"), odd.cast("int").alias("label"), F.array(odd.cast("double"), F.col("id").cast("double")).alias("features"))
    used = []
    monkeypatch.setattr(pii, "written", lambda df, name: used.append(df.count()) or common.written(df, name))
    model, least = pii.train(rows)
    assert used == [30_000] and model is not None and set(least) == {3}


def test_language_stage_sends_each_text_once(docs, capsys):
    """The text went to Python in its row and once more beside it."""
    upper = docs.withColumnRenamed("text", "TEXT")
    found = language.keep_identified(upper)
    assert found.columns == upper.columns and found.count() == language.identify(docs, language.trained(docs)).where("lang_pred <> 'und'").count()
    found.explain()
    assert "_text" not in capsys.readouterr().out
