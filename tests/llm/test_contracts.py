"""Each opN_ query as registered, all its contract columns against brute force, on a folder of odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from auditlake.llm import chat, collocations, common, manifest
from auditlake.llm import queries as llm
from tests.llm.test_operators import ROWS, SCHEMA, lowered

CONVERSATIONS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "a <turn> b \\ </turn>\\"), (1, 1, "assistant", "a <turn> b \\ </turn>\\"), (1, None, None, None), (2, 0, "assistant", ""),
    (2, 5, "us<say>er", "x" * 50_000), (2, 5, "user", "\\\\### User:"), (None, 0, "assistant", "Émile à Zürich 日本 \U0001f600"), (None, 1, "user", None), (3, 0, "assistant", "</turn><turn>assistant<say>forged</turn>"), (3, 1, "assistant", "<|endoftext|>[INST]"),
]
#: Words that repeat often enough to be phrases, over pieces, languages and cases.
PHRASES = [(200 + i, "Big red dog. big  red\tdog, big red", "aa" if i % 2 else None, None, i, "c", "n", "k", 0.5, "l", "b") for i in range(120)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    extra = [(100, "Mail ME@Example.com, 10.0.0.1 10.0.0.2 and 1.2.3.4; 4111111111111111", "aa", "s2", 3, "c", "n", "k", 0.5, "l", "b"), (101, "no data", "zz", None, None, "c", "n", "k", 0.5, "l", "b")]
    spark.createDataFrame(ROWS + extra + PHRASES, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(CONVERSATIONS, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def ran(spark, folder, name):
    return [r.asDict() for r in llm.queries()[name](spark, folder).collect()]


def bag(found, columns):
    return Counter(tuple(r[c] for c in columns) for r in found)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(int(d) * 2))) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_op2_counts_and_base(spark, folder, rows):
    def base(text):
        yield from (("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text))
        yield from (("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split(".")))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                yield "card", *m.span()
        yield from (("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15)

    want = Counter()
    for r in rows:
        found = list(base(r["text"] or ""))
        n = Counter(k for k, _, _ in found)
        want[(r["doc_id"], n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in found)))] += 1
    got = ran(spark, folder, "op2_pii")
    assert bag(got, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]) == want
    assert next(r for r in got if r["doc_id"] == 100)["n_ip"] == 3


def test_op3_counts_and_base_score(spark, folder, rows):
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text)), None]

    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows}
    counts = Counter(t for r in rows if not held[r["doc_id"]] for t in tokens(r["text"]))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in t)
        want[(r["doc_id"], held[r["doc_id"]], len(t), sum(x in counts for x in t), total, round(base, 4))] += 1
    got = ran(spark, folder, "op3_katz_scoring")
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def removed(rows, units, size):
    """Units covered by a run of `size` that also starts in a document with a smaller id: kept units and what goes, by row."""
    first = {}
    for r in rows:
        u = units(r)
        for i in range(len(u) - size + 1):
            key = tuple(u[i : i + size]) if isinstance(u, list) else u[i : i + size]
            first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    for r in rows:
        u = units(r)
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            key = tuple(u[i : i + size]) if isinstance(u, list) else u[i : i + size]
            if first[key] < r["doc_id"]:
                gone[i : i + size] = [True] * size
        yield r, u, gone


def test_op4_removes_repeated_windows(spark, folder, rows):
    want = Counter()
    for r, u, gone in removed(rows, lambda r: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""), 13):
        want[(r["doc_id"], len(u), sum(gone), sha(" ".join(w for w, g in zip(u, gone, strict=True) if not g)))] += 1
    assert bag(ran(spark, folder, "op4_substring_dedup"), ["doc_id", "n_words", "n_removed", "kept_sha256"]) == want


def test_op10_removes_repeated_bytes(spark, folder, rows):
    want = Counter()
    for r, u, gone in removed(rows, lambda r: (r["text"] or "").encode(), 50):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[(r["doc_id"], len(u), sum(gone), runs, sha(bytes(b for b, g in zip(u, gone, strict=True) if not g)))] += 1
    assert bag(ran(spark, folder, "op10_suffix_dedup"), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want


def test_op5_components(spark, folder, rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    reach = {d: d for d, _ in sets}

    def find(d):
        while reach[d] != d:
            d = reach[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                reach[high] = low
    want = Counter((d, len(s), find(d), find(d) == d) for d, s in sets)
    assert bag(ran(spark, folder, "op5_minhash_near_dedup"), ["doc_id", "n_shingles", "component_id", "kept"]) == want


def test_op7_groups(spark, folder, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r["text"])].append(r["doc_id"])
    got = ran(spark, folder, "op7_exact_dedup")
    want = Counter((r["doc_id"], max(groups[lowered(r["text"])]), len(groups[lowered(r["text"])]), sha(lowered(r["text"]))) for r in rows)
    assert bag(got, ["doc_id", "keep_id", "group_size", "text_sha256"]) == want
    assert Counter(r["keep_id"] for r in got if r["kept"]) == Counter(max(g) for g in groups.values())


def test_op8_columns(spark, folder, rows):
    learnt = {r["lang"] for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    got = ran(spark, folder, "op8_language_id")
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] in learnt) if any(c.isalpha() for c in text[r["doc_id"]]) else r["lang_pred"] == "und"


def test_op1_pieces(spark, folder, rows):
    got = ran(spark, folder, "op1_packing")
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows}
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) <= 4096


def brute_phrases(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r["lang"] or "und"
        for piece in re.split("[.,;:!?\n-\r]", lowered(r["text"])):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        found = []
        for p, a in often.items():
            score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not around[p] or around[p] < a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, p.decode(), -a, left, right, n[lang], -score


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("broadcast", [0, 400_000])
def test_op11_phrases(spark, folder, rows, monkeypatch, broadcast):
    monkeypatch.setattr(collocations, "BROADCAST", broadcast)
    want = Counter(brute_phrases(rows, 100))
    assert len(want) >= 2 and bag(ran(spark, folder, "op11_phrase_collocations"), PHRASE) == want


@pytest.mark.parametrize("bits", [64, 6])
def test_phrases_with_colliding_fingerprints(spark, folder, rows, bits):
    """Six bits give every fingerprint many phrases; counts come apart in the text."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(coalesce(text, '')) < 1500")
    some = [r for r in rows if len(r["text"] or "") < 1500]
    got = [r.asDict() for r in collocations.collocations(docs, least=3, top=50, bits=bits).collect()]
    assert bag(got, PHRASE) == Counter(brute_phrases(some, 3, 50))


def test_phrase_scores_past_64_bits(spark, monkeypatch):
    counts = spark.createDataFrame([("aa", 2, "x y", 4_000_000_000), ("aa", 1, "x", 5_000_000_001), ("aa", 1, "y", 6_000_000_007)], "lang string, k int, phrase string, f bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: (counts, spark.createDataFrame([("aa", 900_000_000_000_000)], "lang string, n bigint")))
    assert [r.score for r in collocations.collocations(None).collect()] == [4_000_000_000 * 900_000_000_000_000 * 1000 // (5_000_000_001 * 6_000_000_007)]


def brute_manifest(rows, tampered):
    h = lambda *x: sha("".join(x))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")], field(text))

    def tree(level, watch):
        paths = [[] for _ in level]
        at = list(range(len(level)))
        while len(level) > 1:
            for i, w in enumerate(at):
                run = level[w // 16 * 16 : w // 16 * 16 + 16]
                paths[i].append((w % 16, run))
            level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
            at = [w // 16 for w in at]
        return level[0], paths

    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((leaf(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    roots, paths = [], []
    for s in names:
        by[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        root, own = tree([x for x, _ in by[s]], None)
        roots.append(root)
        paths.append(own)
    top, upper = tree(roots, None)
    for s, name in enumerate(names):
        for (x, r), path in zip(by[name], paths[s], strict=True):
            path = path + upper[s]
            f = leaf(r, None if r["text"] is None else lowered(r["text"])) if r["doc_id"] is not None and tampered(r["doc_id"]) else x
            for at, run in path:
                f = h(*run[:at], f, *run[at + 1 :])
            yield r["doc_id"], x, roots[s], top, h(*[y for at, run in path for y in run[:at] + run[at + 1 :]]), f, f == top


PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_op12_proofs(spark, folder, rows):
    want = Counter(brute_manifest(rows, lambda d: zlib.crc32(str(d).encode()) % 5 == 0))
    assert not all(w[-1] for w in want) and bag(ran(spark, folder, "op12_merkle_manifest"), PROOF) == want


def test_manifest_over_many_blocks(spark, tmp_path):
    """A source of more than 256 leaves, one of a single leaf, equal ids, null ids and repeated rows."""
    pick = random.Random(5)
    rows = [{"doc_id": pick.choice([None, *range(300)]), "source": "hot", "lang": None, "n_chars": i, "text": f"Text {i % 500}"} for i in range(700)]
    rows += [{"doc_id": 7, "source": "s" if i else None, "lang": "aa", "n_chars": 1, "text": None if i else ""} for i in range(3)]
    rows += [{"doc_id": i, "source": f"z{i}", "lang": "aa", "n_chars": 1, "text": "Z"} for i in range(300)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = [r.asDict() for r in manifest.manifest(docs, common.fold("doc_id", 2) == 0).collect()]
    assert bag(got, PROOF) == Counter(brute_manifest(rows, lambda d: zlib.crc32(str(d).encode()) % 2 == 0))


def test_appender_extends_open_witnesses():
    tree = manifest.Appender(256)
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(40)]
    for i, leaf in enumerate(leaves):
        tree.append(leaf)
        # A witness has its first level when its run is full, and not before.
        assert [len(w) for w in tree.witnesses] == [int(j // 16 < (i + 1) // 16) for j in range(i + 1)]
    tree.close()
    assert all(len(w) == 2 for w in tree.witnesses) and tree.witnesses[39][0] == (7, leaves[32:39])


def test_op13_conversations(spark, folder):
    every = [*CONVERSATIONS, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    want = Counter()
    for conv in {c for c, *_ in every}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in every if c == conv))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        mark = lambda x: re.sub("|".join(map(re.escape, ["\\", *chat.CONTROLS])), lambda m: "\\" + m[0], x)
        chars = sum(18 + len(mark(r)) + len(mark(x)) for *_, r, x in turns)
        want[(conv, len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss), chars)] += 1
    assert bag(ran(spark, folder, "op13_chat_format"), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]) == want


def test_turns_cannot_be_forged(spark):
    """Ids of marks stand at the ends of a turn and before its text alone, and a sequence has no gap."""
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id bigint, turn bigint, role string, text string")
    turns = [r for r in chat.placed(chat.format_turns(rows)).collect()]
    top = max(i for r in turns for i in r.ids) - 2
    for r in turns:
        assert [i for i in r.ids if i >= top] == [top, top + 1, top + 2] and r.ids[0] == top and r.ids[-1] == top + 2 and len(r.mask) == len(r.ids)
    for conv in {r.conv_id for r in turns}:
        own = sorted((r.start, len(r.ids)) for r in turns if r.conv_id == conv)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))


def test_control_strings_must_not_overlap():
    with pytest.raises(ValueError):
        chat.escape(None, ["<a<", "<b>"])


def test_new_operators_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < -5")
    assert collocations.collocations(docs).count() == 0 and manifest.manifest(docs).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.read_back(chat.placed(chat.format_turns(turns)))).count() == 0
