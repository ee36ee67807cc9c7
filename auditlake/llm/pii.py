"""Personal data by candidate gradient boosting (operator 2).

Fixed patterns give the base spans, which always stay. High-recall generators
propose further, overlapping spans of the same four kinds: grouped digits
without a plus, written-out or incomplete addresses, cards with other
separators. Boosted trees score them by format (lengths, groups, checksums) and
context (cue words, neighbouring characters). Threshold by kind: the least score
at which the held-out rows reach `PRECISION`; a kind without such a score adds
nothing. Of overlapping additions the best stays, none that overlaps a base span.

The trees learn from base spans rewritten in looser formats in their own context,
from candidates that fail a checksum or range, and from examples written into
places of about `PLACES` documents chosen by hash: personal data of every kind, and
what is mistaken for it (dates, times, ISBNs, amounts, counts, serial and version
numbers, places named after "at"), both with and without words that announce them.
All these rows are used: three in four to learn, the rest for the thresholds. Candidates
that fail a checksum or range are never added.

Defined results: null and empty texts have no spans; a text of any length is
searched as a whole; repeated rows, and rows with one id or none, are searched each;
an empty table gives an empty result; further columns are ignored. Positions are
code points, the end exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import documents, slices, written

KINDS = ["email", "ip", "card", "phone"]
PLACES = 1_500
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A failing run of digits fails from each of its digits, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_GROUPS = re.compile(r"\(?[0-9][0-9 ()./-]{5,34}[0-9]")
_HOST = re.compile(r"@[A-Za-z0-9-]{1,63}")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]? ?(?:at|AT|@) ?[\])]? ?[A-Za-z0-9-]{1,63}(?: ?[\[(]? ?(?:\bdot\b|\bDOT\b|\.) ?[\])]? ?[A-Za-z0-9-]{2,63}){1,4}")
#: Words that announce each kind, and words that announce other numbers.
_CUES = [re.compile(p, re.I) for p in (r"e-?mail|mailto|contact|address|write|reach", r"\bip\b|host|server|addr", r"card|visa|credit|payment|amex|master", r"phone|tel\b|call|mobile|fax|contact|ring|reach|\bsms\b")]
_OTHER = re.compile(r"isbn|ssn|social security|s/n|article|item|invoice|order|populat|total|amount|version|build|serial|part\b|\bno\b|number|\bid\b|date|time|since|until|on the|in stock|sum|page|account|ticket|row|usd|eur", re.I)
#: Context read on each side of a candidate.
_AROUND = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """The address pattern, found from its @ so that no run of letters is read twice."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        go, tail = at + 1, _DOMAIN.match(text, at)
        if tail:
            first = at
            while first > past and text[first - 1] in _LOCAL:
                first -= 1
            if first < at:
                past = go = tail.end()
                out.append((first, past))
        at = text.find("@", go)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    found = [(0, a, b) for a, b in emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _isbn(digits: str) -> bool:
    if len(digits) == 13:
        return digits[:3] in ("978", "979") and sum(int(c) * (1 + i % 2 * 2) for i, c in enumerate(digits)) % 10 == 0
    return len(digits) == 10 and sum(int(c) * (10 - i) for i, c in enumerate(digits)) % 11 == 0


def _date(digits: str) -> bool:
    """Whether the digits begin like year, month, day or day, month, year."""
    if len(digits) < 8:
        return False
    for y, m, d in ((digits[:4], digits[4:6], digits[6:8]), (digits[4:8], digits[2:4], digits[:2]), (digits[4:8], digits[:2], digits[2:4])):
        if 1900 <= int(y) < 2100 and 1 <= int(m) <= 12 and 1 <= int(d) <= 31:
            return True
    return False


def features(kind: int, span: str, before: str, after: str) -> list[float]:
    d, groups = _digits(span), re.findall(r"[0-9]+", span)
    sizes, parts = [*map(len, groups), 0, 0, 0, 0][:4], [int(g[:18]) for g in groups]
    cues = [1.0 if c.search(before) else 0.0 for c in _CUES]
    thousands = len(groups) > 1 and len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:])
    rising = len(groups) > 3 and (all(x < y for x, y in pairwise(parts)) or len(set(sizes[: len(groups)])) == 1 and len(groups) > 4)
    shape = [len(span), len(d), sum(c.isalpha() for c in span), *(span.count(c) for c in " -.(/@"), len(set(re.sub(r"[0-9A-Za-z]", "", span))), len(groups), *sizes, len(groups[-1]) if groups else 0]
    sense = [luhn(d) if 12 < len(d) < 20 else 0, all(map(_small, groups)) if len(groups) == 4 else 0, _isbn(d), _date(d), thousands, rising, len(d) in (10, 13) and d[:2] in ("15", "16", "17", "18"), d[:1] == "0", d[:1] == "1", len(span.split(" at ")) > 1 or len(span.split(" AT ")) > 1, len(re.findall(r"dot|DOT", span))]
    around = [before[-1:].isalnum(), after[:1].isalnum(), cues[kind], sum(cues), bool(_OTHER.search(before)), sum(c.isdigit() for c in before[-12:]), sum(c.isdigit() for c in after[:12]), before[-1:] in "=\"'#", after[:1] in "%:$€"]
    return [float(x) for x in (kind, *shape, *sense, *around)]


def _loose(kind: int, span: str) -> list[str]:
    """A base span in the formats that the generators look for."""
    if kind == 0:
        name, host = span.split("@", 1)
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host.replace('.', ' [dot] ')}"]
    if kind == 3:
        return [span[1:].strip(), re.sub(r"[ ().-]+", "-", span[1:]).strip("-")]
    return [".".join(re.findall(".{1,4}", _digits(span)))] if kind == 2 else []


def _card(pick: random.Random, prefix: str, size: int) -> str:
    body = prefix + "".join(pick.choices("0123456789", k=size - 1 - len(prefix)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def examples(text: str, seed: int) -> Iterator[tuple[int, str, str, str, int]]:
    """(kind, span, before, after, label): personal data and what is mistaken for it, in places of the text."""
    pick = random.Random(seed)
    r = pick.randint
    digits = lambda n: "".join(pick.choices("0123456789", k=n))
    word = lambda: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=r(2, 9)))
    y, m, d = r(1950, 2049), r(1, 12), r(1, 28)
    area, local, line = digits(3), digits(3), digits(4)
    amex = _card(pick, pick.choice(["34", "37"]), 15)
    card = _card(pick, pick.choice(["4", "51", "6011"]), 16)
    isbn = f"978{r(0, 9)}{digits(2)}{digits(6)}"
    isbn += str(-sum(int(c) * (1 + i % 2 * 2) for i, c in enumerate(isbn)) % 10)
    host = ".".join([word() for _ in range(r(1, 2))] + [pick.choice(["com", "org", "net", "de", "io"])])
    spelt = lambda at, dot: f"{word()}{pick.choice(['', '.', '_'])}{word()}{at}{host.replace('.', dot)}"
    # kind, span, label, words that announce it; None: what is only right with such words.
    said = {0: ["write to ", "email: ", "contact ", "reach me: "], 2: ["card ", "credit card: ", "visa ", "payment with "], 3: ["call ", "phone: ", "tel ", "mobile ", "fax "]}
    yes = [(3, f"({area}) {local}-{line}"), (3, f"1-{area}-{local}-{line}"), (3, f"{area}-{local}-{line}"), (3, f"{area}.{local}.{line}"), (3, f"0{digits(3)} {digits(3)}-{digits(4)}"), (3, f"00{r(10, 99)} {digits(2)} {digits(7)}"), (2, f"{amex[:4]} {amex[4:10]} {amex[10:]}"), (2, ".".join(re.findall("....", card))), (2, "/".join(re.findall("....", card))), (0, spelt(" at ", " dot ")), (0, spelt(" [at] ", " [dot] ")), (0, spelt("(at)", "(dot)")), (0, spelt(" AT ", " DOT "))]
    weak = [(3, digits(r(9, 11))), (3, f"{digits(3)} {digits(3)} {digits(3)}"), (2, amex)]
    clock = f"{r(0, 23):02}{r(0, 59):02}{r(0, 59):02}"
    no = [(f"{y}{m:02}{d:02} {clock}", "invoice "), (f"{y}-{m:02}-{d:02} {clock[:2]}", "date: "), (f"{d:02}.{m:02}.{y} {clock[:2]}", "on the "), (f"{y}-{m:02}-{d:02}", "since "), (f"{y}{m:02}{d:02}", "build "), (f"{r(1, 999)} {digits(3)} {digits(3)}", "population of "), (f"{r(1, 999)}.{digits(3)}.{digits(3)}", "total "), (isbn, "ISBN "), (f"{isbn[:3]}-{isbn[3]}-{isbn[4:6]}-{isbn[6:12]}-{isbn[12]}", "ISBN "), (f"1{r(5, 8)}{digits(8)}", "time "), (f"1{r(5, 8)}{digits(11)}", "time "), (" ".join(str(k) for k in range(r(1, 9) * 5, 200, r(5, 25)))[: r(8, 20)].strip(), "rows "), (f"{r(1, 9999)}.{r(1, 999)}.{r(0, 99)}.{r(0, 9999)}", "part "), (f"{digits(r(3, 5))}.{digits(r(1, 3))}.{r(0, 9)}.{r(0, 9)}", "version "), (digits(r(8, 14)), "order "), (f"{digits(5)}/{digits(r(4, 6))}", "ticket "), (f"{y}-{y + r(1, 9)}", "in "), (f"{r(1, 31)} {r(1, 31)} {r(1, 31)} {r(1, 31)} {r(1, 31)} {r(1, 31)}", "numbers ")]
    cut = lambda: r(0, max(0, len(text) - 1))

    def place() -> tuple[str, str]:
        at = text.find(" ", cut())
        return (text[max(0, at - _AROUND) : at + 1], text[at : at + _AROUND]) if at >= 0 else (" ", " ")

    for kind, span in yes:
        before, after = place()
        yield kind, span, before + (pick.choice(said[kind]) if pick.random() < 0.6 else ""), after, 1
    for kind, span in weak:
        before, after = place()
        yield kind, span, before + pick.choice(said[kind]), after, 1
        before, after = place()
        yield kind, span, before, after, 0
    for span, announced in no:
        before, after = place()
        before += announced if pick.random() < 0.6 else ""
        n = len(_digits(span))
        if 7 <= n <= 15:
            yield 3, span, before, after, 0
        if 13 <= n <= 19:
            yield 2, span, before, after, 0
    # What its words alone tell from a phone number, so they always stand before it.
    for span, announced in ((f"{area}-{digits(2)}-{line}", pick.choice(["SSN ", "social security number ", "SSN: "])), (f"{area}-{local}-{line}", pick.choice(["serial ", "serial number ", "S/N "])), (f"{digits(3)}-{digits(3)}-{digits(4)}", pick.choice(["part no. ", "article ", "item no. "]))):
        before, after = place()
        yield 3, span, before + announced, after, 0
    for span in (f"{word()} at {word()}.{word()}", f"{word()} at {word()}. {word().title()}", f"{word()}@{word()}"):
        before, after = place()
        yield 0, span, before, after, 0


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """Candidate spans of high recall, which may overlap."""
    for m in _GROUPS.finditer(text):
        n = len(_digits(m[0]))
        if 7 <= n <= 15:
            yield 3, *m.span()
        if 13 <= n <= 19:
            yield 2, *m.span()
        if m[0].count(".") == 3:
            yield 1, *m.span()
    for m in _HOST.finditer(text):
        first = m.start()
        while first and m.start() - first < 64 and text[first - 1] in _LOCAL:
            first -= 1
        if first < m.start():
            yield 0, first, m.end()
    if any(x in text for x in ("at]", "at)", " dot ", "dot]", " DOT ", " at ")):
        for m in _SPELT.finditer(text):
            yield 0, *m.span()


_FOUND = "rid bigint, doc_id bigint, base array<struct<kind: int, start: int, stop: int>>, more array<struct<kind: int, start: int, stop: int, label: int, features: array<double>>>"
_SPAN = [("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]
_SCHEMA = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(pa.struct(_SPAN))), ("more", pa.list_(pa.struct([*_SPAN, ("label", pa.int32()), ("features", pa.list_(pa.float64()))])))])


def _search(one_in: int):
    """Base spans, candidates, and in one document of so many, by hash, examples to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for rid, doc, h, text in zip(*(part.column(c).to_pylist() for c in ("rid", "doc_id", "h", "text")), strict=True):
                    text = text or ""
                    base, more = base_spans(text), []
                    if h % one_in == 0 and text:
                        more = [(kind, -1, -1, label, features(kind, s, before[-_AROUND:], after)) for kind, s, before, after, label in examples(text, h)]
                    for kind, a, b in base:
                        before, after = text[max(0, a - _AROUND) : a], text[b : b + _AROUND]
                        more += [(kind, -1, -1, 1, features(kind, s, before, after)) for s in _loose(kind, text[a:b])]
                    known = sorted((a, b) for _, a, b in base)
                    at = 0
                    for kind, a, b in sorted(proposals(text), key=lambda x: x[1]):
                        while at < len(known) and known[at][1] <= a:
                            at += 1
                        if any(x < b and a < y for x, y in known[at : at + 8]):
                            continue
                        span = text[a:b]
                        d = _digits(span)
                        wrong = kind == 2 and not luhn(d) or kind == 1 and not all(map(_small, re.findall("[0-9]+", span))) or kind == 3 and not 8 <= len(d) <= 15 or text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()
                        more.append((kind, a, b, 0 if wrong else None, features(kind, span, text[max(0, a - _AROUND) : a], text[b : b + _AROUND])))
                    rows.append({"rid": rid, "doc_id": doc, "base": [dict(zip(("kind", "start", "stop"), x, strict=True)) for x in base], "more": [dict(zip(("kind", "start", "stop", "label", "features"), x, strict=True)) for x in more]})
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def train(candidates: DataFrame):
    """The boosted trees and a threshold by kind, or None without both classes. candidates: rid, kind, label, features."""
    rows = candidates.where("label is not null").select("kind", "label", array_to_vector("features").alias("features"), F.xxhash64("rid", "start", "features").alias("h"))
    held = F.pmod(F.shiftright("h", 24), F.lit(4)) == 0
    rows = written(rows.withColumn("held", held).withColumn("label", F.col("label").cast("double")), "pii-rows")
    learn = rows.where("not held")
    if learn.select("label").distinct().count() < 2:
        return None, {}
    model = GBTClassifier(maxIter=25, maxDepth=5, seed=7, labelCol="label", featuresCol="features").fit(learn)
    scored = model.transform(rows.where("held")).withColumn("bin", F.floor(vector_to_array("probability")[1] * 100).cast("int"))
    down = Window.partitionBy("kind").orderBy(F.desc("bin"))
    bins = scored.groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("precision", F.sum("good").over(down) / F.sum("n").over(down))
    return model, {r["kind"]: r["bin"] / 100 for r in bins.where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("bin").alias("bin")).collect()}


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, stop, by kind and start) for every row."""
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("h"))
    found = written(source.mapInArrow(_search(max(1, docs.count() // PLACES)), _FOUND), "pii")
    candidates = found.select("rid", F.explode("more").alias("m")).select("rid", "m.*")
    model, least = train(candidates)
    if model is None or not least:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    scored = model.transform(candidates.where("start >= 0 and label is null").withColumn("features", array_to_vector("features")))
    bound = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    scored = scored.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= bound[F.col("kind")])
    # Runs of overlapping additions: a run begins where no earlier one reaches.
    order = Window.partitionBy("rid").orderBy("start", "stop", "kind")
    run = scored.withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = run.withColumn("run", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order))
    best = run.withColumn("n", F.row_number().over(Window.partitionBy("rid", "run").orderBy(F.desc("score"), "start", "kind", F.desc("stop")))).where("n = 1")
    added = best.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return found.join(added, "rid", "left").select("doc_id", "base", every.alias("spans"))


def _joined(spans: str):
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _count(kind: int) -> Column:
    """Base spans of a kind. The lambda has one parameter: a second one would be the place in the array."""
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
