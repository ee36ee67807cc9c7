"""Language identification by cross-parsing entropy (operator 8).

For every language a suffix automaton is built over running labelled text. A text
is parsed greedily into the longest phrases that occur in a language's text. c
phrases over n bytes, each a place in m bytes of labelled text, are a cross
entropy of c * log2(m) / n bits a byte; the language with the least wins. Case is
ignored, and runs of ASCII characters that aren't letters count as one space.

What is learned: of each language the labelled documents with the smallest hash of
the id, at most `docs_per_lang` and those of up to `LONG` characters first, until
they hold `chars_per_lang` characters, where the last one is cut. These documented
bounds keep the model small whatever the corpus. Predictions read whole texts.

Defined results: null text and text without a letter give `und` with score 0;
a null label teaches nothing; without any label everything is `und`; ties go to
the first language by name; a text of any length is parsed in one pass, with
memory for the text alone; repeated rows, and rows with one id, are predicted each;
an empty table gives an empty result; further columns are passed by.
The score is 1 - entropy of the winner / entropy of the next language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import documents, fold, resident, slices

DOCS_PER_LANG = 100
CHARS_PER_LANG = 20_000
LONG = 5_000
#: Fewer texts than this are parsed one by one.
LANES = 48
UNKNOWN = "und"

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))


def running(text: str | None) -> bytes:
    """The text in lower case, one space for ASCII characters that aren't letters."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of the text; state 0 is the start."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in nxt[at]:
            nxt[at][c] = new
            at = link[at]
        if at >= 0:
            old = nxt[at][c]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                while at >= 0 and nxt[at].get(c) == old:
                    nxt[at][c] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    return nxt


class _Parser:
    """For each language its automaton as a table, for parsing many texts side by side.

    A table holds the state after a byte, or its complement if a phrase ends before the
    byte. States are places of rows in it.
    """

    def __init__(self, model: dict[str, bytes]):
        self.langs = sorted(model)
        texts = [model[x] for x in self.langs]
        self.bits = np.array([math.log2(len(x) + 1) for x in texts])
        self.kind, self.tables = np.zeros((len(texts), 256), np.uint8), []
        for kind, text in zip(self.kind, texts, strict=True):
            letters = sorted(set(text))
            # The last kind is that of all bytes that the language's text lacks.
            kind[:] = len(letters)
            kind[letters] = np.arange(len(letters))
            automaton, width = suffix_automaton(text), len(letters) + 1
            first = np.zeros(width, np.int32)
            for c, to in automaton[0].items():
                first[kind[c]] = to * width
            table = np.tile(~first, (len(automaton), 1))
            table[0] = first
            for row, state in zip(table, automaton, strict=True):
                for c, to in state.items():
                    row[kind[c]] = to * width
            self.tables.append(table.ravel())

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """The number of longest-match phrases by language (rows) and text; a byte that a language lacks is a phrase of its own."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)
        size = size[order]
        at = np.cumsum(size) - size
        out = np.empty((len(self.langs), len(texts)), np.int64)
        for lang, table in enumerate(self.tables):
            kinds = self.kind[lang][data]
            count, state = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
            step, k = 0, int((size > 0).sum())
            while k >= LANES:
                # The k longest texts, to the end of the shortest of them.
                for step in range(step, int(size[k - 1])):  # noqa: B020
                    to = table.take(state[:k] + kinds[at[:k] + step])
                    ends = to >> 31
                    count[:k] -= ends
                    np.bitwise_xor(to, ends, out=state[:k])
                step = int(size[k - 1])
                k = int((size > step).sum())
            view = memoryview(table)
            for i in range(k):
                s, n = int(state[i]), 0
                for c in kinds[at[i] + step : at[i] + size[i]].tobytes():
                    s = view[s + c]
                    if s < 0:
                        n += 1
                        s = ~s
                count[i] += n
                state[i] = s
            odd = np.flatnonzero(kinds == self.kind[lang].max())
            own = np.bincount(np.searchsorted(at + size, odd, side="right"), minlength=len(texts)) if len(odd) else 0
            out[lang, order] = count + (state != 0) + own
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a byte by text (rows) and language, and which texts have a letter."""
        plain = [running(t) for t in texts]
        size = np.maximum([len(t) for t in plain], 1)
        has = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        return (self.phrases(plain) * self.bits[:, None] / size).T, has


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG) -> dict[str, bytes]:
    """The text of each language's automaton, learned from rows with a label and a text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.withColumn("size", F.length("text")).withColumn("far", F.col("size") > LONG)
    # About four times the rows wanted of each language and kind, by hash: what is ranked below stays small at any size.
    few = rows.groupBy("lang", "far").agg(F.ceil(F.lit(docs_per_lang * 4.0) / F.count(F.lit(1)) * (1 << 40)).alias("most")).collect()
    if not few:
        return {}
    # Two rows a language, whose text the model holds anyway.
    few = F.broadcast(docs.sparkSession.createDataFrame(few, "lang string, far boolean, most long"))
    order = Window.partitionBy("lang").orderBy("far", "h")
    rows = rows.join(few, ["lang", "far"]).where(F.pmod(F.col("h"), F.lit(1 << 40)) <= F.col("most"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    chosen = ranked.where((F.col("rank") <= docs_per_lang) & (F.coalesce("before", F.lit(0)) < chars_per_lang))
    model: dict[str, list[str]] = {}
    for r in chosen.select("lang", "rank", F.substring("text", 1, chars_per_lang).alias("text")).orderBy("lang", "rank").collect():
        model.setdefault(r["lang"], []).append(r["text"])
    plain = {k: running(f" {' '.join(v)} "[:chars_per_lang]) for k, v in model.items()}
    return {k: v for k, v in plain.items() if v.strip()}


def identify(docs: DataFrame, model: dict[str, bytes], keep: list[str] = (), inside: str | None = None) -> DataFrame:
    """keep columns, lang_pred and score of every document; reads text alone.

    inside: a kept struct that has the text as its field of that name, so that no text is sent to Python twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most chars_per_lang characters for each language
    field = [f.name.lower() for f in docs.schema[inside].dataType].index("text") if inside else None
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = resident(("language", *sorted(shared.value.items())), lambda: _Parser(shared.value))
        for batch in batches:
            if inside:
                batch = pa.RecordBatch.from_arrays([*batch.columns, batch.column(inside).field(field)], [*batch.schema.names, "_text"])
            for part in slices(batch, "_text", 8 << 20):
                texts = part.column("_text").to_pylist()
                bits, has = parser.entropies(texts) if parser.langs else (np.ones((len(texts), 1)), np.zeros(len(texts), bool))
                best, two = bits.argmin(axis=1), np.sort(bits, axis=1)[:, :2]
                score = np.where(has, 1 - two[:, 0] / two[:, 1] if two.shape[1] > 1 else 1.0, 0.0)
                pred = [parser.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep, *([] if inside else [F.col("text").alias("_text")])).mapInArrow(run, schema)


def trained(docs: DataFrame) -> dict[str, bytes]:
    """Learned from the rows that aren't held out: crc32 of the id as text, modulo 3, is not 1."""
    return learn(docs.where(F.coalesce(fold("doc_id", 3), F.lit(0)) != 1))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is found; all columns stay as they are."""
    # The row travels as one column, so that no name of its own can clash.
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return identify(rows, trained(docs), ["_row"], "_row").where(F.col("lang_pred") != UNKNOWN).select("_row.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(fold("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "text")
    return identify(rows, trained(docs), ["doc_id", "held_out"])
