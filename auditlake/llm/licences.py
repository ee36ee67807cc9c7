"""Licence scan with a trained paragraph classifier (operator 9, native).

A paragraph is a line with a word, or a sentence over adjacent lines, as headers
are wrapped; a sentence isn't named again for a family that a line of it has
already. Word 1- and 2-grams of the notices below that
are rare in the corpus are the features of a multinomial logistic regression,
whose classes are the licence families and `unknown`. It learns from the notices
and from the paragraphs of at most about `SAMPLE_DOCS` documents, chosen by hash
(a documented bound), labelled by comparison with the notices. The threshold for
a family is calibrated on held-out paragraphs: at most one unknown paragraph in
`ONE_IN` passes. Of what passes, every family counts that a notice and the
family's own marks (`MARKS`) confirm, so a choice of licences names each; `BARS` are
what other families have. A paragraph without any word that marks have (`CLUES`)
isn't asked, as nothing could confirm it.

Defined results: null and empty texts have no paragraph; a text of any length is cut into
its lines and sentences; a paragraph names a family once, however many notices fit; repeated rows are scanned
each; an empty table gives an empty result; a null id is kept as one; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import documents, written

SAMPLE_DOCS = 2_000
ONE_IN = 1_000
#: Share of a notice's 2-grams that a paragraph must have.
CONFIRM = 0.6
UNKNOWN = "unknown"

# Short public notices by licence family.
_VERBS = ("Licensed under", "Released under", "Distributed under", "Available under the terms of")


def _named(*names: str) -> list[str]:
    return [f"{verb} {name}" for name in names for verb in _VERBS] + list(names)


def _gnu(kind: str, things: str, *versions: str) -> list[str]:
    """The usual headers of a GNU licence."""
    out = [f"GNU {kind} as published by the Free Software Foundation"]
    for v in versions:
        out += [f"This {things} is free software you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {v} of the License, or at your option any later version", f"under the terms of the GNU {kind} version {v}", f"This work is licensed under the GNU {kind}, version {v}", f"GNU {kind} v{v}"]
    return out


NOTICES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", *_gnu("Affero General Public License", "program", "3"), "SPDX-License-Identifier: AGPL-3.0-or-later", *_named("AGPL-3.0", "the AGPLv3", "the AGPL v3", "AGPL version 3")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 the License you may not use this file except in compliance with the License", "Released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache 2.0 licensed", "under Apache 2", *_named("Apache-2.0", "the Apache 2.0 license", "the Apache License v2", "the Apache License v2.0", "Apache License Version 2.0")],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", *_named("BSD-2-Clause", "the 2-clause BSD license", "the Simplified BSD license")],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", *_named("BSD-3-Clause", "the 3-clause BSD license", "the New BSD license")],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", *_named("CC-BY-4.0")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", *_named("CC-BY-NC-4.0")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", *_named("CC-BY-SA-4.0")],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal", *_named("CC0-1.0", "CC0 1.0 Universal")],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0", *_named("BSL-1.0", "the Boost Software License", "the Boost Software License 1.0")],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "Eclipse Public License, Version 2.0", *_named("EPL-2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v2.0")],
    "GPL-2.0": ["SPDX-License-Identifier: GPL-2.0-or-later", *_gnu("General Public License", "program", "2"), "GPLv2 licensed", "GNU General Public License Version 2 June 1991", *_named("GPL-2.0", "the GPLv2", "the GPL v2", "GPL version 2")],
    "GPL-3.0": ["SPDX-License-Identifier: GPL-3.0-or-later", *_gnu("General Public License", "program", "3"), "GPLv3 licensed", "GNU General Public License Version 3 29 June 2007", *_named("GPL-3.0", "the GPLv3", "the GPL v3", "GPL version 3")],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", *_named("the ISC License")],
    "LGPL": ["Licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0", *_gnu("Lesser General Public License", "library", "2.1", "3"), *_gnu("Library General Public License", "library", "2"), *_named("LGPL-2.1", "LGPL-3.0", "the LGPL", "the LGPLv3", "the LGPL v3", "the LGPL v2.1", "the Lesser GPL", "the Lesser GPL v2.1", "the Lesser GPL v3")],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "SPDX-License-Identifier: MIT", "MIT licensed", "License: MIT", "MIT-Lizenz", "under Apache 2 or MIT", "MIT or Apache 2", *_named("the MIT license", "MIT license")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", *_named("MPL-2.0", "the MPL v2", "the Mozilla Public License 2.0", "the Mozilla Public License Version 2.0")],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense", *_named("the Unlicense")],
    "Proprietary": ["All rights reserved", "Copyright, all rights reserved", "Proprietary and confidential"],
}

# What a paragraph's words, one space between them, must have and must not have for a family.
_LICENCE = r"\bgnu {}general public license\b.*\b(version |v ?){}\b"
MARKS = {
    "AGPL-3.0": r"\baffero\b|\bagpl",
    "Apache-2.0": r"\bapache\b.*\bv?2\b",
    "BSD-2-Clause": r"\b2 clause\b|\bsimplified bsd\b",
    "BSD-3-Clause": r"\b3 clause\b|\bnew bsd\b|\bredistribution and use\b",
    "CC-BY-4.0": r"\bcc by 4\b|\bcommons attribution 4\b",
    "CC-BY-NC-4.0": r"\bcc by nc 4\b|\battribution noncommercial 4\b",
    "CC-BY-SA-4.0": r"\bcc by sa 4\b|\battribution sharealike 4\b",
    "CC0-1.0": r"\bcc0\b",
    "BSL-1.0": r"\bboost software license\b|\bbsl 1\b",
    "EPL-2.0": r"\beclipse public license\b.*\bv? ?2\b|\bepl v? ?2\b",
    "GPL-2.0": _LICENCE.format("", 2) + r"|\bgpl ?(version |v ?)?2\b",
    "GPL-3.0": _LICENCE.format("", 3) + r"|\bgpl ?(version |v ?)?3\b",
    "ISC": r"\bisc\b|\bwith or without fee\b|\bcopy modify and or distribute this software\b",
    "LGPL": r"\b(lesser|library) (general public|gpl)\b|\blgpl",
    "MIT": r"\bmit\b|\bgranted free of charge\b",
    "MPL-2.0": r"\bmozilla public license\b.*\bv? ?2\b|\bmpl v? ?2\b",
    "Unlicense": r"\bunlicense\b|\bfree and unencumbered\b",
    "Proprietary": r"\brights reserved\b|\bproprietary and confidential\b",
}
BARS = {f: r"\baffero\b|\b(lesser|library) (general public|gpl)\b|\bl?agpl|\blgpl" for f in ("GPL-2.0", "GPL-3.0")} | {"AGPL-3.0": r"\blesser (general public|gpl)\b|\blgpl", "LGPL": r"\baffero\b|\bagpl"}

#: Begin and end of the line number that is written behind each line feed while sentences are cut, and the mark behind a sentence.
_OPEN, _CLOSE, _CUT = "\x02", "\x03", "\x01"
_NUMBER = f"{_OPEN}[0-9]+{_CLOSE}"
#: A sentence ends at a full stop before a capital letter, or at a line without a word.
#: Repeated groups are possessive: Java recurses for each turn of others, and a long run would overflow the task's stack.
_END = rf"[.!?][\"')\]]*+(?:\s|{_NUMBER})++(?=[^\w\nÀ-Þ]*+[A-ZÀ-Þ])|\n{_NUMBER}(?:[^0-9A-Za-z\n{_OPEN}]*+\n{_NUMBER})++"
#: A sentence up to its last plain letter or digit that isn't of a line number.
_OWN = rf"(?s)^.*[0-9A-Za-z](?![0-9]*+{_CLOSE})"


# A word or the beginning of one that every match of a family's marks has, in lower case.
CLUES = ["affero", "apache", "clause", "bsd", "redistribution", "commons", "public", "distribute", "charge", "mozilla", "reserved", "proprietary", "boost", "unencumbered", "unlicense"]
SHORT = ["cc", "gpl", "mpl", "epl", "bsl", "isc", "fee"]
_SHORT = r"(?<![a-z0-9])(?:cc0?(?![a-z0-9])|[al]?gpl|mpl|epl|bsl|isc(?![a-z0-9])|fee(?![a-z0-9]))"
_MIT = r"(?<![a-z0-9])mit(?![a-z0-9])"


def _has(low: Column, words: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [low.contains(w) for w in words])


def _clue(low: Column) -> Column:
    """Whether lower-case text could have some family's marks. A notice of MIT cannot be confirmed without one of four further words."""
    mit = low.contains("mit") & _has(low, ["licen", "lizen", "under", "apache"]) & low.rlike(_MIT)
    return _has(low, CLUES) | mit | (_has(low, SHORT) & low.rlike(_SHORT))


def _hinted(docs: DataFrame) -> DataFrame:
    """The documents that could have a clue; their text is lowered once for all tests."""
    return docs.where(F.exists(F.array(F.lower("text")), lambda low: _has(low, CLUES + SHORT) | (low.contains("mit") & _has(low, ["licen", "lizen", "under", "apache"]))))


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _key() -> Column:
    """The same for rows with the same id and text, whose paragraphs are the same."""
    return F.xxhash64("doc_id", "text").alias("key")


def paragraphs(docs: DataFrame, hinted: bool = False) -> DataFrame:
    """doc_id, key, paragraph and last (both the number of the line), words, pairs of every line with a word; hinted: of those with a clue."""
    lines = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n"), lambda line, i: F.struct(i.alias("paragraph"), line.alias("line")))
    if hinted:
        lines = F.filter(lines, lambda x: _clue(x["line"]))
    # Words are made before the rows, so that no later filter makes them again.
    lines = F.transform(lines, lambda x: F.struct(x["paragraph"].alias("paragraph"), _words(x["line"]).alias("words")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), F.explode(lines).alias("x")).select("doc_id", "key", "x.*")
    return rows.where(F.size("words") > 0).select("doc_id", "key", "paragraph", F.col("paragraph").alias("last"), "words").withColumn("pairs", _pairs(F.col("words")))


def sentences(docs: DataFrame, hinted: bool = False) -> DataFrame:
    """As paragraphs(): every sentence that more than one line holds, from its first line to its last."""
    plain = F.translate(F.coalesce("text", F.lit("")), _CUT + _OPEN + _CLOSE, "   ")
    numbered = F.array_join(F.transform(F.split(plain, "\n"), lambda line, i: F.when(i == 0, line).otherwise(F.concat(F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE), line))), "\n")
    cut = F.split(F.regexp_replace(numbered, _END, "$0" + _CUT), _CUT)
    # What a sentence's end took along of the next line isn't the sentence's.
    own = F.transform(cut, lambda s: F.regexp_extract(s, _OWN, 0))
    over = F.filter(own, lambda s: s.contains(_OPEN))
    if hinted:
        over = F.filter(over, lambda s: F.exists(F.array(F.lower(s)), _clue))
    rows = docs.where(F.col("text").contains("\n")).select(F.col("doc_id").cast("long").alias("doc_id"), _key(), F.explode(over).alias("s"))
    number = lambda which: F.element_at(F.regexp_extract_all("s", F.lit(f"{_OPEN}([0-9]+){_CLOSE}"), 1), which).cast("int")
    starts = F.col("s").rlike(rf"^[^0-9A-Za-z{_OPEN}]*{_OPEN}")
    rows = rows.select("doc_id", "key", F.when(starts, number(1)).otherwise(number(1) - 1).alias("paragraph"), number(-1).alias("last"), _words(F.regexp_replace("s", _NUMBER, " ")).alias("words"))
    return rows.where((F.col("paragraph") < F.col("last")) & (F.size("words") > 0)).withColumn("pairs", _pairs(F.col("words")))


def notices(spark: SparkSession) -> DataFrame:
    rows = [(f, n) for f, texts in NOTICES.items() for n in texts]
    return spark.createDataFrame(rows, "family string, notice string").select("family", "notice", _words(F.col("notice")).alias("words")).withColumn("pairs", _pairs(F.col("words")))


def _marked(words: Column, family: Column | str) -> Column:
    """Whether the words have the family's marks and none of those that bar it."""
    said = F.concat_ws(" ", words)
    has = lambda f: said.rlike(MARKS[f]) & ~said.rlike(BARS[f]) if f in BARS else said.rlike(MARKS[f])
    if isinstance(family, str):
        return has(family)
    ok = F.lit(False)
    for f in MARKS:
        ok = F.when(family == f, has(f)).otherwise(ok)
    return ok


def _compared(rows: DataFrame, key: list[str]) -> DataFrame:
    """The best notice (family, similarity) of each row, over the constant table of notices."""
    known = F.broadcast(notices(rows.sparkSession).select(F.col("family").alias("notice_family"), F.col("pairs").alias("notice_pairs")))
    same = F.size(F.array_intersect("pairs", "notice_pairs")) / F.size("notice_pairs")
    near = rows.join(known, F.arrays_overlap("pairs", "notice_pairs")).withColumn("same", same).where(F.col("same") >= CONFIRM).where(_marked(F.col("words"), F.col("notice_family")))
    return near.groupBy(*key).agg(F.max(F.struct("same", F.size("notice_pairs").alias("size"), F.col("notice_family").alias("family"))).alias("best")).select(*key, F.col("best.family").alias("family"), F.col("best.same").alias("similarity"))


def _grams() -> Column:
    return F.concat("words", "pairs")


class Classifier:
    """The vocabulary, the fitted regression and the calibrated threshold."""

    def __init__(self, docs: DataFrame, sample_docs: int = SAMPLE_DOCS):
        spark = docs.sparkSession
        self.classes = [UNKNOWN, *NOTICES]
        n = docs.count()
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < max(1, (sample_docs << 20) // max(n, 1))
        sample = written(paragraphs(docs.where(share)).withColumn("row", F.monotonically_increasing_id()), "licence-sample")
        labels = _compared(sample, ["row"])
        sample = sample.join(labels, "row", "left").withColumn("family", F.coalesce("family", F.lit(UNKNOWN)))
        # A line of a wrapped notice is no unknown paragraph; the sentence stands for it.
        spans = written(sentences(docs.where(share)).withColumn("row", F.monotonically_increasing_id() + (1 << 62)), "licence-spans")
        spans = spans.join(_compared(spans, ["row"]), "row")
        covered = spans.select(F.col("key").alias("_key"), F.col("paragraph").alias("_first"), F.col("last").alias("_last"))
        sample = sample.join(covered, (F.col("family") == UNKNOWN) & (F.col("key") == F.col("_key")) & F.col("paragraph").between(F.col("_first"), F.col("_last")), "left_anti")
        sample = written(sample.unionByName(spans).withColumn("grams", _grams()), "licence-labelled")
        known = notices(spark).withColumn("grams", _grams())
        # Grams of the notices, without those common in other paragraphs. Both tables are bounded by constants.
        size = sample.where(F.col("family") == UNKNOWN).count()
        grams = known.select(F.explode("grams").alias("gram")).distinct()
        common = sample.where(F.col("family") == UNKNOWN).select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").count().where(F.col("count") > max(2, size // 200))
        vocabulary = [r["gram"] for r in grams.join(common, "gram", "left_anti").orderBy("gram").collect()]
        self.counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
        number = F.array_position(F.array(*map(F.lit, self.classes)), F.col("family")) - 1
        held = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(4)) == 0
        rows = sample.select("family", "grams", held.alias("held"), F.lit(1.0).alias("weight"))
        # The notices weigh as much together as the sample, so that rare families are learned.
        taught = known.select("family", "grams", F.lit(False).alias("held"), F.lit(max(1.0, size / 20.0)).alias("weight"))
        rows = self.counts.transform(rows.unionByName(taught)).withColumn("label", number.cast("double"))
        self.model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3, weightCol="weight").fit(rows.where("not held"))
        unknown = self.model.transform(rows.where("held").where(F.col("family") == UNKNOWN)).select((1 - vector_to_array("probability")[0]).alias("p"))
        passed = unknown.agg(F.percentile_approx("p", 1 - 1 / ONE_IN, 10_000)).first()[0]
        self.least = max(0.5, passed or 0.0)

    def predict(self, rows: DataFrame) -> DataFrame:
        """family, score and chances (by family) of every row of paragraphs(): the best class, or unknown below the threshold."""
        scored = self.model.transform(self.counts.transform(rows.withColumn("grams", _grams())))
        p = vector_to_array("probability")
        scored = scored.withColumn("score", 1 - p[0]).withColumn("best", F.array_position(F.slice(p, 2, len(NOTICES)), F.array_max(F.slice(p, 2, len(NOTICES)))).cast("int"))
        family = F.when(F.col("score") >= self.least, F.get(F.array(*map(F.lit, self.classes)), F.col("best"))).otherwise(UNKNOWN)
        return scored.withColumn("family", family).withColumn("chances", F.slice(p, 2, len(NOTICES))).select(*rows.columns, "family", "score", "chances")


def _confirmed(scored: DataFrame) -> DataFrame:
    """Every family that a notice and the marks confirm, of every row that isn't unknown."""
    known = F.broadcast(notices(scored.sparkSession).groupBy(F.col("family").alias("notice_family")).agg(F.collect_list("pairs").alias("notices")))
    same = F.array_max(F.transform("notices", lambda n: F.coalesce(F.size(F.array_intersect(n, F.col("pairs"))) / F.nullif(F.size(n), F.lit(0)), F.lit(0.0))))
    # The table of families is a constant; a row meets those whose marks it has.
    marked = [F.when(_marked(F.col("words"), f), f) for f in NOTICES]
    rows = scored.where(F.col("family") != UNKNOWN).drop("family").withColumn("notice_family", F.explode(F.array_compact(F.array(*marked))))
    near = rows.join(known, "notice_family").withColumn("similarity", same).where(F.col("similarity") >= CONFIRM)
    return near.select("doc_id", "key", "paragraph", "last", F.col("notice_family").alias("family"), "score", "similarity")


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its first line), family, score, similarity of every paragraph that is found to name a family."""
    classifier = Classifier(docs)
    find = lambda rows: _confirmed(classifier.predict(rows.withColumn("row", F.monotonically_increasing_id())))
    docs = written(_hinted(docs.select("doc_id", "text")), "licence-docs")
    lines = written(find(paragraphs(docs, True)), "licence-lines")
    inside = lines.select(F.col("key").alias("_key"), F.col("family").alias("_family"), F.col("paragraph").alias("_line")).distinct()
    over = find(sentences(docs, True)).join(inside, (F.col("key") == F.col("_key")) & (F.col("family") == F.col("_family")) & F.col("_line").between(F.col("paragraph"), F.col("last")), "left_anti")
    return lines.unionByName(over).select("doc_id", "paragraph", "family", "score", "similarity")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licensed paragraphs by document and family."""
    found = licence_scan(documents(spark, sf_dir))
    return found.groupBy("doc_id", "family").agg(F.count(F.lit(1)).alias("paragraphs"))


# The notices in the test tables, found by plain patterns: what the classifier must agree with there.
ORACLE_OP9 = """
WITH lines AS (
    SELECT CAST(doc_id AS BIGINT) AS doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), found AS (
    SELECT doc_id, CASE
        WHEN regexp_matches(lower(line), 'gnu general public license.* version 3') THEN 'GPL-3.0'
        WHEN regexp_matches(lower(line), 'apache license.* version 2') THEN 'Apache-2.0'
        WHEN regexp_matches(lower(line), 'mit license') THEN 'MIT'
        WHEN regexp_matches(lower(line), 'cc by-nc 4.0') THEN 'CC-BY-NC-4.0'
        WHEN regexp_matches(lower(line), 'all rights reserved') THEN 'Proprietary' END AS family
    FROM lines
)
SELECT doc_id, family, count(*) AS paragraphs FROM found WHERE family IS NOT NULL GROUP BY ALL
"""
