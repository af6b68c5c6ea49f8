"""Licence scan by a positional rare-token index (DataFrame functions only).

The templates are paragraphs of licence texts and notices, as a table of their words. The document
frequency of the licence words over all documents gives each its IDF. A word is rare if its IDF is at
least that of every template's rarest key-phrase word, so each template can be reached by one: that
is the lowest cut that loses none. The index is a table of postings (word, template, position) of the
rare words. A file's highest-IDF licence words, all that are rare, are looked up in it by a join; a word at
place p posts a template's start p - position, and the postings of one file, template and start are
summed. A start goes on if what it has, with all the template's common words granted, can reach
MIN_SHARE. There the whole template is laid over the file: MIN_SHARE of its IDF weight must stand in
place, and its mandatory key phrases in full. Base phrases are looked up by their own rarest word.

The templates bound the broadcast tables and the IDF's rows; no file meets another one, and only
files with a rare word carry their words past the scan.

Defined cases: null text counts as empty; a file without words or licence words has no places and
score 0; a paragraph that is cut off by the file's begin or end counts what is there; repeated rows are
scanned each on its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.words import ascii_lower
from .tables import cut

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, paragraph, mandatory key phrases (in words of the scan).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["copies or substantial portions of the software"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["for any purpose with or without fee is hereby granted"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["endorse or promote products derived from this software"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["specific language governing permissions and limitations under the license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["terms of the gnu general public license"]),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ["see the gnu general public license for more details"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["terms of the gnu lesser general public license"]),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["terms of the gnu affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["terms of the mozilla public license"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution", ["terms of the eclipse public license"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", ["boost software license version 1 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["unencumbered software released into the public domain"]),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", ["as long as the name is changed"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nd", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.", ["creative commons attribution noderivatives 4 0"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "released under the creative commons cc0 public domain dedication", ["cc0 public domain"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["permission is hereby granted"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license"]),
    ("proprietary", "this software is proprietary and confidential", ["proprietary and confidential"]),
]

#: IDF-weighted share of a template's words that must stand at their places.
MIN_SHARE = 0.6

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _split(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def _parsed() -> list[tuple[str, list[str], list[bool]]]:
    """Label, words, and whether each word belongs to a mandatory phrase."""
    out = []
    for label, text, phrases in TEMPLATES:
        words = _split(text)
        must = [False] * len(words)
        for phrase in phrases:
            p = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            must[at : at + len(p)] = [True] * len(p)
        out.append((label, words, must))
    return out


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log((n + 1) / (df + 1)) of each licence word over all documents; at most as many rows as the templates have words."""
    found = docs.select(F.explode(F.concat(F.array_intersect(words_of(F.col("text")), _strings(vocabulary)), F.array(F.lit("")))).alias("word"))
    df = {r["word"]: r["df"] for r in found.groupBy("word").agg(F.count("*").alias("df")).collect()}
    n = df.pop("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def _starts(phrase: list[str], anchor: int) -> Column:
    """Places of a base phrase, from those of its anchor word in `based`."""
    starts = F.filter(F.transform("based", lambda p: p - F.lit(anchor)), lambda s: s >= 0)
    first = [anchor, *(k for k in range(len(phrase)) if k != anchor)]
    return F.filter(starts, lambda s: reduce(lambda a, b: a & b, [F.coalesce(F.get("words", s + F.lit(k)) == F.lit(phrase[k]), F.lit(False)) for k in first]))


def _places(words: list[str]) -> Column:
    """Places of these words in a file."""
    none = F.array().cast("array<int>")
    return F.when(F.arrays_overlap("words", _strings(words)), F.filter(F.transform("words", lambda w, i: F.when(w.isin(words), i)), lambda i: i.isNotNull())).otherwise(none)


class Index:
    """The templates as tables, once the words' weights are known."""

    def __init__(self, spark: SparkSession, parsed: list[tuple[str, list[str], list[bool]]], weight: dict[str, float]) -> None:
        cut = min(max(weight[w] for w, m in zip(words, must, strict=True) if m) for _, words, must in parsed)
        templates, postings = [], []
        for t, (label, words, must) in enumerate(parsed):
            # a corpus in which every file holds every licence word leaves no weights: then all words weigh the same
            own = [weight[w] for w in words] if any(weight[w] > 0 for w in words) else [1.0] * len(words)
            rare = [(k, w) for k, w in enumerate(words) if weight[w] >= cut]
            total = sum(own)
            templates.append((t, label, words, [x / total for x in own], must, MIN_SHARE - (total - sum(own[k] for k, _ in rare)) / total))
            postings += [(w, t, k, own[k] / total) for k, w in rare]
        self.rare = sorted({w for w, *_ in postings})
        self.templates = spark.createDataFrame(templates, "template int, label string, template_words array<string>, weights array<double>, must array<boolean>, least double")
        self.postings = spark.createDataFrame(postings, "word string, template int, at int, weight double")


def _found(files: DataFrame, index: Index) -> DataFrame:
    """row, labels, share of files(row, words, rare) in which templates stand."""
    looked_up = files.select("row", F.explode("rare").alias("place"), F.get("words", F.col("place")).alias("word"))
    posted = looked_up.join(F.broadcast(index.postings), "word").select("row", "template", (F.col("place") - F.col("at")).alias("start"), "weight")
    starts = posted.groupBy("row", "template", "start").agg(F.sum("weight").alias("has"))
    able = starts.join(F.broadcast(index.templates), "template").where(F.col("has") >= F.col("least") - 1e-9)
    laid = able.join(files.select("row", "words"), "row")
    here = lambda k: F.coalesce((F.col("start") + k >= 0) & (F.get("words", F.greatest(F.col("start") + k, F.lit(0))) == F.get("template_words", k)), F.lit(False))
    every = F.sequence(F.lit(0), F.size("template_words") - 1)
    share = F.aggregate(every, F.lit(0.0), lambda total, k: total + F.when(here(k), F.get("weights", k)).otherwise(0.0))
    whole = F.forall(every, lambda k: ~F.get("must", k) | here(k))
    true = laid.where(whole).select("row", "label", share.alias("share")).where(F.col("share") >= MIN_SHARE - 1e-9)
    return true.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("template_labels"), F.max("share").alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (array of base label and start), template_labels, score for every row of docs(doc_id, text)."""
    parsed = _parsed()
    base = [(label, p.split()) for p, label in BASE.items()]
    weight = idf(docs, sorted({w for _, words, _ in parsed for w in words} | {w for _, p in base for w in p}))
    index = Index(docs.sparkSession, parsed, weight)
    anchor = lambda p: max(range(len(p)), key=lambda k: (weight[p[k]], -k))
    anchored = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumns({"based": _places(sorted({p[anchor(p)] for _, p in base})), "rare": _places(index.rare)})
    named = lambda label: lambda s: F.struct(F.lit(label).alias("label"), s.alias("start"))
    places = F.flatten(F.array(*[F.transform(_starts(p, anchor(p)), named(label)) for label, p in base]))
    none = F.array().cast("array<struct<label:string,start:int>>")
    # the row's key is fixed by writing it down
    files = cut(
        anchored.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.when(F.size("based") > 0, places).otherwise(none).alias("places"),
            "rare",
            F.when(F.size("rare") > 0, F.col("words")).alias("words"),
        )
    )
    found = _found(files.where("words is not null").select("row", "words", "rare"), index)
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))))
    return files.select("row", "doc_id", "n_words", "places").join(found, "row", "left").select("doc_id", "n_words", "places", F.coalesce("template_labels", F.array().cast("array<string>")).alias("template_labels"), score.alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    """The scan of every document as counts and joined labels."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["start"])
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("template_labels"))).alias("labels"),
        "score",
    )
