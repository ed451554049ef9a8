"""Licence scans with a positional rare-token index. DataFrame operations only.

The index holds, for each licence template, its words of highest inverse document frequency with their positions,
and for each key phrase its rarest word. A file's index words are looked up; each occurrence proposes a place for
the templates that hold the word; a place stands when the template's index words occur at the same relative
positions, and its mandatory key phrases stand there word for word. Phrases that are a label by themselves go
through the same index: every place holds the phrase's rarest word, so none is missed.

Document frequencies are counted over all files, for the templates' own words only (a fixed, short list).

Defined results: null and empty texts have no words, no places, empty labels and score 0; overlapping places all
count; repeated rows are scanned alike, and rows need no unique or non-null id; extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotstack.llm.common import free_name

#: Key phrases that are a label by themselves.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Parts of notices that more than one of them has.
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_CLAUSES = (
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form "
    "must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_THIRD = (
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission"
)
_BSD_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
    "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GPL_HEADER = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
    "foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should "
    "have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"
)
#: Notices, each with its label and its mandatory key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted", "free of charge"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("source and binary forms", "are permitted"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "is hereby granted"),
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    # whole notices
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("permission to use copy modify and or distribute", "with or without fee is hereby granted"),
    ),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_DISCLAIMER}", ("source and binary forms", "2 redistributions in binary form", "distribution this software is provided by")),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_THIRD} {_BSD_DISCLAIMER}", ("source and binary forms", "to endorse or promote products")),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
        "the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
        ("licensed under the apache license version 2 0", "except in compliance with the license"),
    ),
    ("gpl-3.0", _GPL_HEADER.format(3), ("gnu general public license as published by", "either version 3 of the license")),
    ("gpl-2.0", _GPL_HEADER.format(2), ("gnu general public license as published by", "either version 2 of the license")),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain "
        "one at https mozilla org mpl 2 0",
        ("this source code form", "mozilla public license v 2 0"),
    ),
)
#: Index words of each template, and how many of them have to stand at their places.
RARE_WORDS, RARE_MATCHES = 4, 2
#: Least share of a template's words that stand at their places.
LEAST_SHARE = 0.6


def words(text: Column) -> Column:
    """Runs of digits, a-z and all beyond ASCII, with A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x00-/:-`{-\x7F]+"), "")


def _entries() -> list[tuple[str, list[str], list[tuple[int, int]], bool]]:
    """(label, words, spans of mandatory phrases, base) of base phrases and templates."""
    out = [(label, phrase.split(), [(0, len(phrase.split()))], True) for phrase, label in BASE_PHRASES.items()]
    for label, text, phrases in TEMPLATES:
        own = text.split()
        spans = []
        for phrase in phrases:
            p = phrase.split()
            spans.append((next(i for i in range(len(own)) if own[i : i + len(p)] == p), len(p)))
        out.append((label, own, spans, False))
    return out


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """In how many documents each template word occurs; at most as many rows as the templates have words."""
    vocabulary = sorted({w for _, own, _, _ in _entries() for w in own})
    met = F.array_intersect(words(F.col(text)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(met).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counts}


def scan(docs: DataFrame, frequencies: dict[str, int], text: str = "text") -> DataFrame:
    """`docs` with `n_words` and `places`: an array of (entry, start, label, base, share) of all that stands.

    Columns of these two names are replaced; all others pass through.
    """
    own_name, hit_name = free_name("_words", docs), free_name("_hits", docs)
    entries = _entries()
    rank = lambda w: (frequencies.get(w, 0), w)
    postings: dict[str, list[tuple[int, int]]] = {}
    index_positions = []
    for k, (_, own, _, base) in enumerate(entries):
        rare = sorted(set(own), key=rank)[: 1 if base else RARE_WORDS]
        kept = [next(i for i, x in enumerate(own) if x == w) for w in rare]
        index_positions.append(kept)
        for i in kept:
            postings.setdefault(own[i], []).append((k, i))

    look_up = F.create_map(
        *(x for w, at in sorted(postings.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in at))))
    )
    ints = lambda xs: F.array(*map(F.lit, xs))
    templates = F.array(
        *(
            F.struct(
                F.lit(label).alias("label"),
                F.lit(base).alias("base"),
                F.array(*map(F.lit, own)).alias("own"),
                ints(index_positions[k]).alias("rare"),
                F.lit(min(len(index_positions[k]), RARE_MATCHES)).alias("least"),
                ints(sorted({j for a, n in spans for j in range(a, a + n)})).alias("key"),
            )
            for k, (label, own, spans, base) in enumerate(entries)
        )
    )
    own_words = F.col(own_name)

    def stands(t: Column, start: Column, j: Column) -> Column:
        return F.coalesce(F.get(own_words, start + j) == F.get(t["own"], j), F.lit(False))

    def judged(x: Column) -> Column:
        t, start = F.get(templates, x["k"]), x["start"]
        matched = F.size(F.filter(F.sequence(F.lit(0), F.size(t["own"]) - 1), lambda j: stands(t, start, j)))
        return F.struct(
            x["k"].alias("entry"),
            start.alias("start"),
            t["label"].alias("label"),
            t["base"].alias("base"),
            (matched / F.size(t["own"])).alias("share"),
        )

    def possible(x: Column) -> Column:
        """Index words at the same relative positions, then the mandatory key phrases."""
        t, start = F.get(templates, x["k"]), x["start"]
        together = F.size(F.filter(t["rare"], lambda j: stands(t, start, j))) >= t["least"]
        return together & F.forall(t["key"], lambda j: stands(t, start, j))

    hits = F.filter(
        F.transform(own_words, lambda w, i: F.when(w.isin(*sorted(postings)), i)), lambda i: i.isNotNull()
    )
    proposals = F.flatten(
        F.transform(hit_name, lambda i: F.transform(F.element_at(look_up, F.get(own_words, i)), lambda p: p["k"].cast("long") + (i - p["i"]).cast("long") * len(entries)))
    )
    count = F.lit(len(entries)).cast("long")
    split = F.transform(
        F.array_distinct(proposals),
        lambda c: F.struct(F.pmod(c, count).cast("int").alias("k"), F.floor(c / count).cast("int").alias("start")),
    )
    return (
        docs.withColumn(own_name, words(F.col(text)))
        .withColumn(hit_name, hits)
        .withColumn("n_words", F.size(own_name).cast("long"))
        .withColumn("places", F.filter(F.transform(F.filter(split, possible), judged), lambda p: p["share"] >= LEAST_SHARE))
        .drop(own_name, hit_name)
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, document_frequencies(docs)).drop("text")
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    joined = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )




def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the licence scan that SQL can express: words and the base phrases' places."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_PLACES_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT * FROM (VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])) v(label, words)
), f AS (
  SELECT row_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(words)] = words)) AS place FROM w, p
), g AS (SELECT row_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM f GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(l, '') AS base_labels
FROM w LEFT JOIN g USING (row_id)
"""
