"""License scans by a positional index of rare words, with DataFrame functions alone.

A template is a license's wording with key phrases that are mandatory.  Over the whole corpus it is counted how many documents hold each word
of the templates; the index posts, for each template, the two of its mandatory words that the fewest documents hold, with their
places in it.  Looking up a document's rare words gives the places where a template would have to start; those on which both words
agree are kept, and there all mandatory words are compared.  Each template found gives its label, and counts with the share of its words,
mandatory or not, that stand in their places; the greatest such share is the document's score.

A mandatory phrase is never found without its rare words, so which words are rare decides what is looked at and not what is found. Nothing but the
counts, a row for each word of the templates, leaves its task, so a hot source or a long text moves no rows.

Words are runs of digits, letters a to z after lower-casing A to Z, and signs beyond ASCII. Null and empty texts have no words, no label and score
0. Texts of any length are read whole. Rows may repeat, each is answered; ids may be null; extra columns are ignored, whatever their names;
an empty table gives an empty result. Words that equally many documents hold are taken in alphabetical order.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the contract, each of them mandatory as a whole.
BASE = [("mit", "[under the mit license]"), ("apache-2", "[apache license version 2]"), ("cc-by-nc", "[cc by nc]")]

# Wordings of public licenses; what stands in brackets is mandatory.
WORDINGS = [
    ("agpl-3", "licensed under the [gnu affero general public license] version 3"),
    ("apache-2", "[licensed under the apache license version 2] 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "[spdx license identifier apache 2] 0"),
    ("boost-1", "distributed under the [boost software license version 1] 0"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are [permitted provided that the following conditions are met]"),
    ("cc-by", "this work is licensed under a [creative commons attribution 4 0] international license"),
    ("cc-by-nc", "licensed under a [creative commons attribution noncommercial] 4 0 international license"),
    ("cc-by-nc", "licensed under [cc by nc 4] 0"),
    ("cc-by-sa", "this work is licensed under a [creative commons attribution sharealike] 4 0 international license"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc0", "[cc0 1 0 universal] public domain dedication"),
    ("epl-2", "made available under the terms of the [eclipse public license] 2 0"),
    ("gpl-2", "this work is licensed under the [gnu general public license version 2]"),
    ("gpl-3", "this work is licensed under the [gnu general public license version 3]"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee [is hereby granted]"),
    ("lgpl", "licensed under the [gnu lesser general public license] version 3"),
    ("mit", "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files"),
    ("mit", "[spdx license identifier mit]"),
    ("mit", "released [under the mit license]"),
    ("mpl-2", "subject to the terms of the [mozilla public license] v 2 0"),
    ("unlicense", "[this is free and unencumbered software released into the public domain]"),
]


def parsed(template: tuple[str, str]) -> tuple[str, list[str], list[int]]:
    """Label, words, and the places of the mandatory ones."""
    label, wording = template
    words, must, inside = [], [], False
    for part in wording.split():
        inside |= part.startswith("[")
        if inside:
            must.append(len(words))
        words.append(part.strip("[]"))
        inside &= not part.endswith("]")
    return label, words, must


def words_of(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How many documents hold each word; the vocabulary is that of the templates and not of the corpus."""
    some = sorted(vocabulary)
    held = docs.select(F.explode(F.array_distinct(F.filter(words_of("text"), lambda w: w.isin(some)))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _strings(lists: list[list[str]]) -> Column:
    return F.array(*[F.array(*map(F.lit, x)) for x in lists])


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, wordings: list[tuple[str, str]] = WORDINGS) -> DataFrame:
    """(doc_id, n_words, places, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    places are (template, label, start, score) of all templates found, base ones first numbered; a start may lie before the text's first word if only
    words that aren't mandatory would be there.
    """
    templates = [parsed(t) for t in [*base, *wordings]]
    often = document_frequencies(docs, {w for _, words, _ in templates for w in words})
    index: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for t, (_, words, must) in enumerate(templates):
        rarest = sorted(must, key=lambda j: (often.get(words[j], 0), words[j], j))
        for postings, j in zip(index, (rarest[0], rarest[-1] if len(rarest) < 2 else rarest[1])):
            postings.setdefault(words[j], []).append((t, j))
    looked = sorted({*index[0], *index[1]})
    wide = F.lit(1 << 32).cast("long")  # a place as one number: template, then start

    def starts(postings: dict[str, list[tuple[int, int]]]) -> Column:
        table = F.create_map(*[x for w, own in sorted(postings.items()) for x in (F.lit(w), F.array(*[(F.lit(t).cast("long") * wide + F.lit((1 << 31) - j)) for t, j in own]))])
        return F.flatten(F.transform(F.filter("hits", lambda h: h["w"].isin(sorted(postings))), lambda h: F.transform(F.element_at(table, h["w"]), lambda p: p + h["i"])))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of("text").alias("words"))
    rows = rows.withColumn("hits", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(looked), F.struct(w.alias("w"), i.cast("long").alias("i"))))))
    rows = rows.withColumn("both", F.when(F.size("hits") > 0, F.array_intersect(starts(index[0]), starts(index[1]))).otherwise(F.array().cast("array<bigint>")))
    wording, must = _strings([w for _, w, _ in templates]), F.array(*[F.array(*map(F.lit, m)) for _, _, m in templates])
    label = F.array(*[F.lit(x) for x, _, _ in templates])
    place = F.transform("both", lambda p: F.struct(F.floor(p / wide).cast("int").alias("template"), (p % wide - F.lit(1 << 31)).cast("int").alias("start")))

    def stands(p: Column, j: Column) -> Column:
        return F.coalesce(F.get("words", p["start"] + j) == F.get(F.get(wording, p["template"]), j), F.lit(False))

    def share(p: Column) -> Column:
        own = F.get(wording, p["template"])
        return F.size(F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda j: stands(p, j))) / F.size(own)

    kept = F.filter(place, lambda p: F.forall(F.get(must, p["template"]), lambda j: stands(p, j)))
    rows = rows.withColumn("places", F.when(F.size("both") > 0, kept).otherwise(F.filter(place, lambda p: F.lit(False))))
    scored = F.transform("places", lambda p: F.struct(p["template"].alias("template"), F.get(label, p["template"]).alias("label"), p["start"].alias("start"), share(p).alias("score")))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_sort(scored).alias("places"))
    own = F.filter("places", lambda p: p["template"] < len(base))
    at = F.transform(own, lambda p: p["start"].cast("long"))
    names = lambda places: F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", "places", F.size(own).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), names(own).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def oracle(table: str = "documents") -> str:
    """The same in SQL: every template is tried at every word."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n ".join(f"({t}, '{label}', {listed(words)}, {[j for j in must]})" for t, (label, words, must) in enumerate(map(parsed, [*BASE, *WORDINGS])))
    return f"""
WITH t(template, label, words, must) AS (VALUES {rows}),
     d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w FROM {table}),
     e AS (SELECT r, w, i FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d) x WHERE w[i] IN (SELECT DISTINCT words[must[1] + 1] FROM t)),
     c AS (SELECT r, w, i - must[1] AS s, template, label, words, must FROM e JOIN t ON w[i] = words[must[1] + 1]),
     p AS (SELECT r, template, label, s - 1 AS start, len(list_filter(range(len(words)), lambda j: s + j >= 1 AND w[greatest(s + j, 1)] = words[j + 1])) / CAST(len(words) AS DOUBLE) AS score
           FROM c WHERE len(list_filter(must, lambda j: w[s + j] = words[j + 1])) = len(must)),
     g AS (SELECT r, count(*) FILTER (template < {len(BASE)}) AS n_base, min(start) FILTER (template < {len(BASE)}) AS first_word, max(start) FILTER (template < {len(BASE)}) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {len(BASE)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM p GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN g ON d.r = g.r
"""
