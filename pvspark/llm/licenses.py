"""License scans with DataFrame functions only.

A text's units are its lines, its paragraphs (up to a line without letters and digits), its sentences, the whole text, and, for a notice that
stands amid other words, each run of words as long as a template that has one of its anchors (see anchors()) at the template's place. Normalised (lower case, other than
letters and digits to one space), a unit is compared with each template by the Dice coefficient of their sets of word bigrams. Sizes bound it: with a set of a and one of b
bigrams it is at most 2*min/(a+b), so only templates of a near size are compared. The least overlap that follows from the sizes also gives, for
each template, a few words of which a unit must have one; texts without any of them are passed over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 80  # percent

# Notices of well-known public licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


# Whole paragraphs of the same licences' notices, and of others, beside the short forms. The SQL has the short forms only.
PARAGRAPHS = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}


# Words that are poor signs of a notice.
COMMON = frozenset("a and any be by following for general in is it of or that the this to under with you".split())


def words_of(text: str) -> list[str]:
    """The normal form of a template, as Spark's side makes it of units."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def bigrams(w: Column) -> Column:
    """The distinct bigrams of an array of words, of two at least."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def bounds(size: int, threshold: int) -> tuple[int, int]:
    """How many bigrams a set can have that reaches the threshold (percent) with a set of `size`."""
    return -(-size * threshold // (200 - threshold)), size * (200 - threshold) // threshold


def anchors(text: str, threshold: int) -> list[str]:
    """Words of a template of which each unit that reaches the threshold has one: so many of the template's bigrams hold one of them that the
    others are fewer than the least overlap."""
    grams = bigrams_of(text)
    least = -(-threshold * (bounds(len(grams), threshold)[0] + len(grams)) // 200)
    left, out = set(grams), []
    for word in sorted(set(words_of(text)), key=lambda w: (w in COMMON, -len(w), w)):
        if len(left) < least:
            break
        left = {g for g in left if word not in g.split(" ")}
        out.append(word)
    return out


def placed(w: Column, texts: list[str], threshold: int) -> Column:
    """The runs of an array of words that have a template's length and one of its anchors where the template has it."""
    places: dict[str, list[tuple[int, int]]] = {}
    for t in texts:
        own = words_of(t)
        for word in anchors(t, threshold):
            places.setdefault(word, []).extend((k, len(own)) for k, x in enumerate(own) if x == word)
    table = F.create_map(*(c for word, at in sorted(places.items()) for c in (F.lit(word), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in sorted(set(at)))))))
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(sorted(places)))
    # A run as one number and its words as one text: only of atomic values does array_distinct compare by hash, so many anchors take time in proportion.
    begin = lambda h, p: F.greatest(h["i"] - p["k"], F.lit(0)).cast("long") * (1 << 31)
    runs = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h["x"]), lambda p: begin(h, p) + F.greatest(h["i"] - p["k"] + p["n"], F.lit(0)).cast("long")))))
    start, end = (lambda r: F.shiftright(r, 31).cast("int")), (lambda r: r.bitwiseAND((1 << 31) - 1).cast("int"))
    texts = F.array_distinct(F.transform(runs, lambda r: F.array_join(F.slice(w, start(r) + 1, end(r) - start(r)), " ")))
    return F.transform(texts, lambda t: F.split(t, " "))


def every() -> dict[str, list[str]]:
    """The short forms and the paragraphs."""
    return {name: [*TEMPLATES.get(name, []), *PARAGRAPHS.get(name, [])] for name in sorted({*TEMPLATES, *PARAGRAPHS})}


def matches(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id and licenses, an array of struct<license string, dice double>: the best coefficient of
    each licence that reaches the threshold, by name.

    Nothing is exploded or shuffled. Null and empty texts have no units; repeated units change nothing; of templates of one licence the best one
    counts. Templates of fewer than two words match nothing.
    """
    texts = sorted({(name, t) for name, texts in (templates or every()).items() for t in texts if len(words_of(t)) > 1})
    known = [(name, tuple(bigrams_of(t))) for name, t in texts]
    if not known:
        return docs.select("doc_id", F.array().cast("array<struct<license:string,dice:double>>").alias("licenses"))
    low = min(bounds(len(b), threshold)[0] for _, b in known)
    high = max(bounds(len(b), threshold)[1] for _, b in known)
    words = sorted({w for _, t in texts for w in anchors(t, threshold)})
    low_text = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    short = [w for w in words if len(w) < 5]
    some = reduce(Column.__or__, [F.col("t").contains(w) for w in words if len(w) > 4] + ([F.col("t").rlike(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])")] if short else []))
    text = low_text.select("doc_id", F.when(some, F.regexp_replace("t", "[^a-z0-9\n]+", " ")).otherwise("").alias("t"), F.when(some, F.col("t")).otherwise("").alias("raw"))
    flat = lambda u: F.split(F.trim(F.translate(u, "\n", " ")), " +")
    paragraphs = F.when(F.col("t").rlike("\n *\n"), F.split("t", "\n *\n")).otherwise(F.array().cast("array<string>"))
    sentences = F.transform(F.split("raw", "[.!?][\\s\"')]+"), lambda u: F.split(F.trim(F.regexp_replace(u, "[^a-z0-9]+", " ")), " "))
    text = text.select("doc_id", "t", "raw", flat(F.col("t")).alias("all"))
    units = F.concat(F.transform(F.split("t", "\n"), flat), F.transform(paragraphs, flat), sentences, F.array("all"), placed(F.col("all"), [t for _, t in texts], threshold))
    # a unit with fewer than `low` bigrams, or more than `high`, reaches the threshold with no template; with d distinct words it has d - 1 at least
    sized = F.filter(units, lambda w: (F.size(w) > low) & (F.size(F.array_distinct(F.slice(w, 1, 4 * high))) <= high + 1))
    sets = text.select("doc_id", sized.alias("words")).select("doc_id", F.transform("words", bigrams).alias("sets"))
    sets = sets.select("doc_id", F.filter("sets", lambda s: F.size(s).between(low, high)).alias("sets"))
    found = sets.select("doc_id", *(best(set_, threshold).alias(f"t{k}") for k, (_, set_) in enumerate(known)))
    names = sorted({n for n, _ in known})
    each = [
        F.struct(F.lit(name).alias("license"), F.greatest(*(c if len(c) > 1 else [*c, F.lit(-1.0)])).alias("dice"))
        for name in names
        for c in [[F.coalesce(f"t{k}", F.lit(-1.0)) for k, (n, _) in enumerate(known) if n == name]]
    ]
    return found.select("doc_id", F.filter(F.array(*each), lambda x: x["dice"] >= 0).alias("licenses"))


def best(template: tuple[str, ...], threshold: int) -> Column:
    """The best coefficient that one of the column `sets` reaches with a template; null if none reaches the threshold."""
    a, b = bounds(len(template), threshold)
    other = F.array(*map(F.lit, template))
    near = F.filter("sets", lambda s: F.size(s).between(a, b))
    dice = F.transform(near, lambda s: F.size(F.array_intersect(s, other)) * 2 / (F.size(s) + len(template)))
    return F.array_max(F.filter(dice, lambda x: x * 100 >= threshold))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    top = F.array_max(F.transform("licenses", lambda x: x["dice"]))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.round(F.coalesce(top, F.lit(0.0)), 6).alias("best_dice"),
    )


def oracle() -> str:
    """The result in DuckDB SQL, from an exploded list of units, for texts whose notices are short forms that are lines, paragraphs or texts of their own."""
    rows = ",\n".join(
        "('{}', [{}])".format(name, ", ".join("'{}'".format(x) for x in bigrams_of(t))) for name, texts in TEMPLATES.items() for t in texts
    )
    return f"""
WITH templates(license, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents),
units AS (
  SELECT r, unnest(string_split(t, chr(10))) AS u FROM docs
  UNION ALL SELECT r, unnest(regexp_split_to_array(t, '\\n *\\n')) FROM docs
  UNION ALL SELECT r, t FROM docs
),
worded AS (SELECT r, regexp_split_to_array(trim(replace(u, chr(10), ' ')), ' +') AS w FROM units),
near AS (
  SELECT r, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1
),
hits AS (
  SELECT r, license, max(len(list_intersect(g, t.grams)) * 2.0::DOUBLE / (len(g) + len(t.grams))) AS dice
  FROM near JOIN templates t ON len(list_intersect(g, t.grams)) * 200 >= {THRESHOLD} * (len(g) + len(t.grams)) GROUP BY ALL
),
per AS (SELECT r, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, max(dice) AS best FROM hits GROUP BY r)
SELECT doc_id, CAST(coalesce(n_licenses, 0) AS BIGINT) AS n_licenses,
  coalesce(licenses, '') AS licenses, round(coalesce(best, 0.0::DOUBLE), 6) AS best_dice
FROM docs LEFT JOIN per USING (r)
"""
