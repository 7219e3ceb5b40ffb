"""License scans by diagonal voting.

Texts and templates become words; every run of k words is a k-gram. All rolling k-grams of a text meet the templates'
k-grams in a Spark join; a hit at text word p and template word t votes for the diagonal p - t. Votes are gathered by
document, template and diagonal into runs of neighbouring places, neighbouring diagonals of one template are merged,
so that a few words put in or left out do not part a passage, and merged spans are verified: their share of the
template's words is the score, and a phrase must stand there word for word.

A k-gram is coded by the places of its words in the templates' vocabulary, which is exact: two k-grams have one code
only if they are the same words. Words outside the vocabulary cannot be part of a hit, so a task passes on hits only;
texts are not shuffled. The template table is fixed: its rows are the words of the templates.

Templates are opening passages, short statements such as "under the GNU General Public License", which must stand whole,
and the full texts in ``licenses``, dealt into windows of WINDOW words, so that any run of WINDOW words of a license
covers half of some window. A window whose wording an earlier license of TEXTS has is left to that one, and of different
labels at overlapping places the one with the largest share stays.

Nulls and odd rows: a null text has no words. Repeated rows are scanned each. Very long texts are one row of hits
each. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.common import Scratch

#: Bytes that end a word become spaces, A-Z become a-z; bytes over x7F belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
K = 3
#: Words in a window of a full text.
WINDOW = 40
LICENSES = Path(__file__).resolve().parent / "licenses"


@dataclass(frozen=True)
class Template:
    """exact: all of its k-grams must be there, not only scan()'s share of its words."""

    label: str
    text: str
    phrase: bool = False
    exact: bool = False


#: The phrases, which must stand word for word, and well-known opening passages of public licenses.
PHRASES = [Template("mit", "under the mit license", True), Template("apache-2", "apache license version 2", True), Template("cc-by-nc", "cc by nc", True)]
PASSAGES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("agpl", "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version"),
]


def _gnu(label: str, name: str, short: str, versions: list[str]) -> list[Template]:
    stated = [f"under the {name}", f"the terms of the {name}", f"{name} version", f"under the {short} license", *[f"{n} {v}" for n in (name, f"{short} version", short) for v in versions], *[f"{short} v{v}" for v in versions if " " in v], *[f"licensed under {w}{short}" for w in ("", "the ", "gnu ", "the gnu ")], *[f"gnu {short} v{v}" for v in versions], *[f"{name} v{v}" for v in versions]]
    return [Template(label, t, exact=True) for t in stated if len(words(t)) >= K]


def statements() -> list[Template]:
    """Short statements, which must stand whole."""
    plain = {
        "mit": ["the mit license", "licensed under mit", "spdx license identifier mit"],
        "apache-2": ["apache license 2 0", "apache 2 0 license", "license identifier apache 2 0", "licensed under apache 2 0"],
        "bsd": ["under the bsd license", "under a bsd license", "under a bsd style license", *[f"{a} {b} {c}" for n in ("2", "3", "two", "three") for a, b, c in (("bsd", n, "clause"), (n, "clause", "bsd"))]],
        "mpl-2": ["mozilla public license version 2", "mozilla public license v 2", "mozilla public license 2 0", "mozilla public license v2", "under the mozilla public license", "mpl 2 0"],
        "cc-by": ["creative commons attribution 4 0", "creative commons attribution 3 0", "creative commons attribution license", "creative commons attribution international", "cc by 4 0", "cc by 3 0", "under cc by license", "under a cc by license", "under the cc by license"],
        "cc-by-sa": ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"],
        "cc-by-nc": ["creative commons attribution noncommercial", "creative commons attribution non commercial"],
        "cc0": ["cc0 1 0", "creative commons zero"],
        "isc": ["under the isc license", "the isc license"],
        "unlicense": ["under the unlicense", "released into the public domain"],
    }
    gnu = _gnu("gpl", "gnu general public license", "gpl", ["2", "2 0", "3", "3 0"]) + _gnu("lgpl", "gnu lesser general public license", "lgpl", ["2 1", "3", "3 0"]) + _gnu("lgpl", "gnu library general public license", "lgpl", ["2", "2 0"]) + _gnu("agpl", "gnu affero general public license", "agpl", ["3", "3 0"])
    return gnu + [Template(label, t, exact=True) for label, some in plain.items() for t in some]


#: Full texts and their labels.
TEXTS = {
    "MIT": "mit", "Apache-2.0": "apache-2", "BSD": "bsd", "Unlicense": "unlicense", "GPL-3": "gpl", "GPL-2": "gpl", "GPL-1": "gpl", "LGPL-3": "lgpl", "LGPL-2.1": "lgpl", "LGPL-2": "lgpl",
    "MPL-2.0": "mpl-2", "MPL-1.1": "mpl-1.1", "CC0-1.0": "cc0", "GFDL-1.3": "gfdl", "GFDL-1.2": "gfdl", "Artistic": "artistic",
}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _codes(ids: np.ndarray, base: int) -> np.ndarray:
    """Code of the k-gram that starts at each place; 0 where a word is unknown (id 0)."""
    if len(ids) < K:
        return np.zeros(0, np.int64)
    parts = [ids[i : len(ids) - K + 1 + i] for i in range(K)]
    return np.where(np.logical_and.reduce([p > 0 for p in parts]), (parts[0] * base + parts[1]) * base + parts[2], 0)


@cache
def windows(shared: float = 0.8) -> list[Template]:
    """The full texts in windows of WINDOW words, the last one reaching back; without those that an earlier label's wording covers."""
    first: dict[tuple[bytes, ...], str] = {}
    found = []
    for t in PASSAGES:
        ws = words(t.text)
        for g in zip(*(ws[i:] for i in range(K))):
            first.setdefault(g, t.label)
    for name, label in TEXTS.items():
        ws = words((LICENSES / f"{name}.txt").read_text("utf-8", "replace"))
        for at in sorted({*range(0, max(1, len(ws) - WINDOW), WINDOW), max(0, len(ws) - WINDOW)}):
            some = ws[at : at + WINDOW]
            others = {p + i for p, g in enumerate(zip(*(some[i:] for i in range(K)))) if first.get(g, label) != label for i in range(K)}
            if len(others) < shared * len(some):
                found.append(Template(label, b" ".join(some).decode()))
        for g in zip(*(ws[i:] for i in range(K))):
            first.setdefault(g, label)
    return found


def scan(docs: DataFrame, scratch: Scratch, templates: list[Template] | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_share: float = 0.5, slack: int = 4) -> DataFrame:
    """keep columns of docs with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    templates = PHRASES + PASSAGES + statements() + windows() if templates is None else templates
    split = [words(t.text) for t in templates]
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in split for w in ws}))}
    base = len(vocabulary) + 1
    at = [(n, t.label, t.phrase, len(ws), t.exact, int(p), int(c)) for n, (t, ws) in enumerate(zip(templates, split, strict=True)) for p, c in enumerate(_codes(np.array([vocabulary[w] for w in ws]), base))]
    known = np.unique([c for *_, c in at])

    @F.pandas_udf("struct<n_words:bigint,place:array<bigint>,code:array<bigint>>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            rows = []
            for t in some:
                ws = words(t)
                codes = _codes(np.fromiter(map(vocabulary.get, ws, repeat(0)), np.int64, len(ws)), base)
                found = np.flatnonzero(codes)
                found = found[known[np.minimum(np.searchsorted(known, codes[found]), len(known) - 1)] == codes[found]]
                rows.append((len(ws), found, codes[found]))
            yield pd.DataFrame(rows, columns=["n_words", "place", "code"])

    read = scratch.keep(docs.withColumns({"_rid": F.monotonically_increasing_id(), "_hit": hits(F.col(text))}).select("_rid", *keep, "_hit.*"))
    places = docs.sparkSession.createDataFrame(at, "template int, label string, phrase boolean, long int, exact boolean, t long, code long")
    votes = read.where(F.size("place") > 0).select("_rid", F.explode(F.arrays_zip("place", "code")).alias("h")).select("_rid", F.col("h.place").alias("p"), F.col("h.code").alias("code")).join(F.broadcast(places), "code").withColumn("diagonal", F.col("p") - F.col("t"))

    # a phrase or a short statement: all its k-grams on one diagonal
    by = ["_rid", "template", "label", "long", "diagonal"]
    whole = votes.where("phrase or exact").groupBy(*by, "phrase").agg(F.count("*").alias("n")).where(F.col("n") == F.col("long") - K + 1)
    phrase = whole.where("phrase")
    stated = whole.where("not phrase").select("_rid", "label", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("long")).alias("stop"), F.lit(1.0).alias("share"))
    base_hits = phrase.groupBy("_rid").agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("_base"))

    # a passage: diagonals within ``slack`` of the one before are one; each template word counts once
    passage = votes.where("not phrase and not exact").groupBy(*by).agg(F.collect_set("t").alias("ts"), F.min("p").alias("start"), F.max("p").alias("stop"))
    order = Window.partitionBy("_rid", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True)).cast("int")
    merged = passage.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order)).groupBy("_rid", "template", "label", "long", "_run").agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min("start").alias("start"), (F.max("stop") + K).alias("stop"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + K - 1)))))
    found = merged.withColumn("share", covered / F.col("long")).where(F.col("share") >= least_share).select("_rid", "label", "start", "stop", "share").unionByName(stated)
    # of labels at overlapping places the one with the largest share stays: licenses borrow one another's wording
    reach = max(map(len, split)) * (1 + slack)
    near = Window.partitionBy("_rid").orderBy("start").rangeBetween(-reach, reach)
    beside = F.collect_set(F.struct("start", "stop", "share", "label")).over(near)
    better = F.exists("_beside", lambda o: (o["label"] != F.col("label")) & (o["share"] > F.col("share")) & (o["start"] < F.col("stop")) & (F.col("start") < o["stop"]))
    best = found.withColumn("_beside", beside).where(~better)
    scored = best.groupBy("_rid").agg(F.collect_set("label").alias("_more"), F.max("share").alias("_share"))

    out = read.drop("place", "code").join(base_hits, "_rid", "left").join(scored, "_rid", "left").drop("_rid")
    none = F.array().cast("array<string>")
    text_of = lambda *sets: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(s, none) for s in sets]))), ",")
    return out.withColumns({
        "n_base": F.coalesce("n_base", F.lit(0).cast("long")),
        "base_labels": text_of(F.col("_base")),
        "labels": text_of(F.col("_base"), F.col("_more")),
        "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))),
    }).drop("_base", "_more", "_share")
