"""Licence scan by a positional rare-token index, in DataFrame operations only.

The words of licence templates are weighed by their inverse document frequency over all texts. The index holds
postings (template, position) of each template's rarest words and of the words of its mandatory key phrases. A text
that holds the rarest word of some template's key phrases has all its words looked up. A posting (t, p) met at word i
is a vote for template t beginning at word i - p; votes are sorted and counted by runs, so the work grows with the
votes. A template stands at a place if enough of its rare words agree on it and all its key phrases stand there.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of texts, after A-Z is lower-cased (all but U+0000-2F, U+3A-60 and U+7B-7F), and the base phrases with their labels.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]++"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence notices and passages of licence texts: label, words, key phrases that must stand at their places.
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license",)),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", ("hereby grants to you", "derivative works in source or object form")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("must retain the above copyright notice",)),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful", "gnu general public license")),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("verbatim copies of this license document",)),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl was not distributed",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ("nor the names of its contributors",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("to alter it and redistribute it freely",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0", "public domain dedication")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("compile sell or distribute this software",)),
)
#: Names of licences that stand for themselves, each a template and its own key phrase.
NAMED = (
    ("mit", "the mit license mit"), ("apache", "apache software license version 2 0"), ("apache", "apache software license version 1 1"), ("apache", "apache license 2 0"), ("bsd", "bsd 2 clause license"), ("bsd", "bsd 3 clause license"),
    ("bsd", "3 clause bsd license"), ("bsd", "2 clause bsd license"), ("boost", "boost software license version 1 0"), ("artistic", "the artistic license 2 0"), ("artistic", "artistic license 1 0"), ("eupl", "european union public licence"), ("eupl", "european union public license"),
    ("wtfpl", "do what the fuck you want to public license"), ("gfdl", "gnu free documentation license"), ("ofl", "sil open font license"), ("ms-pl", "microsoft public license"), ("psf", "python software foundation license"), ("mpl", "mozilla public license version 2 0"),
    ("epl", "eclipse public license v 2 0"), ("cddl", "common development and distribution license"), ("isc", "licensed under the isc license"), ("odbl", "open database license"), ("cc0", "creative commons zero"),
)
#: Identifiers of licences as they stand behind "SPDX-License-Identifier", and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "mpl 2 0": "mpl", "epl 2 0": "epl", "isc": "isc",
    "bsl 1 0": "boost", "zlib": "zlib", "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "artistic 2 0": "artistic", "eupl 1 2": "eupl", "wtfpl": "wtfpl", "cddl 1 0": "cddl",
}
#: The conditions of the Creative Commons licences in short and written out, their versions, and the versions' names.
CONDITIONS = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives", "nc sa": "noncommercial sharealike", "nc nd": "noncommercial noderivatives"}
VERSIONS = {"4 0": "international", "3 0": "unported", "2 5": "generic", "2 0": "generic"}


def _templates() -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """The notices, and what the names, identifiers, conditions and versions make up."""
    own = list(NAMED)
    own += [(label, f"spdx license identifier {x}") for x, label in IDENTIFIERS.items()]
    for version, name in VERSIONS.items():
        own.append(("cc-by", f"attribution {version} {name}"))
        for short, long in CONDITIONS.items():
            own += [(f"cc-by-{short.replace(' ', '-')}", f"{x} {version}") for x in (f"cc by {short}", f"attribution {long}")]
    return (*NOTICES, *[(label, words, (words,)) for label, words in own])


TEMPLATES = _templates()
#: Words of a template that are indexed (its rarest), and the share of their places that must agree.
INDEXED, AGREE = 6, 0.6
#: A vote is (template, first word + SHIFT, rare, key) in one number, so that votes sort by template and place.
SHIFT, PLACE_BITS = 1 << 10, 40


def vocabulary() -> list[str]:
    return sorted({w for _, words, _ in TEMPLATES for w in words.split()})


def document_frequency(words: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of rows, and of rows that hold each licence word (a bounded number), of ``words`` (an array column)."""
    vocab = vocabulary()
    held = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.filter("words", lambda w: w.isin(*vocab))))).alias("w"))
    found = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


class Index:
    """Postings of the templates by word, (template, position, rare, key), and what each template needs.

    A word's weight is its IDF; of words with equal weights the one that sorts first counts as rarer. ``total`` rare places
    of a template exist, ``need`` of them must agree, together with all its ``keys`` places of key phrases.
    ``anchors`` are the rarest key words: a text without any of them holds no template."""

    def __init__(self, rows: int, frequency: dict[str, int]):
        idf = {w: math.log((rows + 1) / (frequency.get(w, 0) + 0.5)) for w in vocabulary()}
        rarest = lambda words: sorted(set(words), key=lambda w: (-idf[w], w))
        self.postings: dict[str, list[tuple[int, int, bool, bool]]] = {}
        self.total, self.need, self.keys = [], [], []
        anchors = set()
        for t, (_, text, phrases) in enumerate(TEMPLATES):
            words = text.split()
            rare = set(rarest(words)[:INDEXED])
            key: set[int] = set()
            for phrase in phrases:
                p = phrase.split()
                at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
                key |= set(range(at, at + len(p)))
            anchors.add(rarest(words[i] for i in key)[0])
            for pos, w in enumerate(words):
                if w in rare or pos in key:
                    self.postings.setdefault(w, []).append((t, pos, w in rare, pos in key))
            self.total.append(sum(w in rare for w in words))
            self.need.append(math.ceil(AGREE * self.total[-1]))
            self.keys.append(len(key))
        self.anchors = sorted(anchors)


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase stands; looked for only in texts that hold each of its words."""
    first, *more = phrase.split()
    held = F.array_contains(words, first)
    for w in more:
        held = held & F.array_contains(words, w)

    def here(i: Column) -> Column:
        ok = F.get(words, i) == first
        for j, w in enumerate(more, 1):
            ok = ok & F.coalesce(F.get(words, i + j) == w, F.lit(False))
        return ok

    return F.when(held, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def _best(votes: Column, index: Index) -> Column:
    """Of sorted votes, for each template the most rare places that agree on a place with all its key phrases (0: none)."""
    of = lambda numbers, t: F.get(F.array(*map(F.lit, numbers)), t)
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).alias("rare"), F.lit(0).alias("key"), F.array_repeat(F.lit(0), len(TEMPLATES)).alias("best"))

    def step(s: Column, v: Column) -> Column:
        at = F.shiftright(v, 2)
        rare, key = (F.shiftright(v, 1).bitwiseAND(1)).cast("int"), v.bitwiseAND(1).cast("int")
        again = s["at"] == at
        return F.struct(at.alias("at"), (rare + F.when(again, s["rare"]).otherwise(0)).alias("rare"), (key + F.when(again, s["key"]).otherwise(0)).alias("key"), s["best"].alias("best"))

    def better(s: Column) -> Column:  # a template's best place improves at most as often as it has rare places
        t = F.shiftright(s["at"], PLACE_BITS).cast("int")
        good = (s["rare"] >= of(index.need, t)) & (s["key"] == of(index.keys, t)) & (s["rare"] > F.get(s["best"], t))
        best = F.when(good, F.transform(s["best"], lambda b, j: F.when(j == t, s["rare"]).otherwise(b))).otherwise(s["best"])
        return F.struct(s["at"].alias("at"), s["rare"].alias("rare"), s["key"].alias("key"), best.alias("best"))

    return F.aggregate(votes, start, lambda s, v: better(step(s, v)), lambda s: s["best"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every whole text of ``docs`` (doc_id, text).

    A null, empty or wordless text has no label, no places and score 0. score is the largest share of a reported
    template's rare places that agree (0 if none is reported). Repeated rows get the same answer each;
    an empty table gives no rows. Other columns are ignored.
    """
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # lower() also changes other letters, which no licence word has; U+212A alone would become an ASCII letter
    lower = F.lower(F.replace(plain, F.lit("\u212a"), F.lit("\u00e9")))
    words = docs.select("doc_id", F.regexp_extract_all(lower, F.lit(WORD), 0).alias("words"))
    index = Index(*document_frequency(words.select("words")))
    # indexed words by a hash: a word is compared with those few of its slot
    post = {w: [(t << (PLACE_BITS + 2)) + ((SHIFT - p) << 2) + 2 * rare + key for t, p, rare, key in ps] for w, ps in sorted(index.postings.items())}
    size = 1 << (4 * len(post)).bit_length()
    table: list[list[Column]] = [[] for _ in range(size)]
    for w, codes in post.items():
        table[zlib.crc32(w.encode()) % size].append(F.struct(F.lit(w).alias("w"), F.array(*[F.lit(c).cast("long") for c in codes]).alias("codes")))
    kind = "array<struct<w:string,codes:array<bigint>>>"
    slots = F.array(*[F.array(*x).cast(kind) if x else F.lit(None).cast(kind) for x in table])
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), F.shiftleft(i.cast("long"), 2).alias("i"))), lambda h: h["w"].isin(*post))
    of = lambda h: F.filter(F.get(slots, (F.crc32(h["w"].cast("binary")) % size).cast("int")), lambda e: e["w"] == h["w"])
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.get(of(h), F.lit(0))["codes"], lambda code: code + h["i"])))
    anchored = F.arrays_overlap("words", F.array(*map(F.lit, index.anchors)))
    rows = words.select("doc_id", "words", *[_places(F.col("words"), p).alias(f"p{i}") for i, p in enumerate(BASE)], F.when(anchored, F.sort_array(votes)).alias("votes"))
    rows = rows.withColumn("best", _best(F.col("votes"), index))
    per = [F.when(F.get("best", F.lit(t)) > 0, F.struct(F.lit(label).alias("label"), (F.get("best", F.lit(t)) / F.lit(float(index.total[t]))).alias("share"))) for t, (label, _, _) in enumerate(TEMPLATES)]
    matched = F.when(F.col("best").isNotNull(), F.filter(F.array(*per), lambda m: m.isNotNull())).otherwise(F.array().cast("array<struct<label:string,share:double>>"))
    places = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"), base.alias("base"), matched.alias("matched"))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("matched", lambda m: m["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matched", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def scan_one(text: str | None, index: Index) -> dict:
    """The same for one text in plain Python, place by place, for tests and single files."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    votes: dict[tuple[int, int], list[int]] = {}
    for i, w in enumerate(words):
        for t, p, rare, key in index.postings.get(w, ()):
            own = votes.setdefault((t, i - p), [0, 0])
            own[0] += rare
            own[1] += key
    labels, score = set(base), 0.0
    for (t, _), (rare, key) in votes.items():
        if rare >= index.need[t] and key == index.keys[t]:
            labels.add(TEMPLATES[t][0])
            score = max(score, rare / index.total[t])
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score,
    }
