r"""License scans by a positional index of rare words.

A template is a licence phrase with mandatory key phrases. Inverse document frequency over the corpus, of all words of
templates, tells how rare each is; of each template the LOOKUPS rarest words of its key phrases are indexed with their
places. A file is looked up by those of its words that are in this index, its highest-IDF licence
words: each gives postings (template, offset) with offset = place in the text minus place in the template. A posting
is a candidate if, relative to its offset, AGREE of the template's rare words stand at their places, and counts if
each key phrase stands there word by word. Its score is the share of the template's words that stand at their places.

Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z is lower-cased; whole texts are read, at a cost in proportion to
their length. Null and empty texts have no words, no places and score 0. Each row of the input gives one
row, repeated rows and null ids included; of equally rare words the first in the template is indexed; other columns
are ignored; an empty table gives an empty result. DataFrame operations only, and no shuffle but the count of template words.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: Phrases every scan counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, phrase, mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["permission is hereby granted free of charge"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under cc0", ["cc0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["use this file except in compliance with the license"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["redistribute it and or modify it under the terms of the gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["under the terms of the gnu lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["source code form", "mozilla public license v 2 0"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ["nor the names of its contributors may be used to endorse"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("eupl", "licensed under the european union public licence", ["european union public licence"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["must be plainly marked as such"]),
    ("artistic", "you may distribute this package under the terms of the artistic license", ["artistic license"]),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ["open font license"]),
    ("wtfpl", "do what the fuck you want to public license", ["fuck you want to public license"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("odbl", "made available under the open database license", ["open database license"]),
]
#: Rare words of a template that are indexed.
LOOKUPS = 4
#: Share of them that have to agree on an offset.
AGREE = 0.5


def idf_of(texts: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the vocabulary over the texts (column ws)."""
    own = F.array_intersect("ws", F.array(*map(F.lit, vocabulary)))
    counts = {r.w: r["count"] for r in texts.select(F.explode(own).alias("w")).groupBy("w").count().collect()}  # a row for each word of the templates
    n = texts.count()
    return {w: math.log((1 + n) / (1 + counts.get(w, 0))) for w in vocabulary}


def index(idf: dict[str, float]) -> tuple[dict, list[dict]]:
    """Postings (word -> template, place) of the rare words, and the templates. Their size is fixed by TEMPLATES."""
    postings: dict[str, list] = {}
    templates = []
    for t, (label, phrase, keys) in enumerate(TEMPLATES):
        ws = phrase.split()
        spans = []
        for k in map(str.split, keys):
            at = next(i for i in range(len(ws)) if ws[i : i + len(k)] == k)
            spans.append({"p": at, "ws": k})
        inside = sorted({i for x in spans for i in range(x["p"], x["p"] + len(x["ws"]))})
        rare = sorted(inside, key=lambda i: (-idf[ws[i]], i))[:LOOKUPS]
        for i in rare[: len(rare) - math.ceil(len(rare) * AGREE) + 1]:  # one of these is there wherever enough are
            postings.setdefault(ws[i], []).append({"t": t, "p": i})
        templates.append({"label": label, "ws": ws, "rare": [{"p": i, "w": ws[i]} for i in sorted(rare)], "need": math.ceil(len(rare) * AGREE), "keys": spans})
    return postings, templates


def _places(ws, phrase: str):
    """Starts of a phrase in an array of words."""
    p = phrase.split()
    hit = F.lit(True)
    return F.filter(
        F.transform(ws, lambda w, i: F.when(w == p[0], i)),
        lambda i: i.isNotNull() & F.coalesce(F.slice(ws, i + 1, len(p)) == F.array(*map(F.lit, p)), ~hit),
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    spans (array of label, start and score) for each row of docs."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("ws"))
    postings, templates = index(idf_of(base, sorted({w for _, p, _ in TEMPLATES for w in p.split()})))
    table = F.from_json(F.lit(json.dumps(templates)), "array<struct<label:string,ws:array<string>,rare:array<struct<p:int,w:string>>,need:int,keys:array<struct<p:int,ws:array<string>>>>>")
    lookup = F.from_json(F.lit(json.dumps(postings)), "map<string,array<struct<t:int,p:int>>>")
    may = F.arrays_overlap("ws", F.array(*[F.lit(p.split()[1]) for p in BASE]))  # by, public, rights
    none = F.array().cast("array<int>")
    hits = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(sorted(postings)))

    def judged(c):
        """A span where the candidate c (t, offset) counts, else null."""
        own = F.element_at(table, c["t"] + 1)
        agree = F.size(F.filter(own["rare"], lambda r: F.get("ws", c["offset"] + r["p"]) == r["w"])) >= own["need"]
        whole = F.forall(own["keys"], lambda k: (c["offset"] + k["p"] >= 0) & (F.slice("ws", F.greatest(c["offset"] + k["p"] + 1, F.lit(1)), F.size(k["ws"])) == k["ws"]))
        share = F.size(F.filter(own["ws"], lambda w, j: F.get("ws", c["offset"] + j) == w)) / F.size(own["ws"])
        return F.when(agree & whole, F.struct(own["label"].alias("label"), F.greatest(c["offset"], F.lit(0)).cast("long").alias("start"), share.alias("score")))

    offsets = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(lookup, h["w"]), lambda x: F.struct(x["t"].alias("t"), (h["i"] - x["p"]).alias("offset")))))
    found = base.select("doc_id", "ws", F.size("ws").cast("long").alias("n_words"), *[F.when(may, _places(F.col("ws"), p)).otherwise(none).alias(f"b{k}") for k, p in enumerate(BASE)], hits.alias("hits"))
    spans = F.array_sort(F.array_distinct(F.filter(F.transform(F.array_distinct(offsets), judged), lambda x: x.isNotNull())))
    places = F.concat(*[f"b{k}" for k in range(len(BASE))])
    labels = F.filter(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(v)) for k, v in enumerate(BASE.values())]), lambda x: x.isNotNull())
    out = found.select("doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_sort(labels).alias("bl"), spans.alias("spans"))
    named = F.array_sort(F.array_distinct(F.concat("bl", F.transform("spans", lambda s: s["label"]))))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("bl", ",").alias("base_labels"), F.array_join(named, ",").alias("labels"), score.alias("score"), "spans")
