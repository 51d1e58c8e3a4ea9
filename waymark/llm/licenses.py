"""License scans: a positional rare-token index over licence templates.

Document frequencies over the whole corpus give each licence word its weight. Of every template's first key phrase, the
two words of highest weight are indexed, each in a posting of its own, with their positions in the phrase. A file's
words are looked up in both; a hit at position p on a phrase's word at position q proposes that the phrase starts at
p - q, and the two postings are intersected by (template, start). An alignment counts where the whole first phrase
stands there and the second, if any, follows within its place in the template plus ``SLACK`` words, as in "... as
published by ..., either version 3". The share of the template's words that agree at their places is only the score.
DataFrame functions only: one pass for the frequencies, one for the scan, and no text is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, OWN, ascii_lower, text_or_empty

#: Words by which a second key phrase may come later than in the template.
SLACK = 12


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def places(self) -> list[tuple[int, list[str]]]:
        """Each key phrase with its place in the template."""
        out = []
        for key in self.keys:
            k = key.split()
            out.append((next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k), k))
        return out


#: Usual wordings of public licence notices.
TEMPLATES = (
    Template("mit", "released under the mit license", ("under the mit license",), True),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",), True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",), True),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("use in source and binary forms", "are permitted")),
    Template("bsl-1", "distributed under the boost software license version 1 0", ("boost software license", "version 1")),
    Template("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license", "2 0")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("lgpl-2-1", "licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license", "version 2 1")),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license", "2 0")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("altered source versions must be plainly marked", "misrepresented as being the original software")),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0))


def licence_weights(docs: DataFrame, text_col: str, templates: tuple[Template, ...]) -> dict[str, float]:
    """Inverse document frequency of each word of the first key phrases over all documents. As many rows as such words."""
    lexicon = sorted({w for t in templates for w in t.keys[0].split()})
    own = F.array_intersect(words_of(text_or_empty(text_col)), F.array(*map(F.lit, lexicon)))
    n = docs.count()
    seen = {r.w: r["count"] for r in docs.select(F.explode(own).alias("w")).groupBy("w").count().collect()}
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) for w in lexicon}


Posting = dict[str, list[tuple[int, int]]]


def rare_index(templates: tuple[Template, ...], weights: dict[str, float]) -> tuple[Posting, Posting]:
    """Word to (template, position in its first key phrase), for the rarest and the second rarest word of each phrase."""
    first: Posting = {}
    second: Posting = {}
    for t, template in enumerate(templates):
        spots = sorted((-weights[w], i, w) for i, w in enumerate(template.keys[0].split()))
        for posting, (_, i, w) in zip((first, second), (spots[0], spots[min(1, len(spots) - 1)])):
            posting.setdefault(w, []).append((t, i))
    return first, second


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the smallest and largest of their
    starts (null where there are none), labels are distinct, sorted and joined by commas, and ``score`` is the largest
    share of a found template's words that agree (0 where no label is). Null texts are empty; empty texts have no words
    and no labels. Columns that have these names already are replaced.
    """
    postings = rare_index(templates, licence_weights(docs, text_col, templates))
    w = F.col(f"{OWN}w")
    nothing = F.expr("cast(array() as array<struct<t:int,at:int>>)")

    def proposals(posting: Posting) -> Column:
        """Every (template, start of its first phrase) that a word of the posting proposes."""

        def at(i: Column) -> Column:
            word, out = F.get(w, i), nothing
            for name, spots in posting.items():
                out = F.when(word == name, F.array(*[F.struct(F.lit(t).alias("t"), (i - q).cast("int").alias("at")) for t, q in spots])).otherwise(out)
            return out

        spots = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(list(posting)))
        return F.flatten(F.transform(spots, at))

    def same(at: Column, key: list[str]) -> Column:
        return F.when(at >= 0, F.slice(w, F.greatest(at, F.lit(0)) + 1, F.lit(len(key))) == F.array(*map(F.lit, key))).otherwise(False)

    def within(low: Column, high: Column, key: list[str]) -> Column:
        return F.exists(F.sequence(low, high), lambda s: same(s, key))

    def share(start: Column, t: Template) -> Column:
        agree = F.lit(0)
        for i, word in enumerate(t.words):
            agree = agree + F.when((start + i >= 0) & (F.get(w, start + i) == word), 1).otherwise(0)
        return agree / F.lit(float(len(t.words)))

    def scored(a: Column) -> Column:
        """Alignment to its score; null where a key phrase is missing."""
        out = F.lit(None).cast("double")
        for t, template in enumerate(templates):
            (spot, key), *rest = template.places()
            keys = same(a["at"], key)
            for later, other in rest:
                keys = keys & within(a["at"] + len(key), a["at"] + (later - spot + SLACK), other)
            out = F.when((a["t"] == t) & keys, share(a["at"] - spot, template)).otherwise(out)
        return out

    base = [t for t, template in enumerate(templates) if template.base]
    both = [F.arrays_overlap(w, F.array(*map(F.lit, posting))) for posting in postings]
    aligned = F.when(both[0] & both[1], F.array_intersect(*map(proposals, postings))).otherwise(nothing)
    own = docs.withColumn(f"{OWN}w", words_of(text_or_empty(text_col))).withColumn(f"{OWN}a", aligned)
    found = F.filter(F.transform(f"{OWN}a", lambda a: F.struct(a["t"].alias("t"), a["at"].alias("at"), scored(a).alias("s"))), lambda x: x["s"].isNotNull())

    def label(x: Column) -> Column:
        out = F.lit("")
        for t, template in enumerate(templates):
            out = F.when(x["t"] == t, F.lit(template.label)).otherwise(out)
        return out

    is_base = lambda x: x["t"].isin(base)
    own = own.withColumn(f"{OWN}f", F.when(F.size(f"{OWN}a") > 0, found)).withColumn(f"{OWN}f", F.coalesce(f"{OWN}f", F.expr("cast(array() as array<struct<t:int,at:int,s:double>>)")))
    bases = F.filter(f"{OWN}f", is_base)
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, label))), ",")
    return own.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "n_base": F.size(bases).cast("long"),
            "first_word": F.array_min(F.transform(bases, lambda x: x["at"].cast("long"))),
            "last_word": F.array_max(F.transform(bases, lambda x: x["at"].cast("long"))),
            "base_labels": joined(bases),
            "labels": joined(F.col(f"{OWN}f")),
            "score": F.coalesce(F.array_max(F.transform(f"{OWN}f", lambda x: x["s"])), F.lit(0.0)),
        }
    ).drop(f"{OWN}w", f"{OWN}a", f"{OWN}f")
