"""Short license notices in texts, with bounded edits.

A text is lower-cased (A-Z), its words are joined by single spaces, and every notice is
looked for in that with at most ``k`` edits. By the pigeonhole principle a match with ``k``
edits holds one of the notice's ``k + 1`` pieces unchanged: one automaton finds all pieces
of all notices in a single pass, and the bounded-error matching of the regex library
verifies the surroundings of each and gives the span and its edits. Base phrases are places
where the phrase's words stand consecutively; the same pass finds them.

Defined results: a null or empty text has no words and no hits; repeated rows are scanned
each; very long texts are scanned whole; equal spans of one label are one hit; of
overlapping notices only those with the fewest edits count. Other columns pass through,
but for ``n_words`` and ``hits``, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagesift.functions.columns import named
from pagesift.llm.texts import map_batches

BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices in normalised words, and their labels. Public wording of common licenses.
NOTICES = {
    "licensed under cc by": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "released under the bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "released into the public domain": "public-domain",
    "no rights reserved": "public-domain",
    "all rights reserved": "reserved",
    "unauthorized copying is prohibited": "reserved",
}

EDIT_SHARE = 10  # one edit for every ten characters of a notice

HIT = (
    "struct<label:string,notice:string,base:boolean,edits:int,first_word:int,n_words:int,"
    "span:string>"
)

_TO_WORDS = np.arange(256, dtype=np.uint8)
_TO_WORDS[65:91] += 32
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TO_WORDS[_low : _high + 1] = 32
_TO_WORDS = _TO_WORDS.tobytes()


def edits_allowed(notice: str) -> int:
    return max(1, len(notice) // EDIT_SHARE)


class Finder:
    """The automaton of all seeds and the patterns that verify them."""

    def __init__(self, notices: dict[str, str], phrases: dict[str, str]):
        import ahocorasick
        import regex

        seeds: dict[str, list] = {f" {p} ": [("base", p, label)] for p, label in phrases.items()}
        self.patterns = {}
        for notice, label in notices.items():
            k = edits_allowed(notice)
            self.patterns[notice] = regex.compile(
                rf"(?b)(?<= )(?:{regex.escape(notice, special_only=True)}){{e<={k}}}(?= )"
            )
            cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                seeds.setdefault(notice[a:b], []).append((notice, a, label, k))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[int, list[dict]]:
        """Number of words and hits of a text, in order of place and label."""
        parts = text.encode("utf-8", "replace").translate(_TO_WORDS).split()
        # One character a byte, so that places are the same before and after.
        flat = f" {b' '.join(parts).decode('latin-1')} "
        found: dict[tuple, dict] = {}
        tried: dict[str, int] = {}
        for end, (size, uses) in self.automaton.iter(flat):
            start = end - size + 1
            for use in uses:
                if use[0] == "base":
                    phrase = use[1]
                    key = (start + 1, start + 1 + len(phrase), use[2], True)
                    found[key] = {"notice": phrase, "edits": 0}
                    continue
                notice, at, label, k = use
                low = start - at - k
                if tried.get(notice, -1) >= low + k:  # a match from here on is known
                    continue
                low = max(0, low - 1)
                m = self.patterns[notice].search(flat, low, end + 1 + len(notice) - at - size + k + 2)
                if m:
                    edits = sum(m.fuzzy_counts)
                    a, b = m.span()
                    a += len(m.group()) - len(m.group().lstrip())
                    b -= len(m.group()) - len(m.group().rstrip())
                    tried[notice] = a
                    key = (a, b, label, False)
                    if key not in found or found[key]["edits"] > edits:
                        found[key] = {"notice": notice, "edits": edits}
        out, words, last = [], 0, 1
        notices = sorted(
            (a, b, more["edits"]) for (a, b, _, base), more in found.items() if not base
        )
        longest = max((b - a for a, b, _ in notices), default=0)
        lo = 0  # the first notice that can reach to this one
        for (a, b, label, base), more in sorted(found.items(), key=lambda x: x[0]):
            while lo < len(notices) and notices[lo][0] <= a - longest:
                lo += 1
            i, better = lo, False
            while more["edits"] and not better and i < len(notices) and notices[i][0] < b:
                better = notices[i][1] > a and notices[i][2] < more["edits"]
                i += 1
            if better:
                continue
            words += flat.count(" ", last, a)
            last = a
            span = flat[a:b]
            out.append({
                "label": label, "notice": more["notice"], "base": base, "edits": more["edits"],
                "first_word": words, "n_words": span.count(" ") + 1,
                "span": span.encode("latin-1").decode("utf-8", "replace"),
            })
        return len(parts), out


def find_notices(
    docs: DataFrame, text_col: str = "text", notices: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words`` and ``hits``: label, notice, edits and span of each place.

    Words are counted from 0. ``base`` marks exact phrases; the other hits may overlap them.
    """
    notices = NOTICES if notices is None else notices
    phrases = BASE_PHRASES if phrases is None else phrases
    keep = [c for c in docs.columns if c not in ("n_words", "hits")]
    at = keep.index(text_col)
    more = StructType.fromDDL(f"n_words long, hits array<{HIT}>")
    schema = StructType([docs.schema[c] for c in keep] + more.fields)
    hit = pa.list_(pa.struct([
        ("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()),
        ("edits", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()),
        ("span", pa.string()),
    ]))

    def scan(batches):
        finder = Finder(notices, phrases)
        for batch in batches:
            got = [finder.hits(x.as_py()) for x in pc.fill_null(batch.column(at), "")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _ in got], pa.int64()),
                 pa.array([h for _, h in got], hit)],
                [*keep, "n_words", "hits"],
            )

    return map_batches(docs.select(*named(keep)), scan, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: base places, base labels, all labels, and a score.

    The score is that of the best hit: its unchanged share of the notice, 0 without hits.
    """
    hits = F.col("hits")
    base = F.filter(hits, lambda h: h["base"])
    starts = F.transform(base, lambda h: h["first_word"].cast("long"))

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda h: h["label"]))), ",")

    share = F.transform(hits, lambda h: 1 - h["edits"].cast("double") / F.length(h["notice"]))
    return found.select(
        *named([id_col]), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(hits).alias("labels"),
        F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
    )
