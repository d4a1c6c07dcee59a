"""Licence scan by ordered signature rules: keyword prefilter, priorities, suppression of contained detections.

A text is reduced to its lower-case words (letters, digits and all characters outside ASCII), so punctuation, markup and line
ends never hide a phrase. A rule is one regular expression over these words with a label, a priority and the words it
cannot match without. The rules come from a hand-written table of licences (label, ways to write it) and the forms
in which licences are named: a grant ("released under the ..."), an SPDX tag, a web address, "... licence", "licence: ...".
Per text only the rules whose keywords all occur are tried. Detections are then taken in order of priority and
length, and one that lies inside an accepted one is dropped, so "GNU Lesser General Public License" is no GPL.

The three base phrases are looked up by themselves and their labels always stay.

Defined cases: null text counts as empty; texts without words or detections have empty labels, score 0 and null
positions; overlapping places of a phrase count each; ties of priority and length go to the earlier start, then to the
earlier rule; repeated rows are scanned alike; an empty table gives an empty result; other columns pass through
`scan`, whatever their names (its own begin with `license_`).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import FOLD, extended, mapped, slices, table

#: Base phrases, their labels and a word each cannot occur without (fixed values of the contract).
BASE = (("under the mit license", "mit", "mit"), ("apache license version 2", "apache-2", "apache"),
        ("cc by nc", "cc-by-nc", "cc"))

#: label: (keyword, names as regular expressions over words). A name that is a common word on its own is never matched bare.
TABLE = {
    "mit": ("mit", "mit", "mit x11", "expat mit"),
    "x11": ("x11", "x11",),
    "isc": ("isc", "isc",),
    "0bsd": ("0bsd", "0bsd"),
    "bsd-2": ("bsd", "bsd 2 clause", "simplified bsd", "freebsd bsd", "2 clause bsd"),
    "bsd-3": ("bsd", "bsd 3 clause", "new bsd", "modified bsd", "revised bsd", "3 clause bsd"),
    "bsd-4": ("bsd", "bsd 4 clause", "original bsd", "4 clause bsd"),
    "bsd": ("bsd", "bsd", "bsd style"),
    "apache-1": ("apache", "apache(?: software)?(?: license| licence)?(?: version| v)? ?1(?: [01])?"),
    "apache-2": ("apache", "apache(?: software)?(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    "apache": ("apache", "apache(?: software)?"),
    "gpl-1": ("public", "(?:gnu )?general public(?: license| licence)?(?: version| v)? ?1(?: 0)?"),
    "gpl-2": ("public", "(?:gnu )?general public(?: license| licence)?(?: version| v)? ?2(?: 0)?(?: or (?:any )?later)?"),
    "gpl-3": ("public", "(?:gnu )?general public(?: license| licence)?(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)?"),
    "gpl": ("public", "(?:gnu )?general public"),
    "gpl-2-short": ("gpl", "(?:gnu )?gpl(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    "gpl-3-short": ("gpl", "(?:gnu )?gpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    "gpl-short": ("gpl", "(?:gnu )?gpl"),
    "lgpl-2": ("public", "(?:gnu )?(?:lesser|library) general public(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    "lgpl-2.1": ("public", "(?:gnu )?(?:lesser|library) general public(?: license| licence)?(?: version| v)? ?2 1"),
    "lgpl-3": ("public", "(?:gnu )?(?:lesser|library) general public(?: license| licence)?(?: version| v)? ?3(?: 0)?"),
    "lgpl": ("public", "(?:gnu )?(?:lesser|library) general public"),
    "lgpl-2.1-short": ("lgpl", "(?:gnu )?lgpl(?: version| v)? ?2 1(?: only| or later)?"),
    "lgpl-3-short": ("lgpl", "(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    "lgpl-short": ("lgpl", "(?:gnu )?lgpl"),
    "agpl-3": ("affero", "(?:gnu )?affero general public(?: license| licence)?(?: version| v)? ?3(?: 0)?"),
    "agpl": ("affero", "(?:gnu )?affero general public"),
    "agpl-3-short": ("agpl", "(?:gnu )?agpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    "gfdl": ("documentation", "(?:gnu )?free documentation"),
    "mpl-1.1": ("mozilla", "mozilla public(?: license| licence)?(?: version| v)? ?1 1"),
    "mpl-2": ("mozilla", "mozilla public(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    "mpl": ("mozilla", "mozilla public"),
    "mpl-2-short": ("mpl", "mpl(?: version| v)? ?2(?: 0)?"),
    "epl-1": ("eclipse", "eclipse public(?: license| licence)?(?: version| v)? ?1(?: 0)?"),
    "epl-2": ("eclipse", "eclipse public(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    "edl": ("eclipse", "eclipse distribution"),
    "cddl": ("cddl", "cddl(?: version| v)?(?: ?1(?: [01])?)?"),
    "cddl-long": ("distribution", "common development and distribution"),
    "cpl": ("common", "common public"),
    "eupl": ("eupl", "eupl(?: version| v)?(?: ?1(?: [012])?)?"),
    "eupl-long": ("european", "european union public"),
    "artistic": ("artistic", "(?:perl )?artistic(?: license| licence)?(?: version| v)?(?: ?[12](?: 0)?)?"),
    "bsl": ("boost", "boost(?: software)?"),
    "busl": ("business", "business source"),
    "zlib": ("zlib", "zlib(?: libpng)?"),
    "libpng": ("libpng", "libpng"),
    "python": ("python", "python software foundation", "psf python"),
    "php": ("php", "php"),
    "ruby": ("ruby", "ruby"),
    "openssl": ("openssl", "openssl"),
    "curl": ("curl", "curl"),
    "postgresql": ("postgresql", "postgresql"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    "unlicense": ("unlicense", "unlicense"),
    "wtfpl": ("wtfpl", "wtfpl"),
    "ofl": ("font", "(?:sil )?open font"),
    "odbl": ("database", "open(?: data commons)? database"),
    "odc-by": ("commons", "open data commons attribution"),
    "pddl": ("dedication", "public domain dedication"),
    "cc0": ("cc0", "cc0(?: 1 0)?(?: universal)?"),
    "cc-by": ("cc", "cc by(?: [1234] [05])?"),
    "cc-by-sa": ("cc", "cc by sa(?: [1234] [05])?"),
    "cc-by-nd": ("cc", "cc by nd(?: [1234] [05])?"),
    "cc-by-nc": ("cc", "cc by nc(?: [1234] [05])?"),
    "cc-by-nc-sa": ("cc", "cc by nc sa(?: [1234] [05])?"),
    "cc-by-nc-nd": ("cc", "cc by nc nd(?: [1234] [05])?"),
    "cc-by-long": ("creative", "creative commons attribution(?: [1234] [05])?(?: international)?"),
    "cc-by-sa-long": ("creative", "creative commons attribution share ?alike(?: [1234] [05])?(?: international)?"),
    "cc-by-nd-long": ("creative", "creative commons attribution no ?deriv(?:atives|s)(?: [1234] [05])?"),
    "cc-by-nc-long": ("creative", "creative commons attribution non ?commercial(?: [1234] [05])?(?: international)?"),
    "cc-by-nc-sa-long": ("creative", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"),
    "cc-by-nc-nd-long": ("creative", "creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: [1234] [05])?"),
    "openrail": ("openrail", "(?:creativeml )?open ?rail(?: m)?"),
    "llama": ("llama", "llama(?: [234](?: [0-9])?)?(?: community)?"),
    "ms-pl": ("microsoft", "microsoft public"),
    "ms-rl": ("microsoft", "microsoft reciprocal"),
    "afl": ("academic", "academic free"),
    "osl": ("open", "open software"),
    "vim": ("vim", "vim"),
    "w3c": ("w3c", "w3c(?: software)?"),
    "elastic": ("elastic", "elastic"),
    "sspl": ("server", "server side public"),
    "commons-clause": ("clause", "commons clause"),
}
#: Forms that say enough without a word like "licence" next to them: (label, keyword, regular expression). A short form has its
#: version or another sign with it; "apache 2" or "cc by" alone have not.
ALONE = (
    ("apache-2", "apache", "apache(?: software)? (?:license|licence)(?: version| v)? ?2(?: 0)?"),
    ("gpl-2", "public", "(?:gnu )?general public(?: license| licence)?(?: version| v)? ?2(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-3", "public", "(?:gnu )?general public(?: license| licence)?(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)?"),
    ("lgpl-2", "public", "(?:gnu )?(?:lesser|library) general public(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "public", "(?:gnu )?(?:lesser|library) general public(?: license| licence)?(?: version| v)? ?2 1"),
    ("lgpl-3", "public", "(?:gnu )?(?:lesser|library) general public(?: license| licence)?(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "affero", "(?:gnu )?affero general public(?: license| licence)?(?: version| v)? ?3(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license| licence)?(?: version| v)? ?1 1"),
    ("mpl-2", "mozilla", "mozilla public(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public(?: license| licence)?(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gplv2", "(?:gnu )?gplv2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gplv3", "(?:gnu )?gplv3(?: 0)?(?: only| or later)?"),
    ("lgpl-2", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2", "lgplv2", "(?:gnu )?lgplv2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgplv2", "(?:gnu )?lgplv2 1(?: only| or later)?"),
    ("lgpl-3", "lgplv3", "(?:gnu )?lgplv3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "agplv3", "(?:gnu )?agplv3(?: 0)?(?: only| or later)?"),
    ("mpl-1.1", "mpl", "mpl(?: version| v)? ?1 1"),
    ("mpl-2", "mpl", "mpl(?: (?:version |v ?)2(?: 0)?| 2 0)"),
    ("mpl-2", "mplv2", "mplv2(?: 0)?"),
    ("epl-2", "epl", "epl(?: (?:version |v ?)2(?: 0)?| 2 0)"),
    ("bsd-2", "bsd", "bsd 2 clause|2 clause bsd|simplified bsd"),
    ("bsd-3", "bsd", "bsd 3 clause|3 clause bsd"),
    ("bsd-4", "bsd", "bsd 4 clause|4 clause bsd"),
    ("cc0", "cc0", "cc0 1 0(?: universal)?"),
    ("cc-by", "cc", "cc by [1234] [05]"),
    ("cc-by-sa", "cc", "cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234] [05])?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234] [05])?"),
    ("cc-by", "creative", "creative commons attribution(?: [1234] [05])?(?: international)?"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1234] [05])?(?: international)?"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:atives|s)(?: [1234] [05])?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1234] [05])?(?: international)?"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: [1234] [05])?"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("odc-by", "commons", "open data commons attribution"),
    ("pddl", "dedication", "public domain dedication"),
    ("commons-clause", "clause", "commons clause"),
)
#: Names that are products, schools or people before they are licences: a grant names the licence with the word, or says that it licenses.
VAGUE = frozenset("mit x11 apache bsl ruby php openssl curl postgresql vim w3c elastic llama libpng zlib artistic bsd gpl osl".split())
VERBS = ("(?:licensed|licenced|released|distributed|redistributed|available|published|provided|offered|covered|shared|"
         "governed|used|made available)")
TERMS = "(?: (?:the )?terms(?: and conditions)? of)?(?: the)?(?: an?)? "
#: "... under": enough before any name but vague ones; with "by" and the like, and before those, the word licence must follow.
GRANT = f"{VERBS} (?:under|subject to|in accordance with){TERMS}"
GRANT_BY = f"{VERBS} (?:under|by|according to|subject to|in accordance with){TERMS}"
LICENSED = f"(?:licensed|licenced|released|redistributed) under{TERMS}"
WORD_LICENSE = "(?:license|licence|licenses|lizenz|licencia|public license)"
#: Web addresses, as their words.
ADDRESSES = {
    "mit": "opensource org licenses mit", "apache-2": "apache org licenses license 2 0", "gpl-3": "gnu org licenses gpl 3 0",
    "gpl-2": "gnu org licenses (?:old licenses )?gpl 2 0", "gpl": "gnu org licenses(?: gpl)?(?: html)?", "lgpl-3": "gnu org licenses lgpl 3 0",
    "lgpl-2.1": "gnu org licenses (?:old licenses )?lgpl 2 1", "agpl-3": "gnu org licenses agpl 3 0",
    "mpl-2": "mozilla org (?:en us )?mpl 2 0", "epl-2": "eclipse org legal epl (?:v20|2 0)", "bsd-3": "opensource org licenses bsd 3 clause",
    "bsd-2": "opensource org licenses bsd 2 clause", "isc": "opensource org licenses isc", "bsl": "boost org license 1 0",
    "unlicense": "unlicense org", "cc0": "creativecommons org publicdomain zero", "cc-by": "creativecommons org licenses by [1234] [05]",
    "cc-by-sa": "creativecommons org licenses by sa", "cc-by-nd": "creativecommons org licenses by nd",
    "cc-by-nc": "creativecommons org licenses by nc [1234] [05]", "cc-by-nc-sa": "creativecommons org licenses by nc sa",
    "cc-by-nc-nd": "creativecommons org licenses by nc nd", "ofl": "scripts sil org ofl", "odbl": "opendatacommons org licenses odbl",
}
#: Notices that are whole sentences.
SENTENCES = {
    "mit": ("granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "isc": ("granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "bsd": ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    "unlicense": ("unencumbered", "this is free and unencumbered software released into the public domain"),
    "public-domain": ("domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    "all-rights-reserved": ("reserved", "all rights reserved"),
    "gpl": ("redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
}
PRIORITY = {"sentence": 100, "grant": 95, "spdx": 90, "address": 85, "versioned": 80, "named": 75, "tagged": 65, "alone": 60}


def rules() -> list[tuple[str, int, frozenset, str]]:
    """(label, priority, keywords, regular expression over ' word word ... ') in order."""
    out = []
    clean = lambda label: re.sub(r"-(short|long)$", "", label)
    for label, (key, text) in SENTENCES.items():
        out.append((label, PRIORITY["sentence"], frozenset({key}), text))
    for label, (key, *names) in TABLE.items():
        name = "(?:" + "|".join(names) + ")"
        start = LICENSED if label in VAGUE else GRANT
        out.append((clean(label), PRIORITY["grant"], frozenset({key}), f"(?:{start}{name}|{GRANT_BY}{name} {WORD_LICENSE})"))
        out.append((clean(label), PRIORITY["spdx"], frozenset({key, "spdx"}), f"spdx license identifier {name}"))
        out.append((clean(label), PRIORITY["named"], frozenset({key}), f"{name} {WORD_LICENSE}"))
        out.append((clean(label), PRIORITY["tagged"], frozenset({key}), f"{WORD_LICENSE} (?:is )?(?:the )?{name}"))
    for label, key, text in ALONE:
        out.append((label, PRIORITY["versioned" if "license" in text else "alone"], frozenset({key}), f"(?:{text})"))
    for label, words in ADDRESSES.items():
        key = re.match(r"\w+", words)[0]
        out.append((label, PRIORITY["address"], frozenset({key, "org"}), words))
    return sorted(out, key=lambda r: -r[1])


class Scanner:
    """Compiled rules; built once per task."""

    def __init__(self):
        self.rules = [(label, priority, keys, re.compile(f" {text}(?= )".encode())) for label, priority, keys, text in rules()]
        self.gate = frozenset(k.encode() for k in frozenset().union(*(r[2] for r in self.rules), (k for *_, k in BASE)))
        self.base = [(f" {p} ".encode(), label) for p, label, _ in BASE]
        self.needs = [frozenset(k.encode() for k in r[2]) for r in self.rules]

    def scan(self, text: bytes) -> tuple:
        """Values of COLUMNS for one text."""
        words = text.translate(FOLD).split()
        seen = self.gate.intersection(words)
        if not seen:
            return len(words), 0, None, None, "", "", 0.0, []
        line = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                starts.append(at)
                base.add(label)
                at = line.find(phrase, at + 1)
        found = []
        for nth, ((label, priority, _, pattern), needs) in enumerate(zip(self.rules, self.needs)):
            if needs <= seen:
                found += [(-priority, m.start() - m.end(), m.start(), nth, m.end(), label) for m in pattern.finditer(line)]
        kept = suppress(found)
        labels = base | {label for *_, label in kept}
        score = max([-k[0] / 100 for k in kept] + [PRIORITY["alone"] / 100] * bool(base), default=0.0)
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        at = lambda char: int(np.searchsorted(blanks, char))  # noqa: E731  number of the word behind a blank
        places = [at(s) for s in starts]
        spans = [{"label": label, "start": at(s), "stop": at(e), "score": -p / 100} for p, _, s, _, e, label in sorted(kept, key=lambda k: k[2])]
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), score, spans)


def suppress(found: list[tuple]) -> list[tuple]:
    """Detections (-priority, -length, start, rule, end, label) that lie inside no accepted one, best first."""
    kept: list[tuple] = []
    reach: list[tuple[int, int]] = []  # accepted intervals, by start
    longest = max((-d[1] for d in found), default=0)
    for d in sorted(found):
        near = reach[bisect_left(reach, (d[4] - longest, 0)):bisect_right(reach, (d[2], math.inf))]
        if not any(d[4] <= e for _, e in near):
            kept.append(d)
            insort(reach, (d[2], d[4]))
    return kept


COLUMNS = (("license_words", "bigint"), ("license_places", "bigint"), ("license_first", "bigint"), ("license_last", "bigint"),
           ("license_base", "string"), ("license_labels", "string"), ("license_score", "double"),
           ("license_spans", "array<struct<label:string,start:bigint,stop:bigint,score:double>>"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the columns of COLUMNS; spans are word ranges [start, stop) of the accepted detections, by start."""
    import pyarrow as pa

    texts = docs.columns.index(text_col)
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), COLUMNS[-1][1]: pa.list_(span)}

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, batch.schema.names[texts]):
                rows = [scanner.scan(t or b"") for t in part.column(texts).cast(pa.binary()).to_pylist()]
                new = [pa.array(c, type=kinds[kind]) for c, (_, kind) in zip(zip(*rows), COLUMNS)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(c for c, _ in COLUMNS)])

    return mapped(docs, run, extended(docs.schema, COLUMNS))


def op5_license_scan(spark, sf_dir):
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return rows.select("doc_id", *[F.col(old).alias(new) for (old, _), new in zip(COLUMNS, names)])


QUERIES = {"op5_license_scan": (op5_license_scan, None)}
