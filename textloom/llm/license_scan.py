"""License scans by ordered signature rules, with DataFrame functions only.

A rule has a label, a plain keyword, gate words, a regular expression, a priority (0 is
strongest) and a confidence. Hand-written names of licenses, ``NAMES``, times the
hand-written forms in which texts cite them, ``FORMS``, and the notices of ``NOTICES``
make some hundreds of rules. Keywords and gate words are looked for in the folded text:
lower-cased, with runs of white space, hyphens and plus signs turned into one blank. A
text without any rule's gate word is passed by; of the others, only rules whose keyword
occurs are tried, on the text as it is, and all their matches are found.

Overlaps: in the order of starts, longer first, then stronger, a detection goes if one
before it of the same or a stronger priority covers its whole interval. The base rules
(three phrases as whole words) have priority 0 and always stay.

Everything is an expression over one row: no join, no shuffle, no Python.

Defined results: a null text counts as empty, with no words, labels or places and score
0; repeated rows each get a row; an empty table gives an empty table; other columns
play no part. ``score`` is the largest confidence among the detections that stay.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: A word of a text that isn't lower-cased, and what may not stand beside a phrase.
WORD = f"[^{_NO}]+"
_START, _END = f"(?<![^{_NO}])", f"(?![^{_NO}])"

BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: label, keyword, how the name is written (as a regular expression), SPDX identifier or "".
NAMES = [
    ("mit", "mit", r"(?:the )?(?:x11/)?mit(?:/x11)?(?: \(x11\))?", "MIT"),
    ("mit-0", "mit", r"mit no attribution", "MIT-0"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license| licence)?,? ?(?:version |v\.? ?)?2(?:\.0)?", "Apache-2.0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?,? ?(?:version |v\.? ?)?1\.1", "Apache-1.1"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e,? ?\(?(?:version|v\.?)? ?2(?:\.0)?", "GPL-2.0-only"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e,? ?\(?(?:version|v\.?)? ?3(?:\.0)?", "GPL-3.0-only"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?-?(?:version |v\.? ?)2(?:\.0)?", "GPL-2.0-or-later"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?-?(?:version |v\.? ?)3(?:\.0)?", "GPL-3.0-or-later"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e,? ?\(?(?:version|v\.?)? ?2\.1", "LGPL-2.1-only"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e,? ?\(?(?:version|v\.?)? ?3(?:\.0)?", "LGPL-3.0-only"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e,? ?\(?(?:version|v\.?)? ?3(?:\.0)?", "AGPL-3.0-only"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[sc]e", "GFDL-1.3-only"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause|freebsd) bsd|bsd[ -](?:2-clause|two-clause)", "BSD-2-Clause"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3-clause|three-clause) bsd|bsd[ -](?:3-clause|three-clause)", "BSD-3-Clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause) bsd|bsd[ -]4-clause", "BSD-4-Clause"),
    ("0bsd", "bsd", r"zero-clause bsd|bsd zero[ -]clause", "0BSD"),
    ("isc", "isc", r"isc", "ISC"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e,? ?(?:version |v\.? ?)?1\.1", "MPL-1.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e,? ?(?:version |v\.? ?)?2(?:\.0)?", "MPL-2.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e,? ?(?:version |v\.? ?)?-? ?1(?:\.0)?", "EPL-1.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e,? ?(?:version |v\.? ?)?-? ?2(?:\.0)?", "EPL-2.0"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[sc]e", "CDDL-1.0"),
    ("cpl-1.0", "common public", r"common public licen[sc]e", "CPL-1.0"),
    ("eupl-1.2", "european", r"european union public licen[sc]e", "EUPL-1.2"),
    ("artistic-2.0", "artistic", r"(?:perl )?artistic licen[sc]e,? ?(?:version )?2(?:\.0)?", "Artistic-2.0"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic licen[sc]e,? ?(?:version )?1(?:\.0)?", "Artistic-1.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", "Zlib"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e", "BSL-1.0"),
    ("unlicense", "unlicense", r"unlicense", "Unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "WTFPL"),
    ("wtfpl", "you want to public", r"do what the f[a-z*]+ you want to public licen[sc]e", ""),
    ("python-2.0", "python", r"python software foundation", "Python-2.0"),
    ("python-2.0", "psf", r"psf", ""),
    ("postgresql", "postgresql", r"postgresql", "PostgreSQL"),
    ("openssl", "openssl", r"openssl", "OpenSSL"),
    ("php-3.01", "php", r"php,? ?(?:version |v)?3\.01", "PHP-3.01"),
    ("ofl-1.1", "open font", r"sil open font licen[sc]e", "OFL-1.1"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[sc]e", "ODbL-1.0"),
    ("odbl-1.0", "odbl", r"odbl", ""),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", "MS-PL"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", "MS-RL"),
    ("cecill-2.1", "cecill", r"cecill", "CECILL-2.1"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1\.0)?(?: universal)?", "CC0-1.0"),
    ("cc-by-4.0", "cc by", r"cc[ -]by[ -]4\.0", "CC-BY-4.0"),
    ("cc-by-3.0", "cc by", r"cc[ -]by[ -]3\.0", "CC-BY-3.0"),
    ("cc-by-sa-4.0", "cc by", r"cc[ -]by-sa[ -]4\.0", "CC-BY-SA-4.0"),
    ("cc-by-sa-3.0", "cc by", r"cc[ -]by-sa[ -]3\.0", "CC-BY-SA-3.0"),
    ("cc-by-nc-4.0", "cc by", r"cc[ -]by-nc[ -]4\.0", "CC-BY-NC-4.0"),
    ("cc-by-nc-sa-4.0", "cc by", r"cc[ -]by-nc-sa[ -]4\.0", "CC-BY-NC-SA-4.0"),
    ("cc-by-nd-4.0", "cc by", r"cc[ -]by-nd[ -]4\.0", "CC-BY-ND-4.0"),
    ("cc-by-nc-nd-4.0", "cc by", r"cc[ -]by-nc-nd[ -]4\.0", "CC-BY-NC-ND-4.0"),
    ("cc-by", "attribution", r"creative commons attribution(?: international)?(?! ?-?(?:share|non|no))", ""),
    ("cc-by-sa", "share", r"creative commons attribution[ -]share[ -]?alike", ""),
    ("cc-by-nc", "commercial", r"creative commons attribution[ -]non[ -]?commercial", ""),
]

#: form, expression around the name, priority, confidence.
FORMS = [
    ("under", r"(?:licen[sc]ed|released|distributed|published|available|provided|dual-licensed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})(?:,? ?licen[sc]e)?", 1, 0.95),
    ("terms", r"(?:subject to|governed by|covered by|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name}),? ?licen[sc]e", 1, 0.9),
    ("field", r"licen[sc]e ?[:=] ?[\"']?(?:the )?(?:{name})", 1, 0.9),
    ("name", r"(?:{name}),? ?(?:software )?(?:international )?(?:public )?licen[sc]e", 2, 0.85),
    ("see", r"(?:see|read|copy of) (?:the )?(?:{name}),? ?(?:licen[sc]e)", 2, 0.8),
]

#: label, keyword, expression, priority, confidence: sentences of the licenses themselves, and addresses.
NOTICES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software", 1, 1.0),
    ("mit", "without restriction", r"to deal in the software without restriction, including without limitation the rights to use", 1, 0.95),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee", 1, 1.0),
    ("bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted", 2, 0.8),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software", 1, 0.95),
    ("apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0", 1, 1.0),
    ("apache-2.0", "warranties or conditions", r"distributed on an \"as is\" basis, without warranties or conditions of any kind", 1, 0.9),
    ("gpl-2.0", "either version 2", r"either version 2 of the license, or \(at your option\) any later version", 1, 0.95),
    ("gpl-3.0", "either version 3", r"either version 3 of the license, or \(at your option\) any later version", 1, 0.95),
    ("gpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl", 1, 0.9),
    ("lgpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl", 1, 0.95),
    ("agpl-3.0", "gnu.org/licenses", r"gnu\.org/licenses/agpl", 1, 0.95),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/mpl/2\.0", 1, 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1, 1.0),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|to|into) the public domain", 2, 0.8),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 1, 0.95),
    ("bsl-1.0", "boost.org", r"boost\.org/license_1_0", 1, 1.0),
    ("cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/", 1, 0.95),
    ("cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/", 1, 0.95),
    ("cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc/", 1, 0.95),
    ("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero", 1, 1.0),
    ("proprietary", "all rights reserved", r"(?:proprietary and confidential|unauthorized copying).{0,200}?all rights reserved|all rights reserved.{0,200}?(?:proprietary and confidential|unauthorized copying)", 2, 0.7),
]

_LICENSE = ["license", "licence"]
#: Gate words of each form: a match holds at least one of them.
FORM_GATES = {
    "under": _LICENSE + [f"{verb}{to}under" for verb in ("released", "distributed", "published", "available", "provided") for to in (" ", " to you ")],
    "terms": _LICENSE, "field": _LICENSE, "name": _LICENSE, "see": _LICENSE,
}
_FOLDED = r"[\s+-]{2,}|[\t\n\x0B\f\r+-]"


def fold(text: Column) -> Column:
    """Lower-cased, with runs of what stands between words in the rules (white space, ``-``, ``+``) turned into one blank."""
    return F.regexp_replace(F.lower(text), _FOLDED, " ")


def _key(word: str) -> str:
    return re.sub(_FOLDED, " ", word.lower())


def rules() -> list[dict]:
    """All rules in their order."""
    gap = f"[{_NO}]+"
    out = [{"label": label, "key": phrase.split()[0], "gate": ["license"], "re": f"(?i){_START}{gap.join(phrase.split())}{_END}", "rank": 0, "conf": 0.9} for label, phrase in BASE]
    for label, key, name, spdx in NAMES:
        for kind, form, rank, conf in FORMS:
            out.append({"label": label, "key": key, "gate": FORM_GATES[kind], "re": r"(?i)\b" + form.replace("{name}", name).replace(" ", r"\s+").replace(r"\s+?", r"\s*"), "rank": rank, "conf": conf})
        if spdx:
            out.append({"label": label, "key": _key(spdx), "gate": ["spdx license identifier"], "re": rf"(?i)(?<=spdx-license-identifier[^\n]{{0,80}}[\s(:]){re.escape(spdx)}(?![\w.-])", "rank": 1, "conf": 1.0})
    out += [{"label": label, "key": key, "gate": [key], "re": "(?is)" + expression.replace(" ", r"\s+"), "rank": rank, "conf": conf} for label, key, expression, rank, conf in NOTICES]
    return [{"id": i} | r for i, r in enumerate(out)]


_ALL_GATES = sorted({g for r in rules() for g in r["gate"]})
#: What a folded text with a detection holds: some rule's gate word. Words that hold another one are implied by it.
GATES = [g for g in _ALL_GATES if not any(other != g and other in g for other in _ALL_GATES)]


def gated(low: Column) -> Column:
    """Whether a folded text holds a gate word; plain searches, which are quicker than one expression of alternatives."""
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(g)) for g in GATES])


_RULE = "array<struct<id:int,label:string,key:string,re:string,rank:int,conf:double>>"
_HIT = "array<struct<s:int,e:int,rank:int,id:int,label:string,conf:double>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, rule: Column) -> Column:
    """All matches of a rule, with code point offsets: what lies between the matches, and the matches, laid end to end."""
    hits = F.regexp_extract_all(text, rule["re"], F.lit(0))
    parts = F.split(text, rule["re"], -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_HIT).alias("out"))

    def step(acc, x):
        s = acc["at"] + F.char_length(x["p"])
        e = s + F.char_length(x["m"])
        hit = F.struct(s.alias("s"), e.alias("e"), rule["rank"].alias("rank"), rule["id"].alias("id"), rule["label"].alias("label"), rule["conf"].alias("conf"))
        return F.struct(e.alias("at"), F.array_append(acc["out"], hit).alias("out"))

    pairs = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _suppressed(found: Column, ranks: int) -> Column:
    """Drops detections inside one that comes before in the order (start, longer, stronger, rule) and isn't weaker. ``reach[r]`` is how far those of rank r and stronger have come."""
    ordered = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["rank"].alias("rank"), x["id"].alias("id"), x["label"].alias("label"), x["conf"].alias("conf")))), lambda x: F.struct(x["s"].alias("s"), (-x["ne"]).alias("e"), x["rank"].alias("rank"), x["id"].alias("id"), x["label"].alias("label"), x["conf"].alias("conf")))
    start = F.struct(F.array_repeat(F.lit(-1), ranks).alias("reach"), F.array().cast(_HIT).alias("out"))

    def step(acc, x):
        covered = F.element_at(acc["reach"], x["rank"] + 1) >= x["e"]
        stays = ~covered | (x["rank"] == 0)
        reach = F.transform(acc["reach"], lambda v, r: F.when(stays & (r >= x["rank"]), F.greatest(v, x["e"])).otherwise(v))
        return F.struct(reach.alias("reach"), F.when(stays, F.array_append(acc["out"], x)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def detections(text: Column) -> Column:
    """The detections in a text, an array of (s, e, rank, id, label, conf) in the order of starts; empty without a gate word."""
    table = [{k: v for k, v in r.items() if k != "gate"} for r in rules()]
    keys = sorted({r["key"] for r in table})
    all_rules = F.from_json(F.lit(json.dumps(table)), _RULE)
    key_list = F.split(F.lit("\n".join(keys)), "\n")
    ranks = 1 + max(r["rank"] for r in table)

    def scan(bound):
        held = F.filter(key_list, lambda k: F.contains(bound["low"], k))
        tried = _let(held, lambda h: F.filter(all_rules, lambda r: F.array_contains(h, r["key"])))
        found = _suppressed(F.flatten(F.transform(tried, lambda r: _matches(bound["t"], r))), ranks)
        return F.when(gated(bound["low"]), found).otherwise(F.array().cast(_HIT))

    return _let(F.struct(text.alias("t"), fold(text).alias("low")), scan)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the detections with their offsets."""
    base = F.filter("found", lambda x: x["rank"] == 0)
    words_before = lambda at: F.regexp_count(F.substring(F.col("body"), F.lit(1), at), F.lit(WORD)).cast("bigint")
    some = F.size(base) > 0
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.select("id", "body", detections(F.col("body")).alias("found"))
    return rows.select(
        F.col("id").alias(id_col), F.regexp_count("body", F.lit(WORD)).cast("bigint").alias("n_words"), F.size(base).cast("bigint").alias("n_base"),
        F.when(some, words_before(F.array_min(F.transform(base, lambda x: x["s"])))).alias("first_word"), F.when(some, words_before(F.array_max(F.transform(base, lambda x: x["s"])))).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["conf"])), F.lit(0.0)).alias("score"),
        F.col("found").alias("detections"),
    )


def report(docs: DataFrame, **options) -> DataFrame:
    return scan(docs, **options).drop("detections")
