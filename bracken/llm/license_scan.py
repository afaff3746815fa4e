"""License scans by sentence rules: normalised sentences become identifiers, and ordered rules match their sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The GNU licences' titles in notices, and the version lines of their full texts.
GNU = {"gpl": "gnu general public license", "lgpl": "gnu (lesser|library) general public license", "agpl": "gnu affero general public license"}
GNU_TEXTS = {"GPL-2.0": "version 2 june 1991", "GPL-3.0": "version 3 29 june 2007", "LGPL-2.0": "version 2 june 1991", "LGPL-2.1": "version 2 1 february 1999", "LGPL-3.0": "version 3 29 june 2007", "AGPL-3.0": "version 3 19 november 2007"}
#: Creative Commons: the parts of a licence's name, and its versions.
CC = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("3.0", "4.0")
#: Names that may stand alone behind "SPDX-License-Identifier:".
SPDX = (
    "MIT MIT-0 ISC 0BSD Zlib BSL-1.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.1 Apache-2.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 Unlicense CC0-1.0 Artistic-2.0 WTFPL PostgreSQL Python-2.0 OFL-1.1 "
    "GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
).split()


def _plain(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


def _key(*parts: str) -> str:
    return "_".join(parts).lower().replace("-", "_").replace(".", "_").replace(" ", "_")


def _gnu_sentences() -> dict[str, str]:
    """By licence and version: notices with and without later versions, short notices, titles; then notices without a version."""
    out = {}
    free = "^this (program|library|software|file|work) is free software you can redistribute it and or modify it under the terms of the"
    for name, title in GNU_TEXTS.items():
        kind, version = name.lower().split("-")
        own, v = GNU[kind], _plain(version).removesuffix(" 0")
        out[_key(name, "later")] = f"{free} {own} as published by the free software foundation (either )?version {v}( 0)? of the license or (at your option )?any later version"
        out[_key(name, "only")] = f"{free} {own} (as published by the free software foundation version {v}( 0)?( of the license)?( only)?|version {v}( 0)?( only)?( as published by the free software foundation)?)$"
        out[_key(name, "short")] = f"^(this (program|library|software|file|work|project) is )?(licensed|released|distributed) under the (terms of the )?{own} (v|version )?{v}( 0)?$"
        out[_key(name, "title")] = f"^{own} {title}"
    for kind, own in GNU.items():
        out[f"{kind}_redistribute"] = f"{free} {own}"
    out["gpl_warranty"] = "^this (program|library|software|file|work) is distributed in the hope that it will be useful but without any warranty"
    return out


#: Known sentences of public licences and notices, as patterns on normalised text (lower case, words apart by one space); the first that matches names a sentence.
SENTENCES = {
    "mit_release": r"^(released|licensed|distributed) under the (terms of the )?mit licen[cs]e$",
    "mit_title": r"^(the )?mit license$",
    "mit_grant": r"^permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit_notice": r"^the above copyright notice and this permission notice shall be included in all copies",
    "as_is": r"^the software is provided as is without warranty of any kind",
    "isc_grant": r"^permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",
    "0bsd_grant": r"^permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted$",
    "author_disclaims": r"^the software is provided as is and the author disclaims all warranties",
    "boost_grant": r"^permission is hereby granted free of charge to any person or organization obtaining a copy of the software",
    "zlib_as_is": r"^this software is provided as is without any express or implied warranty$",
    "zlib_grant": r"^permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "apache_release": r"^licensed under the apache license version 2 0( the license)?$",
    "apache_comply": r"^you may not use this file except in compliance with the license$",
    "apache_as_is": r"^unless required by applicable law or agreed to in writing software distributed under the license",
    "apache_title": r"^apache license version 2 0 january 2004",
    **_gnu_sentences(),
    "bsd_grant": r"^redistribution and use in source and binary forms with or without modification are permitted",
    "bsd_advertise": r"^(\d )?all advertising materials mentioning features or use of this software must display",
    "bsd_name": r"^(\d )?neither the name of .* may be used to endorse or promote products",
    "mpl_subject": r"^this source code form is subject to the terms of the mozilla public license( v( 2 0)?)?",
    "mpl_copy": r"^if a copy of the mpl was not distributed with this file",
    "mpl_title": r"^mozilla public license version 2 0$",
    "mpl11_subject": r"^the contents of this file are subject to the mozilla public license version 1 1",
    "epl2_release": r"^this program and the accompanying materials are made available under the terms of the eclipse public license (v |version )?2 0",
    "unlicense": r"^this is free and unencumbered software released into the public domain$",
    "cc0_waived": r"^to the extent possible under law .* waived all copyright and related or neighboring rights",
    "cc0_title": r"^(cc0|creative commons cc0|creative commons zero) (v )?1 0 universal",
    **{_key("cc", kind, *(v.split()), "release"): f"^((this work|this content|this file) is )?licensed under (a |the )?(cc {_plain(kind)} {_plain(v)}|creative commons {words} {_plain(v)}( (international|unported))?( license)?)$" for v in CC_VERSIONS for kind, words in CC.items()},
    **{_key("spdx", n): f"^spdx license identifier {_plain(n)}$" for n in SPDX},
    "all_rights": r"^all rights reserved$",
    "copyright": r"^copyright (c )?\d{4}",
}
#: In this order: a licence and the sentences that must come one after the other, others of known kind may stand between.
#: A rule takes its sentences away, so that a shorter rule doesn't find them again.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT-0", ("mit_grant", "as_is")),
    ("ISC", ("isc_grant", "author_disclaims")),
    ("0BSD", ("0bsd_grant", "author_disclaims")),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("BSL-1.0", ("boost_grant",)),
    ("Apache-2.0", ("apache_release", "apache_comply", "apache_as_is")),
    ("Apache-2.0", ("apache_title",)),
    *((f"{n}-or-later", (_key(n, "later"), "gpl_warranty")) for n in GNU_TEXTS),
    *((f"{n}-or-later", (_key(n, "later"),)) for n in GNU_TEXTS),
    *((f"{n}-only", (_key(n, "only"), "gpl_warranty")) for n in GNU_TEXTS),
    *((f"{n}-only", (_key(n, kind),)) for n in GNU_TEXTS for kind in ("only", "short", "title")),
    ("GPL-1.0-or-later", ("gpl_redistribute", "gpl_warranty")),
    ("LGPL-2.0-or-later", ("lgpl_redistribute", "gpl_warranty")),
    ("AGPL-1.0-or-later", ("agpl_redistribute", "gpl_warranty")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_advertise", "bsd_name")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_name")),
    ("BSD-2-Clause", ("bsd_grant",)),
    ("MPL-2.0", ("mpl_subject", "mpl_copy")),
    ("MPL-2.0", ("mpl_title",)),
    ("MPL-1.1", ("mpl11_subject",)),
    ("EPL-2.0", ("epl2_release",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0_waived",)),
    ("CC0-1.0", ("cc0_title",)),
    ("MIT", ("mit_release",)),
    ("MIT", ("mit_title",)),
    ("Apache-2.0", ("apache_release",)),
    *((f"CC-{kind}-{v}", (_key("cc", kind, v, "release"),)) for v in CC_VERSIONS for kind in CC),
    *((n, (_key("spdx", n),)) for n in SPDX),
    ("all-rights-reserved", ("all_rights",)),
)
#: Every sentence above holds one of these; other texts aren't normalised.
HINT = r"(?i)licen[cs]e|permi|copyright|warranty|redistribut|rights reserved|neither the name|the mpl|unencumbered|advertising materials|cc0|creative commons"
#: As HINT, with words that a line break may part.
WRAPPED_HINT = HINT.replace(" ", "[^a-zA-Z0-9]+")


def _anywhere() -> str:
    """All sentences, each from a start to an end; words are apart by a space, or by `/` where a line wraps.

    A holder's name may end with a full stop: "Neither the name of Foo Inc. nor the names of ...".
    """
    ways = []
    for p in SENTENCES.values():
        body = p.removeprefix("^").removesuffix("$").replace(" ", "[ /]").replace(".*", r"[^|]*(?:\|nor[ /][^|]*)*")
        ways.append(body + "(?=[/|])" * p.endswith("$"))
    return "[/|](?=(" + "|".join(ways) + "))"


def _sentence_ids(text: Column) -> Column:
    """Known sentences by their places. They start and end at line breaks, semicolons, ends of addresses and of sentences.

    Line breaks, semicolons and addresses may also stand inside one; blank lines, and `.`, `!` or `?` before a space, may not.
    """
    x = F.regexp_replace(F.lower(text), r"(https?://[^ \t\r\n]+)", "$1;")
    x = F.translate(x, "|/", "  ")
    x = F.regexp_replace(x, r"[.!?][ \t\r\n]", "|")
    x = F.regexp_replace(x, r"\n[^a-z0-9\n|]*+\n", "|")
    x = F.regexp_replace(F.concat(F.lit("|"), x, F.lit("|")), r"[;\n]", "/")
    x = F.regexp_replace(x, "[^a-z0-9/|]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, " */[ /]*", "/"), r"[ /]?\|[ /|]*", "|")
    plain = F.transform(F.regexp_extract_all(x, F.lit(_anywhere()), F.lit(1)), lambda s: F.translate(s, "/|", "  "))

    def name(s: Column) -> Column:
        keys = iter(SENTENCES.items())
        key, pattern = next(keys)
        out = F.when(s.rlike(pattern), F.lit(key))
        for key, pattern in keys:
            out = out.when(s.rlike(pattern), F.lit(key))
        return out

    return F.transform(plain, name)


def rule_pattern(sentences: tuple[str, ...]) -> str:
    """The sentences one after the other; groups hold what stands between them."""
    return "((?:<[^>]*>)*)".join(f"<{s}>" for s in sentences)


def rule_rest(sentences: tuple[str, ...], mark: str = "$") -> str:
    """What a match of rule_pattern leaves behind."""
    return "".join(f"{mark}{k}" for k in range(1, len(sentences)))


def _match_rules(sequence: Column) -> Column:
    """Names of the rules that match, in their order; each takes its sentences away."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(rule_pattern(s)).alias("pattern"), F.lit(rule_rest(s)).alias("rest")) for n, s in RULES])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        found = F.struct(F.regexp_replace(state["left"], rule["pattern"], rule["rest"]).alias("left"), F.array_append(state["names"], rule["name"]).alias("names"))
        return F.when(F.regexp_like(state["left"], rule["pattern"]), found).otherwise(state)

    return F.array_distinct(F.aggregate(rules, start, apply, lambda state: state["names"]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_ids, licenses, license) of each row.

    licenses: the rules that match, in their order, each name once; license: the first. Null and empty texts, and
    those without a known sentence, have none. Every row is judged by itself: rows that repeat, and rows without an
    id, give a row each; a long text is read whole. Only id and text are read, so columns named like results don't
    matter.
    """
    none = F.array().cast("array<string>")
    out = docs.select(F.col(id_col).alias("_id"), F.when(F.col(text_col).rlike(WRAPPED_HINT), _sentence_ids(F.col(text_col))).otherwise(none).alias("sentence_ids"))
    out = out.withColumn("sentence_ids", F.coalesce("sentence_ids", none))
    sequence = F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    out = out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, _match_rules(sequence)).otherwise(none))
    return out.select(F.col("_id").alias(id_col), "sentence_ids", "licenses", F.get("licenses", F.lit(0)).alias("license"))
