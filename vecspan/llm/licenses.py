"""Licence recognition by sentences and ordered rules (DataFrame functions only).

A text is cut into sentences (at line ends, and after ``.``, ``!`` or ``?`` before white space). A sentence is normalised
(lower case, every run of other characters than letters and digits as one space) and mapped to the identifier of a known
licence sentence; runs of unknown sentences become one gap. Before that, the sentences of ``SENTENCES`` and the standard
notices are looked for across the cuts, so that it doesn't matter where lines are wrapped, that "v. 2.0" is cut, or that a
notice puts several sentences into one; each begins where a sentence begins and has the ends that the licences give it.
The lines of ``statements`` (names of licences in set phrases) are known as whole sentences only.

The sequence of identifiers is then matched against ordered rules: a rule that finds its identifiers next to one another
reports a licence and uses these identifiers up, wherever they stand, so that special rules come before general ones. In
the sequence every identifier has a mark of its own on both sides: matches may follow one another without sharing any.

Cases: null and empty texts have no sentences, no identifiers and no licences; repeated rows keep a result each; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of known licence sentences and their normalised wording (public licence texts).
SENTENCES = [
    ("GPL3", "this work is licensed under the gnu general public license version 3"),
    ("GPL2", "this work is licensed under the gnu general public license version 2"),
    ("GPLany", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("LGPLany", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("LGPLany", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("LGPLany", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation"),
    ("AGPLany", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("orLater", "either version 3 of the license or at your option any later version"),
    ("orLater2", "either version 2 of the license or at your option any later version"),
    ("orLater21", "either version 2 1 of the license or at your option any later version"),
    ("noWarrantyGPL", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("Apache2", "licensed under the apache license version 2 0"),
    ("Apache2Comply", "you may not use this file except in compliance with the license"),
    ("Apache2Copy", "you may obtain a copy of the license at"),
    ("MITname", "released under the mit license"),
    ("MITperm", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("AsIs", "the software is provided as is without warranty of any kind"),
    ("BSDstart", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDsource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDbinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("BSDnames", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("Zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("BSL1", "distributed under the boost software license version 1 0"),
    ("BSL1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("EPL2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("EPL1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("CDDL", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("Artistic2", "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("CCBYNC4", "licensed under cc by nc 4 0"),
    ("CCBY4", "licensed under cc by 4 0"),
    ("CC0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("MPL2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL11", "the contents of this file are subject to the mozilla public license version 1 1"),
]
#: Ordered rules of several identifiers, each with the licence that it tells.
SEQUENCES = [
    (("GPLany", "orLater"), "GPL-3.0-or-later"),
    (("GPLany", "orLater2"), "GPL-2.0-or-later"),
    (("LGPLany", "orLater21"), "LGPL-2.1-or-later"),
    (("LGPLany", "orLater2"), "LGPL-2.0-or-later"),
    (("LGPLany", "orLater"), "LGPL-3.0-or-later"),
    (("AGPLany", "orLater"), "AGPL-3.0-or-later"),
    (("Apache2", "Apache2Comply", "Apache2Copy"), "Apache-2.0"),
    (("Apache2", "Apache2Comply"), "Apache-2.0"),
    (("MITperm", "AsIs"), "MIT"),
    (("BSDstart", "BSDsource", "BSDbinary", "BSDnames"), "BSD-3-Clause"),
    (("BSDstart", "BSDsource", "BSDbinary"), "BSD-style"),
]
#: What a single identifier tells, where no sequence has used it up.
SINGLES = {
    "GPL3": "GPL-3.0-only", "GPL2": "GPL-2.0-only", "GPLany": "GPL-unversioned", "LGPLany": "LGPL-unversioned", "AGPLany": "AGPL-unversioned", "Apache2": "Apache-2.0", "MITperm": "MIT", "MITname": "MIT",
    "ISC": "ISC", "0BSD": "0BSD", "Zlib": "Zlib", "Unlicense": "Unlicense", "BSL1": "BSL-1.0", "EPL2": "EPL-2.0", "EPL1": "EPL-1.0", "CDDL": "CDDL-unversioned", "Artistic2": "Artistic-2.0",
    "CCBYNC4": "CC-BY-NC-4.0", "CCBY4": "CC-BY-4.0", "CC0": "CC0-1.0", "MPL2": "MPL-2.0", "MPL11": "MPL-1.1",
}
#: Public short identifiers of licences, as they stand in tags.
SHORT = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 "
    "EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL "
    "Python-2.0 Unlicense UPL-1.0 WTFPL Zlib"
).split()
#: The Creative Commons licences by their parts' names.
COMMONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
GAP = "~"


def _normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def statements() -> dict[str, tuple[str, str]]:
    """Normalised sentence → identifier and licence: tags, and set phrases with a licence's name, by rule."""
    out = {}
    for name in SHORT:
        for phrase in ("SPDX-License-Identifier: {}", "license: {}", "licensed under the {} license", "released under the {} license"):
            out[_normal(phrase.format(name))] = ("is" + name.replace(".", "").replace("-", ""), name)
    for kind, words in COMMONS.items():
        for version, port in (("4.0", "international"), ("3.0", "unported"), ("2.0", "generic")):
            known = ("is" + f"CC-{kind}-{version}".replace(".", "").replace("-", ""), f"CC-{kind}-{version}")
            out[_normal(f"this work is licensed under a creative commons {words} {version} {port} license")] = known
            out[_normal(f"licensed under cc {kind} {version}")] = known
    for family, words in (("GPL", "general"), ("LGPL", "lesser general"), ("AGPL", "affero general")):
        for version in ("2.0", "2.1", "3.0"):
            for short in {version, version.removesuffix(".0")}:
                for phrase in ("this work is licensed under the gnu {} public license version {}", "licensed under the gnu {} public license version {}", "licensed under the gnu {} public license v{}"):
                    out[_normal(phrase.format(words, short))] = (f"is{family}{version.replace('.', '')}only", f"{family}-{version}-only")
    for _, words in SENTENCES:
        out.pop(words, None)
    return out


def singles() -> dict[str, str]:
    return SINGLES | dict(statements().values())


def licences() -> list[str]:
    """All licences in the order in which they are reported: that of the rules."""
    return list(dict.fromkeys([x for _, x in SEQUENCES] + list(singles().values())))


_BREAK = "[ |]+"
#: Sentences that go on after the known words in the licences; their ends are left open.
_OPEN = {"Apache2Copy", "MITperm", "AsIs", "noWarrantyGPL", "BSDbinary", "BSDnames", "ISC", "BSL1", "EPL2", "EPL1", "CDDL", "MPL11"}
_TAIL = "(?: [^|]*)?"


def _spaced(words: str) -> str:
    return words.replace(" ", _BREAK)


def _notices() -> list[tuple[str, str]]:
    """Patterns over normalised sentences, each between bars, and the identifiers that each stands for. Longer ones come
    first."""
    known: dict[str, str] = {}
    for name, words in SENTENCES:
        known[name] = f"{known[name]}|{_spaced(words)}" if name in known else _spaced(words)
    known = {name: f"(?:{words})" for name, words in known.items()}
    published = _BREAK + _spaced("as published by the free software foundation")
    terms = _spaced("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license")
    mark = f"(?:[0-9a-d]{_BREAK})?"
    apache = known["Apache2"] + f"(?:{_BREAK}the{_BREAK}license)?"
    bsd = known["BSDstart"] + _BREAK + mark + known["BSDsource"] + _BREAK + mark + known["BSDbinary"]
    found = [
        (apache + _BREAK + known["Apache2Comply"] + _BREAK + known["Apache2Copy"] + _TAIL, "Apache2,Apache2Comply,Apache2Copy"),
        (apache + _BREAK + known["Apache2Comply"], "Apache2,Apache2Comply"),
        (known["Apache2"] + f"(?:{_BREAK}the{_BREAK}license{_TAIL})?", "Apache2"),
        (terms + _spaced(" version 3") + published, "GPL3"),
        (terms + _spaced(" version 2") + published, "GPL2"),
        (bsd + rf"(?:[ |][^|]*){{0,3}}[ |]+{mark}" + known["BSDnames"] + _TAIL, "BSDstart,BSDsource,BSDbinary,BSDnames"),
        (bsd + _TAIL, "BSDstart,BSDsource,BSDbinary"),
        (known["ISC"] + _TAIL, "ISC"),
    ]
    for family in ("GPL", "LGPL", "AGPL"):
        for later in ("orLater", "orLater21", "orLater2"):
            found.append((known[f"{family}any"] + _BREAK + known[later], f"{family}any,{later}"))
    return found + [(words + (_TAIL if name in _OPEN else ""), name) for name, words in known.items() if name != "ISC"]


#: Every known sentence has one of these words.
_TRIGGER = "licensed?|warranty|redistribution|permission|copyright|public domain"
_BUCKETS = 64


def _sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n|(?<=[.!?])\s+"), lambda s: s != "")


def _barred(sentences: Column) -> Column:
    """The normalised sentences between bars."""
    normal = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.concat(F.lit("|"), F.array_join(normal, "|"), F.lit("|"))


def _identified(barred: Column) -> Column:
    """The identifiers of the sentences, in order; null for an unknown one. Where a notice stands for several, they are
    one element with commas."""
    marked = barred
    for pattern, names in _notices():
        marked = F.regexp_replace(marked, rf"(?<=\|){pattern}(?=\|)", f"={names}")
    found = F.split(F.regexp_replace(F.when(barred.rlike(_TRIGGER), marked).otherwise("||"), r"^\||\|$", ""), r"\|")
    # whole sentences by a hash, then by themselves
    tables: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for words, (name, _) in statements().items():
        tables[zlib.crc32(words.encode()) % _BUCKETS][words] = name
    table = F.from_json(F.lit(json.dumps(tables)), "array<map<string,string>>")
    whole = lambda s: F.try_element_at(F.get(table, (F.crc32(s.cast("binary")) % _BUCKETS).cast("int")), s)
    return F.transform(found, lambda s: F.when(F.startswith(s, F.lit("=")), F.substring(s, 2, 1000)).otherwise(whole(s)))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, sentence_ids (joined by commas, gaps as ``~``) and licenses (distinct, in the rules' order)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _sentences(F.col(text_col)).alias("sentences"))
    rows = rows.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), _barred(F.col("sentences")).alias("barred"))
    rows = rows.select("doc_id", "n_sentences", _identified(F.col("barred")).alias("ids"))
    line = F.array_join(F.transform("ids", lambda s: F.coalesce(s, F.lit(GAP))), ",")
    line = F.regexp_replace(F.concat(F.lit(","), line, F.lit(",")), f"(?:,{GAP})+,", f",{GAP},")
    rows = rows.select("doc_id", "n_sentences", F.when(F.exists("ids", lambda s: s.isNotNull()), F.regexp_replace(line, "^,|,$", "")).otherwise("").alias("sentence_ids"))
    # every identifier between brackets of its own
    left, found = F.concat(F.lit("<"), F.replace("sentence_ids", F.lit(","), F.lit("><")), F.lit(">")), []
    for sequence, licence in SEQUENCES:
        wanted = "".join(f"<{x}>" for x in sequence)
        found.append(F.when(F.contains(left, F.lit(wanted)), F.lit(licence)))
        left = F.replace(left, F.lit(wanted), F.lit(f"<{GAP}>"))
    rows = rows.select("doc_id", "n_sentences", "sentence_ids", F.when(F.col("sentence_ids") != "", F.struct(left.alias("left"), F.array_compact(F.array(*found)).alias("found"))).alias("seen"))
    rules = F.from_json(F.lit(json.dumps([{"name": f"<{k}>", "licence": v} for k, v in singles().items()])), "array<struct<name:string,licence:string>>")
    told = F.transform(F.filter(rules, lambda r: F.contains(F.col("seen.left"), r["name"])), lambda r: r["licence"])
    every = F.concat(F.col("seen.found"), told)
    order = F.from_json(F.lit(json.dumps(licences())), "array<string>")
    names = F.filter(order, lambda x: F.array_contains(every, x))
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.when(F.col("seen").isNull(), "").otherwise(F.array_join(names, ",")).alias("licenses"))


def oracle() -> str:
    """DuckDB SQL for the same rows, where sentences aren't wrapped: the identifiers are joined by their words, and the
    rules read a line with one letter for each identifier."""
    known = [(words, name) for name, words in SENTENCES] + [(words, name) for words, (name, _) in statements().items()]
    letters = {name: chr(0x4E00 + k) for k, name in enumerate(dict.fromkeys(n for _, n in known))}
    pairs = ", ".join(f"('{words}', '{name}', '{letters[name]}')" for words, name in known)
    left, cases = "letters", []
    for sequence, licence in SEQUENCES:
        wanted = "".join(letters[x] for x in sequence)
        cases.append(f"CASE WHEN contains({left}, '{wanted}') THEN '{licence}' END")
        left = f"replace({left}, '{wanted}', '{GAP}')"
    told = ", ".join(f"('{letters[name]}', '{licence}')" for name, licence in singles().items() if name in letters)
    ranks = ", ".join(f"('{x}', {k})" for k, x in enumerate(licences()))
    return f"""
        WITH known(words, name, letter) AS (VALUES {pairs}), told(letter, licence) AS (VALUES {told}), ranks(licence, rank) AS (VALUES {ranks}),
        cut AS (SELECT row_number() OVER () AS r, doc_id, [s FOR s IN string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\r?\\n', chr(10), 'g'), '\\n') IF s <> ''] AS ss FROM documents),
        flat AS (SELECT r, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM cut),
        named AS (SELECT r, k, name, letter FROM flat LEFT JOIN known ON words = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
        lines AS (SELECT r, regexp_replace(string_agg(coalesce(name, '{GAP}'), ',' ORDER BY k), '{GAP}(?:,{GAP})+', '{GAP}', 'g') AS ids, string_agg(coalesce(letter, '{GAP}'), '' ORDER BY k) AS letters, count(name) AS n FROM named GROUP BY r),
        told_of AS (SELECT r, ids, regexp_replace(letters, '{GAP}+', '{GAP}', 'g') AS letters FROM lines WHERE n > 0),
        found AS (SELECT r, unnest([{', '.join(cases)}]) AS licence FROM told_of UNION SELECT r, licence FROM (SELECT r, unnest(string_split({left}, '')) AS letter FROM told_of) JOIN told USING (letter)),
        listed AS (SELECT r, string_agg(licence, ',' ORDER BY rank) AS licenses FROM (SELECT DISTINCT r, licence FROM found) JOIN ranks USING (licence) GROUP BY r)
        SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
        FROM cut LEFT JOIN told_of USING (r) LEFT JOIN listed USING (r)"""
