"""Licence recognition on the licences' own notices, as they are wrapped in files."""

from __future__ import annotations

import re

import pytest

from vecspan.llm import licenses

APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'''
MIT = '''Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.'''
GPL2 = GPL.replace("version 3", "version 2").replace("Foundation,", "Foundation;")
GPL2_ONLY = '''This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.'''
NOTICES = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD-style"), (GPL, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (GPL2_ONLY, "GPL-2.0-only"), (MPL, "MPL-2.0")]


def licences(spark, texts: list[str]) -> list:
    rows = licenses.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [x for _, x in sorted((x.doc_id, x) for x in rows.collect())]


@pytest.mark.parametrize("prefix", ["", " * ", "# "])
def test_notices(spark, prefix):
    """As they are, as comments, with each paragraph on one line, and between other text."""
    texts = []
    for notice, _ in NOTICES:
        lines = "\n".join((prefix + x).rstrip() for x in notice.split("\n"))
        texts += [lines, "import os\n\n" + lines.replace("\n", "\r\n") + "\nend.", "Code. Words.\n" + "\n\n".join(" ".join(p.split()) for p in notice.split("\n\n"))]
    got = licences(spark, texts)
    assert [x.licenses for x in got] == [n for _, n in NOTICES for _ in range(3)]


def test_sentences_are_counted_as_before(spark):
    got = licences(spark, [MPL, APACHE, "-\nReleased under the MIT License.\n-\n*", "license", "Under the MPL, v. 2.0.", "Unreleased under the MIT License.", "Released under the MIT Licenses."])
    assert [x.n_sentences for x in got] == [5, 7, 4, 1, 2, 1, 1]
    assert got[0].sentence_ids == "MPL2,~" and got[2].sentence_ids == "~,MITname,~" and [x.sentence_ids for x in got[3:]] == [""] * 4


def test_notices_in_a_row(spark):
    """A notice twice is that notice, and doesn't leave a part for a general rule."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.\nEither version 3 of the License, or (at your option) any later version.\n"
    got = licences(spark, [gpl * 2, gpl * 3, GPL + "\n" + GPL, gpl + gpl.split("\n")[0]])
    assert [x.licenses for x in got] == ["GPL-3.0-or-later"] * 3 + ["GPL-3.0-or-later,GPL-unversioned"]
    assert got[0].sentence_ids == "GPLany,orLater,GPLany,orLater"


def test_other_licences(spark):
    lesser = GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
    affero = GPL.replace("GNU General", "GNU Affero General")
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    three = BSD + "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    free = "This is free and unencumbered software released into the public domain."
    eclipse = "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"
    tags = ["// SPDX-License-Identifier: MPL-2.0", "SPDX-License-Identifier: (MIT)", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 3.0", "Licensed under the GNU Lesser General Public License v3."]
    got = licences(spark, [lesser, affero, isc, three, free, eclipse, *tags, "SPDX-License-Identifier: NOPE-1.0"])
    assert [x.licenses for x in got] == ["LGPL-2.1-or-later", "AGPL-3.0-or-later", "ISC", "BSD-3-Clause", "Unlicense", "EPL-2.0", "MPL-2.0", "MIT", "CC-BY-SA-4.0", "CC-BY-SA-3.0", "LGPL-3.0-only", ""]


def test_tables():
    """Every identifier of a rule is known, no words stand for two, and every known sentence has a word that starts the search."""
    names = {n for n, _ in licenses.SENTENCES} | {n for n, _ in licenses.statements().values()}
    assert {x for s, _ in licenses.SEQUENCES for x in s} | set(licenses.singles()) <= names
    words = [w for _, w in licenses.SENTENCES] + list(licenses.statements())
    assert len(words) == len(set(words)) > 200
    starts = re.compile(licenses._TRIGGER)
    later = {"orLater", "orLater2", "orLater21"}
    assert all(starts.search(w) for n, w in licenses.SENTENCES if n not in later) and all(map(starts.search, licenses.statements()))
