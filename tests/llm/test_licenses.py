"""Licence notices as they are published: wrapped, in comments, with numbers, and by SPDX line."""

import textwrap

from siftline.llm import licenses

HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
ASIS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES.'
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)


def gnu(kind, version, tail, hope=HOPE):
    return (f"This {kind} is free software{tail}: you can redistribute it and/or modify it under the terms of the GNU {version}", hope)


LATER = " as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
PUBLISHED = {
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "    http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language.'),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSD-2-Clause": (*BSD[:3], ASIS),
    "BSD-3-Clause": (*BSD, ASIS),
    "GPL-2.0-or-later": gnu("program", "General Public License" + LATER.format(2), ""),
    "GPL-3.0-or-later": gnu("program", "General Public License" + LATER.format(3), ""),
    "AGPL-3.0-or-later": gnu("program", "Affero General Public License" + LATER.format(3), ""),
    "LGPL-2.1-or-later": gnu("library", "Lesser General Public License" + LATER.format("2.1"), "", HOPE.replace("program", "library")),
    "LGPL-3.0-or-later": gnu("library", "Lesser General Public License" + LATER.format(3), "", HOPE.replace("program", "library")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.'),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-SA-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",),
}


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


def test_notices_as_published(spark):
    rows, wanted = [], {}
    for k, (name, parts) in enumerate(PUBLISHED.items()):
        for j, (width, mark) in enumerate(((10_000, ""), (80, ""), (60, ""), (72, "#"), (72, " *"), (72, "//"))):
            text = "Copyright (c) 2020 Some One\n\n" + "\n\n".join(textwrap.fill(p, width) for p in parts) + "\n\nOther words\n"
            rows.append((100 * k + j, commented(text, mark) if mark else text))
            wanted[100 * k + j] = (name, 1)
    for k, name in enumerate(licenses.SPDX):
        for j, line in enumerate((f"SPDX-License-Identifier: {name}", f"// SPDX-License-Identifier: {name}\n#include <x.h>", f"/* SPDX-License-Identifier: {name} */\nint x;")):
            rows.append((10_000 + 10 * k + j, line))
            wanted[10_000 + 10 * k + j] = (name, 1)
    got = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["licenses"], r["n_matches"]) for r in got}
    assert {k: v for k, v in got.items() if v != wanted[k]} == {}


def test_any_holder_in_the_third_clause(spark):
    names = ["Google Inc.", "the University of California, Berkeley", "Some & One GmbH", "the <organization>"]
    rows = [(10 * k + j, "\n\n".join(textwrap.fill(p.replace("the copyright holder", n), w) for p in BSD) + "\n") for k, n in enumerate(names) for j, w in enumerate((10_000, 60, 30))]
    rows += [(100, "\n".join(BSD[:3]) + "\nNeither the name of " + "x " * 40 + "nor the names of its contributors may be used.\n")]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"]) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(100) == ("BSD-2-Clause", 1) and set(got.values()) == {("BSD-3-Clause", 1)}


def test_every_rule_by_its_sentences(spark):
    rows, wanted = [], {}
    for k, (name, sequence) in enumerate(licenses.RULES):
        rows.append((k, "\n\n".join(textwrap.fill(licenses.SENTENCES[s] + ".", 50) for s in sequence)))
        wanted[k] = (len(sequence), name, 1)
    rows += [(1000, None), (1001, ""), (1002, "license " * 200_000), (1003, "a license for software. All rights were reserved.")]
    wanted |= dict.fromkeys(range(1000, 1004), (0, "", 0))
    got = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["licenses"], r["n_matches"]) for r in got} == wanted


def test_hint_covers_all_sentences():
    import re

    assert all(re.search(licenses.hint(licenses.SENTENCES), s) for s in licenses.SENTENCES.values())
