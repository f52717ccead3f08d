"""Licence recognition by sentences and ordered rules, in DataFrame expressions only.

A text is cut into sentences, each is normalised and looked up among known
licence sentences. The sequence of identifiers found (other sentences leave no
trace in it, but end a rule's match if they stand inside) is matched against
rules, the more specific first: a rule is an ordered sequence of identifiers,
and a match uses its sentences up.

A line's end, a semicolon, a colon and ``v.`` may end a sentence or stand inside
one, as in wrapped texts. Comment marks that begin lines, numbers of list items
and URLs are left out.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Sentences of public licence notices, normalised (lower case; anything but letters and digits is one space), by identifier.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-licensed": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0-notice": "released under cc0 1 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "rights": "all rights reserved",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-name-author": "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name-short": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-notice": "distributed under the boost software license version 1 0",
    "epl-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-work-the": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-sa-work-the": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
}
#: Licences that a line with an SPDX identifier may name; a plus sign behind one is not told from its absence.
SPDX = ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Zlib", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")
SENTENCES |= {f"spdx-{x.lower()}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()) for x in SPDX}
#: Ordered rules: licence and its sentences.
_RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name-author", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name-short", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name-author")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name-short")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice-the", "apache-comply", "apache-copy", "apache-asis")),
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy", "apache-asis")),
    ("Apache-2.0", ("apache-notice-the",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-notice-licensed",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant-and", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-notice",)),
    ("EPL-2.0", ("epl-notice",)),
    ("MPL-2.0", ("mpl-notice", "mpl-copy")),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-work",)),
    ("CC-BY-4.0", ("cc-by-work-the",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work-the",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("all-rights-reserved", ("rights",)),
    *[(x, (f"spdx-{x.lower()}",)) for x in SPDX],
)
#: The longer before those they may contain.
RULES = tuple(sorted(_RULES, key=lambda r: -len(r[1])))
#: Signs for the end of a sentence, for a place where one may end, and for a known sentence.
END, BREAK, KNOWN = "\ue000", "\ue001", "\ue002"
WHITE = r"[\x20\x09-\x0D]"
#: Applied in this order to a text in lower case.
STEPS = (
    (f"[{END}{BREAK}{KNOWN}]", " "),
    (r"(?m)^[\x20\x09]*+(?:#++|//++|/?\*++/?|;++|--|%++)(?=[\x20\x09]|$)", ""),
    (r"https?://[^\x20\x09-\x0D]+", "\n"),
    (rf"(?<=^|\n|[.!?;:]{WHITE})(?:{WHITE}*+(?:\(?[0-9]{{1,2}}[.)]|\([a-z]\)))(?={WHITE})", "\n"),
    (rf"(?<=[.!?])(?<!(?<![\p{{L}}\p{{N}}])v\.){WHITE}+|\n[\x20\x09\x0B-\x0D]*\n", END),
    (rf"(?<=[;:]|v\.){WHITE}+|\n", BREAK),
    (rf"[^\p{{L}}\p{{N}}{END}{BREAK}]+", " "),
    (f"[{END}{BREAK}\\x20]*{END}[{END}{BREAK}\\x20]*", f" {END} "),
    (f"[{BREAK}\\x20]*{BREAK}[{BREAK}\\x20]*", f" {BREAK} "),
)


def _words(text: str) -> str:
    """A pattern of words with a space, and perhaps a break, between them."""
    return f"(?: {BREAK})? ".join(text.split())


#: The holder's name in a clause stands for any: pattern and what it becomes.
HOLDER = (f"{_words('neither the name of')}(?:(?: [{END}{BREAK}])? (?!nor )[^ {END}{BREAK}]+){{1,12}}+(?: [{END}{BREAK}])? {_words('nor the names of')}(?:(?: {BREAK})? its)?(?= )", "neither the name of the copyright holder nor the names of its")


def hint(sentences: dict[str, str]) -> str:
    """A pattern that every text with one of the sentences matches: a few words, of which each sentence has one."""
    left, words = list(sentences.values()), []
    while left:
        counts = Counter(w for s in left for w in set(s.split()) if len(w) > 5) or Counter(w for s in left for w in set(s.split()))
        words.append(max(counts, key=lambda w: (counts[w], len(w), w)))
        left = [s for s in left if words[-1] not in s]
    return "(?i)" + "|".join(words)


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """``array<string>``: for each sentence of the text with a word its identifier, or ``-``."""
    out = F.lower(text)
    for pattern, sign in STEPS:
        out = F.regexp_replace(out, pattern, sign)
    out = F.regexp_replace(F.concat(F.lit(f" {END} "), F.trim(out), F.lit(f" {END} ")), *HOLDER)
    # The longer first: a sentence may begin with another one.
    for k, s in sorted(sentences.items(), key=lambda x: -len(x[1])):
        pattern = f"(?<=[{END}{BREAK}] ){_words(s)}(?= [{END}{BREAK}])"
        out = F.regexp_replace(out, pattern, KNOWN + k)
    parts = F.filter(F.transform(F.split(out, f"[{END}{BREAK}]", -1), lambda s: F.trim(s)), lambda s: s != "")
    ids = F.transform(parts, lambda s: F.when(s.startswith(KNOWN), F.substring(s, 2, 1000)).otherwise("-"))
    return F.when(text.rlike(hint(sentences)), ids).otherwise(F.array().cast("array<string>"))


def recognise(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``doc_id, n_sentences, licenses, n_matches`` for every row of ``docs``.

    ``n_sentences`` counts known licence sentences, ``n_matches`` rules matched;
    ``licenses`` lists the distinct licences, sorted and joined by commas, empty
    if there is none. A null or empty text has none; texts of any length are read
    whole. Of rules that match at one place the longer wins, of equal ones the first. Null and repeated ids are
    kept, no rows give no rows, other columns are ignored.
    """
    ids = sentence_ids(F.coalesce(F.col("text"), F.lit("")), sentences)
    # Written as |a||b|: an identifier is then found whole, and neighbours touch.
    rows = docs.select(F.col("doc_id").cast("long"), F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|")))).alias("left"))
    rows = rows.withColumn("n_sentences", F.regexp_count("left", F.lit(r"\|[^|-][^|]*\|")).cast("long"))
    hits = []
    for k, (_, sequence) in enumerate(rules):
        pattern = "".join(f"|{s}|" for s in sequence)
        rest = F.replace(F.col("left"), F.lit(pattern), F.lit("|-|"))
        rows = rows.withColumns({f"n{k}": ((F.length("left") - F.length(rest)) / (len(pattern) - 3)).cast("long"), "left": rest})
        hits.append(F.col(f"n{k}"))
    names = F.array(*[F.when(h > 0, F.lit(name)) for h, (name, _) in zip(hits, rules, strict=True)])
    found = F.array_join(F.array_sort(F.array_distinct(F.array_compact(names))), ",")
    return rows.select("doc_id", "n_sentences", found.alias("licenses"), sum(hits[1:], hits[0]).alias("n_matches"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(read_table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The query in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "map {" + ", ".join(f"{quote(s)}: {quote(k)}" for k, s in SENTENCES.items()) + "}"
    steps, last = [], "ids"
    for k, (_, sequence) in enumerate(RULES):
        pattern = "".join(f"|{s}|" for s in sequence)
        steps.append(f"r{k} AS (SELECT * EXCLUDE (l), replace(l, {quote(pattern)}, '|-|') AS l, CAST((length(l) - length(replace(l, {quote(pattern)}, '|-|'))) / {len(pattern) - 3} AS BIGINT) AS n{k} FROM {last})")
        last = f"r{k}"
    names = ", ".join(f"CASE WHEN n{k} > 0 THEN {quote(name)} END" for k, (name, _) in enumerate(RULES))
    total = " + ".join(f"n{k}" for k in range(len(RULES)))
    # RE2 has no look-behind: a line feed is put where a sentence ends.
    return f"""
WITH parts AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t-\\r]+', '\\1' || chr(10), 'g'), chr(10)),
    lambda s: trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS p FROM documents),
ids AS (
  SELECT doc_id, array_to_string(list_transform(list_filter(p, lambda s: s <> ''), lambda s: '|' || coalesce({known}[s], '-') || '|'), '') AS l FROM parts),
{', '.join(steps)},
counted AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licenses, {total} AS n_matches FROM {last})
SELECT i.doc_id, CAST(len(regexp_extract_all(i.l, '\\|[^|-][^|]*\\|')) AS BIGINT) AS n_sentences, licenses, CAST(n_matches AS BIGINT) AS n_matches
FROM ids i JOIN counted c ON i.doc_id = c.doc_id
"""
