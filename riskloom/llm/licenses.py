"""License texts and notices found by the digest of their canonical form.

A text's canonical form has A-Z as a-z, no copyright lines, one blank for each run of ASCII or typographic punctuation
and white space, and one spelling for equivalent ones. Its SHA-256 is hash-joined to the digests of the catalogue, so a
match is a match of entire texts: the whole document against whole licenses, and each whole line against whole notices.
All of it is DataFrame operations; nothing leaves the JVM.

Rows: a null text counts as empty, which matches nothing; equal canonical texts in the catalogue go to the licence that
sorts first; repeated rows get repeated results; rows that share an id are judged each by its own text; very long texts
are judged whole; extra columns are ignored, also one named like a result; an empty table gives an empty table; an empty
catalogue matches nothing. Lines are matched within their row, so nothing is shuffled.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings (from, to), applied in this order.
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("https", "http"), ("merchantibility", "merchantability")]

COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{a9}\x{2010}-\x{201f}]+"

# Texts of public licences and of the short notices that name one.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
GRANT = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = [
    ("0BSD", "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + GRANT),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + REDISTRIBUTION + DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + DISCLAIMER),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + GRANT),
    ("MIT", 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n' + AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT-0", 'MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n' + AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
]
# Longer texts, from a data file, and notices by SPDX identifiers and by name; the SQL twin has TEXTS and NOTICES only.
LONG_TEXTS = [tuple(x) for x in json.loads(Path(__file__).with_name("license_texts.json").read_text("utf-8"))]
GNU = [("GPL-1.0", "General", "1"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.0", "Library General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3")]
SPDX = ["0BSD", "Artistic-1.0-Perl", "BSD-2-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT-0", "MPL-1.1", "MPL-2.0", "Unlicense"]
MORE_NOTICES = [
    *((x, f"SPDX-License-Identifier: {x}") for x in SPDX),
    *((x, f"SPDX-License-Identifier: {x}{end}") for x in (*(g[0] for g in GNU), "GFDL-1.2", "GFDL-1.3") for end in ("", "+", "-only", "-or-later") if (x, end) != ("GPL-3.0", "-only")),
    *((x, f"This work is licensed under the GNU {kind} Public License, version {v}{later}.") for x, kind, v in GNU for later in ("", ", or any later version", " or later") if later or x not in ("GPL-2.0", "GPL-3.0")),
    *((f"MPL-{v}", f"{how} under the Mozilla Public License, {word} {v}.") for v in ("1.1", "2.0") for how in ("Licensed", "Released") for word in ("version", "v.")),
]
#: Entries of a catalogue, which is broadcast.
MOST = 50_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    small = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    plain = F.regexp_replace(F.regexp_replace(small, COPYRIGHT_LINE, "\n"), PUNCTUATION, " ")
    return F.trim(reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), SPELLINGS, plain))


def canonical_sql(text: str) -> str:
    """The same form in SQL."""
    out = f"regexp_replace(regexp_replace(translate(coalesce({text}, ''), '{CAPITALS}', '{SMALL}'), '{COPYRIGHT_LINE}', chr(10), 'g'), '{PUNCTUATION}', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out}, ' ')"


def digests(spark: SparkSession, rows: list[tuple[str, str]], name: str) -> DataFrame:
    """(digest, name) of a catalogue's texts."""
    known = spark.createDataFrame(rows, "license string, text string")
    return known.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license").alias(name))


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS + LONG_TEXTS, notices: list[tuple[str, str]] = NOTICES + MORE_NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column, digest, license (of the whole text, or null), notices (licences of whole lines, sorted), notice_lines. The catalogue is checked to have at most MOST entries and broadcast."""
    if len(texts) + len(notices) > MOST:
        raise ValueError(f"the catalogue has over {MOST} entries")
    spark = docs.sparkSession
    named = {r.digest: r.notice for r in digests(spark, notices, "notice").collect()} if notices else {}
    digest = lambda text: F.sha2(canonical(text), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0), digest)
    hits = F.filter(lines, lambda d: d.isin(list(named)))  # a set of digests, looked up by hash
    whole = rows.select("id", digest(F.col("text")).alias("digest"), hits.alias("hits"))
    names = F.create_map(*[F.lit(x) for pair in named.items() for x in pair]) if named else F.create_map().cast("map<string,string>")
    out = whole.join(F.broadcast(digests(spark, texts, "license")), "digest", "left")
    found = F.array_sort(F.array_distinct(F.transform("hits", lambda d: F.try_element_at(names, d))))
    return out.select(F.col("id").alias(id_col), "digest", "license", found.alias("notices"), F.size("hits").cast("bigint").alias("notice_lines"))


def scan_sql() -> str:
    """The query's twin: doc_id, digest, license, notices (comma-joined), notice_lines."""
    quoted = lambda rows: ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in r)) for r in rows)
    digest = lambda text: f"sha256({canonical_sql(text)})"
    return f"""
        WITH texts AS (SELECT {digest("t")} AS digest, min(l) AS license FROM (VALUES {quoted(TEXTS)}) v(l, t) GROUP BY 1),
        notes AS (SELECT {digest("t")} AS digest, min(l) AS notice FROM (VALUES {quoted(NOTICES)}) v(l, t) GROUP BY 1),
        lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
        hits AS (
            SELECT doc_id, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices, count(*) AS n
            FROM (SELECT doc_id, {digest("line")} AS digest FROM lines) JOIN notes USING (digest) GROUP BY doc_id
        )
        SELECT d.doc_id, d.digest, t.license, coalesce(h.notices, '') AS notices, CAST(coalesce(h.n, 0) AS BIGINT) AS notice_lines
        FROM (SELECT doc_id, {digest("text")} AS digest FROM documents) d
        LEFT JOIN texts t USING (digest) LEFT JOIN hits h ON h.doc_id = d.doc_id
    """
