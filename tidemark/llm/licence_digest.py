"""License scans (operator 8): canonical digest lookup.

A text is made canonical: lower case, copyright lines out (behind comment marks too), every run of other characters
than letters and digits one space, equivalent spellings unified.  The SHA-256 of the whole
canonical text is hash-joined to the digests of known licences and notices, so any
wrapping, punctuation or spelling of the same words matches, and nothing else does.  Single
lines are looked up the same way, for notices inside longer texts.

Null text: no licence, no notice.  Texts and lines without a word never match.  Texts that share a digest are
one text, so nothing ties.  Texts are read whole, whatever their length.  Only the named columns
are read, so others may have any name.  Repeated rows give equal rows; an empty table gives an
empty result."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.licence_texts import TEXTS

# Public licence texts and notices (identifier, text).
KNOWN: list[tuple[str, str]] = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

# Spellings that mean the same, in canonical form (lower case, single spaces).
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"),
    ("non infringement", "noninfringement"), ("noncommercial", "non commercial"), ("https", "http"), ("wilful", "willful"),
]

# How the list items (c) of the known texts go on; other lines that start with (c) name a holder.
ITEMS = ["the licenses", "representations", "you must", "under patent"]


def _unlike(starts: list[str]) -> str:
    """A pattern (without lookahead, for RE2) of a text that starts like none of these."""
    rest: dict[str, list[str]] = {}
    for x in starts:
        rest.setdefault(x[0], []).append(x[1:])
    longer = [f"{head}{_unlike(tails)}" for head, tails in rest.items() if all(tails)]
    return "(?:" + "|".join([f"[^{''.join(rest)}\\n]", *longer]) + ")"


_HOLDER = r"\(c\)(?:[^\n]*[0-9]{4}|[ \t]*[^ \t\n" + "".join(sorted({x[0] for x in ITEMS})) + "]|[ \\t]*(?:" + "|".join(
    x[0] + _unlike([y[1:] for y in ITEMS if y[0] == x[0]]) for x in ITEMS) + "))"
#: Comment marks may stand before a copyright line.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9]|<|\[|by )|" + _HOLDER + r"|©|all rights reserved)[^\n]*$"

# Title lines of the short texts above.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD"),
}
#: Titles of several licences: no notice of one.
_SHARED = ("BSD License", 'The "Artistic License"')
#: The terms end here; copies often leave out the advice that follows.
_END = "END OF TERMS AND CONDITIONS"


def _forms() -> list[tuple[str, str]]:
    """The full texts as they are dealt: with each title and without, with and without the advice
    after the terms, short lists with numbers and with bullets; then titles and SPDX tags."""
    texts = [(name, TITLES[name], text) for name, text in KNOWN if "\n" in text and name in TITLES] + TEXTS
    texts += [(name, titles, text.replace("and/or distribute", "and distribute")) for name, titles, text in texts if name == "ISC"]
    out = []
    for name, titles, text in texts:
        bodies = [text]
        if _END in text:
            terms = text[:text.index(_END)]
            bodies += [terms + _END, terms] if name == "Apache-2.0" else [terms + _END]
        if name.startswith("BSD-"):
            bodies.append(re.sub(r"(?m)^[1-4]\. ", "* ", text))
        out += [(name, f"{title}\n\n{body}") for body in bodies for title in ("", *titles)]
        out += [(name, title) for title in titles if "license" in title.lower() and title not in _SHARED]
    for name in sorted({name for name, _ in KNOWN + out}):
        ends = ("", "+", "-only", "-or-later") if name.startswith(("GPL", "LGPL", "GFDL")) else ("",)
        out += [(name, f"SPDX-License-Identifier: {name}{end}") for end in ends]
    return list(dict.fromkeys(out))


KNOWN += _forms()


def _kept(part: str) -> bool:
    """Whether a text without `part` cannot get it from SPELLINGS: where a part overlaps what a
    spelling puts in, the text had the same letters there."""
    for variant, usual in SPELLINGS:
        for at in range(1 - len(part), len(usual)):
            cut = usual[max(at, 0):at + len(part)]
            if part[max(-at, 0):][:len(cut)] == cut and not (
                    cut in variant if at >= 0 and len(cut) == len(part) else
                    variant.startswith(cut) if at < 0 and len(cut) < len(usual) else
                    variant.endswith(cut) if at >= 0 else False):
                return False
    return True


def triggers(known: list[tuple[str, str]]) -> list[str]:
    """Parts of words such that every line equal to a known notice of one line holds one of them,
    so other lines need no digest.  The longest part in most notices first; a notice
    without such a part gives the empty one, which every line holds."""
    left = {x for x in (_plain(text) for _, text in known if "\n" not in text) if x}
    out: list[str] = []
    while left:
        count: dict[str, int] = {}
        for text in left:
            parts = {w[i:j] for w in text.split(" ") for i in range(len(w)) for j in range(i + 3, len(w) + 1)}
            for part in parts:
                count[part] = count.get(part, 0) + 1
        part = next((x for x in sorted(count, key=lambda x: (-count[x], -len(x), x)) if _kept(x)), "")
        out.append(part)
        left = {x for x in left if part not in x}
    return out


def _plain(text: str) -> str:
    """`canonical` of a known notice in Python."""
    out = re.sub(r"[\W_]+", " ", re.sub(_COPYRIGHT.replace(r"\p{L}\p{N}", r"\w"), "", text.lower())).strip()
    for variant, usual in SPELLINGS:
        out = out.replace(variant, usual)
    return out


#: What the twin filters lines by: the one trigger of KNOWN.
_NOTICE, = triggers(KNOWN)


def canonical(text: Column) -> Column:
    out = F.lower(text)
    out = F.when(out.rlike(r"copyright|©|\(c\)|all rights reserved"), F.regexp_replace(out, _COPYRIGHT, "")).otherwise(out)
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for variant, usual in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(usual))
    return out


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, licence) of the known texts; one licence per digest."""
    rows = spark.createDataFrame(known, "licence string, text string")
    return (rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence")
            .groupBy("digest").agg(F.min("licence").alias("licence")))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, notices, n_notice_lines): the licence that the whole text is, the
    sorted licences whose notice is a line of it, and how many such lines it has."""
    spark = docs.sparkSession
    digests = known_digests(spark, known)
    pairs = digests.collect()  # the fixed list above
    digests = spark.createDataFrame(pairs, digests.schema)
    found_by = triggers(known)
    lookup = F.create_map(*[F.lit(x) for r in pairs for x in (r["digest"], r["licence"])])
    line = F.transform(F.filter(F.split("text", "\n"), lambda x: reduce(or_, [F.lower(x).contains(part) for part in found_by], F.lit(False))),
                       lambda x: F.element_at(lookup, F.sha2(canonical(x), 256)))
    units = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"),
        F.filter(line, lambda x: x.isNotNull()).alias("found"))
    # the known digests are a fixed list, so the broadcast is bounded
    return (units.join(F.broadcast(digests), "digest", "left")
            .select("doc_id", "licence", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
                    F.size("found").cast("bigint").alias("n_notice_lines")))


def op8_licence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({text}), '{_COPYRIGHT}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for variant, usual in SPELLINGS:
        out = f"replace({out}, '{variant}', '{usual}')"
    return out


def _sql_known() -> str:
    return ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)


ORACLE_SQL = f"""
WITH k AS (SELECT sha256({_sql_canonical('v.text')}) AS digest, min(v.licence) AS licence
           FROM (VALUES {_sql_known()}) AS v(licence, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT d.r, d.doc_id, k.licence FROM d LEFT JOIN k ON sha256({_sql_canonical('d.text')}) = k.digest),
l AS (SELECT r, unnest(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'licen'))) AS line FROM d),
f AS (SELECT l.r, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices, count(*) AS n
      FROM l JOIN k ON sha256({_sql_canonical('l.line')}) = k.digest GROUP BY l.r)
SELECT w.doc_id, w.licence, coalesce(f.notices, '') AS notices, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notice_lines
FROM w LEFT JOIN f USING (r)
"""

QUERIES = {"op8_licence_digest": op8_licence_digest}
ORACLE = {"op8_licence_digest": ORACLE_SQL}
