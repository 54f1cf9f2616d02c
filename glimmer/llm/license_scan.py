"""License scan: canonical digests of entire texts, joined with those of known licenses.

A canonical form drops copyright lines, lowers case, writes equivalent spellings
one way and leaves words separated by one space; its SHA-256 names the text. The
table of known texts is canonicalised and digested by the same expressions, so it
is extended by adding rows; long texts are known by their digests alone. Notices (a line that as a whole is a known one) are
found by the same digests, line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Lines that name a holder and not a term: dropped before the comparison. A line that goes on after "copyright" in words is a term.
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*(copyright\s+(\(c\)|©|\[|<|\d{4}|by )|\(c\)\s*(\d{4}|copyright)|©|all rights reserved)[^\n]*$"
#: Equivalent spellings, after lower case and punctuation; applied in this order to whole words.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("organisation", "organization"), ("authorised", "authorized"), ("recognised", "recognized"),
    ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"),
]
#: Most rows that a table of known texts may have: its digests are broadcast and its names are part of the plan.
MOST_KNOWN = 10_000
# Public license wording, which has to be verbatim to be found.
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Public license texts and notices, by SPDX identifier.
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]
#: Canonical digests of the entire texts that common operating systems ship, by SPDX identifier (fixed values; the tests compute them from such files).
KNOWN_DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


def canonical(text: Column) -> Column:
    """Words of ``text`` in lower case, equivalent spellings one way, copyright lines left out."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " ")
    # two blanks between words: each has its own on both sides, so a spelling is found next to itself
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        wide = [" " + x.replace(" ", "  ") + " " for x in (a, b)]
        c = F.replace(c, *map(F.lit, wide))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def known_digests(spark) -> DataFrame:
    """``digest, license`` of KNOWN and KNOWN_DIGESTS; a digest has one license."""
    d = spark.createDataFrame(KNOWN, "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    d = d.union(spark.createDataFrame([(x, name) for name, x in KNOWN_DIGESTS], "digest string, license string"))
    return d.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, digest, license, notices`` of every row; ``license`` is null unless the entire text is a known one.

    ``notices`` has the sorted licenses of whole lines. Null, empty or copyright-only
    text has the digest of the empty string, which no license has. Repeated rows
    stay. ``known (digest, license)`` may have MOST_KNOWN rows, else it is refused.
    """
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).dropDuplicates(["digest"])
    rows = known.select("digest", "license").limit(MOST_KNOWN + 1).collect()
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    names = F.create_map(*(F.lit(x) for r in rows for x in r)) if rows else F.create_map().cast("map<string,string>")
    known = docs.sparkSession.createDataFrame([tuple(r) for r in rows], "digest string, license string")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.lower(x).rlike("licen[cs]ed?"))
    d = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.transform(lines, lambda x: F.sha2(canonical(x), 256)).alias("lines"))
    d = d.join(F.broadcast(known), "digest", "left")
    notices = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull())))
    return d.select("doc_id", "digest", "license", notices.alias("notices"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"), known_digests(spark))
    return d.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    """The same over lists of words: one word is looked up, two are seen by their neighbour."""
    quoted = COPYRIGHT_LINE.replace("'", "''")
    words = f"string_split(trim(regexp_replace(lower(regexp_replace(coalesce({text}, ''), '{quoted}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    single = " ".join(f"when '{a}' then '{b}'" for a, b in SPELLINGS if " " not in a)
    double = [(a.split(" "), b.split(" ")) for a, b in SPELLINGS if " " in a]
    new = f"case x {single} else x end"
    for (a1, a2), b in double:
        new = f"case when x = '{a1}' and w[i + 1] = '{a2}' then '{b[0]}' when x = '{a2}' and w[i - 1] = '{a1}' then '{b[1] if len(b) > 1 else ''}' else {new} end"
    return f"sha256((select array_to_string(list_filter(list_transform(w, lambda x, i: {new}), lambda x: x <> ''), ' ') from (select {words} as w)))"


_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in KNOWN)
_DIGESTS = ", ".join(f"('{x}', '{name}')" for name, x in KNOWN_DIGESTS)
SQL = f"""
with known as (select digest, min(license) as license from (select {_sql_canonical("text")} as digest, license from (values {_ROWS}) v(license, text) union all select * from (values {_DIGESTS})) where digest <> sha256('') group by 1),
 line as (select doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(lower(x), 'licen[cs]ed?'))) as x from documents),
 notice as (select doc_id, string_agg(distinct license, ',' order by license) as notices from line join known on {_sql_canonical("x")} = digest group by doc_id)
select d.doc_id, {_sql_canonical("d.text")} as digest, k.license, coalesce(n.notices, '') as notices
from documents d left join known k on {_sql_canonical("d.text")} = k.digest left join notice n on n.doc_id = d.doc_id
"""
QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE_SQL = {"op8_license_scan": SQL}
