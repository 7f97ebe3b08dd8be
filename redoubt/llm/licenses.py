"""License scans by canonical digests, in DataFrame functions alone.

A text is brought to a canonical form: copyright lines go, letters become
lower case, punctuation and white space become single spaces, and equivalent
spellings become one.  The digest of the whole form is joined with the digests
of known licence texts.  The unit is an entire text: the whole document, and
each of its lines as a notice of its own.  The known texts are a fixed table of
this module, so their broadcast is bounded by it; of long licences it holds the
digests alone, of the text with and without what follows its terms.  A text
inside a longer document isn't found unless it fills a line.

Definitions: null, empty and blank texts, and those of copyright lines alone,
match nothing; their digest is that of the empty string.  Every row is
returned, repeated ones too; a row without ``doc_id`` is scanned like others.
An empty table gives no rows; columns but ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# ASCII and typographic punctuation, white space, and signs.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F ©«®·»‐-―‘-‟•…™]+"
COPYRIGHT = "^[\\x20\\x09-\\x0D#*/;-]*(copyright|\\(c\\)|©|all rights reserved|portions copyright).*$"

# Equivalent spellings, as parts of words set between spaces.
SPELLINGS = (
    ("licenc", "licens"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("merchantib", "merchantab"),
    ("acknowledgement", "acknowledgment"),
    ("noncommercial", "non commercial"),
    ("sub licens", "sublicens"),
    ("whilst", "while"),
    ("fulfilment", "fulfillment"),
    (" v2 ", " version 2 "),
    (" v3 ", " version 3 "),
    (" 2 0 ", " 2 "),
    (" 3 0 ", " 3 "),
    (" 4 0 ", " 4 "),
)

# Names of licences.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
}
NOTICES = ("{}", "{}.", "Licensed under {}", "Released under {}", "Distributed under {}", "Published under {}", "This work is licensed under {}", "This document is licensed under {}", "This software is licensed under {}", "License: {}", "SPDX-License-Identifier: {}")

_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_APACHE_HEAD = 'Licensed under the Apache License, Version 2.0 (the "License");'
_APACHE_TAIL = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License."
)
_GPL_HEAD = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
_GPL_TAIL = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
    "License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
# Whole licence texts, without their copyright lines.
TEXTS = {
    "MIT": (_MIT_BODY, "MIT License " + _MIT_BODY, "The MIT License (MIT) " + _MIT_BODY),
    "ISC": (
        _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL,
        "ISC License " + _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL,
    ),
    "0BSD": (_PERMIT + ". " + _ISC_TAIL, "BSD Zero Clause License " + _PERMIT + ". " + _ISC_TAIL),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License " + _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License " + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Apache-2.0": (
        _APACHE_HEAD + ' you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 ' + _APACHE_TAIL,
        _APACHE_HEAD + ' you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 ' + _APACHE_TAIL,
    ),
    "GPL-2.0": (_GPL_HEAD + "either version 2 of the License, or (at your option) any later version. " + _GPL_TAIL,),
    "GPL-3.0": (_GPL_HEAD + "either version 3 of the License, or (at your option) any later version. " + _GPL_TAIL,),
    "Unlicense": tuple(
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to " + url
        for url in ("<http://unlicense.org/>", "<https://unlicense.org>")
    ),
    "WTFPL": (
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of this "
        "license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, "
        "DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
}

# Digests of the canonical form of long licences as published: the whole text, then up to the end of its terms.
DIGESTS = {
    "Apache-2.0": (
        "b1d9baf1bad9b73cf999061315032cd81b35fbf2b8e380e4e0c8983be8263533",
        "383108d907616895332d8117617a0f6912e2d7006251811eb3470d0bdbc31391",
    ),
    "GPL-2.0": (
        "c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88",
        "ae49934a47b15ec36e1ce1eb7504b3439c29f0e9be2ed0f60ba20ad7124dcb7c",
    ),
    "GPL-3.0": (
        "82a113fc7afa95809e9d3b96de43f2d9c307a530b781a44dd19a399aabf77458",
        "7e55e548100cc647b64f88d3fef1162c23f810cb9cb4a910e56b35b6cb66e93a",
    ),
    "LGPL-2.0": (
        "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3",
        "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c",
    ),
    "LGPL-2.1": (
        "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345",
        "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c",
    ),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-2.0": ("958b598816b4badbdbe9b534c43402800a21e71d4a3fe22489dbdfde519612fc",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "Artistic-1.0-Perl": ("66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39",),
    "GFDL-1.2": ("2686528d2dbd9b442c26ed5f2501e03b750a331a765132de14a090e46b952a41",),
    "GFDL-1.3": ("8fede8045e46825c33472f7fc1f581242d48dbd00cdcb8ff5fb79b62253853e7",),
}


def known_texts() -> list[tuple[str, str]]:
    """``(licence, text)``: whole texts, and notices by rule from names and forms."""
    out = [(k, t) for k, texts in TEXTS.items() for t in texts]
    for key, names in NAMES.items():
        for name, form in product((key, *names), NOTICES):
            out += [(key, form.format(article + name)) for article in ("", "the ")]
    return out


def canonical_line(line: Column) -> Column:
    text = F.lower(line)
    text = F.when(text.rlike(COPYRIGHT), "").otherwise(F.concat(F.lit(" "), F.regexp_replace(text, NOT_WORD, " "), F.lit(" ")))
    text = F.regexp_replace(text, "  +", " ")
    return F.trim(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), SPELLINGS, text))


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line), lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """``(digest, license, starts)``, one row a digest; a form that names two licences names the lesser.  ``starts`` is
    the first two words of the canonical form, null where only the digest is known."""
    quoted = ", ".join("('%s', '%s')" % (k, t.replace("\\", "\\\\").replace("'", "\\'")) for k, t in known_texts())
    canonical = F.array_join(canonical_lines(F.col("text")), " ")
    spelled = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(license, text)").select("license", canonical.alias("c"))
    spelled = spelled.select("license", digest(F.col("c")).alias("digest"), F.substring_index("c", " ", 2).alias("starts"))
    digests = ", ".join(f"('{k}', '{d}', CAST(NULL AS STRING))" for k, ds in DIGESTS.items() for d in ds)
    both = spelled.union(spark.sql(f"SELECT * FROM VALUES {digests} AS t(license, digest, starts)"))
    return both.groupBy("digest").agg(F.min("license").alias("license"), F.min("starts").alias("starts"))


def scan(docs: DataFrame) -> DataFrame:
    """For every row: ``doc_id``, the ``digest`` of its canonical form, the
    ``license`` its whole text is, the number of lines that are licence notices
    and their licences, in code point order, joined by commas.

    The digests of lines never leave their row: lines that begin as a known text
    does are looked up in the same fixed table, as a literal map, so nothing is
    shuffled."""
    known = known_digests(docs.sparkSession)
    table = sorted((r.starts, r.digest, r.license) for r in known.where("starts is not null").collect())  # the fixed table
    of_digest = F.create_map(*[F.lit(x) for _, d, k in table for x in (d, k)])
    begins = "^(?:" + "|".join(sorted({t[0] for t in table})) + ")(?: |$)"  # words of letters and digits
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    whole = lines.select("doc_id", "lines", digest(F.array_join("lines", " ")).alias("digest"))
    found = F.filter(F.transform(F.filter("lines", lambda x: x.rlike(begins)), lambda x: F.try_element_at(of_digest, digest(x))), lambda x: x.isNotNull())
    met = whole.join(F.broadcast(known.select("digest", "license")), "digest", "left").select("doc_id", "digest", "license", found.alias("found"))
    return met.select("doc_id", "digest", "license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def op10_license_digests(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join("('%s', '%s')" % (k, t.replace("'", "''")) for k, t in known_texts())
    digests = ", ".join(f"('{d}', '{k}')" for k, ds in DIGESTS.items() for d in ds)
    not_word, copyright = NOT_WORD.replace("\\x00", "\\x{00}"), COPYRIGHT

    def line(x: str) -> str:
        text = f"CASE WHEN regexp_matches(lower({x}), '{copyright}') THEN '' ELSE ' ' || regexp_replace(lower({x}), '{not_word}', ' ', 'g') || ' ' END"
        text = f"regexp_replace({text}, '  +', ' ', 'g')"
        for a, b in SPELLINGS:
            text = f"replace({text}, '{a}', '{b}')"
        return f"trim({text}, ' ')"

    return f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT sha256({line('text')}) AS digest, license FROM (VALUES {rows}) t(license, text)
    UNION ALL SELECT * FROM (VALUES {digests}) d(digest, license)) GROUP BY digest),
docs AS (
  SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
lines AS (
  SELECT doc_id, row_no, unnest(raw) AS l, generate_subscripts(raw, 1) AS pos FROM docs),
canon AS (
  SELECT doc_id, row_no, pos, {line('l')} AS c FROM lines),
whole AS (
  SELECT doc_id, row_no, sha256(coalesce(string_agg(c, ' ' ORDER BY pos) FILTER (WHERE c <> ''), '')) AS digest FROM canon GROUP BY ALL),
notices AS (
  SELECT row_no, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM canon JOIN known ON sha256(c) = known.digest WHERE c <> '' GROUP BY row_no)
SELECT doc_id, whole.digest, known.license, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (row_no)
"""


SQL = _sql()
