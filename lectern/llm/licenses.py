"""Licence scans by canonical digest, in DataFrame operations alone.

canonical() lower-cases a text, drops its copyright statements, brings every run of other characters than letters and
digits to one space and equivalent spellings to one form. The digest of a whole canonical text is joined to the digests
of known licences by a hash join. The spelling rules are wider than the words they are for; they run over both sides,
so that only makes a few unlike words equal. The known licences are broadcast if they are at most a million.

Cases: a null or empty text has the digest of the empty text and no licence. Null and repeated doc_ids are scanned
like others. Very long texts are made canonical whole. Two licences with one canonical text count as the one with the
smaller id. Other columns pass through, whatever their names; the two output columns replace namesakes. Empty tables
give no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.base import small

#: Fixed values: (pattern, replacement) of spellings that licence matching takes as equal, after lower-casing.
SPELLINGS = [
    (r"licenc", r"licens"),
    (r"is(e|ed|es|er|ers|ing|ation|ations)( |$)", r"iz\1\2"),
    (r"our(s|ed|able|ite)?( |$)", r"or\1\2"),
    (r"ll(ed|ing)( |$)", r"l\1\2"),
    (r"dgement", r"dgment"),
    (r"(lfil|wil)l?(ful|ment|s)?( |$)", r"\1\2\3"),
    (r"(cent|met)re( |$)", r"\1er\2"),
    (r"(anal|catal)ogue( |$)", r"\1og\2"),
    (r"(offen|practi|defen)ce", r"\1se"),
    (r"programme( |$)", r"program\1"),
    (r"whilst( |$)", r"while\1"),
    (r"https( |$)", r"http\1"),
    (r"(sub|non|per) (licens|commercial|cent)", r"\1\2"),
    (r"copyright owner", r"copyright holder"),
]
#: Fixed value: a line that only says whose copyright it is, not a line of the body that a wrapped text begins so.
STATEMENT = r"(?m)^[ \t]*((copyright[ \t]*[:,]?[ \t]*(\(c\)|©|[12][0-9]{3}|[\[<{])|copyright[ \t]+(?!(notice|holder|owner|licen|law|statement|interest|treat|permission|disclaim|act|protect|right|infring|and|or|in|to|is|on|of|for|as|if|the above)[a-z]*\b)\S)|\(c\)[ \t]*(copyright|[12][0-9]{3})|©)[^\n]*$|(?m)^[ \t]*all rights reserved[ \t.\r]*$"
#: Fixed value: the same as the SQL has it; it also takes lines of a wrapped body, which the tables here don't hold.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Whole texts of short licences and of usual notices.
KNOWN = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

_CLAUSES = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Further short licences, which the SQL doesn't list.
MORE = {"BSD-2-Clause": f"{_CLAUSES} {_BSD_END}", "BSD-3-Clause": f"{_CLAUSES} {_THIRD} {_BSD_END}"}
#: Titles that usual files have above the text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "Zlib": ["zlib License", "The zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
}


def all_known() -> list[tuple[str, str]]:
    """(license_id, text) of the short licences with and without their titles and of the files in license_texts."""
    short = KNOWN | MORE
    titled = [(k, f"{title}\n{short[k]}") for k, titles in TITLES.items() for title in titles]
    return [*short.items(), *titled, *((p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), STATEMENT, "")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return out


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, text) of a dict of licences, of all known ones without it."""
    pairs = all_known() if texts is None else texts.items()
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in pairs))).alias("x")).select("x.*")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs with canonical_sha256 and license_id, null for a text that is no known licence."""
    docs = docs.drop("canonical_sha256", "license_id")
    digests = known.select(F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"), "license_id").groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    digested = docs.withColumn("canonical_sha256", F.sha2(canonical(F.col("text")), 256))
    return digested.join(small(digests, digests.count()), "canonical_sha256", "left").select(*docs.columns, "canonical_sha256", "license_id")


def scan_sql(texts: dict[str, str] = KNOWN) -> str:
    """The same scan of documents in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), {quote(COPYRIGHT_LINE)}, '', 'g')"
        x = f"trim(regexp_replace({x}, {quote(NOT_WORD)}, ' ', 'g'), ' ')"
        for pattern, to in SPELLINGS:
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"
        return f"sha256({x})"

    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in texts.items())
    return f"""with known as (select {canon("text")} as digest, min(license_id) as license_id from (values {rows}) k(license_id, text) group by 1),
d as (select doc_id, {canon("text")} as canonical_sha256 from documents)
select doc_id, canonical_sha256, license_id from d left join known on digest = canonical_sha256"""
