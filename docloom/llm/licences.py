"""Licence scans: canonical digests of entire texts, looked up among known licences.

Case, punctuation, copyright lines and equivalent spellings are normalised away;
the SHA-256 of what is left is joined to the digests of known licences. All of
it is DataFrame functions in one pass over the texts, without a shuffle: the
table of licences is the small side, sent to all tasks only after a count has
proved it small.

Defined cases: a null text has a null digest and no licence; a text with nothing
left after normalising (empty, or punctuation alone) has the digest of nothing
and no licence; licences that normalise alike give the smallest id; repeated
rows each get their answer; an empty table gives no rows; other columns pass
through, and where one is named like an output column the output wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_side

#: Spellings that are the same word in licence texts.
EQUIVALENT_SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("customise", "customize"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

#: A line that begins with a copyright statement.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright[ \t]*(\(c\)|\x{A9}|[0-9]{4}|by )|(\(c\)|\x{A9})[ \t]*[0-9]{4}|all rights reserved)[^\n]*"
#: Signs that do not count: all ASCII but letters and digits, Latin-1 signs, and general punctuation.
PUNCTUATION = r"[\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{BF}\x{2000}-\x{206F}]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Texts of common licences and notices. Callers may bring a table of their own.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


def canonical(text: Column) -> Column:
    """The text without case, copyright lines, punctuation and variant spellings; one space between words."""
    out = F.translate(text, _UPPER, _LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    for old, new in EQUIVALENT_SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical_sql(text: str) -> str:
    """The same as an SQL expression."""
    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'), ' ')"
    for old, new in EQUIVALENT_SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def known_licences(spark) -> DataFrame:
    return spark.createDataFrame(KNOWN, "licence_id string, licence_text string")


def scan(docs: DataFrame, licences: DataFrame | None = None, *, text: str = "text", licence_id: str = "licence_id", licence_text: str = "licence_text", max_broadcast: int | None = None) -> DataFrame:
    """The documents with ``digest`` and ``licence_id`` (null if the whole text is no known licence)."""
    if licences is None:
        licences = known_licences(docs.sparkSession)
    known = licences.select(F.col(licence_id).alias("licence_id"), canonical(F.col(licence_text)).alias("_plain")).where("_plain <> ''")
    known = known.groupBy(F.sha2("_plain", 256).alias("_known")).agg(F.min("licence_id").alias("licence_id"))
    found = docs.drop("digest", "licence_id").withColumn("digest", F.sha2(canonical(F.col(text).cast("string")), 256))
    return found.join(small_side(known, max_broadcast), found["digest"] == F.col("_known"), "left").drop("_known")
