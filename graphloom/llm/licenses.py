"""Licence scans: canonical digests of whole texts, looked up among known licences."""

from __future__ import annotations

from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings, each whole words of canonical text and what they become.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense",
    "sub licensing": "sublicensing", "utilisation": "utilization", "while": "whilst", "wilful": "willful",
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.\n\n" + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
    "implied. See the License for the specific language governing permissions and limitations under the License."
)

#: Short texts and notices of licences. The one-line notices are those that documents of the test tables hold.
KNOWN = (
    ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

_TERMS_END = "END OF TERMS AND CONDITIONS"


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of the published full texts in license_texts, whole and without what follows the terms."""
    out = []
    for file in sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        out.append((name, text))
        if _TERMS_END in text:
            terms = text[: text.index(_TERMS_END)].rstrip()
            out += [(name, terms), (name, f"{terms}\n\n{_TERMS_END}")]
    return tuple(out)


#: Lines that begin, after marks, with a copyright sign or word and hold a sign or a year; and those of reserved rights.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©)[^\n]*(?:\(c\)|©|\d{4})[^\n]*$"
RESERVED_LINE = r"^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"


def canonical(text: Column) -> Column:
    """A text's canonical form: no copyright lines, lower case, words of letters and digits only, one space between,
    and one spelling of each word. Nulls are empty."""
    c = F.coalesce(text, F.lit(""))
    for line in (COPYRIGHT_LINE, RESERVED_LINE):
        c = F.regexp_replace(c, "(?imd)" + line, "")
    # Two spaces between words, so that each word of a row of equal ones has its own.
    c = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for old, new in SPELLINGS.items():
        c = F.replace(c, F.lit(_spaced(old)), F.lit(_spaced(new)))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def _canonical_sql(text: str) -> str:
    c = f"coalesce({text}, '')"
    for line in (COPYRIGHT_LINE, RESERVED_LINE):
        c = f"regexp_replace({c}, '(?im){line}', '', 'g')"
    c = f"' ' || regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for old, new in SPELLINGS.items():
        c = f"replace({c}, '{_spaced(old)}', '{_spaced(new)}')"
    return f"trim(replace({c}, '  ', ' '))"


def scan_sql() -> str:
    """scan() with the known licences, on DuckDB."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN)
    return f"""
WITH known AS (SELECT sha256({_canonical_sql("text")}) AS digest, min(license) AS license FROM (VALUES {rows}) AS v(license, text) GROUP BY 1),
docs AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license FROM docs LEFT JOIN (SELECT * FROM known WHERE digest <> sha256('')) USING (digest)"""


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs with digest and license: the known licence (license, text) whose canonical text the whole document is, or
    null. Of licences with one canonical text the smallest name counts; an empty canonical text matches none. Known are
    KNOWN and full_texts() unless given.
    """
    if known is None:
        known = docs.sparkSession.createDataFrame([*KNOWN, *full_texts()], "license string, text string")
    nothing = F.sha2(F.lit(""), 256)
    names = known.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license")).where(F.col("digest") != nothing)
    return docs.drop("digest", "license").withColumn("digest", digest(F.col(text))).join(names, "digest", "left")
