"""Licence scan by canonical digest, in DataFrame functions alone.

A text is brought into canonical form: A-Z as a-z; equivalent spellings become one; what opens a licence's
text (``OPENERS``) begins a line; lines that state a copyright (with a sign or a year) go; all runs of ASCII characters other than letters and
digits become one space, at the ends none. The SHA-256 of the whole form is looked up among those of
known licences in a hash join. The table of known digests is a constant of this module (digests of the long ones as
their stewards publish them, short ones and usual notices as texts) unless
another one is given; Spark broadcasts it only below its own threshold of size.

Null texts count as empty; what is empty in canonical form is no licence (null). Rows are kept as they
are, repeated ones too. A text that equals several known ones gets the smallest name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: characters that mean the same, and spellings that mean the same
CHARACTERS = ("“”‘’«»‐‑–— ", '""\'\'""---- ')
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"),
    ("colour", "color"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("cancelled", "canceled"), ("fulfil ", "fulfill "), ("noncommercial", "non-commercial"),
    ("sub-license", "sublicense"), ("sub license", "sublicense"), ("per cent", "percent"), ("merchantibility", "merchantability"), ("&", "and"), ("https://", "http://"), ("©", "(c)"),
]
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(all rights reserved\.?[ \t]*|(copyright[ \t:]*(\(c\)|[0-9]{4})|\(c\)[ \t]*(copyright|[0-9]{4}))[^\n]*)"
OPENERS = r"[ \t]+((the )?(mit|isc|zlib|bsd [23]-clause) license|permission (is hereby granted|to use, copy)|redistribution and use in|this software is provided|this program is free software|(this work is )?(licensed|released|dedicated) (under|to) the|licensed under)"
OTHER = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.{} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
# fixed values: known licences and usual notices by name
KNOWN = [
    ("MIT", _MIT), ("MIT", f"MIT License {_MIT}"), ("MIT", f"The MIT License (MIT) {_MIT}"), ("MIT", "Released under the MIT License."),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("ISC", "ISC License " + _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")), ("0BSD", _ISC.format("")),
    ("BSD-2-Clause", _BSD.format("")), ("BSD-2-Clause", "BSD 2-Clause License " + _BSD.format("")),
    *(("BSD-3-Clause", head + _BSD.format(" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")) for head in ("", "BSD 3-Clause License ")),
    ("Zlib", _ZLIB), ("Zlib", f"zlib License {_ZLIB}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
]

# fixed values: SHA-256 of the canonical forms of whole licence texts, as their stewards publish them
DIGESTS = {
    "Apache-2.0": "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "3842a16357f0cdd1e23bb92ec7360a85dcebc4d690aa011625db0b4c951608b1",
    "GFDL-1.3": "af67fd0f1a174a4bcb2f40070ab1d7b5e3519fd4e36fa89113923de9a4638f52",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-3.0": "3c39b58d51baf32b2a21a55c429305f51cfd82e53cad05134293933580b4cd84",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = F.translate(F.coalesce(text, F.lit("")), upper + CHARACTERS[0], upper.lower() + CHARACTERS[1])
    out = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, out)
    out = F.regexp_replace(F.regexp_replace(out, OPENERS, "\n$1"), COPYRIGHT_LINE, "\n")
    return F.trim(F.regexp_replace(out, OTHER, " "))


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = f"translate(coalesce({text}, ''), {quoted(upper + CHARACTERS[0])}, {quoted(upper.lower() + CHARACTERS[1])})"
    for a, b in SPELLINGS:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    out = f"regexp_replace({out}, {quoted(OPENERS)}, chr(10) || '\\1', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, {quoted(COPYRIGHT_LINE)}, chr(10), 'g'), {quoted(OTHER)}, ' ', 'g'))"


def known_digests(known: DataFrame) -> DataFrame:
    """(canonical_sha256, license_id) of a table (license_id, text), one row for each digest."""
    form = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license_id) for each row of ``docs`` (doc_id, text)."""
    if known is None:
        known = docs.sparkSession.createDataFrame(KNOWN, "license_id string, text string")
        fixed = docs.sparkSession.createDataFrame([(d, i) for i, d in DIGESTS.items()], "canonical_sha256 string, license_id string")
        table = known_digests(known).union(fixed).groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    else:
        table = known_digests(known)
    digests = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return digests.join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")
