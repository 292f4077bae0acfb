"""License scans: canonical digest lookup of entire texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same, (variant, canonical), applied in this order to lower-cased words.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("https", "http")]

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

# Public license texts and notices, (id, text). Copyright lines are left out, as the scan leaves them out.
KNOWN = [
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
]


# Digests of the canonical form of whole license files, (id, SHA-256).
KNOWN_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "bc076abbbd0a733d8d1bccb29fc922703ada79172d50fb1903ceeb6a518ec502"),
    ("Artistic-1.0-Perl", "c9bcba9e70d36ab628a0944e717aa88f7b65f5755a9f3061c584801892429806"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "093bb37bff6533bc1f91f57d671e3e2cc9e4e27afc1293808fddc861a6d15329"),
    ("LGPL-2.0", "f9b00d7dd889292d1d69f78a22d72302ac61a82dde1446b16cbbe572b21eed72"),
    ("LGPL-2.1", "cede37d9e3798d7723623960a5fed8377eb7f2b8275723c4d484d1aa3a940c1c"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]


def canonical(text: Column) -> Column:
    """Lower case, no lines that are a copyright notice, words only, one blank between, canonical spellings.

    A line is a copyright notice if it begins, after signs and blanks, with "copyright" or "(c)" and a year
    or a name follows on it, or if it says "all rights reserved" and nothing else. "Copyright" before nothing, or before "notice", "holder" or "owner", is a
    wrapped line of the text and stays. Null gives the empty text.
    """
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", " ")
    x = F.regexp_replace(x, r"(?m)^[^\p{L}\p{N}\n(©]*(copyright(?![^\p{L}\p{N}\n]*(?:$|(?:notices?|holders?|owners?)(?![\p{L}\p{N}])))|\(c\)|©)[^\n]*$", " ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for variant, same in SPELLINGS:
        x = F.replace(x, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {same} "))
    return F.trim(F.regexp_replace(x, " +", " "))


def digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, files: list[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """digest, license of the known texts and files; of texts that are the same once canonical, the first id stays."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(known)], "at int, license string, text string")
    rows = rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license", "at")
    rows = rows.unionByName(spark.createDataFrame([(d, k, len(known) + i) for i, (k, d) in enumerate(files)], "digest string, license string, at int"))
    return rows.groupBy("digest").agg(F.min_by("license", "at").alias("license"))


def scan(docs: DataFrame, known: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """docs (any columns) -> doc_id, digest, license; one row for each input row, license null if unknown.

    A text matches only as a whole. Empty and null texts have the digest of the empty text and no
    license. The known digests are broadcast if there are at most ``broadcast_rows`` of them, about
    100 bytes each; a larger table is joined by a shuffle of digests alone.
    """
    own = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    known = known.filter(F.col("digest") != F.sha2(F.lit(""), 256)).select("digest", "license")
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    return own.join(F.broadcast(known) if small else known, "digest", "left").select("doc_id", "digest", "license")
