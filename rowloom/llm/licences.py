"""Licence scan by canonical digests.

A text is made canonical - lower case, copyright lines away, equivalent spellings made one, runs of
punctuation and space one space - and its SHA-256 looked up among those of known licences, made
canonical the same way. Whole texts are looked up, of a document and of each of its
lines, by a hash join; parts of lines are not.

Only DataFrame functions are used. A unit whose text, lower-cased and without copyright lines, has more letters and digits than
twice the longest known one has characters cannot match, as no spelling halves a text, and is not digested; blanks
and line ends do not count.

Defined results: null, empty and purely copyright units match nothing; several known
licences with one canonical text all match; repeated rows give a finding each, rows with a null id too; very long texts
are units like any other, and so are all their lines; an empty table or an empty
list of licences finds nothing; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.session import materialize

# Words that count as equal (variant, canonical form), whole words of lower-case text.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("centre", "center"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("licences", "licenses"), ("licenced", "licensed"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("practise", "practice"), ("programme", "program"),
    ("recognise", "recognize"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("https", "http"), ("v", "version"),
)

# Known licences and notices (id, text).
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_TAIL = (
    '\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software.\n" + _WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("0BSD", _ISC_GRANT + "." + _ISC_TAIL),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
     "License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or "
     'agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
     "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

COPYRIGHT = r"(?m)^[^\n\p{L}\p{N}]*(?:copyright\b[^\n]*(?:\d{4}|\(c\)|©)|\(c\)|©|all rights reserved)[^\n]*$"


def skeleton(text: Column) -> Column:
    """Lower case, copyright lines away, one space for each run of punctuation and space; line ends stay."""
    low = F.lower(text)
    marks = [F.contains(low, F.lit(mark)) for mark in ("copyright", "(c)", "©", "all rights reserved")]
    bare = F.when(reduce(lambda a, b: a | b, marks), F.regexp_replace(low, COPYRIGHT, "")).otherwise(low)
    return F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " ")


def spelled(bones: Column) -> Column:
    """The canonical text of a skeleton or of a line of it."""
    whole = F.concat(F.lit(" "), F.btrim(F.regexp_replace(bones, "[ \n]+", " ")), F.lit(" "))
    return F.btrim(reduce(lambda text, pair: F.replace(text, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUIVALENT, whole))


def known_licences(spark: SparkSession) -> DataFrame:
    """The licences of KNOWN (licence, text)."""
    return spark.createDataFrame(list(KNOWN), "licence string, text string")


def _head(text: Column) -> Column:
    return F.regexp_extract(text, "^[ \n]*([^ \n]+)", 1)


def digests(licences: DataFrame) -> DataFrame:
    """(licence, digest, length, head) of each known text that is not empty; head is its first word."""
    made = licences.withColumn("_text", spelled(skeleton(F.col("text")))).filter("_text <> ''")
    return made.select("licence", F.sha2("_text", 256).alias("digest"), F.length("_text").alias("length"), _head(F.col("_text")).alias("head")).distinct()


def _heads(known: DataFrame) -> DataFrame:
    """Every word that a text may begin with before the spellings if its canonical text is a known one."""
    before: dict[str, set[str]] = {}
    for variant, canonical in EQUIVALENT:
        before.setdefault(canonical.split(" ")[0], set()).add(variant.split(" ")[0])
    for words in before.values():
        for word in list(words):
            words |= before.get(word, set())
    pairs = [(word, other) for word, words in before.items() for other in sorted(words)]
    heads = known.select("head").distinct()
    changed = known.sparkSession.createDataFrame(pairs, "head string, before string")
    return heads.unionByName(heads.join(changed, "head").select(F.col("before").alias("head"))).distinct()


def scan(docs: DataFrame, licences: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, licence) for each unit that is a known licence; line 0 is the whole text, lines count from 1.

    Of the units only those with a first word that can lead to a known text are spelled and digested.
    """
    # written tables, so that Spark knows their size and sends them to the tasks if they are small
    known = materialize(digests(licences), "licences")
    heads = materialize(_heads(known), "heads")
    longest = known.agg(F.max("length")).first()[0] or 0
    rows = docs.select(F.col(doc_id).alias("doc_id"), skeleton(F.col(text)).alias("bones")).filter(F.col(text).isNotNull())
    # a text of one line is a unit once, as the whole text
    parts = F.split("bones", "\n", -1)
    units = F.concat(F.array("bones"), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")))
    units = rows.select("doc_id", F.posexplode(units).alias("line", "unit"))
    # most units are short enough with their blanks
    least = F.length(F.replace(F.replace("unit", F.lit("\n"), F.lit("")), F.lit(" "), F.lit("")))
    units = units.filter((F.length("unit") <= 2 * longest + 2) | (least <= 2 * longest + 2))
    likely = units.withColumn("head", _head(F.col("unit"))).join(heads, "head", "left_semi")
    found = likely.select("doc_id", "line", F.sha2(spelled(F.col("unit")), 256).alias("digest"))
    return found.join(known.select("digest", "licence").distinct(), "digest").select("doc_id", "line", "licence")
